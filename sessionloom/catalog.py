"""Every query of the engine by name, with its DuckDB twin. Arrays are compared as text, weights as whole multiples of 1e-9."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom import oracles as o
from sessionloom.functions.hold import fresh_dir, held, held_parts
from sessionloom.functions.stretches import spread
from sessionloom.operators import boosting, candidates, embeddings, evaluation, features, models, sampling, sessions, voting
from sessionloom.operators.covisitation import SPECS, adjacency, covisitation, merge, prepared
from sessionloom.plans import recommender
from sessionloom.plans import refreshed as refreshed_
from sessionloom.sources import adapters

T_MIN, T_MAX = 1_704_067_200, 1_706_659_200
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
EVENT = "session, aid, ts, type, eid"
WEIGHTS = features.EVENT_WEIGHTS


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def text(array: Column) -> Column:
    return F.array_join(F.transform(array, lambda x: x.cast("string")), " ")


def listed(sql: str) -> str:
    return f"array_to_string({sql}, ' ')"


def users(spark: SparkSession, d: str) -> DataFrame:
    return adapters.user_events(spark, d)


def visits(spark: SparkSession, d: str) -> DataFrame:
    return adapters.visit_events(spark, d)


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return features.unit_vectors(adapters.read_vectors(spark, f"{d}/embeddings.parquet"))


def sessions_held(spark: SparkSession, d: str) -> DataFrame:
    """visits() for queries that use them more than once."""
    return held(adapters.visit_events(spark, d), "visits")


def dealt(events: DataFrame) -> DataFrame:
    """Sessions dealt to tasks by their number of events, as each event makes many pairs: tasks grow in number, not in size."""
    return spread(events, "session")


def matrix(events: DataFrame, name: str, n: int | None = None) -> DataFrame:
    return covisitation(events, SPECS[name], T_MIN, T_MAX, top_n=n)


# Sources

query("normalize_events", f"WITH {o.U} SELECT {EVENT} FROM u")(users)
query("visit_events", f"WITH {o.V} SELECT {EVENT} FROM v")(visits)


@query("flatten_sessions", f"WITH {o.V} SELECT session + 100000000 AS session, aid, ts, CASE type WHEN 0 THEN 'clicks' WHEN 1 THEN 'carts' ELSE 'orders' END AS type, (session + 100000000) // 100000 AS chunk_id FROM v")
def flatten_sessions(spark, d):
    """Events nested, written to and read from JSON text, and flattened with a shift."""
    nested = adapters.nest_sessions(visits(spark, d)).select(F.to_json(F.struct("session", "events")).alias("line"))
    parsed = nested.select(F.from_json("line", adapters.SESSION_JSON).alias("x")).select("x.*")
    return adapters.flatten_sessions(parsed, shift=100_000_000)


@query("order_session_counts", """SELECT o_custkey AS session, count(*) AS n_views, count(*) FILTER (WHERE l_returnflag = 'N') AS n_clicks, count(*) FILTER (WHERE l_returnflag = 'A') AS n_carts,
 count(*) FILTER (WHERE l_returnflag = 'R') AS n_orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey""")
def order_session_counts(spark, d):
    """Counts of order-line sessions, without the cap of 255."""
    n = adapters.order_events(spark, d).groupBy("session")
    return n.agg(F.count("*").alias("n_views"), *[F.count_if(F.col("type") == k).alias(f"n_{c}") for k, c in enumerate(candidates.CLASSES)])


@query("order_popularity_week", """WITH n AS (SELECT l_partkey AS aid, CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS type, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
 SELECT aid, type, n * 10000 / sum(n) OVER (PARTITION BY type) AS popularity_week FROM n""")
def order_popularity_week(spark, d):
    return features.popularity_week(adapters.order_events(spark, d))


# Splits and labels

query("split_train", f"WITH {o.S} SELECT {EVENT} FROM s WHERE first_ts <= split_ts AND ts < split_ts")(lambda s, d: sessions.train_part(visits(s, d)))
query("split_test", f"WITH {o.S} SELECT {EVENT} FROM s WHERE first_ts > split_ts")(lambda s, d: sessions.test_part(visits(s, d)))
query("split_extra", f"WITH {o.S} SELECT {EVENT} FROM s WHERE first_ts < split_ts AND last_ts > split_ts AND ts >= split_ts QUALIFY count(*) OVER (PARTITION BY session) > 1")(lambda s, d: sessions.straddling_part(visits(s, d)))


def labels_as_text(df: DataFrame) -> DataFrame:
    return df.withColumns({"label_carts": text(F.col("label_carts")), "label_orders": text(F.col("label_orders"))})


LABELS_SQL = f"label_click, {listed('label_carts')} AS label_carts, {listed('label_orders')} AS label_orders"
query("ground_truth", f"WITH {o.V} SELECT {EVENT}, {LABELS_SQL} FROM {o.truth('v')}")(lambda s, d: labels_as_text(sessions.ground_truth(visits(s, d))))
query("cut_labels", f"WITH {o.V} SELECT session, {LABELS_SQL} FROM {o.truth('v')} WHERE pos = {o.CUT}")(lambda s, d: labels_as_text(sessions.cut_sessions(visits(s, d))[1]))
query(
    "cut_events",
    f"WITH {o.V} SELECT {EVENT} FROM (SELECT *, count(*) OVER (PARTITION BY session) AS n, row_number() OVER (PARTITION BY session ORDER BY ts, eid) AS pos FROM v) WHERE n > 1 AND pos <= {o.CUT}",
)(lambda s, d: sessions.cut_sessions(visits(s, d))[0])
LONG_SQL = f"""cut AS (SELECT * FROM {o.truth('v')} WHERE pos = {o.CUT}),
gt AS (SELECT session, 'clicks' AS type, [label_click] AS ground_truth FROM cut WHERE label_click IS NOT NULL
 UNION ALL SELECT session, 'carts', label_carts FROM cut WHERE len(label_carts) > 0 UNION ALL SELECT session, 'orders', label_orders FROM cut WHERE len(label_orders) > 0)"""


@query("label_long", f"WITH {o.V}, {LONG_SQL} SELECT session, type, {listed('ground_truth')} AS ground_truth FROM gt")
def label_long(spark, d):
    """Long labels, by way of the nested form."""
    _, labels = sessions.cut_sessions(visits(spark, d))
    nested = labels.select(
        "session",
        F.struct(F.col("label_click").alias("clicks"), F.when(F.size("label_carts") > 0, F.col("label_carts")).alias("carts"), F.when(F.size("label_orders") > 0, F.col("label_orders")).alias("orders")).alias("labels"),
    )
    return adapters.labels_long(nested).withColumn("ground_truth", text(F.col("ground_truth")))


query("buyers", f"WITH {o.V} SELECT {EVENT} FROM v WHERE session IN (SELECT session FROM v WHERE type <> 0)")(lambda s, d: sessions.with_buys(visits(s, d), visits(s, d)))
D_GT = "sum(cut) OVER (PARTITION BY session ORDER BY ts, eid)::BIGINT AS d FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY session ORDER BY ts, eid) > 7200 THEN 1 ELSE 0 END AS cut FROM u)"
D_GE = "sum(cut) OVER (PARTITION BY session ORDER BY ts, eid)::BIGINT AS d FROM (SELECT *, CASE WHEN least(greatest(ts - coalesce(lag(ts) OVER (PARTITION BY session ORDER BY ts, eid), 0), 0), 86400) >= 7200 THEN 1 ELSE 0 END AS cut FROM u)"
query("subsessions_gt2h", f"WITH {o.U} SELECT {EVENT}, {D_GT}")(lambda s, d: sessions.subsessions(users(s, d)))
query("subsessions_ge2h", f"WITH {o.U} SELECT {EVENT}, {D_GE}")(lambda s, d: sessions.subsessions_inclusive(users(s, d)))
query(
    "subsession_flags",
    f"""WITH {o.U}, x AS (SELECT {EVENT}, {D_GT}) SELECT {EVENT}, d, CASE WHEN row_number() OVER (PARTITION BY session, d ORDER BY ts, eid) = 1 THEN 1 ELSE 0 END AS a,
 CASE WHEN row_number() OVER (PARTITION BY session, d ORDER BY ts DESC, eid DESC) = 1 THEN 1 ELSE 0 END AS b, (ts - min(ts) OVER ()) // 86400 AS day FROM x""",
)(lambda s, d: sessions.subsession_flags(users(s, d)))
query("tail30", f"WITH {o.U} SELECT {EVENT} FROM u QUALIFY row_number() OVER (PARTITION BY session ORDER BY ts DESC, eid DESC) <= 30")(lambda s, d: sessions.tail(users(s, d)))
query("recent_starts", f"WITH {o.V} SELECT {EVENT} FROM v QUALIFY min(ts) OVER (PARTITION BY session) > {T_MAX - 21 * 86400}")(lambda s, d: sessions.started_after(visits(s, d), T_MAX - 21 * 86_400))


def last_sql(types: str) -> str:
    cols = ", ".join(f"coalesce(max(aid) FILTER (WHERE p = {i}), -1) AS last_{i}" for i in range(5))
    return f"WITH {o.V}, b AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts DESC, eid DESC) - 1 AS p FROM v WHERE type IN ({types})) SELECT session, {cols} FROM b WHERE p < 5 GROUP BY session"


query("last_items", last_sql("0, 1, 2"))(lambda s, d: sessions.last_items(visits(s, d)))
query("last_bought_items", last_sql("1, 2"))(lambda s, d: sessions.last_items(visits(s, d), types=(1, 2)))
LEAD = "lead(aid, {}) OVER (PARTITION BY session ORDER BY ts, eid)"
query("next_item_pairs", f"WITH {o.V} SELECT session, aid, {LEAD.format(1)} AS aid_next FROM v QUALIFY aid_next IS NOT NULL")(lambda s, d: sessions.next_pairs(visits(s, d)))
query("next_item_multi", f"WITH {o.V} SELECT DISTINCT aid, aid_next FROM ({' UNION ALL '.join(f'SELECT aid, {LEAD.format(k)} AS aid_next FROM v' for k in (1, 2, 3))}) WHERE aid_next IS NOT NULL")(lambda s, d: sessions.next_pairs(visits(s, d), (1, 2, 3)))
query(
    "lag_frame",
    f"""WITH {o.U}, x AS (SELECT {EVENT}, {D_GE}), l AS (SELECT *, {', '.join(f'coalesce(lag(aid, {i}) OVER (PARTITION BY session, d ORDER BY ts, eid), -1) AS lag{i}' if i else 'aid AS lag0' for i in range(11))} FROM x)
 SELECT session, ts, type, eid, d, {', '.join(f'lag{i}' for i in range(11))}, (ts - (SELECT min(ts) FROM u)) // 28800 AS hour FROM l WHERE type = 0 AND lag1 >= 0""",
)(lambda s, d: sessions.lag_frame(users(s, d)))
query(
    "running_stats",
    f"""WITH {o.V} SELECT {EVENT}, row_number() OVER w - 1 AS pos, count(*) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS len,
 row_number() OVER (PARTITION BY session, aid ORDER BY ts DESC, eid DESC) AS aid_count, max(aid) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS max_aid FROM v WINDOW w AS (PARTITION BY session ORDER BY ts DESC, eid DESC)""",
)(lambda s, d: sessions.running_stats(visits(s, d)))
query("seed_lists", f"WITH {o.U} SELECT session, list, aid, pos FROM {o.seeds('u')}")(lambda s, d: sessions.seed_lists(users(s, d)))

# Matrices

for _name, _spec in SPECS.items():
    query(f"covis_{_name}", f"WITH {o.V} SELECT aid_x, aid_y, wgt_e9, rank FROM {o.covis(_spec, 'v', T_MIN, T_MAX)}")(lambda s, d, n=_name: matrix(dealt(visits(s, d)), n))
for _name in ("93", "116", "157", "235"):
    query(f"covis_users_{_name}", f"WITH {o.U} SELECT aid_x, aid_y, wgt_e9, rank FROM {o.covis(SPECS[_name], 'u', T_MIN, T_MAX)}")(lambda s, d, n=_name: matrix(dealt(users(s, d)), n))
query(
    "covis_merged",
    f"""WITH {o.V}, m AS (SELECT * FROM {o.covis(SPECS['temporal'], 'v', T_MIN, T_MAX, top_n=0)} UNION ALL SELECT * FROM {o.covis(SPECS['type136'], 'v', T_MIN, T_MAX, top_n=0)}),
 t AS (SELECT aid_x, aid_y, sum(wgt_e9)::BIGINT AS wgt_e9 FROM m GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY aid_x ORDER BY wgt_e9 DESC, aid_y) AS rank FROM t QUALIFY rank <= 20""",
)(lambda s, d: (lambda e: merge([matrix(e, "temporal", 0), matrix(e, "type136", 0)], 20))(sessions_held(s, d)))


@query("adjacency_lists", f"WITH {o.V} SELECT aid_x AS aid, string_agg(aid_y, ' ' ORDER BY rank) AS candidates FROM {o.covis(SPECS['93'], 'v', T_MIN, T_MAX)} GROUP BY aid_x")
def adjacency_lists(spark, d):
    return adjacency(matrix(visits(spark, d), "93")).withColumn("candidates", text(F.col("candidates")))


# Candidates

POPULAR = "SELECT type, aid, count(*) AS n_events, row_number() OVER (PARTITION BY type ORDER BY count(*) DESC, aid) - 1 AS pos FROM {} GROUP BY type, aid"
query("popular_topk", f"WITH {o.V} {POPULAR.format('v')} QUALIFY pos < 100")(lambda s, d: candidates.popular(visits(s, d)))
COOC = """c AS (WITH m AS (SELECT 0 AS m, * FROM mt UNION ALL SELECT 1, * FROM ty), k AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, eid) AS k FROM {src}),
 t AS (SELECT session, aid_y, count(*) AS votes, min(k * 1000000 + m * 1000 + rank) AS first FROM k JOIN m ON m.aid_x = k.aid GROUP BY ALL),
 r AS (SELECT *, sum(votes) OVER (PARTITION BY session) AS total, row_number() OVER (PARTITION BY session ORDER BY votes DESC, first) AS place FROM t)
 SELECT session, aid_y AS candidates FROM r WHERE total <= {n} OR place <= {n} UNION SELECT session, aid FROM {src})"""
MATS = f"mt AS (SELECT * FROM {o.covis(SPECS['temporal'], 'v', T_MIN, T_MAX)}), ty AS (SELECT * FROM {o.covis(SPECS['type136'], 'v', T_MIN, T_MAX)})"
KEPT = f"kept AS (SELECT {EVENT} FROM (SELECT *, count(*) OVER (PARTITION BY session) AS n, row_number() OVER (PARTITION BY session ORDER BY ts, eid) AS pos FROM v) WHERE n > 1 AND pos <= {o.CUT})"
C_V = f"WITH {o.V}, {MATS}, {COOC.format(src='v', n=100)}"
C_KEPT = f"WITH {o.V}, {MATS}, {KEPT}, {LONG_SQL}, {COOC.format(src='kept', n=40)}"


def two(events: DataFrame) -> list[DataFrame]:
    """Two matrices of held events."""
    events = dealt(events)
    return [held(matrix(events, n), n) for n in ("temporal", "type136")]


def cooc(spark, d) -> tuple[DataFrame, DataFrame]:
    """Co-occurring candidates of all sessions, and the sessions."""
    e = sessions_held(spark, d)
    return candidates.cooccurring(e, two(e), 100), e


class Kept:
    """What queries on cut sessions share, each computed once and only if asked for: all events, the kept ones, labels, two matrices, candidates."""

    def __init__(self, spark, d):
        self.events = sessions_held(spark, d)
        self._kept, self._labels = sessions.cut_sessions(self.events)

    @cached_property
    def kept(self) -> DataFrame:
        return held(self._kept, "kept")

    @cached_property
    def truth(self) -> DataFrame:
        return held(sessions.labels_to_long(self._labels), "truth")

    @cached_property
    def matrices(self) -> dict[str, DataFrame]:
        return dict(zip(("temporal", "type136"), two(self.events), strict=True))

    @cached_property
    def pairs(self) -> DataFrame:
        return held(candidates.cooccurring(self.kept, list(self.matrices.values()), 40), "pairs")


query("candidates_cooc", f"{C_V} SELECT session, candidates FROM c")(lambda s, d: cooc(s, d)[0])
HITS = "h AS (SELECT session, type, unnest(ground_truth) AS candidates FROM gt)"
GT = ", ".join(f"CASE WHEN EXISTS (SELECT 1 FROM h WHERE h.session = c.session AND h.candidates = c.candidates AND h.type = '{k}') THEN 1 ELSE 0 END AS gt_{k}" for k in candidates.CLASSES)


@query("candidates_labelled", f"{C_KEPT}, {HITS} SELECT session, candidates, {GT} FROM c")
def candidates_labelled(spark, d):
    k = Kept(spark, d)
    return candidates.labelled(k.pairs, k.truth)


query("candidates_blend", f"{C_V} SELECT session, candidates FROM c UNION SELECT v.session, m.aid_y FROM v JOIN mt m ON m.aid_x = v.aid")(
    lambda s, d: (lambda e: (lambda m: candidates.blended([candidates.cooccurring(e, m, 100), e.join(m[0], F.col("aid") == F.col("aid_x")).select("session", F.col("aid_y").alias("candidates"))]))(two(e)))(sessions_held(s, d))
)
query("candidates_unseen", f"{C_V} SELECT session, candidates FROM c EXCEPT SELECT session, aid FROM v")(lambda s, d: candidates.unseen(*cooc(s, d)))
query("first_candidate", f"{C_V} SELECT session, min(candidates) AS candidates FROM c GROUP BY session")(lambda s, d: candidates.one_per_session(cooc(s, d)[0], "candidates"))


@query("candidate_recall", f"{C_KEPT}, l AS (SELECT session, list(candidates) AS preds FROM c GROUP BY session) SELECT type, sum(len(preds))::BIGINT AS n_preds, sum(least(20, len(ground_truth)))::BIGINT AS n_gts, sum(least(20, len(list_intersect(ground_truth, preds))))::BIGINT AS n_found, n_found / n_gts AS recall FROM l JOIN gt USING (session) GROUP BY type")
def candidate_recall(spark, d):
    """The most that ranking can reach: recall of whole candidate lists."""
    k = Kept(spark, d)
    return evaluation.coverage(k.pairs.groupBy("session").agg(F.collect_list("candidates").alias("preds")), k.truth)


VOTE_SINCE = {n: (SPECS[n].__class__(**{**SPECS[n].__dict__, "started_days": 31}) if SPECS[n].started_days else SPECS[n]) for n in voting.MATRICES}


def vote_parts(spark, d, names):
    """Users as sessions, so that some are long; first-event matrices take all sessions then."""
    e = held(prepared(users(spark, d)), "users")
    # Lists are asked for by several sources, so matrices and seeds are kept; each matrix is planned by itself.
    many = dealt(e)
    mats = held_parts((covisitation(many, VOTE_SINCE[n], T_MIN, T_MAX).select(F.lit(n).alias("matrix"), "aid_x", "aid_y", "rank") for n in names), "lists")
    e = e.drop("t0", "k", "back")
    return e, held(sessions.seed_lists(e)), mats


def used(spec) -> list[str]:
    return sorted({v.matrix for v in (*spec.long, *spec.short, *([spec.second] if spec.second else []))})


def vote(spec):
    def run(spark, d):
        e, seeds, mats = vote_parts(spark, d, sorted({*used(spec), *(used(voting.FAST) if spec is not voting.FAST else [])}))
        top = {k: candidates.popular(e.where(F.col("type") == k)) for k in (0, 2)}
        fast = voting.suggest(e, seeds, mats, voting.FAST, popular=top[0])
        if spec is voting.FAST:
            return fast
        return voting.suggest(e, seeds, mats, spec, fast=held(fast), popular=top[2] if spec is voting.ORDERS else top[0])

    return run


def vote_sql(spec) -> str:
    mats = sorted({*used(spec), *used(voting.FAST)})
    parts = [o.U, f"seeds0 AS (SELECT * FROM {o.seeds('u')})", *[f"m_{n} AS (SELECT * FROM {o.covis(VOTE_SINCE[n], 'u', T_MIN, T_MAX)})" for n in mats], o.vote(voting.FAST, "u", "fast", popular_type=0)]
    if spec is not voting.FAST:
        parts.append(o.vote(spec, "u", "slow", fast="fast", popular_type=2 if spec is voting.ORDERS else 0))
    return f"WITH {', '.join(parts)} SELECT session, aid, pos FROM {'fast' if spec is voting.FAST else 'slow'}"


for _s in (voting.FAST, voting.CLICKS, voting.ORDERS):
    query(f"vote_{_s.name}", vote_sql(_s))(vote(_s))

# Features

APART = "(last_ts - ts)"
KIND_163 = "CASE type WHEN 0 THEN 1::DOUBLE WHEN 1 THEN 6::DOUBLE ELSE 3::DOUBLE END"
WT = f"(1::DOUBLE / ln(2::DOUBLE + {APART} // 60))"
EW = f"""ew AS (SELECT {EVENT}, CASE WHEN pos = 0 THEN 1::DOUBLE ELSE pow(2::DOUBLE, 0.1::DOUBLE) - 1 END AS w_pos_log, {KIND_163} AS w_type_163, CASE WHEN {APART} < 86400 THEN 1::DOUBLE ELSE 0::DOUBLE END AS w_lastday, {WT} AS w_time,
 {WT} * (1::DOUBLE / ln(2::DOUBLE + pos)) * (1::DOUBLE / ln(1::DOUBLE + pos + 1)) * (1::DOUBLE / ln(1::DOUBLE + nth)) AS w_recsys FROM
 (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts DESC, eid DESC) - 1 AS pos, max(ts) OVER (PARTITION BY session) AS last_ts, row_number() OVER (PARTITION BY aid ORDER BY session, ts DESC, eid DESC) AS nth FROM v))"""


def rounded(df: DataFrame, digits: int = 6, keys: tuple[str, ...] = ("session", "candidates", "aid", "type", "ts", "eid")) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal; the shift keeps exact halves from falling either way."""
    return df.select(*[F.round(F.col(f"`{c}`") + F.lit(1.2345e-8), digits).alias(c) if t == "double" and c not in keys else F.col(f"`{c}`") for c, t in df.dtypes])


def r(sql: str, name: str) -> str:
    return f"round({sql} + 1.2345e-8::DOUBLE, 6) AS {name}"


W_SUM = ", ".join(r(f"sum({w})", w) for w in WEIGHTS)
query("event_weights", f"WITH {o.V}, {EW} SELECT {EVENT}, {', '.join(r(w, w) for w in WEIGHTS)} FROM ew")(lambda s, d: rounded(features.event_weights(visits(s, d))))
query("session_weights", f"WITH {o.V}, {EW} SELECT session, aid AS candidates, {W_SUM} FROM ew GROUP BY ALL")(lambda s, d: rounded(features.session_weights(visits(s, d))))
query("session_weights_noclick", f"WITH {o.V}, {EW} SELECT session, aid AS candidates, {', '.join(r(f'sum(CASE WHEN type <> 0 THEN {w} ELSE 0 END)', w) for w in WEIGHTS)} FROM ew GROUP BY ALL")(lambda s, d: rounded(features.session_weights(visits(s, d), no_click=True)))
SW = f"sw AS (SELECT session, aid AS candidates, {', '.join(f'sum({w}) AS {w}' for w in WEIGHTS)} FROM ew GROUP BY ALL)"
query(
    "weights_fill",
    f"{C_V}, {EW}, {SW}, j AS (SELECT c.session, c.candidates, {', '.join(WEIGHTS)} FROM c LEFT JOIN sw ON c.session = sw.session AND c.candidates = sw.candidates) SELECT session, candidates, {', '.join(r(f'coalesce({w}, (SELECT min({w}) FROM j) / 2)', w) for w in WEIGHTS)} FROM j",
)(lambda s, d: (lambda pairs, e: rounded(features.with_weights(pairs, features.session_weights(e))))(*cooc(s, d)))
query("popularity_weighted", f"WITH {o.V}, {EW} SELECT aid, {', '.join(r(f'sum(CASE WHEN type = {k} THEN {w} ELSE 0 END)', f'{c}_{w}') for k, c in enumerate(candidates.CLASSES) for w in WEIGHTS)} FROM ew GROUP BY aid")(lambda s, d: rounded(features.weighted_popularity(visits(s, d))))
WEEK = "SELECT aid, type, count(*) * 10000 / sum(count(*)) OVER (PARTITION BY type) AS popularity_week FROM v GROUP BY aid, type"
DAY_ = f"SELECT aid, type, (ts + 7200 - {T_MIN}) // 86400 AS day, count(*) * 10000 / sum(count(*)) OVER (PARTITION BY type, (ts + 7200 - {T_MIN}) // 86400) AS popularity_day FROM v GROUP BY aid, type, (ts + 7200 - {T_MIN}) // 86400"
HOUR = """SELECT aid, type, hour, r * 100 / sum(r) OVER (PARTITION BY type, hour) AS popularity_hour FROM (SELECT aid, type, hour, sum(n) OVER (PARTITION BY aid, type ORDER BY hour RANGE BETWEEN 3600 PRECEDING AND 3600 FOLLOWING) AS r FROM
 (SELECT aid, type, ts + 7200 - (ts + 7200) % 3600 AS hour, count(*) AS n FROM v GROUP BY ALL))"""
query("popularity_week", f"WITH {o.V}, p AS ({WEEK}) SELECT aid, type, {r('popularity_week', 'popularity_week')} FROM p")(lambda s, d: rounded(features.popularity_week(visits(s, d))))
query("popularity_day", f"WITH {o.V}, p AS ({DAY_}) SELECT aid, type, day, {r('popularity_day', 'popularity_day')} FROM p")(lambda s, d: rounded(features.popularity_day(visits(s, d), T_MIN)))
query("popularity_hour", f"WITH {o.V}, p AS ({HOUR}) SELECT aid, type, hour, {r('popularity_hour', 'popularity_hour')} FROM p")(lambda s, d: rounded(features.popularity_hour(visits(s, d))))


def refreshed(spark, d) -> refreshed_.Store:
    """Hourly counts in a store that was filled from four fifths of the sessions; then one of these went and the last fifth came."""
    events, root = sessions_held(spark, d), fresh_dir(spark, "refreshed")
    for k in range(5):
        events.where(F.pmod("session", F.lit(5)) == k).write.parquet(f"{root}/in/{k}")
    of = refreshed_.Sums(lambda e: features.with_hours(e, T_MIN), ("aid", "type", "day", "hour"), ("n",))
    store = refreshed_.Store(spark, f"{root}/store", of)
    store.refresh([f"{root}/in/{k}" for k in (0, 1, 2, 3)])
    store.refresh([f"{root}/in/{k}" for k in (0, 2, 3, 4)])
    return store


FOUR = "four AS (SELECT * FROM v WHERE (session % 5 + 5) % 5 <> 1)"
query("popularity_refreshed", f"WITH {o.V}, {FOUR}, p AS ({WEEK.replace('FROM v', 'FROM four')}) SELECT aid, type, {r('popularity_week', 'popularity_week')} FROM p")(lambda s, d: rounded(features.popularity_week(refreshed(s, d).total())))
query("popularity_hour_refreshed", f"WITH {o.V}, {FOUR}, p AS ({HOUR.replace('FROM v', 'FROM four')}) SELECT aid, type, hour, {r('popularity_hour', 'popularity_hour')} FROM p")(lambda s, d: rounded(features.popularity_hour(refreshed(s, d).total())))


def pop_sql() -> str:
    cols = []
    for k, c in enumerate(candidates.CLASSES):
        w, dy, h = (f"coalesce((SELECT popularity_{p} FROM {p}_ x WHERE x.aid = a.candidates AND x.type = {k}{f' AND x.{p} = a.{p}' if p != 'week' else ''}), 0)" for p in ("week", "day", "hour"))
        cols += [r(w, f"popularity_week_{c}"), r(dy, f"popularity_day_{c}"), r(h, f"popularity_hour_{c}"), r(f"coalesce({h} / nullif({dy}, 0), 0)", f"popularity_hour_day_{c}"), r(f"coalesce({dy} / nullif({w}, 0), 0)", f"popularity_day_week_{c}")]
    return f"""{C_V}, week_ AS ({WEEK}), day_ AS ({DAY_}), hour_ AS ({HOUR}), t AS (SELECT session, max(ts) AS l FROM v GROUP BY session),
 a AS (SELECT c.session, candidates, (l + 7200 - {T_MIN}) // 86400 AS day, l + 7200 - (l + 7200) % 3600 AS hour FROM c JOIN t ON c.session = t.session) SELECT session, candidates, {', '.join(cols)} FROM a"""


query("popularity_ratios", pop_sql())(lambda s, d: (lambda pairs, e: rounded(features.popularity(pairs, e, T_MIN)))(*cooc(s, d)))


def agg3(value: str, name: str) -> str:
    return f"{r(f'avg({value})', name + '_mean')}, {r(f'sum({value})', name + '_sum')}, {r(f'max({value})', name + '_max')}"


query(
    "covis_features",
    f"""{C_KEPT}, {EW.replace('FROM v)', 'FROM kept)')}, {SW}, x AS (SELECT c.session, c.candidates, coalesce(m.wgt_e9 / 1e9::DOUBLE, 0) AS w, {', '.join(f'coalesce(sw.{w}, 0) AS {w}' for w in WEIGHTS)} FROM c JOIN kept v ON v.session = c.session
 LEFT JOIN mt m ON m.aid_x = v.aid AND m.aid_y = c.candidates LEFT JOIN sw ON sw.session = c.session AND sw.candidates = v.aid)
 SELECT session, candidates, {', '.join(agg3(f'w * {w}' if w else 'w', f'm_{w}' if w else 'm') for w in ('', *WEIGHTS))} FROM x GROUP BY session, candidates""",
)(lambda s, d: (lambda k: rounded(features.covisitation_features(k.pairs, k.kept, k.matrices["temporal"], features.session_weights(k.kept))))(Kept(s, d)))
ACTIONS = ", ".join(f"least(255, count(v.eid){f' FILTER (WHERE v.type = {k - 1})' if k else ''}) AS candidate_{n}_before" for k, n in enumerate(("all", *candidates.CLASSES)))
query("count_actions", f"{C_V} SELECT c.session, c.candidates, {ACTIONS} FROM c LEFT JOIN v ON v.session = c.session AND v.aid = c.candidates GROUP BY c.session, c.candidates")(lambda s, d: features.count_actions(*cooc(s, d)))
query("session_counts", f"WITH {o.U} SELECT session, least(255, count(*)) AS n_views, {', '.join(f'least(255, count(*) FILTER (WHERE type = {k})) AS n_{c}' for k, c in enumerate(candidates.CLASSES))} FROM u GROUP BY session")(lambda s, d: features.session_counts(users(s, d)))
query(
    "rank_features",
    f"WITH {o.V}, {EW}, e AS (SELECT session, aid AS candidates, sum(w_type_163) AS w_type_163, sum(w_lastday) AS w_lastday FROM ew GROUP BY ALL) SELECT session, candidates, w_type_163, w_lastday, least(255, rank() OVER (PARTITION BY session ORDER BY w_type_163 DESC)) AS w_type_163_rank, least(255, rank() OVER (PARTITION BY session ORDER BY w_lastday DESC)) AS w_lastday_rank FROM e",
)(lambda s, d: features.ranks(held(features.session_weights(visits(s, d)).select("session", "candidates", "w_type_163", "w_lastday"), "ranked"), ["w_type_163", "w_lastday"]))
VEC = "e AS (SELECT vec_id AS aid, list_transform(embedding, lambda x: x::DOUBLE / (sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))) + 1e-12::DOUBLE)) AS vec FROM embeddings)"
SIM = "coalesce(list_dot_product(a.vec, b.vec), 0)"
query("unit_vectors", f"WITH {VEC} SELECT aid, {r('list_sum(vec)', 'total')}, {r('list_dot_product(vec, vec)', 'norm')} FROM e")(
    lambda s, d: rounded(vectors(s, d).select("aid", F.aggregate("vec", F.lit(0.0), lambda a, x: a + x).alias("total"), F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x).alias("norm")))
)
query(
    "lastn_cosine",
    f"""{C_KEPT}, {VEC}, l AS (SELECT session, aid, row_number() OVER (PARTITION BY session ORDER BY ts DESC, eid DESC) - 1 AS p FROM kept QUALIFY p < 5), x AS (SELECT c.session, c.candidates, p, {SIM} AS sim FROM c JOIN l ON l.session = c.session LEFT JOIN e a ON a.aid = c.candidates LEFT JOIN e b ON b.aid = l.aid)
 SELECT session, candidates, {', '.join(r(f'coalesce(max(sim) FILTER (WHERE p = {i}), -1)', f'sim_last_{i}') for i in range(5))} FROM x GROUP BY session, candidates""",
)(lambda s, d: (lambda k: rounded(features.last_item_similarity(k.pairs, sessions.last_items(k.kept), vectors(s, d))))(Kept(s, d)))
query(
    "mf_features",
    f"""{C_KEPT}, {VEC}, {EW.replace('FROM v)', 'FROM kept)')}, {SW}, x AS (SELECT c.session, c.candidates, coalesce(list_dot_product(a.vec, b.vec) + 1, 0) AS s, {', '.join(f'coalesce(sw.{w}, 0) AS {w}' for w in WEIGHTS)} FROM c JOIN kept v ON v.session = c.session
 LEFT JOIN e a ON a.aid = c.candidates LEFT JOIN e b ON b.aid = v.aid LEFT JOIN sw ON sw.session = c.session AND sw.candidates = v.aid)
 SELECT session, candidates, {', '.join(agg3(f's * {w}', f'mf_{w}') for w in WEIGHTS)} FROM x GROUP BY session, candidates""",
)(lambda s, d: (lambda k: rounded(features.factor_features(k.pairs, k.kept, vectors(s, d), features.session_weights(k.kept))))(Kept(s, d)))
KIND_MP = "CASE type WHEN 1 THEN 9::DOUBLE ELSE 0.5::DOUBLE END"


def pw(start: float) -> str:
    low = f"(pow(2::DOUBLE, {start}::DOUBLE) - 1)"
    return f"({low} + (1 - {low}) * (nth - 1) / n) * {KIND_MP}"


PW = f"pw AS (SELECT {EVENT}, {KIND_MP} AS type_mp, CASE WHEN nth = 1 THEN 1 ELSE 0 END AS last, {pw(0.1)} AS wgt_1, {pw(0.5)} AS wgt_2 FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts DESC, eid DESC) AS nth, count(*) OVER (PARTITION BY session) AS n FROM {{}}))"
query("position_weights", f"WITH {o.V}, {PW.format('v')} SELECT {EVENT}, type_mp, last, {r('wgt_1', 'wgt_1')}, {r('wgt_2', 'wgt_2')} FROM pw")(lambda s, d: rounded(features.position_weights(visits(s, d))))
HITS_W = "count(*) FILTER (WHERE sim > 0)"
query(
    "w2v_features",
    f"""{C_KEPT}, {VEC}, {PW.format('kept')}, x AS (SELECT c.session, c.candidates, pw.*, CASE WHEN {SIM} < 0.5 THEN 0 ELSE {SIM} END AS sim FROM c JOIN pw ON pw.session = c.session LEFT JOIN e a ON a.aid = c.candidates LEFT JOIN e b ON b.aid = pw.aid)
 SELECT session, candidates, {r('max(sim)', 'w2v_max')}, {r(f'sum(sim) / (1 + {HITS_W})', 'w2v_mean')}, {HITS_W} AS w2v_count, {r(f'sum(sim * wgt_1) / (1 + {HITS_W})', 'w2v_wgt_1')}, {r(f'sum(sim * wgt_2) / (1 + {HITS_W})', 'w2v_wgt_2')}, {r('max(sim * last)', 'w2v_last')}, {r(f'sum(sim * type_mp) / (1 + {HITS_W})', 'w2v_type')} FROM x GROUP BY session, candidates""",
)(lambda s, d: (lambda k: rounded(features.sequence_features(k.pairs, k.kept, vectors(s, d))))(Kept(s, d)))
query("correlated_features", f"WITH {o.V}, {EW}, {SW}, c AS (SELECT 'w_type_163' AS a, 'w_time' AS b, corr(w_type_163, w_time) AS corr FROM sw UNION ALL SELECT 'w_type_163', 'w_lastday', corr(w_type_163, w_lastday) FROM sw UNION ALL SELECT 'w_time', 'w_lastday', corr(w_time, w_lastday) FROM sw) SELECT a, b, {r('corr', 'corr')} FROM c WHERE corr > 0.3")(
    lambda s, d: rounded(features.correlated(features.session_weights(visits(s, d)), ["w_type_163", "w_time", "w_lastday"], 0.3))
)


def vector_sets(spark, d) -> dict[str, tuple[DataFrame, bool]]:
    """Five sets of vectors under the names of what they are trained on, two of them of carts and orders. The tables hold one set, so the others are its dimensions turned by eight each."""
    raw = adapters.read_vectors(spark, f"{d}/embeddings.parquet")
    turned = lambda k: raw.select("aid", F.concat(F.slice("vec", 8 * k + 1, 64), F.slice("vec", 1, 8 * k)).alias("vec")) if k else raw
    half = lambda k: turned(k).select("aid", F.slice("vec", 1, 32).alias("vec"))
    names = ("mf_1_9_buys", "mf_1", "mf_1_5", "seq", "w2v")
    return {n: (held(features.unit_vectors(half(k)), n), n.endswith("_buys")) for k, n in enumerate(names)}


def full_table(spark, d) -> DataFrame:
    k = Kept(spark, d)
    return recommender.feature_table(candidates.labelled(k.pairs, k.truth), k.kept, k.events, vector_sets(spark, d), T_MIN, T_MAX, hold=held)


query("feature_table")(full_table)


# Sampling

LAB = f"{C_KEPT}, {HITS}, lab AS (SELECT session, candidates, {GT} FROM c)"
HASH = "((session * 31 + candidates) % 1000003 * 7919 + 42) % 1000003"


def lab(spark, d):
    k = Kept(spark, d)
    return candidates.labelled(k.pairs, k.truth)


query("negative_sampling", f"{LAB} SELECT * FROM lab WHERE gt_clicks = 1 UNION ALL SELECT * FROM (SELECT * FROM lab WHERE gt_clicks = 0 ORDER BY {HASH}, session, candidates LIMIT (SELECT floor(sum(gt_clicks) / 0.5)::BIGINT FROM lab))")(lambda s, d: sampling.negatives(lab(s, d), "gt_clicks", 0.5))
query("sample_pairs", f"{C_V} SELECT session, candidates FROM c ORDER BY {HASH}, session, candidates LIMIT 500")(lambda s, d: sampling.sample_n(cooc(s, d)[0], 500))
query("quantile_filter", f"WITH {o.V} SELECT {EVENT} FROM v WHERE session < (SELECT quantile_cont(session, 0.1) FROM v)")(lambda s, d: sampling.under_quantile(visits(s, d), 0.1))
query("modulo_split", f"WITH {o.V} SELECT {EVENT} FROM v WHERE session % 40 = 11")(lambda s, d: sampling.modulo(visits(s, d), 40, 11))
query("fold_split", f"WITH {o.V} SELECT {EVENT}, ((session % 1000003 * 7919 + 42) % 1000003 % 5)::INTEGER AS fold FROM v")(lambda s, d: sampling.folds(visits(s, d)))
query("target_sessions", f"{LAB} SELECT session, candidates, gt_clicks, gt_carts, gt_orders FROM lab QUALIFY max(gt_clicks) OVER (PARTITION BY session) = 1 OR row_number() OVER (PARTITION BY session ORDER BY candidates) = 1")(lambda s, d: sampling.with_targets(lab(s, d), "gt_clicks"))

# Evaluation


def scored(k: Kept, which: str = "type136") -> DataFrame:
    """A plain score for each pair: the votes of the session's events through one matrix, as whole multiples of 1e-9."""
    edges = k.matrices[which].select(F.col("aid_x").alias("aid"), F.col("aid_y").alias("candidates"), "wgt_e9")
    got = k.kept.join(edges, "aid").groupBy("session", "candidates").agg(F.sum("wgt_e9").cast("double").alias("pred"))
    return k.pairs.join(got, ["session", "candidates"], "left").na.fill(0.0, ["pred"])


def scored_sql(m: str, tag: str) -> str:
    return f"{tag} AS (SELECT c.session, c.candidates, coalesce(p, 0)::DOUBLE AS pred FROM c LEFT JOIN (SELECT session, aid_y, sum(wgt_e9) AS p FROM kept JOIN {m} ON aid_x = aid GROUP BY ALL) q ON q.session = c.session AND q.aid_y = c.candidates)"


TOP = "top AS (SELECT session, list(candidates ORDER BY pred DESC, candidates) AS preds FROM (SELECT * FROM {} QUALIFY row_number() OVER (PARTITION BY session ORDER BY pred DESC, candidates) <= 20) GROUP BY session)"
E_SQL = f"{C_KEPT}, {scored_sql('ty', 'sc')}, {TOP.format('sc')}"
COVER = "SELECT type, sum(len(preds))::BIGINT AS n_preds, sum(least(20, len(ground_truth)))::BIGINT AS n_gts, sum(least(20, len(list_intersect(ground_truth, preds))))::BIGINT AS n_found, n_found / n_gts AS recall FROM top JOIN gt USING (session) GROUP BY type"
OFFICIAL = "SELECT type, sum(least(20, len(ground_truth)))::BIGINT AS n_gts, sum(CASE WHEN preds IS NULL THEN 0 ELSE least(20, len(list_intersect(ground_truth, preds))) END)::BIGINT AS n_found, n_found / n_gts AS recall FROM gt LEFT JOIN top USING (session) GROUP BY type"


@query("recall_at_20", f"{E_SQL} {COVER}")
def recall_at_20(spark, d):
    k = Kept(spark, d)
    return evaluation.coverage(evaluation.top_lists(scored(k)), k.truth)


@query("official_scores", f"{E_SQL} {OFFICIAL}")
def official_scores(spark, d):
    k = Kept(spark, d)
    return evaluation.official_scores(evaluation.top_lists(scored(k)), k.truth)


@query("weighted_cv", f"{E_SQL}, f AS ({OFFICIAL}) SELECT {r('sum(recall * CASE type WHEN $$clicks$$ THEN 0.1::DOUBLE WHEN $$carts$$ THEN 0.3::DOUBLE ELSE 0.6::DOUBLE END)', 'score')} FROM f")
def weighted_cv(spark, d):
    return rounded(evaluation.weighted_recall(official_scores(spark, d)))


AUC_SQL = """x AS (SELECT h.g, gt, least(floor(pred / (pred + 1e9::DOUBLE) * 65536), 65535) AS b FROM (SELECT sc.*, gt_clicks, gt_carts, gt_orders FROM sc JOIN lab USING (session, candidates)) UNPIVOT (gt FOR g IN (gt_clicks, gt_carts, gt_orders)) h),
 n AS (SELECT g, b, count(*) FILTER (WHERE gt = 1) AS p, count(*) FILTER (WHERE gt <> 1) AS n FROM x GROUP BY ALL), l AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY g ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS less FROM n)"""


@query("auc_by_class", f"{C_KEPT}, {HITS}, lab AS (SELECT session, candidates, {GT} FROM c), {scored_sql('ty', 'sc')}, {AUC_SQL} SELECT g AS target, {r('sum(p::DOUBLE * (less + n / 2)) / (sum(p)::DOUBLE * sum(n))', 'auc')} FROM l GROUP BY g")
def auc_by_class(spark, d):
    """How well the plain score tells each class's candidates from the others."""
    k = Kept(spark, d)
    rows = scored(k).join(candidates.labelled(k.pairs, k.truth), ["session", "candidates"])
    long = rows.select((F.col("pred") / (F.col("pred") + F.lit(1e9))).alias("pred"), F.inline(F.array(*[F.struct(F.lit(f"gt_{c}").alias("target"), F.col(f"gt_{c}").alias("gt")) for c in candidates.CLASSES])))
    return rounded(boosting.auc(long, "gt", keys=("target",)))


B_SQL = f"{C_KEPT}, {scored_sql('ty', 'sc')}, {scored_sql('mt', 's2')}, b AS (SELECT session, candidates, sum(pred) AS pred FROM (SELECT session, candidates, pred * 0.75::DOUBLE AS pred FROM sc UNION ALL SELECT session, candidates, pred * 0.25::DOUBLE FROM s2) GROUP BY ALL)"


#: Each class's shares of the two scores.
BLENDS = {c: {"type136": a, "temporal": 1 - a} for c, a in (("clicks", 0.75), ("carts", 0.5), ("orders", 0.25))}


def scored_twice(k: Kept) -> DataFrame:
    """Pairs with both matrices' plain scores, which are summed from the votes that make the pairs, so that sessions stay in their tasks."""
    return candidates.cooccurring(k.kept, list(k.matrices.values()), 40, scores=tuple(k.matrices)).withColumns({n: F.col(n).cast("double") for n in k.matrices})


query("blend_scores", f"{B_SQL} SELECT session, candidates, pred FROM b")(lambda s, d: (lambda k: evaluation.blend([(scored(k, n), w) for n, w in BLENDS["clicks"].items()]))(Kept(s, d)))
#: Written apart: scores by class as literal sums, popular items of each class by counting, lists padded by position.
B_CLASS = f"""{C_KEPT}, {scored_sql('ty', 'sc')}, {scored_sql('mt', 's2')},
 two AS (SELECT sc.session, sc.candidates, sc.pred AS a, s2.pred AS b FROM sc JOIN s2 ON sc.session = s2.session AND sc.candidates = s2.candidates),
 b AS (SELECT session, candidates, 'clicks' AS type, a * 0.75::DOUBLE + b * 0.25::DOUBLE AS pred FROM two UNION ALL SELECT session, candidates, 'carts', a * 0.5::DOUBLE + b * 0.5::DOUBLE FROM two
 UNION ALL SELECT session, candidates, 'orders', a * 0.25::DOUBLE + b * 0.75::DOUBLE FROM two),
 best AS (SELECT session, type, candidates AS aid, row_number() OVER (PARTITION BY session, type ORDER BY pred DESC, candidates) AS place FROM b QUALIFY place <= 20),
 pop AS (SELECT CASE type WHEN 0 THEN 'clicks' WHEN 1 THEN 'carts' ELSE 'orders' END AS type, aid, row_number() OVER (PARTITION BY type ORDER BY count(*) DESC, aid) AS place FROM v GROUP BY v.type, aid),
 have AS (SELECT session, type, count(*) AS n FROM best GROUP BY ALL),
 filled AS (SELECT session, type, aid, place FROM best UNION ALL SELECT have.session, have.type, pop.aid, n + pop.place FROM have JOIN pop ON pop.type = have.type AND n + pop.place <= 20),
 pad AS (SELECT session, type, string_agg(aid, ' ' ORDER BY place) AS preds FROM filled GROUP BY session, type)"""



query("blend_by_class", f"{B_CLASS} SELECT session, type, candidates, pred FROM b")(lambda s, d: evaluation.blend_by_class(scored_twice(Kept(s, d)), BLENDS))

def padded(spark, d):
    k = Kept(spark, d)
    rows = evaluation.blend_by_class(scored_twice(k), BLENDS)
    return evaluation.padded(evaluation.top_lists(rows, keys=("session", "type")), candidates.by_class(candidates.popular(k.events, 20)))


query("pad_popular", f"{B_CLASS} SELECT session, type, preds FROM pad")(lambda s, d: padded(s, d).withColumn("preds", text(F.col("preds"))))
query("submission", f"{B_CLASS} SELECT session || '_' || type AS session_type, preds AS labels FROM pad")(lambda s, d: evaluation.submission(padded(s, d)))
query("parse_submission", f"{B_CLASS} SELECT session, type, preds FROM pad")(lambda s, d: evaluation.parse_submission(evaluation.submission(padded(s, d))).withColumn("preds", text(F.col("preds"))))

# Models: trained here, so no SQL twin but for what they are trained on

query(
    "shifted_pmi",
    f"""WITH {o.V}, k AS (SELECT session, aid, row_number() OVER (PARTITION BY session ORDER BY ts, eid) AS k FROM v), c AS (SELECT aid, count(*) AS c FROM v GROUP BY aid),
 s AS (SELECT aid, 0.001::DOUBLE * (SELECT count(*) FROM v) / c AS x FROM c), kept AS (SELECT aid, least(1::DOUBLE, sqrt(x) + x) AS p FROM s),
 n AS (SELECT x.aid AS a, y.aid AS b, count(*) * any_value(p.p) * any_value(q.p) AS n FROM k x JOIN k y ON x.session = y.session AND abs(x.k - y.k) BETWEEN 1 AND 3 JOIN kept p ON p.aid = x.aid JOIN kept q ON q.aid = y.aid GROUP BY ALL),
 t AS (SELECT a, sum(n) AS na FROM n GROUP BY a), r AS (SELECT n.a, n.b, ln(n * (SELECT sum(na) FROM t) / t.na / u.na) - ln(1::DOUBLE) AS v FROM n JOIN t ON t.a = n.a JOIN t u ON u.a = n.b)
 SELECT a, b, {r('v', 'v')} FROM r WHERE v > 0""",
)(lambda s, d: rounded(embeddings.shifted_pmi(sessions_held(s, d), negatives=1), keys=("a", "b")))


query("mf_train")(lambda s, d: models.item_factors(visits(s, d)))
query("mf_pairs_train")(lambda s, d: embeddings.next_item_factors(sessions.next_pairs(visits(s, d)).select("aid", "aid_next")))
# The tables draw items almost independently, so that five negatives leave no entry; with one there are some.
query("skip_gram_train")(lambda s, d: embeddings.skip_gram_vectors(sessions_held(s, d), negatives=1))
query("w2v_train")(lambda s, d: models.item_vectors(visits(s, d)))


def trained(spark, d):
    k = Kept(spark, d)
    rows = features.with_weights(candidates.labelled(k.pairs, k.truth), features.session_weights(k.kept))
    return held(sampling.folds(features.count_actions(rows, k.kept), 2))


RANKER = [*WEIGHTS, "candidate_all_before"]
query("gbt_scores")(lambda s, d: models.cross_fit(trained(s, d), "gt_clicks", RANKER, 2, rounds=3, depth=3)[0])
query("gbt_importance")(lambda s, d: models.cross_fit(trained(s, d), "gt_clicks", RANKER, 2, rounds=3, depth=3)[1])
query("feature_codes")(lambda s, d: (lambda rows: boosting.coded(rows, boosting.code_cuts(rows, RANKER)))(trained(s, d)))


@query("boosted_rounds")
def boosted_rounds(spark, d):
    """(round, auc): the held-out AUC after each round, trained on byte codes until it rises no more."""
    rows = trained(spark, d)
    rows = held(boosting.coded(rows, boosting.code_cuts(rows, RANKER)), "codes")
    history = boosting.boosted(rows, "gt_clicks", RANKER, depth=4).history
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(history, 1)], "round int, auc double")


def coded_rows(spark, d):
    rows = trained(spark, d)
    return held(boosting.coded(rows, boosting.code_cuts(rows, RANKER)), "codes")


# Settings by successive halving, on the same codes.
query("search_trials")(lambda s, d: boosting.halving(coded_rows(s, d), "gt_clicks", RANKER, trials=8, first=1, most=4)[1])


@query("ranked_rounds")
def ranked_rounds(spark, d):
    """(round, recall): the held-out recall of each session's best 20 after each round of the pairwise ranker, until it rises no more."""
    history = boosting.ranked(coded_rows(spark, d), "gt_clicks", RANKER, depth=4).history
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(history, 1)], "round int, recall double")


query("gbt_tuned")(lambda s, d: models.tune_ranker(trained(s, d), "gt_clicks", RANKER, depths=(2, 3), rounds=(2, 4)))
