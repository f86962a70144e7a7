"""Small cases worked out by hand, one for each rule that is easy to get wrong."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionloom.operators import candidates, evaluation, features, sampling, sessions, voting
from sessionloom.operators.covisitation import SPECS, CovisSpec, covisitation
from sessionloom.sources import adapters, sinks

E = "session long, aid long, ts long, type int, eid long"


@pytest.fixture
def events(spark):
    def make(*rows):
        return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], E)

    return make


def edges(df):
    return {(r.aid_x, r.aid_y): r.wgt_e9 for r in df.collect()}


def test_labels(events):
    rows = sessions.ground_truth(events((1, 5, 10, 0), (1, 7, 20, 1), (1, 9, 30, 0), (1, 7, 40, 2))).orderBy("ts").collect()
    assert [(r.label_click, r.label_carts, r.label_orders) for r in rows] == [(9, [7], [7]), (9, [], [7]), (None, [], [7])]


def test_label_of_item_zero(events):
    e = events((1, 5, 10, 0), (1, 0, 20, 0))
    assert sessions.ground_truth(e).first().label_click is None
    assert sessions.ground_truth(e, drop_zero_aid=False).first().label_click == 0


def test_single_event_sessions_have_no_cut(events):
    kept, labels = sessions.cut_sessions(events((1, 5, 10, 0), (2, 6, 10, 0), (2, 7, 11, 0)))
    assert [r.session for r in kept.collect()] == [2] and [r.session for r in labels.collect()] == [2]


def test_session_at_the_split(events):
    t = 10 * 86_400
    e = events((1, 1, t - 7 * 86_400, 0), (1, 2, t, 0), (2, 1, t - 8 * 86_400, 0), (3, 1, t - 86_400, 0))
    assert [r.session for r in sessions.train_part(e).collect()] == [2]
    assert [r.session for r in sessions.test_part(e).collect()] == [3]
    assert sessions.straddling_part(e).count() == 0


def test_pauses(events):
    e = events((1, 1, 0, 0), (1, 1, 7200, 0), (1, 1, 14_401, 0))
    assert [r.d for r in sessions.subsessions(e).orderBy("ts").collect()] == [0, 0, 1]
    late = events((1, 1, 10_000, 0), (1, 1, 17_200, 0), (1, 1, 24_401, 0))
    assert [r.d for r in sessions.subsessions_inclusive(late).orderBy("ts").collect()] == [1, 2, 3]


def test_position_weight_and_time_weight(events):
    rows = features.event_weights(events((1, 1, 0, 0), (1, 2, 1, 0), (1, 3, 60, 1))).orderBy(F.desc("ts")).collect()
    assert [round(r.w_pos_log, 7) for r in rows] == [1.0, 0.0717735, 0.0717735]
    assert [round(r.w_time, 9) for r in rows] == [round(x, 9) for x in (1 / math.log(2), 1 / math.log(2), 1 / math.log(3))]
    assert [r.w_type_163 for r in rows] == [6.0, 1.0, 1.0]


def test_a_pair_counts_once_a_session(events):
    got = edges(covisitation(events((1, 1, 0, 0), (1, 2, 10, 0), (1, 1, 20, 0), (1, 2, 30, 2)), SPECS["type136"], 0, 100))
    assert got == {(1, 2): 6_000_000_000, (2, 1): 1_000_000_000}  # the latest y


def test_a_day_apart_is_too_far(events):
    assert edges(covisitation(events((1, 1, 0, 0), (1, 2, 86_400, 0)), SPECS["type136"], 0, 100)) == {}
    assert len(edges(covisitation(events((1, 1, 0, 0), (1, 2, 86_399, 0)), SPECS["type136"], 0, 100))) == 2


def test_neighbours_reach_only_first_occurrences(events):
    e = events((1, 1, 0, 0), (1, 2, 1, 0), (1, 1, 2, 0), (1, 3, 3, 0))
    assert edges(covisitation(e, SPECS["217"], 0, 100)) == {(1, 2): 10**9, (2, 1): 10**9, (1, 3): 10**9}


def test_self_pairs(events):
    e = events((1, 1, 0, 0), (1, 1, 3600, 0))
    assert edges(covisitation(e, SPECS["116"], 0, 3600)) == {(1, 1): 0}
    assert edges(covisitation(e, SPECS["93"], 0, 3600)) == {}


def test_half_life(events):
    got = edges(covisitation(events((1, 1, 0, 0), (1, 2, 3600, 1)), SPECS["99"], 0, 3600))
    assert got == {}
    got = edges(covisitation(events((1, 1, 0, 2), (1, 2, 3600, 1)), SPECS["99"], 0, 3600))
    assert got == {(1, 2): 500_000_000, (2, 1): 500_000_000}


def test_best_n_and_symmetry(events, spark, sf):
    e = adapters.visit_events(spark, sf)
    plain = CovisSpec("plain", 0, "1", "x.aid <> y.aid")
    all_ = edges(covisitation(e, plain, 0, 1))
    assert all(all_[b, a] == w for (a, b), w in all_.items())
    top = covisitation(e, plain, 0, 1, top_n=3)
    assert top.groupBy("aid_x").count().agg(F.max("count")).first()[0] <= 3


def test_results_do_not_depend_on_partitions(spark, sf):
    got = []
    for n in ("1", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(sorted(map(tuple, covisitation(adapters.visit_events(spark, sf), SPECS["93"], 1_704_067_200, 1_706_659_200).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1]


def test_ranks(spark):
    rows = [(1, k, v) for k, v in enumerate([5.0, 5.0, 3.0, None, float("nan")])]
    df = spark.createDataFrame(rows, "session long, candidates long, x double")
    assert [r.x_rank for r in features.ranks(df, ["x"]).orderBy("candidates").collect()] == [1, 1, 3, 4, 4]
    many = df.withColumns({f"x{k}": F.col("x") * k for k in range(1, 10)})
    wide = features.ranks(many, [f"x{k}" for k in range(1, 10)]).orderBy("candidates").collect()
    assert [r.x3_rank for r in wide] == [1, 1, 3, 4, 4]


def test_rolling_hours(events):
    rows, k = [], 0
    for hour, n in ((0, 1), (1, 10), (2, 100), (5, 1000)):
        for _ in range(n):
            rows.append((k, 1, hour * 3600, 0))
            k += 1
    other = [(k + j, 2, h * 3600, 0) for j, h in enumerate((0, 1, 2, 5))]
    got = {r.hour // 3600: r.popularity_hour for r in features.popularity_hour(events(*rows, *other), shift=0).where("aid = 1").collect()}
    want = {0: (11, 2), 1: (111, 3), 2: (110, 2), 5: (1000, 1)}
    assert {h: round(v, 9) for h, v in got.items()} == {h: round(100 * a / (a + b), 9) for h, (a, b) in want.items()}


def test_votes_beyond_full_blocks_are_dropped(spark):
    source = voting.VoteSource("701", "all", 30, "w", head=30)
    size = lambda n: spark.range(n).selectExpr("id AS i", f"{n} AS size", "1 AS n", "0 AS pos", "1 AS rank").select(F.expr(voting.weight_sql(source)).alias("v")).agg(F.sum("v")).first()[0]
    assert size(29) is None and size(30) == size(59) == 32 * 10**9 and size(60) == 64 * 10**9


def test_recall_counts_twenty(spark):
    truth = spark.createDataFrame([(1, "carts", list(range(1, 26)))], "session long, type string, ground_truth array<long>")
    lists = spark.createDataFrame([(1, [*range(1, 19), 100, 101])], "session long, preds array<long>")
    r = evaluation.coverage(lists, truth).first()
    assert (r.n_preds, r.n_gts, r.n_found) == (20, 20, 18)
    alone = truth.unionByName(spark.createDataFrame([(2, "carts", [5])], truth.schema))
    assert evaluation.official_scores(lists, alone).first().n_gts == 21


def test_blend_of_one_sided_scores(spark):
    s = "session long, candidates long, pred double"
    a, b = spark.createDataFrame([(1, 1, 0.5)], s), spark.createDataFrame([(1, 2, 0.5), (1, 1, 0.5)], s)
    got = {r.candidates: r.pred for r in evaluation.blend([(a, 0.8), (b, 0.2)]).collect()}
    assert {k: round(v, 9) for k, v in got.items()} == {1: 0.5, 2: 0.1}
    assert {k: round(v, 9) for k, v in got.items()} == {r.candidates: round(r.pred, 9) for r in evaluation.blend([(b, 0.2), (a, 0.8)]).collect()}


def test_no_edge_counts_as_zero(spark, events):
    e = events((1, 1, 0, 0), (1, 2, 10, 0))
    pairs = spark.createDataFrame([(1, 9), (1, 8)], "session long, candidates long")
    matrix = spark.createDataFrame([(1, 8, 2 * 10**9)], "aid_x long, aid_y long, wgt_e9 long")
    got = {r.candidates: (r.m_mean, r.m_sum, r.m_max) for r in features.covisitation_features(pairs, e, matrix, features.session_weights(e)).collect()}
    assert got == {9: (0.0, 0.0, 0.0), 8: (1.0, 2.0, 2.0)}


def test_similarity_features(spark, events):
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (9, [0.4, math.sqrt(1 - 0.16)])], "aid long, vec array<double>")
    e = events((1, 1, 0, 0))
    pairs = spark.createDataFrame([(1, 2), (1, 9), (1, 7)], "session long, candidates long")
    got = {r.candidates: r for r in features.sequence_features(pairs, e, vec).collect()}
    assert got[2].w2v_max == pytest.approx(0.6) and got[2].w2v_count == 1 and got[2].w2v_mean == pytest.approx(0.3)
    assert got[9].w2v_max == 0 and got[7].w2v_count == 0


def test_short_sessions_have_minus_one(events):
    r = sessions.last_items(events((1, 7, 0, 0))).first()
    assert (r.last_0, r.last_1, r.last_4) == (7, -1, -1)


def test_missing_weights_are_half_the_least(spark, events):
    e = events((1, 1, 0, 0), (1, 2, 10, 1))
    pairs = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "session long, candidates long")
    got = {r.candidates: r.w_type_163 for r in features.with_weights(pairs, features.session_weights(e)).collect()}
    assert got == {1: 1.0, 2: 6.0, 3: 0.5}


def test_negatives(spark):
    rows = [(i, j, int(i == j)) for i in range(10) for j in range(10)]
    df = spark.createDataFrame(rows, "session long, candidates long, gt int")
    assert sampling.negatives(df, "gt", 0.5).groupBy("gt").count().collect().__len__() == 2
    assert sampling.negatives(df, "gt", 0.5).where("gt = 0").count() == 20
    assert sampling.negatives(df, "gt", -1).count() == 10
    assert sampling.negatives(df, "gt", 0.01).count() == 100


def test_padding_may_repeat(spark):
    lists = spark.createDataFrame([(1, [5, 6])], "session long, preds array<long>")
    popular = spark.createDataFrame([(5, 0), (9, 1), (8, 2)], "aid long, pos int")
    assert evaluation.padded(lists, popular, 4).first().preds == [5, 6, 5, 9]


def test_json_round_trip(spark, events, tmp_path):
    e = events((1, 5, 10, 0), (1, 6, 11, 1), (2, 7, 12, 2))
    sinks.write_json(adapters.nest_sessions(e), f"{tmp_path}/j")
    got = adapters.flatten_sessions(adapters.read_sessions_json(spark, f"{tmp_path}/j"), shift=100)
    assert sorted((r.session, r.aid, r.ts, r.type) for r in got.collect()) == [(101, 5, 10, "clicks"), (101, 6, 11, "carts"), (102, 7, 12, "orders")]


def test_sinks(spark, events, tmp_path):
    e = events((1, 5, 10_999, 0), (60_000, 6, 11_000, 1))
    sinks.write_grouped(e, f"{tmp_path}/g")
    assert sorted(p.name for p in tmp_path.glob("g/grp=*")) == ["grp=0", "grp=1"]
    raw = e.withColumn("type", F.element_at(F.array(F.lit("clicks"), F.lit("carts")), F.col("type") + 1))
    sinks.write_parquet(raw, f"{tmp_path}/p")
    assert sorted((r.ts, r.type) for r in adapters.read_events(spark, [f"{tmp_path}/p"]).collect()) == [(10, 0), (11, 1)]
    lists = spark.createDataFrame([(1, [5, 6]), (2, [])], "session long, preds array<long>")
    sinks.write_submission(evaluation.submission({"clicks": lists}), f"{tmp_path}/c")
    back = evaluation.parse_submission(adapters.read_csv(spark, f"{tmp_path}/c", "session_type string, labels string").na.fill(""))
    assert {r.session: r.preds for r in back.collect()} == {1: [5, 6], 2: []}


def test_blended_and_unseen(spark, events):
    e = events((1, 1, 0, 0))
    s = spark.createDataFrame([(1, 1), (1, 2)], "session long, candidates long")
    assert candidates.blended([s, s]).count() == 2 and [r.candidates for r in candidates.unseen(s, e).collect()] == [2]


def test_ranks_of_sessions_over_many_batches(spark):
    """A session that ends in another Arrow batch, infinities, and a plan that doesn't grow with the features."""
    values = [float("inf"), 3.0, float("-inf"), None, float("nan"), 3.0, -0.0, 0.0]
    rows = [(s, c, values[(c + (s or 0)) % 8]) for s in (None, 1, 2, 7) for c in range(40 if s == 2 else 8)]
    df = spark.createDataFrame(rows, "session long, candidates long, x double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        got = {(r.session, r.candidates): r.x_rank for r in features.ranks(df, ["x"], 20).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    real = lambda v: v is not None and v == v
    for s, c, v in rows:
        same = [w for t, _, w in rows if t == s and real(w)]
        assert got[s, c] == min(20, 1 + (sum(w > v for w in same) if real(v) else len(same))), (s, c, v)
    wide = df.select("session", "candidates", *[(F.col("x") + k).alias(f"x{k}") for k in range(20)])
    assert "collect_list" not in features.ranks(wide, [f"x{k}" for k in range(20)])._jdf.queryExecution().optimizedPlan().toString()


def test_widened_is_its_operators_in_parts(spark, monkeypatch):
    """Over many small parts, with a session without items, items without vectors or edges, and a vector that isn't finite; no row by pair and item is aggregated or ranked by a plan of its own."""
    monkeypatch.setattr(features, "WIDENED_A_PART", 4)
    rng = np.random.default_rng(8)
    rows = [(s, int(rng.integers(0, 9)), 1_704_067_200 + 60 * k, int(rng.integers(0, 3)), 100 * s + k) for s in range(12) for k in range(1 + s % 6)]
    e = spark.createDataFrame(rows, "session long, aid long, ts long, type int, eid long")
    pairs = spark.createDataFrame([(s, c) for s in (*range(12), 99) for c in range(s % 5 or 10)], "session long, candidates long")
    unit = features.unit_vectors(spark.createDataFrame([(a, [float(x) for x in rng.random(4)]) for a in range(7)], "aid long, vec array<double>"))
    odd = unit.where("aid <> 2").unionByName(spark.createDataFrame([(2, [float("nan")] * 4)], "aid long, vec array<double>"))
    sets = {"u": (unit, False), "u_buys": (odd, True)}
    mats = spark.createDataFrame([(m, x, y, int(rng.integers(1, 5)) * 10**9, 1) for m in ("p", "q") for x in range(9) for y in range(8) if rng.random() < 0.5], "matrix string, aid_x long, aid_y long, wgt_e9 long, rank int")
    own, items = features.held(features.with_weights(pairs, features.session_weights(e)).drop("w_time")), features.held(features.session_items(e))
    ranked = ["w_recsys", "u_seq_max", "u_last_0", "u_buys_lastday_mean", "matrix_q_mean"]
    table = features.widened(own, items, sets, mats, ["p", "q"], ranked)
    assert table.columns == [*own.columns, *features.wide_names(["u", "u_buys"], ["p", "q"]), *[f"{c}_rank" for c in ranked]] and len(table.columns) == 6 + 2 * 27 + 2 * 18 + 5
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Window" not in plan and "_mean" not in plan.split("FlatMapCoGroupsInArrow", 1)[1].split("\n", 1)[1]
    got = {(r.session, r.candidates): r.asDict() for r in table.collect()}
    assert len(got) == pairs.count()
    parts = [(features.covisitation_features(pairs, e, mats.where(F.col("matrix") == m), features.session_weights(e), f"matrix_{m}"), {}) for m in "pq"]
    for name, (vectors, buys) in sets.items():
        last, w = sessions.last_items(e, types=(1, 2) if buys else (0, 1, 2)), features.session_weights(e, no_click=buys)
        parts.append((features.last_item_similarity(pairs, last, vectors, name=name), {}))
        parts.append((features.factor_features(pairs, e, vectors, w, name), {f"{name}_{w}_{a}": f"{name}_{w.removeprefix('w_')}_{a}" for w in features.EVENT_WEIGHTS for a in ("mean", "sum", "max")}))
        parts.append((features.sequence_features(pairs, e, vectors, name), {f"{name}_{x}": f"{name}_seq_{x}" for x in ("max", "mean", "count", "wgt_1", "wgt_2", "last", "type")}))
    for part, names in parts:
        found = part.collect()
        assert len(found) == len(got)
        for r in found:
            for c in set(part.columns) - {"session", "candidates"}:
                assert got[r.session, r.candidates][names.get(c, c)] == pytest.approx(r[c], abs=1e-9), (c, r)
    for (s, _), r in got.items():
        for c in ranked:
            assert r[f"{c}_rank"] == 1 + sum(x[c] > r[c] for (t, _), x in got.items() if t == s), c
    odd_ids = own.where("session = 5 AND candidates < 4").unionByName(own.where("session = 7 AND candidates < 2").withColumn("session", F.lit(None).cast("long")))
    nothing = features.session_items(e.where("session = 5").withColumn("aid", F.lit(None).cast("long")))
    for r in features.widened(odd_ids, nothing, sets, mats, ["p", "q"], ranked).collect():  # null ids meet nothing, and are a session of their own
        assert r.matrix_p_sum == r.u_recsys_sum == 0.0 and r.u_last_0 == (0.0 if r.session else -1.0) and r.u_seq_max_rank == 1 and r.w_recsys_rank <= 4
    assert features.widened(own.limit(0), items, sets, mats, ["p", "q"], ranked).count() == 0
