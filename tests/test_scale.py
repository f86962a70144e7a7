"""Hot keys, wide ids and plans: what the catalogue's small tables don't show."""

import re
from bisect import bisect_right

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionloom import oracles
from sessionloom.functions import hold
from sessionloom.functions.stretches import cut_points, spread, stretch
from sessionloom.operators import candidates, covisitation, features, sampling, sessions, voting
from sessionloom.sources import adapters

E = "session long, aid long, ts long, type int, eid long"
FAR = [-(2**63), 2**63 - 1]


def test_stretches(spark):
    values = [*FAR, 0, 5, 5, 5, 9, None, *range(100, 200)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    cuts = cut_points(df, "v", 16)
    assert cuts == sorted(set(cuts)) and 10 <= len(cuts) <= 15
    for some in (cuts, cuts[:1], [], list(range(-5, 300, 7))):
        got = {r.v: r.s for r in df.select("v", stretch(F.col("v"), some).alias("s")).collect()}
        assert got == {v: None if v is None else bisect_right(some, v) for v in values}
    assert cut_points(df.where("v IS NULL"), "v") == []


def test_weights_of_ids_over_all_of_64_bits(spark):
    rng = np.random.default_rng(3)
    rows = [(int(s), int(rng.integers(0, 3)), int(rng.integers(0, 50)), 0, k) for k, s in enumerate([*FAR * 3, *rng.integers(-(2**63), 2**63 - 1, 200), *rng.integers(0, 9, 60)])]
    got = {r.eid: r.nth for r in features._numbered(spark.createDataFrame(rows, E), 16).collect()}
    for aid in range(3):
        own = sorted((r for r in rows if r[1] == aid), key=lambda r: (r[0], -r[2], -r[4]))
        assert [got[r[4]] for r in own] == list(range(1, len(own) + 1))
    assert features.event_weights(spark.createDataFrame(rows, E)).count() == len(rows)


def test_quantile_of_ids_over_all_of_64_bits(spark):
    keys = [*FAR, -7, 0, 3, 3, 3, 12]
    df = spark.createDataFrame([(k,) for k in keys], "session long")
    for share in (0.0, 0.3, 0.5, 0.9, 1.0):
        assert sampling.quantile(df, share, "session").first().q == pytest.approx(float(np.quantile(np.array(keys, float), share)))


def test_one_item_of_all_events_is_spread(spark):
    """A hot item, and one session id far from all others: stretches stay about equal."""
    events = spark.range(100_000).selectExpr("CASE WHEN id = 0 THEN -(1L << 62) ELSE id END AS session", "7L AS aid", "id AS ts", "0 AS type", "id AS eid")
    cuts = cut_points(events, "session", 256)
    sizes = [r["count"] for r in events.groupBy(stretch(F.col("session"), cuts).alias("s")).count().collect()]
    assert len(sizes) >= 200 and max(sizes) <= 5 * 100_000 / 256


def test_held_tables_go_with_their_block(spark):
    df = spark.range(5)
    with hold.scratch():
        a = hold.held(df, "a")
        b = hold.keep(df, "b")
        assert a.count() == 5
    assert b.count() == 5 and not hold.own_dir(spark).startswith(hold.own_dir(spark, "llm"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FileNotFound|FILE_NOT_EXIST"):
        spark.read.parquet(a.inputFiles()[0]).count()
    hold.clear(spark, "of-this-test")


def random_events(n, sessions, items, seed, span=40 * 86_400):
    rng = np.random.default_rng(seed)
    return [(int(rng.integers(0, sessions)), int(rng.integers(0, items)), int(t), int(rng.choice([0, 0, 1, 2])), k) for k, t in enumerate(np.sort(rng.integers(0, span // 600, n)) * 600)]


@pytest.fixture(scope="module")
def crowded(spark):
    """Few sessions with many events of few items, many of them at one time."""
    rows = random_events(1500, 4, 12, 1)
    con = duckdb.connect()
    con.execute("CREATE TABLE v (session BIGINT, aid BIGINT, ts BIGINT, type INT, eid BIGINT)")
    con.executemany("INSERT INTO v VALUES (?, ?, ?, ?, ?)", rows)
    return spark.createDataFrame(rows, E).cache(), con


@pytest.mark.parametrize("name", sorted(n for n in covisitation.SPECS if not n.endswith("_40")))
def test_matrices_of_crowded_sessions(crowded, monkeypatch, name):
    """Blocks of three items, and intervals shorter than sessions, against SQL over all pairs of events."""
    monkeypatch.setattr(covisitation, "BLOCK", 3)
    events, con = crowded
    spec = covisitation.SPECS[name]
    want = con.execute(f"SELECT * FROM {oracles.covis(spec, 'v', 0, 40 * 86_400, chunk=2)}").fetchall()
    for e in (events, covisitation.prepared(events)):
        got = covisitation.covisitation(e, spec, 0, 40 * 86_400, chunk=2)
        assert sorted(map(tuple, got.select("aid_x", "aid_y", "wgt_e9", "rank").collect())) == sorted(want)


def test_a_session_over_a_year_makes_few_pairs(spark):
    """100,000 events of one session: pairs within two hours stay in proportion to them, and those within 14 days to its items."""
    e = spark.range(100_000).selectExpr("1L AS session", "id * 7919 % 300 AS aid", "id * 315 AS ts", "CAST(id % 3 AS INT) AS type", "id AS eid")
    near = covisitation._near_in_time(e, e, covisitation.SPECS["239"])
    assert near.count() <= 25 * 100_000
    buys = e.where("type <> 0")
    made = covisitation._near_in_time(buys, buys, covisitation.SPECS["90"])
    assert made.count() <= 3 * 27 * 300 * 300
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert "to#" in plan.split("Join Inner")[1].split("\n")[0] and "bucket#" in plan.split("Join Inner")[1].split("\n")[0]


def test_a_hot_session_is_paired_in_blocks(spark):
    """One session with 4000 items beside small ones: its pairs are dealt to 64 keys of about equal size, and count once."""
    e = spark.range(4000).selectExpr("1L AS session", "id AS aid", "id AS ts", "CAST(id % 3 AS INT) AS type", "id AS eid").unionByName(spark.range(3000).selectExpr("2 + id DIV 3 AS session", "id AS aid", "id AS ts", "0 AS type", "id AS eid"))
    met = covisitation._in_blocks(e, e, F.expr("x.aid <> y.aid"))
    keys = [r["count"] for r in met.where("x.session = 1").groupBy("x.bx", "x.by").count().collect()]
    assert len(keys) == 64 and sum(keys) == 4000 * 3999 and max(keys) <= 3 * sorted(keys)[32]
    assert met.where("x.session <> 1").count() == 1000 * 6 and met.where("x.session <> 1 AND x.bx + x.by > 0").count() == 0
    before = covisitation._before(e.where("session = 1"), e.where("session = 1 AND aid % 100 = 0"))
    assert before.count() == sum(range(0, 4000, 100))


def test_cuts_to_the_best_are_limited_before_they_are_sorted(spark, sf):
    events = adapters.visit_events(spark, sf)
    for df in (candidates.popular(events), sessions.last_items(events)):
        assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()


def test_ranks_in_arrays(spark):
    rng = np.random.default_rng(9)
    rows = [(s, k, float(rng.integers(0, 400)), None if k % 7 == 0 else float("nan") if k % 11 == 0 else float(rng.choice([-0.0, 0.0, 1.5, float("-inf")]))) for s, n in ((1, 700), (2, 3), (None, 5)) for k in range(n)]
    df = spark.createDataFrame(rows, "session long, candidates long, x double, `y.z` double")
    got = {(r.session, r.candidates): (r.x_rank, r["y.z_rank"]) for r in features.ranks(df, ["x", "y.z"]).collect()}
    real = lambda v: v is not None and v == v
    for s, k, x, y in rows:
        own = [r for r in rows if r[0] == s]
        want = [min(255, 1 + sum(real(r[c]) and (not real(v) or r[c] > v) for r in own)) for c, v in ((2, x), (3, y))]
        assert got[s, k] == tuple(want)
    assert "Generate" not in features.ranks(df, ["x", "y.z"])._jdf.queryExecution().executedPlan().toString()


def test_votes_are_planned_step_by_step(spark):
    """The driver never has the plan of a whole suggester: each step is a table."""
    empty = lambda kinds: spark.createDataFrame([], kinds)
    sizes = []

    def noted(df):
        sizes.append(df._jdf.queryExecution().analyzed().toString().count("\n"))
        return empty(df.schema)

    seeds, lists = empty("session long, list string, aid long, pos int"), empty("matrix string, aid_x long, aid_y long, rank int")
    for spec in voting.SPECS.values():
        noted(voting.suggest(empty(E), seeds, lists, spec, fast=empty("session long, aid long, pos int"), popular=empty("aid long, pos int"), hold=noted))
    assert max(sizes) <= 60


def test_votes_of_cooccurrence_grow_by_tasks(spark):
    """Partitions grow with the events, and votes are counted by hash without sorting them first or shuffling the session's items apart."""
    events = spark.range(0, 90_000, 1, 2).selectExpr("id div 3 AS session", "id % 50 AS aid", "id AS ts", "0 AS type", "id AS eid")
    lists = spark.range(50 * 40).selectExpr("id div 40 AS aid_x", "id % 40 AS aid_y", "CAST(id % 40 AS INT) + 1 AS rank")
    got = candidates.cooccurring(events, [lists, lists], 40)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "REPARTITION_BY_NUM" in plan
    assert spread(events, "session", 1000).rdd.getNumPartitions() == 90
    assert {r.candidates for r in got.where("session = 16").collect()} == {*range(40), 48, 49, 0}


def test_training_rows_are_dealt_by_their_number(spark, monkeypatch):
    from sessionloom.operators import models

    monkeypatch.setattr(models, "ROWS_A_TASK", 100)
    rows = spark.range(5000).coalesce(1).selectExpr("id AS session", "id AS candidates")
    sizes = [len(p) for p in models._dealt(rows).rdd.glom().collect()]
    assert sum(sizes) == 5000 and len(sizes) == 50 and max(sizes) < 300


def test_matrices_take_sessions_dealt_by_number(spark, monkeypatch):
    from sessionloom import catalog

    parts, matrix = [], catalog.matrix
    monkeypatch.setattr(catalog, "spread", lambda rows, key: spread(rows, key, 100))
    monkeypatch.setattr(catalog, "matrix", lambda e, n: parts.append(e.rdd.getNumPartitions()) or matrix(e, n))
    events = hold.held(spark.range(3000).selectExpr("id DIV 3 AS session", "id % 7 AS aid", "1704067200 + id AS ts", "CAST(id % 3 AS INT) AS type", "id AS eid"))
    want = [sorted(map(tuple, matrix(events, n).collect())) for n in ("temporal", "type136")]
    assert [sorted(map(tuple, m.collect())) for m in catalog.two(events)] == want and min(parts) >= 30


def shuffles(df):
    """Keys of a plan's exchanges, by name, each as often as it comes."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.sub(r"#\d+L?", "", m) for m in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)]


def test_neighbours_meet_without_a_join(spark):
    """Matrices by position shuffle the events once, not twelve rows for each of them."""
    events = spark.range(3000).selectExpr("id div 30 AS session", "id % 7 AS aid", "id AS ts", "CAST(id % 3 AS INT) AS type", "id AS eid")
    got = covisitation.covisitation(events, covisitation.SPECS["235"], 0, 3000)
    assert shuffles(got).count("session") == 1 and "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_votes_are_summed_where_they_are_made(spark):
    seeds = hold.held(spark.range(60).selectExpr("id div 3 AS session", "'all' AS list", "id % 20 AS aid", "CAST(id % 3 AS INT) AS pos", "3L AS n", "false AS long", "false AS lone"))
    lists = hold.held(spark.range(400).selectExpr("'93' AS matrix", "id div 20 AS aid_x", "id % 20 AS aid_y", "CAST(id % 20 AS INT) + 1 AS rank"))
    votes = voting._votes(seeds, lists, [(1, False, voting.VoteSource("93", "all", 5, double=True)), (2, False, voting.VoteSource("93", "all", 3))])
    assert shuffles(votes) == ["session"]
    assert {(r.aid, r.v) for r in votes.where("session = 0").collect()} == {(0, 9 * 10**9), (1, 6 * 10**9), (2, 6 * 10**9), (3, 3 * 10**9), (4, 3 * 10**9)}


def test_pairs_stay_with_their_session(spark):
    """Features of pairs that small tables are joined to: pairs are dealt by session once, and by nothing else."""
    events = hold.held(spark.range(300).selectExpr("id div 3 AS session", "id % 20 AS aid", "1704067200 + id AS ts", "CAST(id % 3 AS INT) AS type", "id AS eid"))
    pairs = hold.held(spark.range(1000).selectExpr("id div 10 AS session", "id % 10 AS candidates"))
    vectors = hold.held(spark.range(15).selectExpr("id AS aid", "array(CAST(id AS DOUBLE), 1.0D) AS vec"))
    weights = hold.held(features.session_weights(events))
    got = features.factor_features(pairs, events, vectors, weights)
    assert "session, candidates" not in shuffles(got) and not any("aid, candidates" in k or "candidates, aid" in k for k in shuffles(got)) and got.count() == 1000
    assert not any("candidates" in k for k in shuffles(features.popularity(pairs, events, 1704067200)))


def test_actions_are_counted_in_more_tasks(spark):
    """The tasks that pairs and events meet in grow in number with the events."""
    events = hold.held(spark.range(0, 900_000).selectExpr("id div 3 AS session", "id % 50 AS aid", "id AS ts", "0 AS type", "id AS eid"))
    got = features.count_actions(spark.range(30).selectExpr("id AS session", "id % 50 AS candidates"), events)
    assert re.search(r"hashpartitioning\(session, candidates, 45\), REPARTITION_BY_NUM", re.sub(r"#\d+L?", "", got._jdf.queryExecution().executedPlan().toString()))
    assert {r.session for r in got.where("candidate_all_before = 1").collect()} == {0, 24, 25}


def test_scores_come_of_the_votes(spark):
    """Blended lists of cut sessions need one shuffle of the events, and the scores are those of a join over all votes."""
    from sessionloom.operators import evaluation

    events = hold.held(spark.range(300).selectExpr("id div 5 AS session", "id * id % 13 AS aid", "id AS ts", "0 AS type", "id AS eid"))
    lists = {n: hold.held(spark.range(10 * 6).selectExpr("id div 6 AS aid_x", f"(id * {k}) % 11 AS aid_y", "CAST(id % 6 AS INT) + 1 AS rank", f"id * {k} + 1 AS wgt_e9")) for n, k in (("a", 3), ("b", 5))}
    got = candidates.cooccurring(events, list(lists.values()), 8, scores=("a", "b"))
    want = candidates.cooccurring(events, list(lists.values()), 8)
    for n, m in lists.items():
        sums = events.join(m, F.col("aid") == F.col("aid_x")).groupBy("session", F.col("aid_y").alias("candidates")).agg(F.sum("wgt_e9").alias(n))
        want = want.join(sums, ["session", "candidates"], "left")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    top = evaluation.top_lists(evaluation.blend_by_class(got, {"clicks": {"a": 0.5, "b": 0.5}, "orders": {"a": 1.0}}), 3, ("session", "type"))
    assert shuffles(top).count("session") == 1 and not any("candidates" in k or "type" in k for k in shuffles(top))
