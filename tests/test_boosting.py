"""Boosting, its AUC and its byte codes against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionloom import catalog
from sessionloom.operators import boosting


def plain_auc(y, s):
    pos, neg = [v for v, t in zip(s, y, strict=True) if t], [v for v, t in zip(s, y, strict=True) if not t]
    return np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg]) if pos and neg else None


@pytest.fixture(scope="module")
def table(spark):
    """A target of two features and their product, noise, and one feature that is missing where the target is likely."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(3000):
        a, b, noise = rng.random(3)
        y = int(rng.random() < 1 / (1 + np.exp(-6 * (a + a * b - 0.9))))
        miss = None if rng.random() < (0.8 if y else 0.2) else float("nan") if rng.random() < 0.01 else float(rng.random())
        rows.append((i // 5, i, float(a), float(b), float(noise), miss, y))
    return spark.createDataFrame(rows, "session long, candidates long, a double, b double, noise double, gone double, gt int").cache()


NAMES = ["a", "b", "noise", "gone"]


def test_auc_by_buckets(spark):
    rng = np.random.default_rng(1)
    for n, levels in ((300, 20), (50, 3), (2, 2)):
        y, s = rng.integers(0, 2, n).tolist(), (rng.integers(0, levels, n) / levels).tolist()
        df = spark.createDataFrame(list(zip(y, s, strict=True)), "gt int, pred double")
        want = plain_auc(y, s)
        got = boosting.auc(df, "gt").first().auc
        assert got == want if want is None else got == pytest.approx(want)
    one = spark.createDataFrame([("x", 1, 0.5), ("y", 1, 1.0), ("y", 0, 0.2)], "k string, gt int, pred double")
    assert {r.k: r.auc for r in boosting.auc(one, "gt", keys=("k",)).collect()} == {"x": None, "y": 1.0}
    assert boosting.auc(one.limit(0), "gt", keys=("k",)).count() == 0


def test_training_stops_where_the_auc_says(spark, table):
    model = boosting.boosted(table, "gt", NAMES, rounds=25, patience=2, depth=2, rate=1.0)
    best = int(np.argmax(model.history)) + 1
    assert len(model.trees) == best and (len(model.history) == best + 2 or len(model.history) == 25)
    held = table.where(boosting.arithmetic_hash(F.col("session"), 42, 1000) < 200)
    for k in (1, best):  # what was measured on the way is what the model scores
        rows = held.join(model.score(held, k), ["session", "candidates"]).select("gt", "pred").collect()
        assert model.history[k - 1] == pytest.approx(plain_auc([r.gt for r in rows], [r.pred for r in rows]), abs=2e-3)
    assert model.history[best - 1] > 0.85


def test_missing_values_go_their_own_way(spark, table):
    """By one split on a feature whose missing values belong with the large ones, and on one where with the small ones."""
    rows = [(k, k, None if k % 3 == 0 else float(k % 100), int(k % 3 == 0 or k % 100 > 70)) for k in range(1500)]
    df = spark.createDataFrame(rows, "session long, candidates long, x double, gt int")
    for data in (df, df.withColumn("x", -F.col("x"))):
        model = boosting.boosted(data, "gt", ["x"], rounds=1, depth=1)
        assert model.history[0] == 1.0


def test_codes_are_a_byte_and_as_good(spark, table):
    cuts = boosting.code_cuts(table, NAMES)
    codes = boosting.coded(table, cuts)
    assert [t for c, t in codes.dtypes if c in NAMES] == ["tinyint"] * 4 and all(len(c) <= 254 for c in cuts.values())
    both = codes.select("candidates", F.col("gone").alias("code")).join(table.select("candidates", "gone"), "candidates").collect()
    for r in both:
        v = r.gone if r.gone is not None and r.gone == r.gone else None
        assert r.code == (boosting.MISSING if v is None else sum(c <= v for c in cuts["gone"]) - 127)
    exact = boosting.boosted(table, "gt", NAMES, rounds=12, patience=12, depth=3)
    coarse = boosting.boosted(codes, "gt", NAMES, rounds=12, patience=12, depth=3)
    assert abs(max(exact.history) - max(coarse.history)) < 0.002 or max(coarse.history) > max(exact.history)


def plain_swaps(rows, k):
    """(label, margin) of one session in order of candidates -> (residual, weight) each."""
    order = sorted(range(len(rows)), key=lambda i: (-rows[i][1], i))
    top = {i: at < k for at, i in enumerate(order)}
    w = 1 / max(1, min(k, sum(y for y, _ in rows)))
    g, h = [0.0] * len(rows), [0.0] * len(rows)
    for i, (yi, mi) in enumerate(rows):
        for j, (yj, mj) in enumerate(rows):
            if yi and not yj and top[i] != top[j]:
                rho = 1 / (1 + np.exp(mi - mj))
                g[i], g[j], h[i], h[j] = g[i] + w * rho, g[j] - w * rho, h[i] + w * rho * (1 - rho), h[j] + w * rho * (1 - rho)
    return list(zip(g, h, strict=True))


def test_swaps_and_recall_against_plain_python(spark):
    rng = np.random.default_rng(4)
    for k in (1, 3, 50):
        sessions = [[(int(rng.random() < 0.3), float(rng.integers(0, 6) / 3)) for _ in range(n)] for n in (1, 2, 7, 12)]
        df = spark.createDataFrame([(s, c, c + 100 * s, float(y), m) for s, rows in enumerate(sessions) for c, (y, m) in enumerate(rows)], "session long, candidates long, features long, label double, margin double")
        got = {r.features: (r.residual, r.weight) for r in boosting._swaps(df, k).collect()}
        found = hits = 0
        for s, rows in enumerate(sessions):
            for c, want in enumerate(plain_swaps(rows, k)):
                assert got[c + 100 * s] == pytest.approx(want, abs=1e-12)
            best = sorted(rows, key=lambda r: -r[1])[:k]  # sorting keeps the order of candidates in ties
            found, hits = found + sum(y for y, _ in best), hits + min(k, sum(y for y, _ in rows))
        assert boosting._recall(df, k) == pytest.approx(found / hits)
    assert np.isnan(boosting._recall(df.limit(0), 3))


def test_pairs_rank_better_than_chances(spark):
    """Chances depend mostly on the session, which can't order its candidates; a shallow tree of logistic residuals spends its rounds there."""
    rng = np.random.default_rng(5)
    rows = []
    for s in range(250):
        busy = rng.random()
        for c in range(12):
            own, noise = rng.random(2)
            rows.append((s, c, float(busy), float(own), float(noise), int(rng.random() < 0.85 * busy**4 * (0.1 + own))))
    df = spark.createDataFrame(rows, "session long, candidates long, busy double, own double, noise double, gt int").cache()
    names, how = ["busy", "own", "noise"], {"rounds": 2, "patience": 2, "depth": 1, "rate": 0.5}
    held_out = df.where(boosting.arithmetic_hash(F.col("session"), 42, 1000) < 200)

    def recall(model):
        return boosting._recall(model.margin(held_out).withColumn("label", F.col("gt").cast("double")), 3)

    pairs, chances = boosting.ranked(df, "gt", names, k=3, **how), boosting.boosted(df, "gt", names, **how)
    assert recall(pairs) == pytest.approx(max(pairs.history))
    assert recall(pairs) > recall(chances) + 0.02
    small = boosting.ranked(df.where("candidates < 3"), "gt", names, k=3, rounds=1)  # nothing to swap
    assert small.history == [1.0] and all(v == 0 for v in small.leaves[0])


def test_search_finds_the_planted_setting(spark, table):
    """A tree of one split at a crawl can't get there in few rounds; others can."""
    space = {"depth": (1, 4), "rate": (0.0001, 0.5)}
    model, trials = boosting.halving(table, "gt", NAMES, trials=4, first=1, most=4, space=space)
    got = [tuple(r) for r in trials.collect()]
    rungs = {k: [r for r in got if r[1] == k] for k in (1, 2, 3)}
    assert [len(rungs[k]) for k in rungs] == [4, 2, 1] and [rungs[k][0][2] for k in rungs] == [1, 2, 4]
    for k in (1, 2):  # those that go on are the best
        assert {r[0] for r in rungs[k + 1]} == {r[0] for r in rungs[k][: len(rungs[k + 1])]} and rungs[k] == sorted(rungs[k], key=lambda r: (-r[3], r[0]))
    assert rungs[3][0][4] == 4 and max(model.history) == rungs[3][0][3] and len(model.trees) == model.history.index(max(model.history)) + 1
    # A trial's rounds after a rung are those of an unbroken training.
    same = boosting.boosted(table, "gt", NAMES, rounds=4, patience=4, depth=4, rate=rungs[3][0][5])
    assert model.history == pytest.approx(same.history)
    assert boosting.settings(boosting.SPACE, 20, 42) == boosting.settings(boosting.SPACE, 20, 42) and len({tuple(s.items()) for s in boosting.settings(boosting.SPACE, 20, 42)}) == 20


def test_nothing_to_train_on(spark, table):
    model = boosting.boosted(table.limit(0), "gt", NAMES, rounds=3)
    assert model.trees == [] and boosting.code_cuts(table.limit(0), NAMES) == {c: [] for c in NAMES}
    assert model.score(table.limit(5)).count() == 5
    assert boosting.ranked(table.limit(0), "gt", NAMES, rounds=3).trees == []
    model, trials = boosting.halving(table.limit(0), "gt", NAMES, trials=3)
    assert model.trees == [] and trials.count() == 3


def test_rounds_are_made_on_distinct_rows(spark, table):
    """Rows that come ten times are one row of the rounds, with their number, and teach what they taught."""
    codes = boosting.coded(table, boosting.code_cuts(table, NAMES, bins=4)).cache()
    ten = codes.crossJoin(spark.range(10).select((F.col("id") * 1_000_003 * 1000).alias("more"))).withColumn("session", F.col("session") + F.col("more")).drop("more")
    laid = boosting._laid_out(ten, "gt", NAMES, 0.2, 42)
    assert laid.agg(F.sum("n")).first()[0] == 30_000 and laid.count() == codes.withColumn("o", boosting.arithmetic_hash(F.col("session"), 42, 1000) < 200).select(*NAMES, "gt", "o").distinct().count() < 3000
    for train in (boosting.boosted, lambda *a, **k: boosting.ranked(*a, k=2, **k)):
        one, all_ = (train(d, "gt", NAMES, rounds=1, depth=2) for d in (codes, ten))
        assert one.history == pytest.approx(all_.history)
        margins = [[r.margin for r in m.margin(codes).orderBy("candidates").select("margin").collect()] for m in (one, all_)]
        assert np.std(margins[0]) > 0 and np.corrcoef(*margins)[0, 1] > 0.999
    few = boosting.boosted(codes, "gt", NAMES, rounds=1, depth=3, least=900)  # rows, not distinct ones
    sizes = few.trees[0].transform(boosting._laid_out(codes, "gt", NAMES, 0.2, 42).where("NOT held_out").withColumn("margin", F.lit(0.0))).groupBy("leaf").agg(F.sum("n").alias("n")).collect()
    assert len(sizes) > 1 and min(r.n for r in sizes) >= 900


@pytest.mark.parametrize("name", ["boosted_rounds", "ranked_rounds"])
def test_queries_train_until_the_measure_rises_no_more(spark, sf, monkeypatch, name):
    """A measure that rises for 40 rounds gets them all, and ten more; one that is never there doesn't keep the training going."""

    def fake(values):
        def one(model, rows, **how):
            model.trees.append(None), model.leaves.append([]), model.history.append(values(len(model.history)))
            return rows

        return one

    monkeypatch.setattr(boosting, "_round", fake(lambda k: min(k, 39) / 100))
    assert catalog.QUERIES[name](spark, sf).count() == 50
    model = boosting._until_best(boosting.Boosted([], 0.0), None, 20, 10)
    assert len(model.history) == len(model.trees) == 20  # a number that is asked for holds
    monkeypatch.setattr(boosting, "_round", fake(lambda k: float("nan")))
    assert len(boosting._until_best(boosting.Boosted([], 0.0), None, None, 10).trees) == 10
