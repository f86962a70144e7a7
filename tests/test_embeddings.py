"""Vectors on planted groups of items, and the parts of their training by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionloom.operators import embeddings, models, sessions

E = "session long, aid long, ts long, type int, eid long"


@pytest.mark.parametrize("blocks", range(1, 9))
def test_strata_share_no_block_and_hold_every_cell_once(blocks):
    rounds = embeddings.strata(blocks)
    assert sorted(c for s in rounds for c in s) == [(i, j) for i in range(blocks) for j in range(i, blocks)]
    for s in rounds:
        used = [b for i, j in s for b in {i, j}]
        assert len(used) == len(set(used))


@pytest.fixture(scope="module")
def walks(spark):
    """120 items in 12 groups; a session goes through all groups, four items of each, so whole sessions say nothing about groups, and neighbours do."""
    rng = np.random.default_rng(5)
    rows, k = [], 0
    for s in range(240):
        for g in rng.choice(12, 12, replace=False):
            for a in rng.choice(10, 4, replace=False):
                rows.append((s, int(10**12 * (10 * g + a)), k, 0, k))
                k += 1
    return spark.createDataFrame(rows, E).cache()


def recall(vectors, truth, k=10):
    """Share of truth(aid, aid_next) among the k nearest others by product."""
    ids = sorted(vectors)
    m = np.array([vectors[i] for i in ids])
    s = m @ m.T
    np.fill_diagonal(s, -np.inf)
    near = {ids[i]: {ids[j] for j in np.argsort(-s[i])[:k]} for i in range(len(ids))}
    return np.mean([b in near.get(a, ()) for a, b in truth])


def test_factors_beat_sessions_at_next_items(spark, walks):
    train, held = walks.where("session < 200"), walks.where("session >= 200")
    truth = [(r.aid, r.aid_next) for r in sessions.next_pairs(held).collect()]
    pairs = sessions.next_pairs(train).select("aid", "aid_next")
    own = {r.aid: r.vec for r in embeddings.next_item_factors(pairs, rank=16, epochs=12, batch=512, block_items=45).collect()}
    als = {r.aid: r.vec for r in models.item_factors(train, rank=16, rounds=10).collect()}
    assert set(own) == set(als) and recall(own, truth) > recall(als, truth) + 0.05 and recall(own, truth) > 0.4


def test_factors_do_not_depend_on_partitions(spark, walks):
    pairs = sessions.next_pairs(walks.where("session < 30")).select("aid", "aid_next")
    got = [sorted((r.aid, r.vec) for r in embeddings.next_item_factors(p, rank=4, epochs=2, batch=100, block_items=50).collect()) for p in (pairs, pairs.repartition(9))]
    assert got[0] == got[1]
    assert embeddings.next_item_factors(pairs.limit(0), rank=4, epochs=1).count() == 0


def test_skip_gram_finds_planted_groups(spark, walks):
    got = []
    for n in ("4", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append({r.aid: np.array(r.vec) for r in embeddings.skip_gram_vectors(walks, size=12, negatives=2).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    ids = sorted(got[0])
    assert len(ids) == 120
    m = np.array([got[0][i] for i in ids])
    unit = m / np.linalg.norm(m, axis=1)[:, None]
    s = unit @ unit.T
    np.fill_diagonal(s, -np.inf)
    same = [ids[j] // 10**13 == ids[i] // 10**13 for i in range(120) for j in np.argsort(-s[i])[:9]]
    assert np.mean(same) > 0.95
    other = np.array([got[1][i] for i in ids])
    assert np.allclose(m @ m.T, other @ other.T, atol=1e-6)


def test_factorised_is_the_nearest_of_its_rank(spark):
    rng = np.random.default_rng(1)
    b = rng.standard_normal((30, 5)) * [5, 4, 3, 2, 1]
    m = b @ b.T
    rows = [(i, j, float(m[i, j])) for i in range(30) for j in range(30)]
    got = sorted((r.aid, r.vec) for r in embeddings.factorised(spark.createDataFrame(rows, "a long, b long, v double"), 3, extra=4).collect())
    v = np.array([x for _, x in got])
    values, axes = np.linalg.eigh(m)
    assert np.allclose(v @ v.T, (axes[:, -3:] * values[-3:]) @ axes[:, -3:].T, atol=1e-6)


def test_shifted_pmi_by_hand(spark):
    e = spark.createDataFrame([(1, 1, 1, 0, 1), (1, 2, 2, 0, 2), (2, 1, 1, 0, 3), (2, 2, 2, 0, 4), (3, 3, 1, 0, 5), (3, 4, 2, 0, 6)], E)
    got = {(r.a, r.b): r.v for r in embeddings.shifted_pmi(e, sample=10.0, negatives=1).collect()}
    assert {k: round(v, 9) for k, v in got.items()} == {(1, 2): round(np.log(2 * 6 / 4), 9), (2, 1): round(np.log(2 * 6 / 4), 9), (3, 4): round(np.log(6), 9), (4, 3): round(np.log(6), 9)}
    assert embeddings.skip_gram_vectors(e.limit(0), size=2).count() == 0


def test_slope_of_many_and_of_few_vectors():
    """By pairs that come, by all pairs of few vectors, and one pair after another."""
    rng = np.random.default_rng(3)
    e = rng.normal(size=(12, 4))
    for n in (10, 3000):
        a, b, c = rng.integers(0, 12, (3, n))
        want = np.zeros_like(e)
        for i, j, y in [*zip(a, b, [1.0] * n, strict=True), *zip(a, c, [0.0] * n, strict=True)]:
            w = y - 1 / (1 + np.exp(-e[i] @ e[j]))
            d, f = w * e[j], w * e[i]
            want[i] += d
            want[j] += f
        assert np.allclose(embeddings._slope(e, [(a, b, 1.0), (a, c, 0.0)]), want)
