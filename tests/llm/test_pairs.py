"""Near duplicates of texts and vectors, and connected components, against brute force."""

import itertools

import numpy as np
import pandas as pd
import pytest

from sessionloom.llm import minhash, multi_index
from sessionloom.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def closure(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text, width):
    w = text.encode().lower().split() if text else []
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def test_components(spark):
    edges = [(9, 8), (8, 7), (7, 1), (5, 4), (4, 4), (5, 4), (20, 21), (22, 21), (23, 22), (24, 23), (None, 3), (25, 24)]
    got = {r.id: r.component_id for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {9: 1, 8: 1, 7: 1, 1: 1, 5: 4, 4: 4, 20: 20, 21: 20, 22: 20, 23: 20, 24: 20, 25: 20}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_a_long_path(spark):
    n = 300
    edges = [(int(a), int(b)) for a, b in zip(np.random.default_rng(1).permutation(n), np.roll(np.random.default_rng(1).permutation(n), 1), strict=True)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == n and {r.component_id for r in got} == {0}


@pytest.mark.parametrize("width", [2, 5])
def test_documents_against_brute_force(spark, sf, width):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    sets = {r.doc_id: shingles(r.text, width) for r in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = closure(sets, links)
    got = {r.id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, width=width).collect()}
    assert got == {i: (len(s), want[i]) for i, s in sets.items()}
    kept = {r.doc_id for r in minhash.keep_first(docs, width=width).collect()}
    assert kept == {i for i, c in want.items() if i == c}


def test_variants_of_one_text_against_brute_force(spark):
    """Many texts around the threshold, so that links go through members other than the smallest."""
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for k in range(150):
        words = list(base)
        for at in rng.choice(60, rng.integers(0, 9), replace=False):
            words[at] = f"x{rng.integers(0, 30)}"
        texts.append((k, " ".join(words)))
    sets = {i: shingles(t, 2) for i, t in texts}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    got = {r.id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), width=2).collect()}
    assert got == closure(sets, links)


def test_bound_of_the_pre_test():
    """bits_apart against sums of the binomial distribution, for any threshold."""
    from math import comb

    assert minhash.bits_apart(0.8) == 20
    for t in (0.5, 0.7, 0.85, 0.95, 1.0):
        k, p = minhash.bits_apart(t), (1 - t) / 2
        tail = lambda n, p=p: sum(comb(64, i) * p**i * (1 - p) ** (64 - i) for i in range(n + 1, 65))
        assert tail(k) <= 1.1e-6 and (k == 0 or tail(k - 1) > 0.9e-6)


def test_scratch_tables_go(spark):
    from sessionloom.llm import common

    folders = lambda: {str(x.getPath().getName()) for x in fs.listStatus(at)} if fs.exists(at) else set()
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(common.scratch_dir(spark))
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    before = folders()
    df = spark.createDataFrame([(i, f"a b c d e f {i % 3}") for i in range(20)], "doc_id long, text string")
    assert minhash.near_duplicates(df).count() == 20 and minhash.keep_first(df).count() == 3
    left = folders() - before
    assert sorted(x.rpartition("-")[0] for x in left) == ["gone", "near-duplicates"]  # what the two results read


def test_documents_edge_cases(spark):
    long = " ".join(f"v{i % 5000}" for i in range(60_000))
    rows = [(7, None), (8, ""), (9, " \t\n"), (None, "a b c"), (3, "One two three"), (2, "one TWO\tthree"), (2, "one TWO\tthree"), (4, "one"), (5, "ONE"), (6, "É b"), (1, "é b"), (10, long), (11, long + " tail")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, id string, hashes int")
    got = {r.id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, width=2).collect()}
    assert got[7] == (0, 7) and got[8] == (0, 8) and got[9] == (0, 9)
    assert got[2] == (2, 2) and got[3] == (2, 2) and got[4] == (1, 4) and got[5] == (1, 4)
    assert got[6] == (1, 6) and got[1] == (1, 1)  # only A-Z is lower-cased
    assert got[10][1] == 10 and got[11][1] == 10
    kept = minhash.keep_first(df, width=2)
    assert kept.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, i) for i in (1, 2, 2, 4, 6, 7, 8, 9, 10)] + [(True, 0)]
    empty = df.limit(0)
    assert minhash.near_duplicates(empty, width=2).count() == 0 and minhash.keep_first(empty).count() == 0


def test_texts_under_one_id_are_judged_apart(spark):
    a, b, c = "one two three four five six", "seven eight nine ten eleven twelve", "red green blue black white grey"
    rows = [(1, a), (2, a), (2, b), (2, b), (3, b), (4, c), (4, c.upper()), (4, None), (None, a), (None, None), (5, "x y z")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, first int")
    got = sorted(((r.id or 0, r.n_shingles, r.component_id or 0) for r in minhash.near_duplicates(df, width=2).collect()))
    assert got == [(0, 0, 0), (0, 5, 0), (1, 5, 1), (2, 5, 1), (2, 5, 2), (2, 5, 2), (3, 5, 2), (4, 0, 4), (4, 5, 4), (4, 5, 4), (5, 2, 5)]
    kept = sorted(((r.doc_id or 0, r.text or "") for r in minhash.keep_first(df, width=2).collect()))
    assert kept == sorted([(1, a), (2, b), (2, b), (4, c.upper()), (4, ""), (0, a), (0, ""), (5, "x y z")])


def brute_vectors(ids, x, threshold=0.9):
    x = x / np.linalg.norm(x, axis=1)[:, None]
    s = x @ x.T >= threshold
    np.fill_diagonal(s, False)
    return s.sum(1), closure(ids, [(ids[i], ids[j]) for i, j in zip(*np.nonzero(s), strict=True)])


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 32))
    noise = rng.standard_normal((1200, 32)) * rng.choice([0.1, 0.25, 0.33], 1200)[:, None]
    x = np.concatenate([centres[rng.integers(0, 40, 1200)] + noise, rng.standard_normal((800, 32))])
    x[100:140] = x[100]
    rows = [(int(i), v.tolist(), 0) for i, v in enumerate(x)]
    got = multi_index.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), block=128).toPandas().set_index("id").sort_index()
    n, comp = brute_vectors(list(range(len(x))), x)
    assert (got["n_links"].to_numpy() <= n).all()
    assert got["n_links"].sum() >= 0.95 * n.sum()
    assert np.mean([got["component_id"][i] == comp[i] for i in range(len(x))]) > 0.97


@pytest.mark.parametrize("kind", ["rank 4", "rank 8", "spectrum", "clusters"])
def test_recall_of_anisotropic_vectors(spark, kind):
    """Neighbours that differ along the directions that separate the cells."""
    rng = np.random.default_rng(6)
    n, dim = 4000, 64
    if kind == "clusters":
        x = rng.standard_normal((400, dim))[rng.integers(0, 400, n)] + 0.3 * rng.standard_normal((n, dim))
    elif kind == "spectrum":
        x = rng.standard_normal((n, dim)) / np.arange(1, dim + 1)
    else:
        rank = int(kind.split()[1])
        x = rng.standard_normal((n, rank)) @ rng.standard_normal((rank, dim))
    got = multi_index.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).toPandas().set_index("id").sort_index()
    x /= np.linalg.norm(x, axis=1)[:, None]
    n_links = (x @ x.T >= 0.9).sum(1) - 1
    assert n_links.sum() > 5000 and (got["n_links"].to_numpy() <= n_links).all()
    assert got["n_links"].sum() >= 0.98 * n_links.sum()


@pytest.mark.parametrize("planted", [0.01, 0.03, 0.05])
def test_planted_neighbours_of_each_row(spark, planted):
    """64 dimensions, copies near and at the threshold: both ends of a link count it, and each row finds at least 0.9 of its own on average."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal((6000, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    x = np.concatenate([base, base[:1500] + planted * rng.standard_normal((1500, 64)), base[:500] + planted * rng.standard_normal((500, 64))])
    order = rng.permutation(len(x))
    x = x[order]
    got = multi_index.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"), block=500).toPandas().set_index("id").sort_index()
    f = x.astype(np.float32).astype(float)
    n, comp = brute_vectors(list(range(len(x))), f)
    mine = got["n_links"].to_numpy()
    assert (mine <= n).all() and mine.sum() % 2 == 0
    has = n > 0
    assert (mine[has] / n[has]).mean() >= 0.95 and mine.sum() >= 0.95 * n.sum()
    assert np.mean([got["component_id"][i] == comp[i] for i in np.flatnonzero(has)]) >= 0.95


@pytest.mark.parametrize("block", [7, 64, 5000])
def test_blocks_count_each_link_once_for_both_ends(block):
    """All block pairs of one cell, as near_vectors deals them out, against brute force."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.standard_normal((20, 8)).repeat(6, 0) + 0.2 * rng.standard_normal((120, 8)), rng.standard_normal((30, 8))])
    ids, members = np.arange(len(x)), np.arange(len(x)) % 3 > 0
    n, comp = brute_vectors(ids.tolist(), x)
    s = x / np.linalg.norm(x, axis=1)[:, None]
    linked = s @ s.T >= 0.9
    np.fill_diagonal(linked, False)
    linked[np.ix_(~members, ~members)] = False  # visitors aren't compared with each other
    verify, count, edges = multi_index._verify(0.9), np.zeros(len(x), int), []
    side = {True: np.array_split(ids[members], -(-members.sum() // block)), False: np.array_split(ids[~members], -(-(~members).sum() // block))}
    pairs = [(a, q, j == 0) for a in side[True] for j, q in enumerate(side[False])] + [(a, b, False) for i, a in enumerate(side[True]) for b in side[True][i + 1 :]]
    for a, b, alone in pairs:
        pdf = pd.DataFrame({"id": [*a, *b], "right": [False] * len(a) + [True] * len(b), "mult": 1, "vec": list(x[[*a, *b]]), "alone": alone})
        for r in verify(pdf).itertuples():
            count[r.id] += r.n
            edges.append((r.id, r.root))
    assert count.tolist() == linked.sum(1).tolist()
    assert closure(ids.tolist(), edges) == closure(ids.tolist(), list(zip(*np.nonzero(linked), strict=True)))


def test_table_recall(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    pdf = df.toPandas()
    n, comp = brute_vectors(pdf["vec_id"].tolist(), np.stack(pdf["embedding"]).astype(float))
    got = multi_index.near_vectors(df).toPandas().set_index("id")
    assert got["n_links"].sum() >= 0.9 * n.sum() and (got.loc[pdf["vec_id"], "n_links"].to_numpy() <= n).all()


def test_vectors_edge_cases(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [None, 1.0]), (6, [nan, 1.0]), (7, [inf, 0.0]), (8, []), (9, [1.0, 0.0, 0.0]), (10, [0.9, 0.4]), (11, [1.0, 0.0]), (None, [1.0, 0.0]), (12, [0.0, 1.0])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, id int")
    got = {r.id: (r.n_links, r.component_id) for r in multi_index.near_vectors(df).collect()}
    for i in (3, 4, 5, 6, 7, 8, 9, 12):
        assert got[i] == (0, i)
    assert got[1] == (3, 1) and got[2] == (3, 1) and got[11] == (3, 1) and got[10] == (3, 1)
    assert got[None] == (0, None)
    assert multi_index.near_vectors(df.limit(0)).count() == 0


def test_traversal_visits_by_rising_distance():
    rng = np.random.default_rng(0)
    a, b = rng.random(7), rng.random(5)
    got = list(multi_index.traverse(a, b, 10))
    d = [a[i] + b[j] for i, j in got]
    assert d == sorted(d) and len(set(got)) == 35
    assert pd.Series(d).is_monotonic_increasing
