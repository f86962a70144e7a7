"""Near-duplicate vectors by an inverted multi-index.

Vectors are scaled to length one and cut in halves; each half has a codebook of
its own (k-means on a sample of `sample` vectors, or PER_CODE for each code where that is more), and the product of the
codebooks is a grid of cells of about CELL vectors each, so its codes grow with the square root of the table. Every vector lives in its nearest cell. As a query, a vector
visits cells from the nearest on by multi-sequence traversal (a heap over the
two sorted half distances) until their distance is over that of the nearest by
`slack`. The slack is measured so that the wanted share of neighbours is met, and
is the largest of what four kinds of neighbours ask for: sampled vectors turned by the
threshold's angle in random directions of the full space, and in directions drawn with the sample's
covariance (where vectors have a low rank, neighbours differ along what separates
the cells); the sample's real neighbours; and those of them near the threshold.

Two vectors are compared once: within their cell, or where the one of the lower cell visits the higher; a link counts for both ends.
They are compared in double precision, in blocks of `block` by `block`. What is copied to a visited cell is the vector in the type of its table.

Equal vectors are collapsed first and count by their number. A cell with many
vectors is cut into blocks, so no task holds a cell; a block returns counts
and one link a member to its smallest, never pairs.

Vectors that are null, empty, zero or hold null or non-finite components link
with nothing, nor do vectors of different lengths with each other. A null id links with nothing and has a null
component. An id that comes with several vectors is one node, with the links of all of them.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import block_roots, components, keep, scratch, workers_find_package, written

CELL = 256  # vectors a cell, on average
PER_CODE = 16  # vectors of the sample for each code, at least
TILE = 1024  # rows of a block that are multiplied at once


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = nearest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(c))
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * x @ c.T)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return distances(x, c).argmin(1)


def traverse(d1: np.ndarray, d2: np.ndarray, slack: float):
    """Cells (i, j) by rising d1[i] + d2[j], until that is over the smallest by slack."""
    o1, o2 = d1.argsort(), d2.argsort()
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    stop = s1[0] + s2[0] + slack
    heap, n1, n2 = [(s1[0] + s2[0], 0, 0)], len(s1), len(s2)
    while heap:
        d, a, b = heapq.heappop(heap)
        if d > stop:
            return
        yield int(o1[a]), int(o2[b])
        if b + 1 < n2:
            heapq.heappush(heap, (s1[a] + s2[b + 1], a, b + 1))
        if b == 0 and a + 1 < n1:
            heapq.heappush(heap, (s1[a + 1] + s2[0], a + 1, 0))


class MultiIndex:
    def __init__(self, sample: np.ndarray, codes: int, threshold: float, recall: float, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.cut = sample.shape[1] // 2
        h1, h2 = self.halves(sample)
        self.c1, self.c2 = kmeans(h1, codes if self.cut else 1, rng), kmeans(h2, codes, rng)
        self.slack = self._slack(sample, threshold, recall, rng)

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.cut], x[:, self.cut :]

    def scores(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.halves(x)
        return distances(a, self.c1), distances(b, self.c2)

    def home(self, x: np.ndarray) -> np.ndarray:
        a, b = self.scores(x)
        return a.argmin(1) * len(self.c2) + b.argmin(1)

    def _excess(self, a: np.ndarray, b: np.ndarray, at: np.ndarray, home: np.ndarray) -> np.ndarray:
        """How much further than its nearest cell each query at[k], with half distances a and b, must look to visit home[k]."""
        i, j = np.divmod(home, len(self.c2))
        return a[at, i] + b[at, j] - a.min(1)[at] - b.min(1)[at]

    def _slack(self, sample: np.ndarray, threshold: float, recall: float, rng: np.random.Generator) -> float:
        picked = rng.choice(len(sample), 4000)
        x = sample[picked]
        a, b = self.scores(x)
        every = np.arange(len(x))
        kinds = []
        scale, axes = np.linalg.eigh(sample.T @ sample / len(sample))
        drawn = rng.standard_normal(x.shape)
        for turn in (drawn, (drawn * np.sqrt(np.maximum(scale, 0))) @ axes.T):
            turn = turn - (turn * x).sum(1)[:, None] * x
            norm = np.linalg.norm(turn, axis=1)[:, None]
            turn = np.where(norm > 1e-9, turn / np.maximum(norm, 1e-9), 0)
            kinds.append(self._excess(a, b, every, self.home(threshold * x + math.sqrt(1 - threshold**2) * turn)))
        # Real neighbours: each picked vector once, with all of the sample.
        home, (picked, first) = self.home(sample), np.unique(picked, return_index=True)
        real, close = [], []
        for lo in range(0, len(picked), 250):
            at = first[lo : lo + 250]
            cosine = x[at] @ sample.T
            cosine[np.arange(len(at)), picked[lo : lo + 250]] = -1
            q, y = np.nonzero(cosine >= threshold)
            real.append(self._excess(a, b, at[q], home[y]))
            close.append(cosine[q, y] <= threshold + 0.2 * (1 - threshold))
        real, close = np.concatenate(real), np.concatenate(close)
        kinds += [real, real[close]]
        return max(float(np.quantile(k, recall)) for k in kinds if len(k)) + 1e-9

    def visits(self, x: np.ndarray) -> list[list[int]]:
        a, b = self.scores(x)
        return [[i * len(self.c2) + j for i, j in traverse(p, q, self.slack)] for p, q in zip(a, b, strict=True)]


def unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def _verify(threshold: float):
    """Rows of one block pair: members (side 0) and what they are compared with (side 1); `alone`: the members with each other, too."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        right = pdf["right"].to_numpy()
        b, q = pdf[~right], pdf[right]
        ids = [b["id"].to_numpy(np.int64), q["id"].to_numpy(np.int64)]
        mult = [b["mult"].to_numpy(np.int64), q["mult"].to_numpy(np.int64)]
        x = [unit(v["vec"]) if len(v) else np.zeros((0, 1)) for v in (b, q)]
        n = [np.zeros(len(v), np.int64) for v in (b, q)]
        edges = []  # of each tile with a link: its rows, and the smallest id that each is connected to there
        for other in (0, 1):
            if not len(x[other]) or not len(x[0]) or (other == 0 and not pdf["alone"].iloc[0]):
                continue
            for lo in range(0, len(x[0]), TILE):
                for to in range(0, len(x[other]), TILE):
                    rows, cols = slice(lo, lo + TILE), slice(to, to + TILE)
                    linked = x[0][rows] @ x[other][cols].T >= threshold
                    linked &= ids[0][rows][:, None] != ids[other][cols][None, :]
                    if not linked.any():
                        continue
                    n[0][rows] += linked @ mult[other][cols]
                    if other:  # the members' square has both ends already
                        n[1][cols] += mult[0][rows] @ linked
                    low, some = block_roots(linked, ids[0][rows], ids[other][cols]), (linked.any(1), linked.any(0))
                    edges += [(ids[0][rows][some[0]], low[0][some[0]]), (ids[other][cols][some[1]], low[1][some[1]])]
        counts = [pd.DataFrame({"id": i[k > 0], "n": k[k > 0], "root": i[k > 0]}) for i, k in zip(ids, n, strict=True)]
        joined = pd.DataFrame({"id": np.concatenate([e[0] for e in edges]), "n": 0, "root": np.concatenate([e[1] for e in edges])}) if edges else counts[0][:0]
        return pd.concat([*counts, joined.drop_duplicates()])

    return run


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9, recall: float = 0.98, sample: int = 20_000, block: int = 2048
) -> DataFrame:
    """(id, n_links, component_id), one row for each row of vectors."""
    with scratch():
        return keep(_near(vectors, id_col, vec_col, threshold, recall, sample, block), "near-vectors")


def _near(vectors: DataFrame, id_col: str, vec_col: str, threshold: float, recall: float, sample: int, block: int) -> DataFrame:
    spark = vectors.sparkSession
    workers_find_package(spark)
    v = F.col("vec")
    kind = "array<float>" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast(kind).alias("vec"))
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.col("id").isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)
    named = rows.withColumn("good", F.coalesce(good, F.lit(False))).withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(7), v), "dim": F.size("vec")})
    keys = ["dim", "h1", "h2"]
    short = written(named.select("id", "good", *keys), "vectors")
    classes = written(short.where("good").groupBy(*keys).agg(F.min("id").alias("rep"), F.count("*").alias("mult")), "classes")
    reps = named.where("good").join(classes, [*keys]).where("id = rep").dropDuplicates(["id", *keys]).select("id", "vec", "mult", *keys)
    sizes = {r.dim: r["count"] for r in classes.groupBy("dim").count().collect()}  # lengths of vectors, few
    models = {}
    for dim, n in sizes.items():
        codes = int(max(2, round(math.sqrt(n / CELL))))
        most = max(sample, PER_CODE * codes)
        part = min(1.0, 1.2 * most / n)
        some = reps.where(F.col("dim") == dim).where(F.pmod(F.xxhash64("h1"), F.lit(1_000_003)) < int(part * 1_000_003) + 1).select("vec").limit(most)
        got = some.toPandas()["vec"]
        models[dim] = MultiIndex(unit(got if len(got) else [np.ones(dim)]), codes, threshold, recall)
    if not sizes:
        return short.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    sent = spark.sparkContext.broadcast(models)

    def place(batches):
        """A row where the vector lives, and one for each higher cell that it visits; lower ones visit it."""
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                model, x = sent.value[dim], unit(part["vec"])
                home = model.home(x)
                for at in range(0, len(part), 500):
                    some, own = part.iloc[at : at + 500], home[at : at + 500]
                    seen = [np.array([c for c in cells if c > h], np.int64) for cells, h in zip(model.visits(x[at : at + 500]), own.tolist(), strict=True)]
                    take = np.concatenate([np.arange(len(some)), np.repeat(np.arange(len(some)), [len(s) for s in seen])])
                    out = some.iloc[take][["dim", "id", "vec", "mult"]].copy()
                    out["cell"] = np.concatenate([own, *seen]).astype(np.int64)
                    out["visit"] = np.arange(len(take)) >= len(some)
                    yield out[["dim", "cell", "visit", "id", "mult", "vec"]]

    placed = written(reps.select("dim", "id", "vec", "mult").mapInPandas(place, f"dim int, cell long, visit boolean, id long, mult long, vec {kind}"), "placed")
    blocks = lambda c: F.ceil(F.count_if(c) / block).cast("int")
    parts = placed.groupBy("dim", "cell").agg(blocks(~F.col("visit")).alias("nb"), blocks(F.col("visit")).alias("nq"))
    # Block pairs of a cell: member block i with visitors' block j (0: visitors, and the members with each other where j is 0), and with member block j > i (1).
    dealt = placed.join(written(parts.where("nb > 0"), "cells"), ["dim", "cell"])
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("visit"), F.col("nq")).otherwise(F.col("nb"))).cast("int"))
    pair = lambda kind, i, j, right: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), F.lit(right).alias("right"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    own = F.col("own")
    visits = F.transform(upto(F.col("nb")), lambda i: pair(0, i, own, True))
    lives = F.concat(
        F.transform(upto(F.greatest("nq", F.lit(1))), lambda j: pair(0, own, j, False)),
        F.transform(F.filter(upto(F.col("nb")), lambda j: j > own), lambda j: pair(1, own, j, False)),
        F.transform(F.filter(upto(F.col("nb")), lambda i: i < own), lambda i: pair(1, i, own, True)),
    )
    dealt = dealt.select("dim", "cell", "id", "mult", "vec", F.inline(F.when(F.col("visit"), visits).otherwise(lives))).withColumn("alone", F.expr("kind = 0 AND j = 0"))
    keyed = dealt.groupBy("dim", "cell", "kind", "i", "j")
    found = written(keyed.applyInPandas(_verify(threshold), "id long, n long, root long"), "links")
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    joined = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    per_class = (
        classes.join(counts.withColumnRenamed("id", "rep"), "rep", "left")
        .join(joined.select(F.col("id").alias("rep"), "component_id"), "rep", "left")
        .select(*keys, (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    )
    every = short.join(written(per_class, "per-class").withColumn("good", F.lit(True)), [*keys, "good"], "left")
    return every.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
