"""Item vectors trained on pairs of items: factors with in-batch negatives, and skip-gram with negatives as a factorised matrix. Weights live in tables, never on the driver."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions import hold
from sessionloom.functions.hold import held, keep, scratch
from sessionloom.operators.sessions import along


def strata(blocks: int) -> list[list[tuple[int, int]]]:
    """Rounds of (i, j), i <= j, in which no block comes twice and which together hold every pair of blocks once: the blocks alone, then the circle method."""
    n = blocks + blocks % 2
    out = [[(i, i) for i in range(blocks)]]
    for r in range(n - 1):
        pairs = [(r, n - 1), *[((r + k) % (n - 1), (r - k) % (n - 1)) for k in range(1, n // 2)]]
        out.append(sorted((min(p), max(p)) for p in pairs if max(p) < blocks))
    return [s for s in out if s]


def _normal(seed: int, k) -> Column:
    """A number around 0 with variance 1 / 3 from an item's id: the same on every run."""
    return F.xxhash64("aid", k, F.lit(seed)) / F.lit(2.0**63)


def _slope(e: np.ndarray, sides: list[tuple[np.ndarray, np.ndarray, float]]) -> np.ndarray:
    """Slope of the logistic loss in vectors e for pairs of their numbers, each side with the outcome of its pairs. Few vectors make a square matrix of pairs, many only those that come."""
    g = np.zeros_like(e)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    for a, b, outcome in sides:
        if len(e) ** 2 <= 4 * len(a):
            w = np.bincount(a * len(e) + b, minlength=len(e) ** 2).reshape(len(e), -1) * (outcome - sigmoid(e @ e.T))
            g += (w + w.T) @ e
        else:
            keys, n = np.unique(a * len(e) + b, return_counts=True)
            a, b = np.divmod(keys, len(e))
            w = (n * (outcome - sigmoid((e[a] * e[b]).sum(1))))[:, None]
            np.add.at(g, np.concatenate([a, b]), np.concatenate([w * e[b], w * e[a]]))
    return g


def _descent(rate: float, batch: int, seed: int, epoch: int):
    """One pass over the pairs of a cell. Of a batch, each pair is an example, and its first item with the second of another pair, by a permutation, a counterexample."""

    def step(key, pairs: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if pairs.empty or own.empty:
            return own[["aid", "block", "vec", "acc"]]
        own, pairs = own.sort_values("aid"), pairs.sort_values(["aid", "aid_next"])
        ids = own["aid"].to_numpy()
        e, acc = np.stack(own["vec"].to_numpy()).astype(np.float64), np.stack(own["acc"].to_numpy()).astype(np.float64)
        each = np.repeat(np.arange(len(pairs)), pairs["n"].to_numpy())
        a, b = np.searchsorted(ids, pairs["aid"].to_numpy())[each], np.searchsorted(ids, pairs["aid_next"].to_numpy())[each]
        rng = np.random.default_rng([seed, epoch, int(key[0]), int(key[1])])
        order = rng.permutation(len(a))
        for at in range(0, len(order), batch):
            u, v = a[order[at : at + batch]], b[order[at : at + batch]]
            w = v[rng.permutation(len(v))]
            # Of equal pairs one product is made, and they count as often as they come.
            rows, back = np.unique(np.concatenate([u, v, w]), return_inverse=True)
            back = back.reshape(3, -1)
            g = _slope(e[rows], [(back[0], back[1], 1.0), (back[0], back[2], 0.0)]) / len(u)
            acc[rows] += g * g
            e[rows] += rate * g / np.sqrt(acc[rows] + 1e-12)
        return pd.DataFrame({"aid": ids, "block": own["block"].to_numpy(), "vec": list(e), "acc": list(acc)})

    return step


def next_item_factors(pairs: DataFrame, rank: int = 64, epochs: int = 20, rate: float = 0.1, batch: int = 65_536, block_items: int = 50_000, seed: int = 42) -> DataFrame:
    """(aid, vec) so that vec . vec tells items that follow each other: logistic loss on pairs(aid, aid_next), against as many pairs of a batch put together anew.

    Stratified descent: items are dealt to blocks of about block_items by hash, and pairs to cells by both blocks. In a round, each block is in one cell at most, so cells are trained side by side
    on their own two blocks; the rounds of an epoch hold every cell once. A task has the vectors of two blocks and the distinct pairs between them. Each round's vectors are a table.
    """
    with scratch():
        n = held(pairs.where("aid IS NOT NULL AND aid_next IS NOT NULL").groupBy("aid", "aid_next").agg(F.count("*").alias("n")), "pairs")
        items = n.select("aid").unionByName(n.select(F.col("aid_next").alias("aid"))).distinct()
        blocks = max(1, -(-items.count() // block_items))
        block = lambda c: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(blocks)).cast("int")
        cells = n.withColumns({"x": block("aid"), "y": block("aid_next")})
        cells = held(cells.select("aid", "aid_next", "n", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j")), "cells")
        start = F.transform(F.sequence(F.lit(0), F.lit(rank - 1)), lambda k: _normal(seed, k))
        vectors = held(items.select("aid", block("aid").alias("block"), start.alias("vec"), F.array_repeat(F.lit(0.0), rank).alias("acc")), "factors")
        for epoch in range(epochs):
            for stratum in strata(blocks):
                met = {b: cell for cell in stratum for b in cell}
                rows = [(b, *met.get(b, (b, b))) for b in range(blocks)]  # a block without a partner waits
                where = F.broadcast(pairs.sparkSession.createDataFrame(rows, "block int, i int, j int"))
                now = F.broadcast(pairs.sparkSession.createDataFrame(stratum, "i int, j int"))
                own = vectors.join(where, "block").groupBy("i", "j")
                trained = cells.join(now, ["i", "j"]).groupBy("i", "j").cogroup(own).applyInPandas(_descent(rate, batch, seed, epoch), "aid long, block int, vec array<double>, acc array<double>")
                before, vectors = vectors, held(trained, "factors")
                hold.drop(before)
        return keep(vectors.select("aid", "vec"), "item-factors")


def shifted_pmi(events: DataFrame, window: int = 3, negatives: int = 5, sample: float = 1e-3) -> DataFrame:
    """(a, b, v): by how much two items stand within `window` places of each other more often than by chance, as log, less log(negatives); only what is over 0.

    That is the matrix which skip-gram with so many negatives factorises. Places are counted as often as the thinning of frequent items (by `sample`, as usual for it) leaves them on average.
    """
    e = events.select("session", "aid", F.row_number().over(along()).alias("k"))
    left = e.withColumn("to", F.explode(F.array(*[F.col("k") + d for d in range(-window, window + 1) if d]))).select("session", F.col("aid").alias("a"), F.col("to").alias("k"))
    n = left.join(e.withColumnRenamed("aid", "b"), ["session", "k"]).groupBy("a", "b").agg(F.count("*").alias("n"))
    of = events.groupBy("aid").agg(F.count("*").alias("c"))
    total = F.broadcast(of.agg(F.sum("c").alias("all")))  # one row
    share = sample * F.col("all") / F.col("c")
    kept = of.crossJoin(total).select("aid", F.least(F.lit(1.0), F.sqrt(share) + share).alias("kept"))
    n = n.join(kept.select(F.col("aid").alias("a"), F.col("kept").alias("ka")), "a").join(kept.select(F.col("aid").alias("b"), F.col("kept").alias("kb")), "b").select("a", "b", (F.col("n") * F.col("ka") * F.col("kb")).alias("n"))
    sums = n.groupBy("a").agg(F.sum("n").alias("na"))
    whole = F.broadcast(sums.agg(F.sum("na").alias("t")))  # one row
    v = F.log(F.col("n") * F.col("t") / F.col("na") / F.col("nb")) - F.log(F.lit(float(negatives)))
    met = n.join(sums, "a").join(sums.select(F.col("a").alias("b"), F.col("na").alias("nb")), "b").crossJoin(whole)
    return met.select("a", "b", v.alias("v")).where("v > 0")


def _products(rows: DataFrame, left: str, right: str, d: int) -> np.ndarray:
    """Sum of the outer products of two vector columns, d x d: one matrix a partition goes to the driver."""

    def run(batches):
        total = np.zeros((d, d))
        for pdf in batches:
            if len(pdf):
                total += np.stack(pdf[left].to_numpy()).T @ np.stack(pdf[right].to_numpy())
        yield pd.DataFrame({"m": [total.ravel()]})

    return np.sum([r.m for r in rows.select(*{left, right}).mapInPandas(run, "m array<double>").collect()] or [np.zeros(d * d)], axis=0).reshape(d, d)


def _times(rows: DataFrame, column: str, m: np.ndarray) -> DataFrame:
    """(aid, q): the vectors of a column times a small matrix."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"aid": pdf["aid"], "q": list(np.stack(pdf[column].to_numpy()) @ m) if len(pdf) else []})

    return rows.select("aid", column).mapInPandas(run, "aid long, q array<double>")


def factorised(matrix: DataFrame, size: int, rounds: int = 8, extra: int = 10, seed: int = 42) -> DataFrame:
    """(aid, vec): vectors whose products are nearest to a symmetric matrix(a, b, v) of non-negative spectrum, by randomised block power iteration.

    Each round multiplies the sparse table with a block of size + extra columns, one join and one sum with map-side partials, and makes the columns orthonormal through their
    small Gram matrix. Columns start from hashes of ids, and signs are fixed, so results don't depend on partitioning but for rounding.
    """
    d = size + extra
    with scratch():
        matrix = held(matrix, "matrix")
        start = F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda k: _normal(seed, k))
        q = matrix.select(F.col("a").alias("aid")).unionByName(matrix.select(F.col("b").alias("aid"))).distinct().select("aid", start.alias("q"))

        def multiplied(q: DataFrame) -> DataFrame:
            met = matrix.join(q.select(F.col("aid").alias("b"), *[F.get("q", F.lit(k)).alias(f"q{k}") for k in range(d)]), "b")
            return met.groupBy(F.col("a").alias("aid")).agg(*[F.sum(F.col("v") * F.col(f"q{k}")).alias(f"y{k}") for k in range(d)]).select("aid", F.array(*[f"y{k}" for k in range(d)]).alias("y"))

        for _ in range(rounds):
            y = held(multiplied(q), "block")
            values, axes = np.linalg.eigh(_products(y, "y", "y", d))
            q = _times(y, "y", axes * np.where(values > 1e-12 * max(values[-1], 1e-300), 1 / np.sqrt(np.maximum(values, 1e-300)), 0.0))
        q = held(q, "basis")
        met = held(q.join(multiplied(q), "aid"), "product")
        small = _products(met, "q", "y", d)
        values, axes = np.linalg.eigh((small + small.T) / 2)
        best = np.argsort(-values, kind="stable")[:size]
        axes = axes[:, best] * np.sign(axes[np.abs(axes[:, best]).argmax(axis=0), best])
        return keep(_times(q, "q", axes * np.sqrt(np.maximum(values[best], 0.0))).withColumnRenamed("q", "vec"), "item-vectors")


def skip_gram_vectors(events: DataFrame, size: int = 50, window: int = 3, negatives: int = 5, sample: float = 1e-3, rounds: int = 8, seed: int = 42) -> DataFrame:
    """(aid, vec): skip-gram with negative sampling over sessions as sentences, through the matrix that it factorises. Items that stand near none more often than by chance have no vector."""
    return factorised(shifted_pmi(events, window, negatives, sample), size, rounds, seed=seed)
