"""Cutting a key's values into stretches of about equal numbers of rows, by a mergeable quantile sketch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of the sketch: ranks are right to about an eighth of a percent.
SKETCH = 4096


def cut_points(rows: DataFrame, key: str, n: int = 1024) -> list[int]:
    """At most n - 1 values of a whole-number key, rising, with about as many rows between any two; one pass with map-side sketches.

    Values are compared only, never subtracted, so they may span all 64 bits. Nulls don't count. The sketch is random, so cuts may differ from run to run:
    what is computed with them must not depend on where they are.
    """
    ranks = F.array(*[F.lit(k / n) for k in range(1, n)])
    sketch = rows.where(F.col(key).isNotNull()).agg(F.kll_sketch_agg_bigint(F.col(key).cast("long"), F.lit(SKETCH)).alias("s"), F.count("*").alias("n"))
    got = sketch.select(F.when(F.col("n") > 0, F.kll_sketch_get_quantile_bigint("s", ranks)).alias("q")).first()[0]
    return sorted(set(got or []))


def stretch(value: Column, cuts: list, kind: str = "long") -> Column:
    """How many of the cuts are at most the value, by binary search; null for null."""
    if not cuts:
        return F.when(value.isNotNull(), 0)
    at = F.array(*[F.lit(c).cast(kind) for c in cuts])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])
    found = F.aggregate(steps, F.lit(0), lambda low, step: F.when((low + step <= len(cuts)) & (F.get(at, low + step - 1) <= value), low + step).otherwise(low))
    return F.when(value.isNotNull(), found)


def spread(rows: DataFrame, key: str | list[str], per_task: int = 20_000) -> DataFrame:
    """rows dealt by a key or several to partitions of about so many, however many there are: for what makes many rows of each, whose tasks would else grow with what goes in, not with what comes of it.

    Rows are counted first, so they should be held.
    """
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // per_task)), *([key] if isinstance(key, str) else key))
