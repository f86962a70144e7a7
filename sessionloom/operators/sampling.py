"""Samples and splits that come out the same on every run: chosen by arithmetic on ids, not by random numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.expr import arithmetic_hash
from sessionloom.functions.stretches import cut_points, stretch


def _order(df: DataFrame, seed: int):
    return arithmetic_hash(F.col("session") * 31 + F.col("candidates"), seed, 1_000_003)


def negatives(labelled: DataFrame, target: str, ratio: float, seed: int = 42) -> DataFrame:
    """All positives, and int(positives / ratio) negatives (ratio -1: none), those with the smallest hash.

    Negatives are taken by a hash threshold with exact completion inside its bucket, so they aren't sorted in one place.
    """
    if ratio == -1:
        return labelled.where(F.col(target) == 1)
    n = F.broadcast(labelled.agg(F.floor(F.sum(F.col(target)) / F.lit(float(ratio))).cast("long").alias("want")))
    neg = labelled.where(F.col(target) == 0).withColumn("h", _order(labelled, seed))
    counts = neg.groupBy("h").agg(F.count("*").alias("c"))
    # At most as many rows as the hash has values.
    upto = counts.withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy("h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cut = upto.crossJoin(n).where("before < want").select("h", (F.col("want") - F.col("before")).alias("take"))
    nth = F.row_number().over(Window.partitionBy("h").orderBy("session", "candidates"))
    chosen = neg.join(cut, "h").withColumn("nth", nth).where("nth <= take").select(labelled.columns)
    return labelled.where(F.col(target) == 1).unionByName(chosen)


def sample_n(rows: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n rows of (session, candidates, ...), those with the smallest hash."""
    return rows.withColumn("h", _order(rows, seed)).orderBy("h", "session", "candidates").limit(n).drop("h")


def quantile(rows: DataFrame, share: float, key: str, stretches: int = 1024) -> DataFrame:
    """One row `q`: the exact quantile of a whole-number key, between two values in proportion.

    Keys are counted by stretches of about equally many rows, from a quantile sketch; only the stretches that hold the two values are looked at key by key.
    """
    counts = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("v")).agg(F.count("*").alias("c"))
    counts = counts.withColumn("stretch", stretch(F.col("v"), cut_points(rows, key, stretches)))
    upto = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy("stretch").agg(F.sum("c").alias("n"))  # at most `stretches` rows
    at = totals.agg(((F.sum("n") - 1) * F.lit(float(share))).alias("at"))
    held = totals.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).crossJoin(F.broadcast(at))
    held = held.where((F.col("before") <= F.ceil("at")) & (F.col("before") + F.col("n") > F.floor("at")))
    some = counts.join(F.broadcast(held.select("stretch", "before", "at")), "stretch")  # two rows at most
    within = Window.partitionBy("stretch").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    some = some.withColumn("through", F.col("before") + F.sum("c").over(within))
    covers = lambda p: (F.col("through") - F.col("c") <= p) & (F.col("through") > p)
    value = lambda p: F.max(F.when(covers(p), F.col("v"))).cast("double")
    two = some.agg(value(F.floor("at")).alias("a"), value(F.ceil("at")).alias("b"), F.max("at").alias("at"))
    return two.select((F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at"))).alias("q"))


def under_quantile(rows: DataFrame, share: float, key: str = "session") -> DataFrame:
    """rows whose key is under the exact quantile of the rows' keys."""
    return rows.crossJoin(F.broadcast(quantile(rows, share, key))).where(F.col(key) < F.col("q")).drop("q")


def modulo(rows: DataFrame, m: int, r: int, key: str = "session") -> DataFrame:
    return rows.where(F.pmod(F.col(key), F.lit(m)) == r)


def folds(rows: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """rows with `fold`, the same for all rows of a session."""
    return rows.withColumn("fold", arithmetic_hash(F.col("session"), seed, k).cast("int"))


def with_targets(rows: DataFrame, target: str) -> DataFrame:
    """All rows of sessions that have a positive, and one row, the smallest candidate, of the others."""
    seen = rows.withColumns({"has": F.max(target).over(Window.partitionBy("session")), "nth": F.row_number().over(Window.partitionBy("session").orderBy("candidates"))})
    return seen.where("has = 1 OR nth = 1").drop("has", "nth")
