"""Recall metrics, blending of scores, and submissions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.expr import ratio

CLASS_WEIGHTS = {"clicks": 0.1, "carts": 0.3, "orders": 0.6}


def top_lists(scored: DataFrame, k: int = 20, keys: tuple[str, ...] = ("session",)) -> DataFrame:
    """(*keys, preds): each session's (and type's, with that key) k best candidates, ties by candidate."""
    w = Window.partitionBy(*keys).orderBy(F.desc("pred"), "candidates")
    top = scored.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k)
    return top.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "candidates"))), lambda x: x["candidates"]).alias("preds"))


def coverage(lists: DataFrame, truth: DataFrame, k: int = 20) -> DataFrame:
    """(type, n_preds, n_gts, n_found, recall): sessions with predictions and truth; at most k of each session count."""
    both = lists.join(truth, "session")
    found = F.least(F.lit(k), F.size(F.array_intersect("ground_truth", "preds")))
    n = both.groupBy("type").agg(F.sum(F.size("preds")).cast("long").alias("n_preds"), F.sum(F.least(F.lit(k), F.size("ground_truth"))).cast("long").alias("n_gts"), F.sum(found).cast("long").alias("n_found"))
    return n.withColumn("recall", ratio(F.col("n_found").cast("double"), F.col("n_gts").cast("double")))


def official_scores(lists: DataFrame, truth: DataFrame, k: int = 20) -> DataFrame:
    """(type, n_gts, n_found, recall) over all labelled sessions, with predictions or not."""
    both = truth.join(lists, "session", "left")
    hits = F.coalesce(F.size(F.array_intersect("ground_truth", F.slice("preds", 1, k))), F.lit(0))
    hits = F.when(F.col("preds").isNull(), 0).otherwise(F.least(F.lit(k), hits))
    n = both.groupBy("type").agg(F.sum(F.least(F.lit(k), F.size("ground_truth"))).cast("long").alias("n_gts"), F.sum(hits).cast("long").alias("n_found"))
    return n.withColumn("recall", ratio(F.col("n_found").cast("double"), F.col("n_gts").cast("double")))


def weighted_recall(scores: DataFrame, weights: dict[str, float] = CLASS_WEIGHTS) -> DataFrame:
    """(score): the classes' recalls by weight; one row."""
    w = F.lit(0.0)
    for c, v in weights.items():
        w = F.when(F.col("type") == c, F.lit(v)).otherwise(w)
    return scores.agg(F.coalesce(F.sum(w * F.col("recall")), F.lit(0.0)).alias("score"))


def blend(models: list[tuple[DataFrame, float]]) -> DataFrame:
    """(session, candidates, pred): weighted sum of models' scores, a missing one counting 0."""
    out = None
    for scored, w in models:
        one = scored.select("session", "candidates", (F.col("pred") * F.lit(float(w))).alias("pred"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("session", "candidates").agg(F.sum("pred").alias("pred"))


def blend_by_class(scored: DataFrame, weights: dict[str, dict[str, float]]) -> DataFrame:
    """(session, type, candidates, pred) of scored(session, candidates, one column a score): each class's weighted sum, a missing score counting 0. Scores are read once for all classes."""
    sums = [F.struct(F.lit(c).alias("type"), reduce(lambda a, b: a + b, [F.coalesce(F.col(s), F.lit(0.0)) * F.lit(float(w)) for s, w in of.items()]).alias("pred")) for c, of in weights.items()]
    return scored.select("session", "candidates", F.inline(F.array(*sums))).select("session", "type", "candidates", "pred")


def padded(lists: DataFrame, popular: DataFrame, k: int = 20) -> DataFrame:
    """lists(session, type, preds) filled to k with the most popular items of their own type, in order, which may repeat.

    popular(type, aid, pos) names types as lists does. Lists of one class have no type, nor have its popular items.
    """
    keys = [c for c in ("type",) if c in lists.columns]
    ranked = F.array_sort(F.collect_list(F.when(F.col("pos") < k, F.struct("pos", "aid"))))
    top = F.broadcast(popular.groupBy(*keys).agg(F.transform(ranked, lambda x: x["aid"]).alias("top")))  # a row a class
    missing = F.greatest(F.lit(0), F.lit(k) - F.size("preds"))
    pad = F.slice(F.coalesce("top", F.array().cast("array<long>")), F.lit(1), missing)
    met = lists.join(top, keys, "left") if keys else lists.crossJoin(top)
    return met.select("session", *keys, F.slice(F.concat("preds", pad), 1, k).alias("preds"))


def submission(lists: DataFrame | dict[str, DataFrame]) -> DataFrame:
    """(session_type, labels) of lists(session, type, preds), or of each class's lists(session, preds)."""
    if isinstance(lists, dict):
        every = [one.select("session", F.lit(c).alias("type"), "preds") for c, one in lists.items()]
        lists = reduce(DataFrame.unionByName, every)
    return lists.select(F.concat_ws("_", F.col("session").cast("string"), "type").alias("session_type"), F.array_join(F.transform("preds", lambda x: x.cast("string")), " ").alias("labels"))


def parse_submission(rows: DataFrame) -> DataFrame:
    """(session, type, preds) of (session_type, labels); an empty list stays empty."""
    key = F.split("session_type", "_")
    ids = F.transform(F.filter(F.split("labels", " "), lambda x: x != ""), lambda x: x.cast("long"))
    return rows.select(key[0].cast("long").alias("session"), key[1].alias("type"), ids.alias("preds"))
