"""Candidate sets of sessions: from matrices, labelled, blended."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.stretches import spread

CLASSES = ("clicks", "carts", "orders")


def popular(events: DataFrame, n: int = 100) -> DataFrame:
    """(type, aid, n_events, pos): each type's most frequent items."""
    counts = events.groupBy("type", "aid").agg(F.count("*").alias("n_events"))
    w = Window.partitionBy("type").orderBy(F.desc("n_events"), "aid")
    return counts.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n).withColumn("pos", F.col("pos") - 1)


def by_class(ranked: DataFrame) -> DataFrame:
    """Rows of popular() with the class's name as their type."""
    return ranked.withColumn("type", F.element_at(F.array(*[F.lit(c) for c in CLASSES]), F.col("type") + 1))


def cooccurring(events: DataFrame, matrices: list[DataFrame], n: int = 100, scores: tuple[str, ...] = ()) -> DataFrame:
    """(session, candidates, *scores): a session's own items and what its events call up from the matrices.

    An event contributes one vote for each item of its item's lists. Over n votes, only the n items with most votes stay, ties by
    the earliest vote (events in order, then the matrices' lists in order). scores names the matrices: a column each, the sum of its weights (wgt_e9) over all
    votes for the candidate, null if there are none; it comes of the same votes, in the session's own task.
    """
    along = Window.partitionBy("session").orderBy("ts", "eid")
    e = spread(events.select("session", "aid", "ts", "eid"), "session").select("session", "aid", F.row_number().over(along).alias("k"))
    lists = None
    for which, m in enumerate(matrices):
        one = m.select(F.col("aid_x").alias("aid"), F.struct("aid_y", F.lit(which).alias("m"), "rank", *(["wgt_e9"] if scores else [])).alias("one"))
        lists = one if lists is None else lists.unionByName(one)
    lists = lists.groupBy("aid").agg(F.collect_list("one").alias("lists"))
    # An event's own item comes with its votes, without a place, so that both are one aggregate in the session's partition.
    own = F.array(F.struct(F.col("aid").alias("aid_y"), F.lit(None).cast("int").alias("m"), F.lit(None).cast("int").alias("rank"), *([F.lit(None).cast("long").alias("wgt_e9")] if scores else [])))
    votes = e.join(lists, "aid", "left").select("session", "k", F.inline(F.concat(own, F.coalesce("lists", F.array()))))
    # The earliest vote as one number: event, matrix, place in its list.
    first = F.col("k") * (1 << 32) + F.col("m") * (1 << 24) + F.col("rank")
    votes = votes.groupBy("session", F.col("aid_y").alias("candidates")).agg(F.count("m").alias("votes"), F.min(first).alias("first"), F.max(F.col("m").isNull()).alias("own"), *[F.sum(F.when(F.col("m") == k, F.col("wgt_e9"))).alias(s) for k, s in enumerate(scores)])
    # What has no vote comes last and moves no place.
    ranked = votes.withColumn("place", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("votes"), "first"))).withColumn("total", F.sum("votes").over(Window.partitionBy("session")))
    return ranked.where(((F.col("votes") > 0) & ((F.col("total") <= n) | (F.col("place") <= n))) | F.col("own")).select("session", "candidates", *scores)


def labelled(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """candidates(session, candidates) with gt_clicks, gt_carts, gt_orders (0 or 1); truth(session, type, ground_truth)."""
    hits = truth.select("session", "type", F.explode("ground_truth").alias("candidates")).groupBy("session", "candidates")
    hits = hits.agg(*[F.max((F.col("type") == c).cast("int")).alias(f"gt_{c}") for c in CLASSES])
    out = candidates.dropDuplicates(["session", "candidates"]).join(hits, ["session", "candidates"], "left")
    return out.select("session", "candidates", *[F.coalesce(f"gt_{c}", F.lit(0)).alias(f"gt_{c}") for c in CLASSES])


def blended(sets: list[DataFrame]) -> DataFrame:
    """Distinct (session, candidates) of several sets."""
    out = sets[0].select("session", "candidates")
    for s in sets[1:]:
        out = out.unionByName(s.select("session", "candidates"))
    return out.distinct()


def unseen(candidates: DataFrame, events: DataFrame) -> DataFrame:
    """candidates that the session has no event of."""
    return candidates.join(events.select("session", F.col("aid").alias("candidates")).distinct(), ["session", "candidates"], "left_anti")


def one_per_session(rows: DataFrame, order: str) -> DataFrame:
    """The first row of each session by a column that tells rows apart."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("session").orderBy(order))).where("nth = 1").drop("nth")
