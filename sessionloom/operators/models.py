"""Thin wrappers over pyspark.ml for what the recommender trains."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler, Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.expr import arithmetic_hash
from sessionloom.functions.hold import fresh_dir, held
from sessionloom.functions.stretches import spread


def dense_ids(rows: DataFrame, col: str) -> DataFrame:
    """(col, dense): the distinct values of a column with numbers from 0 without gaps, in order; for models that take 32-bit ids.

    Values are sorted in ranges; a value's number is its place in its range and the values in the ranges before, of which there are as many as partitions.
    """
    ranged = held(rows.select(col).where(F.col(col).isNotNull()).distinct().repartitionByRange(F.col(col)).sortWithinPartitions(col).withColumn("at", F.monotonically_increasing_id()), "ranged")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes, before, run = sorted((r.part, r.n) for r in ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()), [], 0
    for k, n in sizes:
        before.append((k, run))
        run += n
    if run >= 1 << 31:
        raise ValueError(f"{run} distinct values of {col} don't fit 32-bit ids")
    first = F.broadcast(rows.sparkSession.createDataFrame(before, "part long, before long"))  # a row a partition
    return ranged.withColumn("part", part).join(first, "part").select(col, (F.col("before") + place).cast("int").alias("dense"))


#: Session-item pairs of a block of sessions, and of a block of items, to which each session's factors are sent once a round.
USERS_A_BLOCK, ITEMS_A_BLOCK = 100_000, 3_000_000


def item_factors(events: DataFrame, rank: int = 64, rounds: int = 20, seed: int = 42) -> DataFrame:
    """(aid, vec) by implicit-feedback factorisation of session x item counts. Ids of any size.

    A round sends the factors of all sessions to the items. Item factors are checkpointed after each, so that what it sent is deleted instead of staying for ten; blocks grow in number with the pairs.
    """
    spark = events.sparkSession
    n = held(events.where("session IS NOT NULL AND aid IS NOT NULL").groupBy("session", "aid").agg(F.count("*").cast("float").alias("n")), "counts")
    users, items, size = held(dense_ids(n, "session"), "users"), held(dense_ids(n, "aid"), "items"), n.count()
    n = n.join(users.withColumnRenamed("dense", "u"), "session").join(items.withColumnRenamed("dense", "i"), "aid").select("u", "i", "n")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(fresh_dir(spark, "factors"))
    blocks = {"numUserBlocks": max(10, -(-size // USERS_A_BLOCK)), "numItemBlocks": max(10, -(-size // ITEMS_A_BLOCK))}
    als = ALS(rank=rank, maxIter=rounds, implicitPrefs=True, userCol="u", itemCol="i", ratingCol="n", seed=seed, checkpointInterval=1, **blocks)
    found = als.fit(n).itemFactors
    return found.join(items, found["id"] == items["dense"]).select("aid", F.col("features").alias("vec"))


def item_vectors(events: DataFrame, size: int = 50, window: int = 3, rounds: int = 5, seed: int = 42) -> DataFrame:
    """(aid, vec) by word2vec over sessions as sentences."""
    s = events.groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "eid", "aid"))), lambda x: x["aid"].cast("string")).alias("words"))
    model = Word2Vec(vectorSize=size, windowSize=window, minCount=1, maxIter=rounds, seed=seed, inputCol="words", outputCol="v").fit(s)
    return model.getVectors().select(F.col("word").cast("long").alias("aid"), vector_to_array("vector").alias("vec"))


#: Rows of a task in training, which keeps them in memory: the files of many like rows are small, so that by their size a few tasks would get them all.
ROWS_A_TASK = 250_000


def _dealt(features: DataFrame) -> DataFrame:
    """features, which should be held, in as many partitions as their rows ask for."""
    return spread(features, "session", ROWS_A_TASK)


def _assembled(features: DataFrame, names: list[str]) -> DataFrame:
    safe = features.select("*", *[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(f"f{i}") for i, c in enumerate(names)])
    return VectorAssembler(inputCols=[f"f{i}" for i in range(len(names))], outputCol="features").transform(safe)


def train_ranker(features: DataFrame, target: str, names: list[str], rounds: int = 10, depth: int = 4, seed: int = 42, stop_share: float = 0.0, tolerance: float = 0.01) -> GBTClassificationModel:
    """Boosted trees on a binary target. With stop_share, so much of the sessions is held out, and training stops when its error no longer falls by the tolerance.

    Where so few sessions are none or all of them, nothing is held out.
    """
    rows = _assembled(_dealt(features), names).withColumn("label", F.col(target).cast("double"))
    how = {"maxIter": rounds, "maxDepth": depth, "seed": seed}
    rows = rows.withColumn("held_out", arithmetic_hash(F.col("session"), seed, 1000) < int(1000 * stop_share))
    stop_share = stop_share if rows.select("held_out").distinct().count() == 2 else 0
    if stop_share:
        how |= {"validationIndicatorCol": "held_out", "validationTol": tolerance}
    return GBTClassifier(**how).fit(rows.select("features", "label", *(["held_out"] if stop_share else [])))


def score(features: DataFrame, model: GBTClassificationModel, names: list[str]) -> DataFrame:
    """(session, candidates, pred)."""
    return model.transform(_assembled(features, names)).select("session", "candidates", vector_to_array("probability")[1].alias("pred"))


def tune_ranker(features: DataFrame, target: str, names: list[str], depths: tuple[int, ...] = (3, 4), rounds: tuple[int, ...] = (5, 10), seed: int = 42) -> DataFrame:
    """(maxDepth, maxIter, auc), the best first: every combination, trained on three quarters of the rows and judged on the rest."""
    rows = _assembled(_dealt(features), names).withColumn("label", F.col(target).cast("double"))
    gbt = GBTClassifier(seed=seed)
    grid = ParamGridBuilder().addGrid(gbt.maxDepth, list(depths)).addGrid(gbt.maxIter, list(rounds)).build()
    judged = TrainValidationSplit(estimator=gbt, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(), trainRatio=0.75, seed=seed).fit(rows.select("features", "label"))
    found = [(int(m[gbt.maxDepth]), int(m[gbt.maxIter]), float(v)) for m, v in zip(grid, judged.validationMetrics, strict=True)]
    return features.sparkSession.createDataFrame(sorted(found, key=lambda r: (-r[2], r[0], r[1])), "maxDepth int, maxIter int, auc double")


def cross_fit(features: DataFrame, target: str, names: list[str], k: int = 3, **how) -> tuple[DataFrame, DataFrame]:
    """(out-of-fold scores, mean importance by feature): one model for each of k folds; features has `fold`. Loops over folds, not rows."""
    spark, scores, importance = features.sparkSession, None, []
    for fold in range(k):
        model = train_ranker(features.where(F.col("fold") != fold), target, names, **how)
        part = score(features.where(F.col("fold") == fold), model, names)
        scores = part if scores is None else scores.unionByName(part)
        importance += [(n, float(v)) for n, v in zip(names, model.featureImportances.toArray(), strict=True)]
    mean = spark.createDataFrame(importance, "feature string, v double").groupBy("feature").agg(F.avg("v").alias("importance"))
    return scores, mean
