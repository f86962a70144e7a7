"""The corpus pipeline: five stages over documents, each written as Parquet and read again for the next one.

run(spark, sf_dir) applies STAGES to the documents table. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm import bpe, langid, linefreq, minhash, mixing
from sessionloom.llm.common import keep, scratch, written
from sessionloom.llm.queries import vocabulary_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their language as predicted; those without any letter go."""
    return langid.relabel(docs, langid.train(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source; n_chars follows."""
    columns = docs.columns
    return linefreq.drop_boilerplate(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, similarity 0.8."""
    return minhash.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.taken(docs)


def bpe_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document and the text that they decode to: (doc_id, lang, source, n_tokens, ids, decoded)."""
    done = bpe.encode_decode(docs, vocabulary_path(), keep=("lang", "source"))
    return done.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("bpe", bpe_ids)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, as a table; those of the stages before go when it is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch():
        for name, stage in STAGES[:-1]:
            docs = written(stage(spark, docs, sf_dir), name)
        name, stage = STAGES[-1]
        return keep(stage(spark, docs, sf_dir), name)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run()'s rows with the ids as one text, so that rows can be compared."""
    return run(spark, sf_dir).withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), " "))


QUERIES = {"pipeline": pipeline}
#: Stages 1, 3 and 5 have no SQL form; tests hold the whole against brute force.
ORACLE_SQL = None
