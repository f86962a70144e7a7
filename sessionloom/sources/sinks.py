"""Where results go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_grouped(df: DataFrame, path: str, size: int = 50_000, key: str = "session") -> None:
    """Parquet folders of `size` keys each; rows are dealt by folder first, so a folder has few files."""
    out = df.withColumn("grp", F.floor(F.col(key) / size).cast("long"))
    out.repartition("grp").write.mode("overwrite").partitionBy("grp").parquet(path)


def write_submission(df: DataFrame, path: str) -> None:
    """CSV (session_type, labels)."""
    df.select("session_type", "labels").write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
