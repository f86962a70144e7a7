"""Keeping what is used more than once, as tables in the shared folder."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scopes = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which the driver and all executors share; only local sessions without it use a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), f"sessionloom-{os.getuid()}")
    return found.rstrip("/")


def own_dir(spark: SparkSession, part: str = "held") -> str:
    """The folder of this application's tables of one part of the package."""
    return f"{shared_dir(spark)}/sessionloom-{spark.sparkContext.applicationId}/{part}"


def fresh_dir(spark: SparkSession, name: str, part: str = "held") -> str:
    return f"{own_dir(spark, part)}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession, part: str = "held") -> None:
    """Delete what results of that part of the package still read; call it when they are no longer wanted."""
    delete_path(spark, own_dir(spark, part))


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what is in a folder; none if it isn't there."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


@contextmanager
def scratch():
    """Tables held inside go when the block ends, but for those that the block passes to keep()."""
    stack = _scopes.__dict__.setdefault("stack", [])
    stack.append([])
    try:
        yield
    finally:
        for spark, path in stack.pop():
            delete_path(spark, path)


def _write(df: DataFrame, name: str, part: str, level: int) -> DataFrame:
    spark = df.sparkSession
    path = fresh_dir(spark, name, part)
    df.write.parquet(path)
    stack = _scopes.__dict__.get("stack") or []
    if len(stack) >= level:
        stack[-level].append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def held(df: DataFrame, name: str = "held", part: str = "held") -> DataFrame:
    """df computed once, as a Parquet table in the shared folder: its plan stays short, its size is known to the planner, and lost executors don't matter.

    It goes with the scratch() around it, and without one when clear() is called.
    """
    return _write(df, name, part, 1)


def held_parts(parts: Iterable[DataFrame], name: str = "held", part: str = "held") -> DataFrame:
    """The union of frames of one schema, each computed and written on its own, so that the driver has the plan of one at a time; read as one table."""
    done = [held(df, name, part) for df in parts]
    paths = [f"{f.rpartition('/')[0]}" for df in done for f in df.inputFiles()[:1]]
    return done[0].sparkSession.read.schema(done[0].schema).parquet(*paths) if paths else done[0]


def drop(df: DataFrame) -> None:
    """Delete a held table that nothing reads any more, before its block ends."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        delete_path(df.sparkSession, path)


def keep(df: DataFrame, name: str = "kept", part: str = "held") -> DataFrame:
    """The result of a scratch() block, as a table that outlives it but belongs to the next scratch() around, if there is one."""
    return _write(df, name, part, 2)
