"""Sums that are kept up to date file by file: what new input files add, and what removed ones take away.

A store is a folder of versions. Each version has the partial sums of the files that it added, by file (`parts`), the totals over all files then present
(`total`), and last the manifest: a row for each file with its size, its time and the version whose parts hold it. A refresh lists the input, reads the
files that the manifest doesn't know, aggregates them by file, adds that to the last totals, and subtracts the stored parts of files that are gone. So its work
is that of the changes and of one merge of totals. A file that was written anew (other size or time) counts as gone and new. A version without manifest, from a
run that broke off, is never read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.functions.hold import delete_path, folders

FILE = ("file", "size", "changed")


@dataclass(frozen=True)
class Sums:
    """prepare turns rows of input files into rows with the keys and the summed columns; it keeps other columns (the file's name is one)."""

    prepare: Callable[[DataFrame], DataFrame]
    keys: tuple[str, ...]
    sums: tuple[str, ...]


def listed(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file, size, changed) of the Parquet files under paths. Their content isn't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(list(paths))
    return found.select(F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("changed"))


class Store:
    """Totals of one Sums in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, of: Sums):
        self.spark, self.path, self.of = spark, path.rstrip("/"), of

    def version(self) -> int:
        """The last complete version; 0 before the first."""
        found = [int(v) for v in folders(self.spark, self.path) if v.isdigit() and "_SUCCESS" in folders(self.spark, f"{self.path}/{v}/manifest")]
        return max(found, default=0)

    def manifest(self) -> DataFrame:
        """(file, size, changed, part)"""
        v = self.version()
        return self.spark.read.parquet(f"{self.path}/{v}/manifest") if v else self.spark.createDataFrame([], "file string, size long, changed timestamp, part int")

    def total(self) -> DataFrame:
        """The keys with their sums over all files of the last version."""
        return self.spark.read.parquet(f"{self.path}/{self.version()}/total").drop("rows")

    def changes(self, paths: Sequence[str]) -> tuple[DataFrame, DataFrame]:
        """(new, gone) files under paths against the manifest."""
        now, known = listed(self.spark, paths), self.manifest()
        return now.join(known, list(FILE), "left_anti"), known.join(now, list(FILE), "left_anti")

    def refresh(self, paths: Sequence[str]) -> DataFrame:
        """total() of the files that are under paths now. Paths without any change write nothing."""
        before = self.version()
        new, gone = self.changes(paths)
        names = [r.file for r in new.select("file").collect()]  # a row a file, as in Spark's own listing
        if before and not names and not gone.limit(1).count():
            return self.total()
        now, keys, sums = f"{self.path}/{before + 1}", list(self.of.keys), [*self.of.sums, "rows"]
        delete_path(self.spark, now)  # of a run that broke off
        ups = []
        if names:
            rows = self.of.prepare(self.spark.read.parquet(*names).withColumn("file", F.col("_metadata.file_path"))).withColumn("rows", F.lit(1).cast("long"))
            parts = rows.groupBy("file", *keys).agg(*[F.sum(c).alias(c) for c in sums])
            parts.repartition("file").sortWithinPartitions("file").write.parquet(f"{now}/parts")
            ups.append(self.spark.read.parquet(f"{now}/parts"))
        if before:
            ups.append(self.spark.read.parquet(f"{self.path}/{before}/total"))
            for r in gone.select("part").distinct().collect():  # a row a version
                taken = self.spark.read.parquet(f"{self.path}/{r.part}/parts").join(gone.where(F.col("part") == r.part).select("file"), "file", "left_semi")
                ups.append(taken.withColumns({c: -F.col(c) for c in sums}))
        total = None
        for df in ups:
            total = df.select(*keys, *sums) if total is None else total.unionByName(df.select(*keys, *sums))
        if total is None:
            raise ValueError(f"no Parquet files under {', '.join(paths)}")
        total.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums]).where("rows <> 0").write.parquet(f"{now}/total")
        kept = self.manifest().join(gone.select(*FILE), list(FILE), "left_anti").select(*FILE, "part")
        new.select(*FILE, F.lit(before + 1).alias("part")).unionByName(kept).write.parquet(f"{now}/manifest")
        return self.total()

    def prune(self) -> None:
        """Delete totals and manifests of versions before the last, and parts that no file of it has."""
        last = self.version()
        used = {r.part for r in self.manifest().select("part").distinct().collect()}
        for v in folders(self.spark, self.path):
            if v.isdigit() and int(v) < last:
                delete_path(self.spark, f"{self.path}/{v}/manifest")
                delete_path(self.spark, f"{self.path}/{v}/total")
                if int(v) not in used:
                    delete_path(self.spark, f"{self.path}/{v}")
