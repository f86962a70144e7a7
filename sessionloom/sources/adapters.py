"""Event tables: E(session, aid, ts, type, eid) with ts in seconds, type 0 click, 1 cart, 2 order, and eid breaking ties."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TYPES = {"clicks": 0, "carts": 1, "orders": 2}
SESSION_JSON = "session LONG, events ARRAY<STRUCT<aid: LONG, ts: LONG, type: STRING>>"
LABEL_JSON = "session LONG, labels STRUCT<clicks: LONG, carts: ARRAY<LONG>, orders: ARRAY<LONG>>"


def type_code(kind, names: dict[str, int] = TYPES):
    out = F.lit(None).cast("int")
    for name, code in names.items():
        out = F.when(kind == name, F.lit(code)).otherwise(out)
    return out


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table with a session for each user. Errors aren't events."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type <> 'error'")
    return raw.select(
        F.col("user_id").alias("session"),
        F.get_json_object("props", "$.k").cast("long").alias("aid"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"),
        type_code(F.col("event_type"), {"click": 0, "view": 0, "signup": 1, "purchase": 2}).alias("type"),
        F.col("event_id").alias("eid"),
    )


def visits(events: DataFrame, gap: int = 86_400, most: int = 1000) -> DataFrame:
    """Sessions cut where a user pauses for over gap seconds: session * most + number of pauses so far.

    From `most` pauses on, where that would run into the next user's sessions, ids are negative: -(session * 2^31 + pauses), so no two visits share one.
    """
    w = Window.partitionBy("session").orderBy("ts", "eid")
    cut = events.withColumn("cut", F.coalesce((F.col("ts") - F.lag("ts").over(w) > gap).cast("long"), F.lit(0)))
    n = cut.withColumn("cut", F.sum("cut").over(w))
    id_ = F.when(F.col("cut") < most, F.col("session") * most + F.col("cut")).otherwise(-(F.col("session") * (1 << 31) + F.col("cut")))
    return n.withColumn("session", id_).drop("cut")


def visit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visits(user_events(spark, sf_dir))


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as events (customer, part, ship date, return flag); lines have no unique key, so this is for order-free operators."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_shipdate", "l_returnflag")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("session"),
        F.col("l_partkey").alias("aid"),
        F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("ts"),
        type_code(F.col("l_returnflag"), {"N": 0, "A": 1, "R": 2}).alias("type"),
    )


def read_sessions_json(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """JSON lines {session, events: [{aid, ts, type}]}, with a fixed schema so that the scan splits and infers nothing."""
    return spark.read.schema(SESSION_JSON).json(paths)


def read_labels_json(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.schema(LABEL_JSON).json(paths)


def flatten_sessions(nested: DataFrame, shift: int = 0, chunk: int = 100_000) -> DataFrame:
    """One row for each event of nested sessions, with the chunk its session belongs to."""
    flat = nested.select((F.col("session") + shift).alias("session"), F.inline("events"))
    return flat.withColumn("chunk_id", F.floor(F.col("session") / chunk).cast("long"))


def nest_sessions(events: DataFrame) -> DataFrame:
    """Sessions as read_sessions_json returns them, events in order. A session is one row, as in the source format."""
    names = F.create_map(*[F.lit(x) for k, v in TYPES.items() for x in (v, k)])
    e = F.array_sort(F.collect_list(F.struct("ts", "eid", "aid", "type")))
    item = lambda x: F.struct(x["aid"].alias("aid"), x["ts"].alias("ts"), F.element_at(names, x["type"]).alias("type"))
    return events.groupBy("session").agg(F.transform(e, item).alias("events"))


def labels_long(labels: DataFrame) -> DataFrame:
    """(session, type, ground_truth) from nested labels; absent ones have no row, a click is an array of one."""
    click = F.when(F.col("labels.clicks").isNotNull(), F.array("labels.clicks"))
    rows = [F.struct(F.lit(name).alias("type"), c.cast("array<long>").alias("ground_truth")) for name, c in (("clicks", click), ("carts", F.col("labels.carts")), ("orders", F.col("labels.orders")))]
    return labels.select("session", F.inline(F.array(*rows))).where("ground_truth IS NOT NULL")


def read_events(spark: SparkSession, paths: Iterable[str], columns: Iterable[str] = ("session", "aid", "ts", "type")) -> DataFrame:
    """Parquet files of raw events (milliseconds, type names) in the compact form; only the columns asked for are read."""
    raw = spark.read.parquet(*paths).select(*columns)
    out = raw
    if "ts" in raw.columns:
        out = out.withColumn("ts", F.floor(F.col("ts") / 1000).cast("long"))
    if "type" in raw.columns and dict(raw.dtypes)["type"] == "string":
        out = out.withColumn("type", type_code(F.col("type")))
    return out


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def with_folds_file(rows: DataFrame, path: str) -> DataFrame:
    """rows of the sessions that a CSV file (session, fold) names, with their fold."""
    return rows.join(read_csv(rows.sparkSession, path, "session LONG, fold INT"), "session")


def read_npy(spark: SparkSession, path: str, rows_per_read: int = 10_000) -> DataFrame:
    """(aid, vec) of a matrix in an .npy file, whose row number is the item. Each task maps its stretches of rows, so all executors must see the file at this path."""
    import numpy as np

    n = np.load(path, mmap_mode="r").shape[0]
    starts = spark.range(0, n, rows_per_read, max(1, -(-n // rows_per_read)))

    def read(batches):
        import pandas as pd

        for pdf in batches:
            for at in pdf["id"].tolist():
                part = np.load(path, mmap_mode="r")[at : at + rows_per_read]
                yield pd.DataFrame({"aid": np.arange(at, at + len(part)), "vec": list(np.asarray(part, np.float64))})

    return starts.mapInPandas(read, "aid long, vec array<double>")


def read_vectors(spark: SparkSession, path: str, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(aid, vec) of an embedding table."""
    return spark.read.parquet(path).select(F.col(id_col).alias("aid"), F.col(vec_col).alias("vec"))
