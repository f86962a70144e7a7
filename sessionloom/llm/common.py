"""What several operators share: scratch tables, typed empty results, connected components."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import urllib.parse
import zipfile
import zlib
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.functions import hold
from sessionloom.functions.hold import delete_path, scratch  # noqa: F401  the operators take them from here

PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def scratch_dir(spark: SparkSession) -> str:
    """The folder that holds this application's tables of this subpackage."""
    return hold.own_dir(spark, "llm")


def fresh_dir(spark: SparkSession, name: str) -> str:
    return hold.fresh_dir(spark, name, "llm")


def clear_scratch(spark: SparkSession) -> None:
    """Delete what results of these operators still read; call it when they are no longer wanted."""
    hold.clear(spark, "llm")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors, is computed once. It goes with the scratch() around it."""
    return hold.held(df, name, "llm")


def keep(df: DataFrame, name: str) -> DataFrame:
    """The result of a scratch() block, as a table that outlives it but belongs to the next scratch() around, if there is one."""
    return hold.keep(df, name, "llm")


class Store:
    """Byte access to a folder given by URI."""

    def __init__(self, uri: str):
        scheme = urllib.parse.urlsplit(uri).scheme
        if scheme in ("", "file"):
            from pyarrow.fs import LocalFileSystem

            self.fs, self.root = LocalFileSystem(), urllib.parse.urlsplit(uri).path
        else:
            from pyarrow.fs import FileSystem

            # pyarrow knows the object store that Hadoop calls s3a or s3n as s3.
            self.fs, self.root = FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))
        self.uri, self.mapped = uri, scheme in ("", "file")

    def create(self, name: str):
        self.fs.create_dir(self.root, recursive=True)
        return self.fs.open_output_stream(f"{self.root}/{name}", compression=None)

    def open(self, name: str):
        return self.fs.open_input_file(f"{self.root}/{name}")

    def local(self, name: str) -> str:
        """A path that can be memory-mapped: the file's own, or a copy that this process makes once and that goes with it."""
        if self.mapped:
            return f"{self.root}/{name}"
        if (self.uri, name) not in _copies:
            if not _copies:
                _copies[None] = tempfile.TemporaryDirectory(prefix="sessionloom-")
            path = os.path.join(_copies[None].name, f"{len(_copies)}")
            with self.fs.open_input_stream(f"{self.root}/{name}", compression=None) as f, open(path, "wb") as to:
                while some := f.read(16 << 20):
                    to.write(some)
            _copies[self.uri, name] = path
        return _copies[self.uri, name]


_copies: dict = {}


def workers_find_package(spark: SparkSession) -> None:
    """Python workers import this package by name, so it is sent to them, once for each application."""
    sc = spark.sparkContext
    if getattr(sc, "_sessionloom_sent", False):
        return
    name = os.path.basename(PACKAGE)
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="sessionloom-")), f"{name}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(PACKAGE):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join(name, os.path.relpath(full, PACKAGE)))
    sc.addPyFile(path)
    sc._sessionloom_sent = True


def unused(columns: list[str], *names: str) -> list[str]:
    """names for helper columns, none of which is one of columns (which Spark compares without case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
        taken.add(name.lower())
    return out


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of edges(a, b): one row (id, component_id) per node, component_id the smallest id reachable.

    Alternates large-star and small-star steps, which keep connectivity and move
    every node toward the smallest of its component; rounds grow with the
    logarithm of the size. Each node's smallest neighbour is a min() with
    map-side partials, so a hub never gathers its neighbours in one place; it is
    written before it is joined back, so adaptive execution sees its size and
    can split a hub's rows. Self loops and repeated edges are allowed; nulls are dropped.
    """
    with scratch():
        edges = written(
            edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
            .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
            .distinct(),
            name,
        )
        nodes = edges

        def state(e: DataFrame):
            return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

        before = state(edges)
        while before[0]:
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
            edges = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), name)
            least = written(edges.groupBy("u").agg(F.min("v").alias("m")), name)
            edges = written(
                edges.join(least, "u")
                .select(F.col("v").alias("u"), F.col("m").alias("v"))
                .where("u <> v")
                .unionByName(least.select("u", F.col("m").alias("v")))
                .distinct(),
                name,
            )
            now = state(edges)
            if now == before:
                break
            before = now
        heads = nodes.select(F.col("u").alias("id")).unionByName(nodes.select(F.col("v").alias("id"))).distinct()
        return keep(
            heads.join(edges.select(F.col("u").alias("id"), "v"), "id", "left").select("id", F.coalesce("v", "id").alias("component_id")), name
        )


def per_text(documents: DataFrame, id_col: str, text_col: str, fn, fields: str, uses: tuple = ()) -> DataFrame:
    """(id, *fields) for each row: fn takes a list of texts (None for null) and returns a list of tuples. uses: the worker_cache functions that it calls.

    The id column passes through as Arrow, so null and large ids stay what they are.
    """
    spark = documents.sparkSession
    workers_find_package(spark)
    rows = documents.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, {fields}"
    kinds = arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        alone(*uses)
        for batch in batches:
            for part in parts(batch, 1):
                got = fn(part.column(1).to_pylist())
                columns = list(zip(*got, strict=True)) or [()] * (len(kinds) - 1)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(kinds)[1:], strict=True))], schema=kinds)

    return rows.mapInArrow(run, schema)


def arrow_schema(ddl: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


class Held(dict):
    """A cache of make(key) in two generations: when `most` keys are held, those not asked for since the last time go. What is frequent stays, whatever comes once.

    Keys of over `longest` signs aren't held (None: keys have no length), so the bytes are bounded with the keys.
    """

    def __init__(self, make, most: int, longest: int | None = 64):
        super().__init__()
        self.make, self.most, self.longest, self.older = make, most, longest, {}

    def __missing__(self, key):
        if self.longest is not None and len(key) > self.longest:
            return self.make(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        got = self.older.get(key)
        if got is None:
            got = self.make(key)
        self[key] = got
        return got


_kept_by_worker: list = []


def worker_cache(make):
    """functools.cache for what a Python worker keeps from task to task; see alone()."""
    found = cache(make)
    _kept_by_worker.append(found)
    return found


def alone(*mine) -> None:
    """Called as a task begins, with the worker_cache functions that it uses: what others have kept goes.

    Spark's Python workers outlive a stage, so that those of a chain of operators would hold the tables of all of them at once.
    """
    gone = [f for f in _kept_by_worker if f not in mine and f.cache_info().currsize]
    for f in gone:
        f.cache_clear()
    if gone:
        import pyarrow as pa

        gc.collect()
        pa.default_memory_pool().release_unused()


def parts(batch, column: int, size: int = 2 << 20):
    """An Arrow batch in runs of rows whose texts have about so many bytes at most, one row at least: what a worker holds as Python objects at once."""
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for k, n in enumerate(lengths.tolist()):
        if k > start and held + n > size:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += n
    if len(lengths):
        yield batch.slice(start)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length, each number in as few bytes as the column's largest needs, compressed."""
    out = [len(columns[0]).to_bytes(8, "little")]
    for x in columns:
        x = x.astype(np.uint64)
        size = next(s for s in (1, 2, 4, 8) if not len(x) or int(x.max()) < 1 << (8 * s))
        out += [bytes([size]), x.astype(f"<u{size}").tobytes()]
    return zlib.compress(b"".join(out), 1)


def unpack(raw: bytes) -> list[np.ndarray]:
    raw = zlib.decompress(raw)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    while at < len(raw):
        size = raw[at]
        out.append(np.frombuffer(raw, f"<u{size}", n, at + 1).astype(np.int64))
        at += 1 + size * n
    return out


def summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, rising, and each column's sums."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    return key[first], *[np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values]


def word_ids(texts: list[list[bytes]]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of texts, each word's number among them in order of the texts, and how many words each text has."""
    known: dict[bytes, int] = {}
    lengths = np.array([len(t) for t in texts], np.int64)
    ids = np.empty(int(lengths.sum()), np.int64)
    at = 0
    for t in texts:
        ids[at : at + len(t)] = [known.setdefault(w, len(known)) for w in t]
        at += len(t)
    return list(known), ids, lengths


def block_roots(linked: np.ndarray, q: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id reachable within the block, for queries and for members."""
    big = np.iinfo(np.int64).max
    rq, rb = q.copy(), b.copy()
    rows, cols = np.nonzero(linked)
    while len(rows):
        low_q = np.full(len(q), big)
        np.minimum.at(low_q, rows, rb[cols])
        nq = np.minimum(rq, low_q)
        low_b = np.full(len(b), big)
        np.minimum.at(low_b, cols, nq[rows])
        nb = np.minimum(rb, low_b)
        if (nq == rq).all() and (nb == rb).all():
            break
        rq, rb = nq, nb
    return rq, rb
