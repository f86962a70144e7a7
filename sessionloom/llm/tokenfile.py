"""Token files: frequency-ranked ids, byte-aligned with the control bytes apart, decoded by numpy table lookup.

Ids are replaced by their rank in the corpus (the most frequent is 0; ties by
id), so most take one byte. A block holds whole documents:

    "FRSV" | u32 documents | u64 ids | u64 start | i64 doc id each | u8 null flag each | u32 ids each | control | data

all little-endian. Four ids share a control byte of four two-bit fields: bytes of
the id less one, lowest bits first; data bytes follow without gaps. `start` is the
number of ids in all documents of the shard before the block; `shards.parquet` has that of all shards before each. Blocks are rows (shard, block,
n_ids, payload) of Parquet files partitioned by shard, so Spark's committer
writes them on any file system and lost tasks are simply run again; shards and
blocks are in ascending order of document id (nulls first; of equal ids by a hash of their token ids). `ranks.parquet`
beside them tells which id has which rank.

Texts are tokenised where they are read. What is then sorted by document id are token ids, two bytes each, and a document id with
many rows spreads over several shards. Null and empty texts hold just the end id. Rows that repeat are written each.
"""

from __future__ import annotations

import re
import struct
import zlib
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.bpe import Cutter, cut_all, laid_out
from sessionloom.llm.common import alone, arrow_schema, delete_path, fresh_dir, parts, worker_cache, workers_find_package

IDS_A_BLOCK = 400_000
#: Longer chunks and pieces aren't held, so what a worker holds is bounded in bytes.
LONGEST = 64
MAGIC = b"FRSV"


class LibraryTokenizer:
    """The tokenizers library, step by step: added tokens, its normaliser and pre-tokenizer on each distinct chunk between white space
    (see bpe.Cutter), its model on each distinct piece. None of them looks across white space, so the ids are those of whole texts.
    """

    def __init__(self, spec: str, held: int = 300_000):
        from tokenizers import Tokenizer

        self.cutter = Cutter(spec)
        library = Tokenizer.from_str(spec)
        self.model = library.model
        added = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
        self.added = {f" {t}": struct.pack("<I", i) for t, i in added.items()}
        self._added = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.held, self.known, self.older, self.pieces = held, {}, {}, {}

    def _chunks(self, distinct: list[str]) -> list[bytes]:
        """The ids of each chunk as little-endian uint32. What isn't held is taken apart in this one loop: a call for each would cost as much again."""
        known, older, pieces = self.known, self.older, self.pieces
        find, tokens, new = self.cutter.pieces, self.model.tokenize, {}
        out = list(map(known.get, distinct))
        for k in [k for k, got in enumerate(out) if got is None]:
            c = distinct[k]
            got = older.get(c)
            if got is None:
                got = self.added.get(c)
            if got is None:
                ids = []
                for p in find(c):
                    one = pieces.get(p)
                    if one is None:
                        found = [t.id for t in tokens(p)]
                        one = struct.pack(f"<{len(found)}I", *found)
                        if len(p) <= LONGEST:
                            pieces[p] = one
                    ids.append(one)
                got = b"".join(ids)
            if len(c) <= LONGEST:
                new[c] = got
            out[k] = got
        if len(pieces) > self.held:
            pieces.clear()
        if len(known) + len(new) > self.held:
            self.older, self.known = known, {}
        self.known.update(new)
        return out

    def encode_all(self, texts, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of an Arrow array one after another, number of each text's ids), with the end id after each text if there is one.

        Arrow cuts the texts and numbers their distinct chunks, so that only those become Python's and are looked up one by one; numpy then lays out the ids.
        """
        cut, sizes = cut_all(texts, self._added)
        coded = cut.dictionary_encode()
        raw = self._chunks(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids, sizes = laid_out(raw, coded.indices.to_numpy(), sizes)
        ends = np.cumsum(sizes)
        return (ids, sizes) if end is None else (np.insert(ids, ends, end), sizes + 1)

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian uint32."""
        import pyarrow as pa

        return self.encode_all(pa.array([text], pa.large_string()))[0].tobytes()


@worker_cache
def library(spec: str) -> LibraryTokenizer:
    return LibraryTokenizer(spec)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit numbers."""
    x = np.ascontiguousarray(ranks, "<u4")
    size = 1 + (x > 0xFF).astype(np.uint8) + (x > 0xFFFF) + (x > 0xFFFFFF)
    code = np.zeros(-(-len(x) // 4) * 4, np.uint8)
    code[: len(x)] = size - 1
    c = code.reshape(-1, 4)
    control = c[:, 0] | c[:, 1] << 2 | c[:, 2] << 4 | c[:, 3] << 6
    keep = np.arange(4, dtype=np.uint8)[None, :] < size[:, None]
    return control.astype(np.uint8).tobytes(), x.view(np.uint8).reshape(-1, 4)[keep].tobytes()


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Control byte -> sizes of its four numbers, and their offsets."""
    sizes = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1
    return sizes.astype(np.uint8), sizes.sum(axis=1).astype(np.int64)


def decode_ranks(control: bytes, data: bytes, count: int) -> np.ndarray:
    sizes, _ = _tables()
    size = sizes[np.frombuffer(control, np.uint8)].reshape(-1)[:count]
    keep = np.arange(4, dtype=np.uint8)[None, :] < size[:, None]
    out = np.zeros((count, 4), np.uint8)
    out[keep] = np.frombuffer(data, np.uint8)
    return out.reshape(-1).view("<u4")


def pack(ids: list[int | None], lengths: np.ndarray, ranks: np.ndarray, start: int) -> bytes:
    control, data = encode_ranks(ranks)
    return b"".join(
        [
            MAGIC,
            np.array([len(ids)], "<u4").tobytes(),
            np.array([len(ranks), start], "<u8").tobytes(),
            np.array([i or 0 for i in ids], "<i8").tobytes(),
            np.array([i is None for i in ids], np.uint8).tobytes(),
            np.asarray(lengths, "<u4").tobytes(),
            control,
            data,
        ]
    )


def unpack(block: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray, int]:
    """(document ids, lengths, ranks, start)."""
    if block[:4] != MAGIC:
        raise ValueError("not a token block")
    n = int(np.frombuffer(block, "<u4", 1, 4)[0])
    count, start = map(int, np.frombuffer(block, "<u8", 2, 8))
    at = 24
    ids = np.frombuffer(block, "<i8", n, at).tolist()
    null = np.frombuffer(block, np.uint8, n, at := at + 8 * n)
    lengths = np.frombuffer(block, "<u4", n, at := at + n)
    at += 4 * n
    control = block[at : at + -(-count // 4)]
    ranks = decode_ranks(control, block[at + len(control) :], count)
    return [None if z else i for i, z in zip(ids, null.tolist(), strict=True)], lengths, ranks, start


def write_tokens(documents: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode documents into token files at path; see the module for their format."""
    spark = documents.sparkSession
    workers_find_package(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        sent = spark.sparkContext.broadcast(f.read())
    docs = documents.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = "id long, seq long, n int, ids binary, counts boolean"
    kinds = arrow_schema(schema)

    def plain(batches):
        """A row for each document, numbered; at last one row of how often each id came."""
        import pyarrow as pa
        from pyspark import TaskContext

        alone(library)
        lib = library(sent.value)
        seq, seen = TaskContext.get().partitionId() << 33, np.zeros(0, np.int64)

        def rows(ids, raw, sizes, counts):
            return pa.RecordBatch.from_arrays([ids, pa.array(range(seq, seq + len(raw)), pa.int64()), pa.array(sizes, pa.int32()), pa.array(raw, pa.binary()), pa.array([counts] * len(raw))], schema=kinds)

        for batch in batches:
            for part in parts(batch, 1, 4 << 20):
                ids, counted = lib.encode_all(part.column(1), end_id)
                now = np.bincount(ids, minlength=len(seen))
                now[: len(seen)] += seen
                seen = now
                sizes, ends = counted.tolist(), np.cumsum(counted).tolist()
                wide = 2 if ids.max() <= 0xFFFF else 4  # the first byte tells how wide a document's ids are
                flat = ids.astype(f"<u{wide}").tobytes()
                raw = [bytes([wide]) + flat[wide * (e - n) : wide * e] for e, n in zip(ends, sizes, strict=True)]
                yield rows(part.column(0), raw, sizes, False)
                seq += len(raw)
        if len(seen):
            yield rows(pa.array([None], pa.int64()), [seen.astype("<i8").tobytes()], [0], True)

    staged_path = fresh_dir(spark, "plain-ids")
    docs.mapInArrow(plain, schema).write.option("compression", "zstd").parquet(staged_path)
    staged = spark.read.schema(schema).parquet(staged_path)

    def split_counts(batches):
        import pyarrow as pa

        for batch in batches:
            for raw in batch.column(0).to_pylist():
                n = np.frombuffer(raw, "<i8")
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["token", "n"])

    counted = staged.where("counts").select("ids").mapInArrow(split_counts, "token int, n long").groupBy("token").agg(F.sum("n").alias("n"))
    by_rank = sorted(((-r.n, r.token) for r in counted.collect()))  # as many rows as the vocabulary has ids at most
    order = np.array([t for _, t in by_rank], np.int64)
    rank_of = np.zeros(int(order.max()) + 1 if len(order) else 1, "<u4")
    rank_of[order] = np.arange(len(order))
    ranks = spark.sparkContext.broadcast(rank_of)
    spark.createDataFrame([(k, int(t)) for k, t in enumerate(order)], "rank int, token int").coalesce(1).write.parquet(f"{path}/ranks.parquet")
    out = "shard int, block int, n_ids long, payload binary"
    out_kinds = arrow_schema(out)

    def blocks(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        shard, block, start = TaskContext.get().partitionId(), 0, 0
        names: list = []
        sizes: list[int] = []
        parts: list[np.ndarray] = []

        def flush():
            nonlocal block, start
            n = sum(sizes)
            payload = pack(names, np.array(sizes, "<u4"), ranks.value[np.concatenate(parts)], start)
            row = pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([n], pa.int64()), pa.array([payload], pa.binary())], schema=out_kinds)
            block, start = block + 1, start + n
            names.clear(), sizes.clear(), parts.clear()
            return row

        held = 0
        for batch in batches:
            for id_, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = raw.as_py()
                names.append(id_)
                parts.append(np.frombuffer(raw, f"<u{raw[0]}", offset=1))
                sizes.append(len(parts[-1]))
                held += sizes[-1]
                if held >= IDS_A_BLOCK:
                    yield flush()
                    held = 0
        if names:
            yield flush()

    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = staged.where("NOT counts").select("id", "ids", "seq").withColumn("h", F.xxhash64("ids"))
    keys = [F.col("id").asc_nulls_first(), F.col("h"), F.col("seq")]
    ranged = ranged.repartitionByRange(shards, *keys).sortWithinPartitions(*keys).select("id", "ids")
    ranged.mapInArrow(blocks, out).write.partitionBy("shard").option("compression", "zstd").parquet(f"{path}/blocks")
    totals = _blocks(spark, path).groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()  # one row a shard
    before, run = [], 0
    for shard, n in sorted((r.shard, r.n) for r in totals):
        before.append((shard, run))
        run += n
    spark.createDataFrame(before, "shard int, before long").coalesce(1).write.parquet(f"{path}/shards.parquet")
    delete_path(spark, staged_path)


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("block int, n_ids long, payload binary, shard int").parquet(f"{path}/blocks")


def _read(spark: SparkSession, path: str, schema: str, make) -> DataFrame:
    """make(start of each document and the end, tokens of the block) -> arrays of schema's columns after the first two."""
    workers_find_package(spark)
    ranks = spark.read.parquet(f"{path}/ranks.parquet").orderBy("rank").collect()  # as many rows as the vocabulary has ids at most
    before = {r.shard: r.before for r in spark.read.parquet(f"{path}/shards.parquet").collect()}  # one row a shard
    sent = spark.sparkContext.broadcast((np.array([r.token for r in ranks] or [0], "<i4"), before))
    kinds = arrow_schema(schema)

    def decode(batches):
        import pyarrow as pa

        tokens, before = sent.value
        for batch in batches:
            for shard, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids, lengths, ranks, start = unpack(block.as_py())
                offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
                columns = [pa.array(ids, pa.int64()), pa.array(before[shard] + start + offsets[:-1]), *make(offsets, tokens[ranks])]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    return _blocks(spark, path).select("shard", "payload").mapInArrow(decode, schema)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, tokens array<int>) of every document in the token files at path."""

    def make(offsets, tokens):
        import pyarrow as pa

        return [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(tokens))]

    return _read(spark, path, "doc_id long, start long, tokens array<int>", make)


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the token files at path, decoded as read_tokens does."""

    def make(offsets, tokens):
        import pyarrow as pa

        o = offsets.tolist()
        return [pa.array(np.diff(offsets)), pa.array([checksum(tokens[a:b]) for a, b in zip(o, o[1:], strict=False)], pa.int64())]

    return _read(spark, path, "doc_id long, start long, n_tokens long, ids_crc32 long", make)


def checksum(tokens) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.asarray(tokens, "<u4").tobytes())

