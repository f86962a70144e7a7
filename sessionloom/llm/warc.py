"""WARC archives with an index written first, read back by coalesced byte ranges.

Each page becomes one gzip member in a .warc.gz file: `response` with the page,
or `revisit` where an equal payload of at least `min_bytes` bytes has a smaller id. While records are
written, their index rows (file, offset, length, url, digest, ...) are collected; they end as a Parquet
table beside the archives. Reading takes any selection of index rows, deals them out by stretches of SPAN bytes of a file (so one
file may be read by many tasks), sorts them by file and offset, merges
neighbours into one read each, and parses the records from the bytes. What a revisit says is taken from the response it refers to,
which is read and hashed too, once for all of its revisits.

A task names its files after its attempt and index rows carry the name, so a lost or repeated task leaves at
most an unreferenced file. Files are opened by Python: file: paths as such, other schemes by pyarrow.fs.
Pages aren't shuffled unless the table of repeated digests is too large to broadcast.

A null page is the empty payload; a null url is left out; a null id is written as such and never a
revisit's target. Rows that repeat an id and payload are all responses if that id is the smallest.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.common import Store, arrow_schema, keep, scratch, workers_find_package, written

DATE = "1970-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
INDEX = "file string, offset long, length long, page_id long, url string, digest string, payload_bytes long, record_type string, refers_to long"
FILE_BYTES, GAP, RUN, SPAN, TASK_BYTES = 1 << 30, 64 << 10, 8 << 20, 1 << 20, 64 << 20


def _id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page(text: str) -> int | None:
    got = text.removeprefix("<urn:page:").removesuffix(">")
    return None if got == "null" else int(got)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member. refers_to: the response's page, for a revisit."""
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_id(refers_to)}"]
    block = HTTP if refers_to is not None else HTTP + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of a record; a revisit has no payload of its own."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_bytes: int = 100) -> DataFrame:
    """Write pages to archives in path; returns the index, which is also at path/index."""
    spark = pages.sparkSession
    workers_find_package(spark)
    body = F.coalesce(F.col(f"`{body_col}`").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), body.alias("body")).withColumn("digest", F.sha2("body", 256))
    kinds = arrow_schema(INDEX)

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, store, out, name, at, part = TaskContext.get(), Store(path), None, "", 0, 0
        for batch in batches:
            got = []
            for page_id, url, body, digest, refers_to in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if out is None or at >= FILE_BYTES:
                    if out:
                        out.close()
                    name, at, part = f"part-{task.partitionId():05d}-{part:03d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz", 0, part + 1
                    out = store.create(name)
                raw = record(page_id, url, body, digest, refers_to)
                out.write(raw)
                got.append((name, at, len(raw), page_id, url, digest, len(body), "response" if refers_to is None else "revisit", refers_to))
                at += len(raw)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got, strict=True) if got else [()] * len(kinds), kinds, strict=True)], schema=kinds)
        if out:
            out.close()

    large = rows.where(F.octet_length("body") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("c"))
    with scratch():
        firsts = written(large.where("c > 1 AND first IS NOT NULL").select("digest", "first"), "repeated-payloads")
        other = (F.octet_length("body") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first"))
        marked = rows.join(firsts, "digest", "left").withColumn("refers_to", F.when(other, F.col("first")))
        marked.select("page_id", "url", "body", "digest", "refers_to").mapInArrow(write, INDEX).write.parquet(f"{path}/index")
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def runs(rows: list[tuple[str, int, int]]):
    """Indexes of (file, offset, length) rows, sorted, in runs of one read each: at most GAP bytes between and RUN bytes long."""
    held: list[int] = []
    for k, (file, offset, length) in enumerate(rows):
        if held:
            first, last = rows[held[0]], rows[held[-1]]
            if file != last[0] or offset - (last[1] + last[2]) > GAP or offset + length - first[1] > RUN:
                yield held
                held = []
        held.append(k)
    if held:
        yield held


def read_records(index: DataFrame, path: str, payloads: bool = True) -> DataFrame:
    """Records of the index rows, from the archives: (page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload).

    Every payload is hashed anew and must have its digest. A revisit has the digest, size and (with payloads) payload of
    the response that it refers to, whether that is among the index rows or not; without such a response the read fails.
    An index row that repeats is read once.
    """
    spark = index.sparkSession
    workers_find_package(spark)
    place = ["file", "offset", "length"]
    rows = index.dropDuplicates(["file", "offset"])
    back = rows.where("record_type = 'revisit'")
    wanted = back.groupBy(F.col("refers_to").alias("page_id"), "digest").agg(F.lit(True).alias("target"))
    with scratch():
        # Of responses with one id and digest any will do.
        at = F.min(F.struct(*place)).alias("at")
        targets = read_index(spark, path).where("record_type = 'response'").join(wanted, ["page_id", "digest"]).groupBy("page_id", "digest").agg(at).select("at.*", F.lit(True).alias("target"))
        both = rows.where("record_type <> 'revisit'").select(*place, F.lit(True).alias("own")).join(targets, place, "full")
        responses = keep(_fetched(written(both, "responses"), path, payloads), "payloads")
        revisits = _fetched(keep(back.select(*place, F.lit(True).alias("own"), F.lit(False).alias("target")), "revisits"), path, False)
    named = responses.where("target").select(F.col("page_id").alias("of"), F.col("payload_digest").alias("has"), F.col("payload_bytes").alias("size"), F.col("payload").alias("body"))
    met = revisits.join(named, (F.col("refers_to") == F.col("of")) & (F.col("payload_digest") == F.col("has")), "left")
    lost = F.raise_error(F.concat(F.lit("no response with its digest for the revisit of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))))
    size = F.when(F.col("of").isNull(), lost.cast("long")).otherwise(F.col("size"))
    out = ["page_id", "url", "record_type", "refers_to", "payload_digest"]
    return responses.where("own").select(*out, "payload_bytes", "payload").unionByName(met.select(*out, size.alias("payload_bytes"), F.col("body").alias("payload")))


def _fetched(wanted: DataFrame, path: str, payloads: bool) -> DataFrame:
    """Records at wanted(file, offset, length, own, target), a table; own and target pass through, null as false."""
    schema = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary, own boolean, target boolean"
    kinds = arrow_schema(schema)

    def one(member: bytes) -> tuple:
        headers, payload = parse(member)
        digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
        kind, refers = headers["WARC-Type"], headers.get("WARC-Refers-To")
        if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"{headers['WARC-Record-ID']}: the payload doesn't have its digest")
        return _page(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), kind, _page(refers) if refers else None, digest, len(payload), payload if payloads and kind == "response" else None

    def read(batches):
        import pyarrow as pa

        store, name, file = Store(path), None, None
        for batch in batches:
            rows = list(zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True))
            for run in runs([r[:3] for r in rows]):
                first, last = rows[run[0]], rows[run[-1]]
                if first[0] != name:
                    name, file = first[0], store.open(first[0])
                raw = file.read_at(last[1] + last[2] - first[1], first[1])
                got = [(*one(raw[rows[k][1] - first[1] :][: rows[k][2]]), bool(rows[k][3]), bool(rows[k][4])) for k in run]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got, strict=True), kinds, strict=True)], schema=kinds)

    # As many tasks as the bytes ask for, and all cores for what is less; stretches are dealt by hash.
    total, spans = wanted.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count_distinct("file", F.floor(F.col("offset") / SPAN))).first()
    tasks = max(1, -(-total // TASK_BYTES), min(spans, 4 * wanted.sparkSession.sparkContext.defaultParallelism))
    dealt = wanted.select("file", "offset", "length", "own", "target").repartition(tasks, "file", F.floor(F.col("offset") / SPAN)).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(read, schema)
