"""Order-independent document fingerprints: a homomorphic multiset hash over paragraphs.

A text is the multiset of its units: lines, cut further at sentence ends, sentences of over SHORT characters also after
words that end in one of an eighth of all characters (so that the cuts move with the words, and an inserted word changes one unit), and
where a piece has over WINDOW words, every WINDOW words. Each unit is hashed
(BLAKE2b, 512 bits) to a wide vector, and vectors add lane by lane modulo
powers of two, so units may come in any order, be inserted (`add`) or deleted
(`remove`) without the rest of the text, and equal multisets have equal sums:

* 8 dense lanes modulo 2^32 decide equality;
* a count modulo 2^32;
* LANES wide lanes modulo 2^32, to each of which a unit adds a Cauchy value of its own, in
  fixed point. They measure likeness: the difference of two sums is, in every lane, a Cauchy value times
  the units that stand in one text more often than in the other, so the median over
  the lanes tells their number, with repeats. Values come from 16 bits, those of the outermost of their classes from another 40, so that sums of
  millions of different units are still Cauchy; from about 2 * 10^7 different units on, more than a tenth of the lanes pass 2^31.
  With the counts this is the likeness of the multisets, shared units over all units;
  its standard deviation is about 0.04 at 0.6 and 0.06 at 0, and a few different units are told exactly.

Null and empty texts have no unit: the zero fingerprint, alike (1.0) to each
other and unlike (0.0) to any other. Documents are ordered by id, nulls first, and of one id by a hash of their text.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import workers_find_package

WINDOW, SHORT, LANES = 24, 48, 192
_CUT = re.compile(r"(?<=[.!?])\s+|\n+")
_FINE = re.compile("(?<=[" + "".join(re.escape(chr(c)) for c in range(0x30, 0x3000) if c % 8 == 4) + r"])\s+")
DENSE = 8
#: Values of a lane: quantiles of the Cauchy distribution, whose median size is ONE. Each 64-bit mix of a unit picks four of them.
ONE = 16
_CLASSES = 1 << 16
_CAUCHY = np.rint(ONE * np.tan(np.pi * ((np.arange(_CLASSES) + 0.5) / _CLASSES - 0.5))).astype(np.int64)
_KEYS = np.random.default_rng(20_240_901).integers(1, 2**63, LANES // 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Units whose lanes are made at once.
ROWS = 2048


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift), element-wise."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _lanes(h: np.ndarray) -> np.ndarray:
    """Sums of the units' lane values; h: two 64-bit hashes a unit."""
    out = np.zeros(LANES, np.int64)
    for at in range(0, len(h), ROWS):
        part = h[at : at + ROWS]
        picks = _mix(part[:, :1] * _KEYS + part[:, 1:]).view(np.uint16)
        out += _CAUCHY[picks].sum(axis=0)
        # The outermost classes have no single value: where in them, another 40 bits say.
        rows, lanes = np.nonzero((picks + np.uint16(1)) <= 1)
        if len(rows):
            picked = picks[rows, lanes]
            bits = _mix(part[rows, 1] * _KEYS[lanes // 4] + part[rows, 0] + lanes.astype(np.uint64)) >> np.uint64(24)
            size = np.rint(ONE / np.tan(np.pi * (bits + 0.5) / 2.0**40 / _CLASSES)).astype(np.int64)
            np.add.at(out, lanes, np.where(picked == 0, -size, size) - _CAUCHY[picked])
    return out


def units(text: str | None) -> list[str]:
    """The text's paragraphs, long ones cut further; see the module. Blank ones count for nothing."""
    out = []
    for part in _CUT.split(text or ""):
        for piece in (part,) if len(part) <= SHORT else _FINE.split(part):
            if len(piece) <= 8 * WINDOW:
                if piece and not piece.isspace():
                    out.append(piece)
                continue
            words = piece.split(" ")
            out.extend(" ".join(words[k : k + WINDOW]) for k in range(0, len(words), WINDOW))
    return out


class Fingerprint:
    """Sums of unit vectors; supports add, remove and +."""

    __slots__ = ("count", "dense", "wide")

    def __init__(self, dense=None, count: int = 0, wide=None):
        self.dense = np.zeros(DENSE, np.uint32) if dense is None else dense
        self.count = count
        self.wide = np.zeros(LANES, np.uint32) if wide is None else wide

    @classmethod
    def of(cls, parts: list[str]) -> Fingerprint:
        if not parts:
            return cls()
        raw = b"".join([hashlib.blake2b(p.encode("utf-8", "surrogatepass")).digest() for p in parts])
        h = np.frombuffer(raw, np.uint32).reshape(-1, 16)
        wide = _lanes(h[:, DENSE : DENSE + 4].copy().view(np.uint64))
        return cls(h[:, :DENSE].sum(axis=0, dtype=np.uint64).astype(np.uint32), len(parts), (wide & 0xFFFFFFFF).astype(np.uint32))

    @classmethod
    def of_text(cls, text: str | None) -> Fingerprint:
        return cls.of(units(text))

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.dense + other.dense, (self.count + other.count) & 0xFFFFFFFF, self.wide + other.wide)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.dense - other.dense, (self.count - other.count) & 0xFFFFFFFF, self.wide - other.wide)

    def add(self, parts: list[str]) -> Fingerprint:
        return self + Fingerprint.of(parts)

    def remove(self, parts: list[str]) -> Fingerprint:
        return self - Fingerprint.of(parts)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Fingerprint) and self.count == other.count and bool((self.dense == other.dense).all())

    __hash__ = None

    def hex(self) -> str:
        return self.dense.tobytes().hex() + f"{self.count:08x}" + self.wide.tobytes().hex()

    @classmethod
    def from_hex(cls, text: str) -> Fingerprint:
        at = DENSE * 8
        return cls(np.frombuffer(bytes.fromhex(text[:at]), np.uint32), int(text[at : at + 8], 16), np.frombuffer(bytes.fromhex(text[at + 8 :]), np.uint32))

    def likeness(self, other: Fingerprint) -> float:
        """1.0 for equal multisets; else shared units over all units, repeats counted, from the lanes and the counts."""
        if self == other:
            return 1.0
        both, apart = self.count + other.count, abs(self.count - other.count)
        size = np.abs((self.wide - other.wide).view(np.int32).astype(np.int64))
        size.partition([LANES // 2 - 1, LANES // 2])
        found = float(size[LANES // 2 - 1] + size[LANES // 2]) / (2 * ONE)
        # Units that differ are as odd in number as all units, no fewer than the counts differ by, no more than all.
        differ = min(both, max(apart, 2 - both % 2, both % 2 + 2 * round((found - both % 2) / 2)))
        return (both - differ) / (both + differ)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_text(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many (or all) of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def with_following(documents: DataFrame, id_col: str, text_col: str, rows_per_range: int = 4000) -> DataFrame:
    """Rows (rng, id, text, ahead), a partition for each range, in order of (id, hash of the text), ending with a row `ahead` that only tells what comes next.

    Ranges begin at keys of the table, quantiles of a sample of about 20 keys a range, so an id with many texts is split as well. There are as many as
    rows over rows_per_range asks for, up to eight a core, and one for each 10 * rows_per_range rows beyond that. The first row of each range
    is sent to the range before it as well, and the table's first row to the last range. One shuffle of the rows, no single partition.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    key = F.struct(F.col("id").isNotNull().cast("int").alias("real"), F.coalesce("id", F.lit(0)).cast("long").alias("id"), F.xxhash64("text").alias("h"))
    n, first = docs.agg(F.count("*"), F.min(key)).first()
    ranges = max(1, min(n // rows_per_range, 8 * spark.sparkContext.defaultParallelism), n // (10 * rows_per_range))
    starts: list[tuple] = []
    if ranges > 1:
        part = min(1.0, 20 * ranges / n)
        some = docs.select(key.alias("k")).where(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < int(part * (1 << 30)) + 1).distinct()
        found = sorted(tuple(r.k) for r in some.collect())  # about 20 a range
        starts = sorted({found[len(found) * k // ranges] for k in range(1, ranges) if found} - {tuple(first)})
    sent = spark.sparkContext.broadcast((starts, set(starts), tuple(first) if n else None))

    @F.pandas_udf("array<int>")
    def places(real: pd.Series, id_: pd.Series, h: pd.Series) -> pd.Series:
        """The row's range, and -1 - the range that it is only shown to."""
        starts, known, first = sent.value
        out = []
        for k in zip(real.tolist(), id_.tolist(), h.tolist(), strict=True):
            at = bisect_right(starts, k)
            out.append([at, -at] if k in known else [at, -1 - len(starts)] if k == first else [at])
        return pd.Series(out)

    dealt = docs.select("id", "text", F.xxhash64("text").alias("h"), F.explode(places(key["real"], key["id"], key["h"])).alias("place"))
    ahead = F.col("place") < 0
    both = dealt.select(F.when(ahead, -1 - F.col("place")).otherwise(F.col("place")).alias("rng"), "id", "text", ahead.cast("int").alias("ahead"), "h")
    return both.repartitionById(len(starts) + 1, F.col("rng")).sortWithinPartitions("rng", "ahead", F.col("id").asc_nulls_first(), "h").drop("h")


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCHEMA, one row for each row of documents (a repeated row: each time, followed by its twin); the last is followed by the first."""
    workers_find_package(documents.sparkSession)

    def run(batches):
        held = None
        for pdf in batches:
            out = []
            for rng, id_, text, ahead in zip(pdf["rng"].tolist(), pdf["id"].tolist(), pdf["text"].tolist(), pdf["ahead"].tolist(), strict=True):
                fp = Fingerprint.of_text(text)
                if held is not None and held[0] == rng:
                    _, hid, htext, hfp = held
                    after = edited_text(htext, text)
                    efp = hfp if after == htext else Fingerprint.of_text(after)
                    sha = hashlib.sha256(after.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((None if hid is None else int(hid), len(htext), sha, hfp.hex(), efp.hex(), hfp.likeness(efp), hfp.likeness(fp)))
                held = None if ahead else (rng, id_, text, fp)
            got = pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
            yield got.assign(doc_id=pd.array(got["doc_id"].tolist(), dtype="Int64"))

    return with_following(documents, id_col, text_col).select("rng", F.col("id").cast("string").alias("id"), "text", "ahead").mapInPandas(run, SCHEMA).withColumnRenamed("doc_id", id_col)
