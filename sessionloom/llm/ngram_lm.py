"""Language-model scoring: an interpolated modified Kneser-Ney n-gram model, counted in Spark and memory-mapped by workers.

A text's tokens are its words, A-Z lower-cased, and an END; what stands before the first is BEGIN.

Counting. The lexicon comes first: words are counted by their 64-bit hash. Its shards (ranges of hashes) are sorted arrays in files, and a word's
place in them is its number. Tasks then count the n-grams of their own documents and send them packed, by ranges of the n-gram's hash. A shard sums them,
writes its sorted array of hashes and counts, and sends on, summed first, what the next lower order and the contexts take from it:
each different n-gram adds one to its last n - 1 words (the Kneser-Ney count of that (n - 1)-gram, how many words come before it),
and its count to its first n - 1 words (the sum S of a context and how many of its n-grams have counts of 1, 2, 3 and more). So each order takes one shuffle, keys are spread by a
hash of the whole n-gram, and a word or pair that makes up a third of the corpus is one number for each task.

Probability, with a the count (the Kneser-Ney count below the highest order) and D(a) one of three discounts of each order, by the counts of counts:
p(w | h) = (max(a - D(a), 0) + (D1 N1 + D2 N2 + D3 N3) p(w | h without its first word)) / S, and the shorter context's where S = 0; below single words 1 / (V + 1) for each of V
tokens and one unknown. Where counts of counts don't give discounts between 0 and a, they are 0.5, 1, 1.5.

Scoring. Workers map the files, look up each distinct key of some documents once, in order, and interpolate. Files in a folder of scheme file: are mapped in place;
from another store a worker copies those that it needs to its own disk. The driver holds a row for each file: one a table and SHARD_BYTES of text.

Null and empty texts are an END alone; null ids count as the text '' where documents are held out. Without training texts every probability is 1 / (V + 1) = 1. Words whose 64-bit hashes
are the same would count as one (under one pair expected in 6 * 10^9 words). Rows that repeat count and are scored each.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import Store, arrow_schema, fresh_dir, pack, parts, summed, unpack, word_ids, workers_find_package

ORDER = 2
#: Tokens that a task takes at once; bytes of training text for each shard.
CHUNK, SHARD_BYTES = 1 << 20, 32 << 20
END = b"\n"
#: Values from this on stand in a list of their own, so that the others take a byte.
LARGE = 255
MESSAGE = "kind string, level int, shard int, data binary, file string, sizes array<long>, total long, tally array<long>"


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def word_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def keys_of(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each row of word numbers."""
    x = np.full(len(columns[0]), len(columns), np.uint64)
    for c in columns:
        x = x * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64) + np.uint64(1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def discounts(tally: list[int]) -> tuple[float, float, float]:
    """From how many n-grams have counts 1 to 4."""
    n1, n2, n3, n4 = tally
    if n1 and n2 and n3:
        y = n1 / (n1 + 2 * n2)
        d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
        if all(0 <= x <= k for k, x in enumerate(d, 1)):
            return d
    return 0.5, 1.0, 1.5


class Table:
    """Sorted keys and their values in shards by the keys' first bits, mapped when first looked at. Keys that aren't there have value 0.

    A shard's file has the keys, for each column the places and values of its LARGE numbers, then a byte a key for each column.
    """

    def __init__(self, root: str, bits: int, files: dict[int, tuple[str, list[int]]], columns: int):
        self.root, self.bits, self.files, self.columns = root, bits, files, columns
        self.base = np.concatenate([[0], np.cumsum([files[s][1][0] if s in files else 0 for s in range(1 << bits)])])
        self.maps: dict[int, tuple[np.ndarray, list]] = {}

    def __getstate__(self):
        return self.__dict__ | {"maps": {}}

    def arrays(self, shard: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """The keys, and each column as (bytes, places, values)."""
        if shard not in self.maps:
            name, (n, *large) = self.files[shard]
            whole = np.memmap(Store(self.root).local(name), np.uint8, "r")
            words, at, columns = whole[: 8 * (n + 2 * sum(large))].view("<u8"), n, []
            for k, m in enumerate(large):
                own = len(whole) - (len(large) - k) * n
                columns.append((whole[own : own + n], words[at : at + m], words[at + m : at + 2 * m]))
                at += 2 * m
            self.maps[shard] = words[:n], columns
        return self.maps[shard]

    def lookup(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each key's place in the whole table (-1: none), and its values, a column each."""
        some, back = np.unique(keys, return_inverse=True)
        place, values = np.full(len(some), -1), np.zeros((self.columns, len(some)), np.int64)
        shards = shard_of(some, self.bits)
        for shard in np.unique(shards).tolist():
            if shard in self.files:
                a, b = np.searchsorted(shards, [shard, shard + 1])
                own, columns = self.arrays(shard)
                at = np.minimum(np.searchsorted(own, some[a:b]), len(own) - 1)
                hit = np.flatnonzero(own[at] == some[a:b])
                place[a + hit] = self.base[shard] + at[hit]
                for k, (small, places, large) in enumerate(columns):
                    got = small[at[hit]].astype(np.int64)
                    some_large = np.flatnonzero(got == LARGE)
                    got[some_large] = large[np.searchsorted(places, at[hit][some_large])]
                    values[k, a + hit] = got
        return place[back], values[:, back]


def shard_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


@dataclass
class Model:
    """n tokens of v kinds; tables by name: words, then grams and contexts of each order (`g2`, `c2`, ...); discounts and sums by order."""

    order: int
    tokens: int = 0
    kinds: int = 0
    tables: dict[str, Table] = field(default_factory=dict)
    cut: dict[int, tuple[float, float, float]] = field(default_factory=dict)
    singles: tuple[int, int, int, int] = (0, 0, 0, 0)

    def numbered(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each token's number (kinds + 1: unknown) and count, and each text's length."""
        words, ids, lengths = word_ids(texts)
        place, (count,) = self.tables["words"].lookup(np.array([word_hash(w) for w in words], np.uint64))
        return np.where(place < 0, self.kinds + 1, place)[ids], count[ids], lengths

    def windows(self, ids: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        """Columns: the token `order` - 1 before each, ..., the token itself; BEGIN is number `kinds`."""
        at = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        back = lambda j: np.where(at >= j, ids[np.maximum(np.arange(len(ids)) - j, 0)], self.kinds)
        return [back(j) for j in range(self.order - 1, 0, -1)] + [ids]

    def log10(self, columns: list[np.ndarray]) -> np.ndarray:
        """log10 of the probability of the last column's tokens after the others."""
        less = lambda a, k: np.maximum(a - np.array([0.0, *self.cut[k]])[np.minimum(a, 3)], 0)
        s, *kinds = self.singles
        p = np.full(len(columns[0]), 1 / (self.kinds + 1))
        if s:
            _, (a,) = self.tables["g1"].lookup(keys_of(columns[-1:]))
            p = (less(a, 1) + np.dot(self.cut[1], kinds) * p) / s
        for k in range(2, self.order + 1):
            _, (s, *kinds) = self.tables[f"c{k}"].lookup(keys_of(columns[-k:-1]))
            _, (a,) = self.tables[f"g{k}"].lookup(keys_of(columns[-k:]))
            known = s > 0
            p = np.where(known, (less(a, k) + np.tensordot(self.cut[k], np.array(kinds), 1) * p) / np.maximum(s, 1), p)
        return np.log10(p)


def _batch(rows: list[tuple], kinds):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)


def _in_chunks(batches, of):
    """of(texts) for the texts of the last column, by about CHUNK tokens; yields its result with the other columns' rows."""
    others, texts, held = [], [], 0
    for batch in batches:
        for part in parts(batch, batch.num_columns - 1):
            for *other, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                others.append(other)
                texts.append(tokens(text))
                held += len(texts[-1])
            if held >= CHUNK:
                yield others, of(texts)
                others, texts, held = [], [], 0
    if texts:
        yield others, of(texts)


def _saved(root: str, name: str, shard: int, keys: np.ndarray, *columns: np.ndarray) -> tuple[str, list[int]]:
    """A shard's file, as Table reads it, and its sizes. The name is the attempt's, so a repeated task leaves at most a file that nothing refers to."""
    file, large = f"{name}-{shard}-{uuid.uuid4().hex}", [np.flatnonzero(c >= LARGE) for c in columns]
    with Store(root).create(file) as f:
        f.write(keys.astype("<u8").tobytes())
        for c, at in zip(columns, large, strict=True):
            f.write(at.astype("<u8").tobytes() + c[at].astype("<u8").tobytes())
        for c in columns:
            f.write(np.minimum(c, LARGE).astype(np.uint8).tobytes())
    return file, [len(keys), *map(len, large)]


def _sent(kind: str, level: int, bits: int, keys: np.ndarray, columns: list[np.ndarray]):
    """Messages with packed columns, by the shard of the keys."""
    shards = shard_of(keys, bits)
    order = np.lexsort((*columns[::-1], shards))
    cut = np.searchsorted(shards[order], np.arange((1 << bits) + 1))
    for s in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
        some = order[cut[s] : cut[s + 1]]
        yield kind, level, s, pack(*[c[some] for c in columns]), None, None, None, None


def _joined(messages: list[bytes], width: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Rising keys, the word numbers of each and the sums of the other columns; width: word numbers a row."""
    columns = [np.concatenate(c) for c in zip(*map(unpack, messages), strict=True)]
    keys = keys_of(columns[:width])
    order = np.argsort(keys, kind="stable")
    first = order[np.flatnonzero(np.r_[True, np.diff(keys[order]) > 0])]
    return keys[first], [c[first] for c in columns[:width]], list(summed(keys, *columns[width:])[1:])


def _level(root: str, bits: int, level: int):
    """A shard's messages for the n-grams of `level` words and the contexts one longer: writes both and sends on what the next level takes. Rows about files pass."""
    kinds = arrow_schema(MESSAGE)

    def run(table):
        import pyarrow as pa

        shard, out, got = table.column("shard")[0].as_py(), [], {"gram": [], "context": []}
        for row in table.to_pylist():
            if row["kind"] in got:
                got[row["kind"]].append(row["data"])
            else:
                out.append(tuple(row[f.name] for f in kinds))
        if got["context"]:
            keys, _, sums = _joined(got["context"], level)
            out.append(("file", level + 1, shard, None, *_saved(root, f"c{level + 1}", shard, keys, *sums), None, None))
        if got["gram"]:
            keys, words, (a,) = _joined(got["gram"], level)
            tally = [int((a == k).sum()) for k in range(1, 5)]
            out.append(("count", level, shard, None, *_saved(root, f"g{level}", shard, keys, a), int(a.sum()), tally))
            if level > 1:
                ones = np.ones(len(a), np.int64)
                for kind, own, columns in (("gram", words[1:], [ones]), ("context", words[:-1], [a, *[(a == k) * ones for k in (1, 2)], (a > 2) * ones])):
                    own_keys = keys_of(own)
                    order = np.argsort(own_keys, kind="stable")
                    first = order[np.flatnonzero(np.r_[True, np.diff(own_keys[order]) > 0])]
                    out += _sent(kind, level - 1, bits, own_keys[first], [*[c[first] for c in own], *summed(own_keys, *columns)[1:]])
        return pa.Table.from_batches([_batch(out, kinds)])

    return run


def _words(root: str):
    """A shard's words: their hashes and counts, written."""
    kinds = arrow_schema(MESSAGE)

    def run(table):
        import pyarrow as pa

        shard = table.column("shard")[0].as_py()
        columns = [np.concatenate(c) for c in zip(*(unpack(d) for d in table.column("data").to_pylist()), strict=True)]
        keys, count = summed(columns[0].view(np.uint64), columns[1])
        return pa.Table.from_batches([_batch([("word", 0, shard, None, *_saved(root, "words", shard, keys, count), int(count.sum()), None)], kinds)])

    return run


def train(documents: DataFrame, use: Column | None = None, text_col: str = "text", order: int = ORDER) -> Model:
    """The model of the documents for which `use` holds, its arrays in the shared folder until the application's scratch is cleared."""
    spark = documents.sparkSession
    workers_find_package(spark)
    root, kinds = fresh_dir(spark, "ngram-lm"), arrow_schema(MESSAGE)
    texts = documents.where(F.lit(True) if use is None else use).select(F.col(f"`{text_col}`").cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = max(0, (size // SHARD_BYTES).bit_length())
    table = lambda rows, columns: Table(root, bits, {r.shard: (r.file, r.sizes) for r in rows}, columns)

    def counted(batches):
        def of(texts):
            words, ids, _ = word_ids(texts)
            hashes = np.array([word_hash(w) for w in words], np.uint64)
            return list(_sent("word", 0, bits, hashes, [hashes.view(np.int64), np.bincount(ids, minlength=len(words))]))

        for _, rows in _in_chunks(batches, of):
            yield _batch(rows, kinds)

    found = texts.mapInArrow(counted, MESSAGE).groupBy("shard").applyInArrow(_words(root), MESSAGE).select("shard", "file", "sizes", "total").collect()  # a row a shard
    model = Model(order, sum(r.total for r in found), sum(r.sizes[0] for r in found), {"words": table(found, 1)})
    sent = spark.sparkContext.broadcast(model)

    def grams(batches):
        model = sent.value

        def of(texts):
            ids, _, lengths = model.numbered(texts)
            columns = model.windows(ids, lengths)
            keys = keys_of(columns)
            order = np.argsort(keys, kind="stable")
            first = order[np.flatnonzero(np.r_[True, np.diff(keys[order]) > 0])]
            own, count = summed(keys, np.ones(len(keys), np.int64))
            return list(_sent("gram", model.order, bits, own, [*[c[first] for c in columns], count]))

        for _, rows in _in_chunks(batches, of):
            yield _batch(rows, kinds)

    rows = texts.mapInArrow(grams, MESSAGE)
    for level in range(order, 0, -1):
        rows = rows.groupBy("shard").applyInArrow(_level(root, bits, level), MESSAGE)
    found = rows.select("kind", "level", "shard", "file", "sizes", "total", "tally").collect()  # rows about files only
    for level in range(1, order + 1):
        own = [r for r in found if r.kind == "count" and r.level == level]
        tally = [sum(r.tally[k] for r in own) for k in range(4)]
        model.cut[level] = discounts(tally)
        model.tables[f"g{level}"] = table(own, 1)
        model.tables[f"c{level}"] = table([r for r in found if r.kind == "file" and r.level == level], 4)
        if level == 1:
            model.singles = (sum(r.total for r in own), tally[0], tally[1], sum(r.sizes[0] for r in own) - tally[0] - tally[1])
    return model


SCORED = "n_tokens long, n_known long, base_score double, score double"


def score(documents: DataFrame, model: Model, keep_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """(*keep_cols, n_tokens, n_known, base_score, score), a row for each row of documents.

    score is the log10 probability of the text with its END; 10 ** (-score / n_tokens) is its perplexity.
    """
    spark = documents.sparkSession
    workers_find_package(spark)
    sent = spark.sparkContext.broadcast(model)
    rows = documents.select(*[F.col(f"`{c}`").alias(f"k{k}") for k, c in enumerate(keep_cols)], F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]], SCORED])
    kinds = arrow_schema(schema)

    def run(batches):
        model = sent.value

        def of(texts):
            ids, count, lengths = model.numbered(texts)
            starts = np.cumsum(lengths) - lengths
            sums = lambda x: np.add.reduceat(x, starts)
            base = np.log10((count + 1) / (model.tokens + model.kinds + 1))
            return lengths, sums((count > 0).astype(np.int64)), sums(base), sums(model.log10(model.windows(ids, lengths)))

        for others, got in _in_chunks(batches, of):
            yield _batch([(*o, *g) for o, g in zip(others, zip(*(x.tolist() for x in got), strict=True), strict=True)], kinds)

    return rows.mapInArrow(run, schema).toDF(*keep_cols, "n_tokens", "n_known", "base_score", "score")


def bucket(id_col: str) -> Column:
    """crc32 of the id as text, mod 7: 2 is held out. A null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % 7
