"""Source divergence audit: which sources of a language differ most, and by which terms, in exact whole numbers.

A group is the documents of one language and source. Each language keeps the terms that stand in at least `min_docs` of its documents.
A group gives term t the share p = 1 + floor(UNIT * (count + 1) / (N + V)): N its kept terms with repeats, V the language's
kept terms; the language as a whole gives q in the same way. A term's divergence is floor((p - q)^2 / q); two sources diverge by
its sum over all kept terms (part `pair`), and a source's own terms are those that it uses more often than its language (part `term`).

Counting: tasks count their own documents by group and term and send, for each language and slice of the terms (by hash), one packed row; a slice is merged in one
place, drops the terms of too few documents, and yields a compressed vector for each group: its terms' places in the slice and its counts.

Meeting, by systolic rotation: the sources of a language are dealt to blocks. In each slice, a block's vectors stay in one partition, and the other
blocks' vectors come by in the rounds of a round-robin tournament (circle method), one after the other; of two blocks that meet, one stays and the other travels, by
turns, and a meeting is evaluated in both directions. A task holds the vectors of one block and one visitor. First of all the language's own vector comes with
the terms, and a heap keeps each group's best `top` of the slice; the best of all slices are among them. Terms that neither of two groups has add a constant each and aren't looped over.

A hot source or language is spread over all slices, and a hot term is one number for each group and task. What grows with the square of the sources of a language is the result,
and each vector is copied to half of the blocks. Null text, language and source are ''. Groups without any term have share 1 + floor(UNIT / V) everywhere, and
value 0 where the language keeps no term. Counts may reach 9 * 10^15. Rows that repeat count each; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.llm.common import arrow_schema, keep, pack, parts, scratch, summed, unpack, word_ids, workers_find_package, written

UNIT = 1_000_000_000
#: Tokens that a task counts before it sends them; bytes of text for each slice of a language's terms; sources a block.
CHUNK, SLICE_BYTES, BLOCK = 1 << 21, 64 << 20, 4
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

COUNTED = "lang string, slice int, sources array<string>, terms binary, source binary, term binary, tf binary, df binary"
VECTORS = "lang string, slice int, source string, whole boolean, n long, v long, vector binary, terms binary"
MET = "lang string, source string, part string, item string, value long"


def terms(text: str) -> list[bytes]:
    """Runs of letters A to Z, lower-cased, and characters beyond ASCII, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def slice_of(term: bytes, slices: int) -> int:
    return zlib.crc32(term) % slices


def shares(counts: np.ndarray | int, n: int, v: int) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / (n + v)), by three steps of a thousand, so that nothing overflows."""
    whole, rest = np.int64(0), np.asarray(counts, np.int64) + 1
    for _ in range(3):
        rest = rest * 1000
        whole, rest = whole * 1000 + rest // (n + v), rest % (n + v)
    return whole + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _counted(groups: list[tuple[str, str]], texts: list[list[bytes]], slices: int):
    """Rows of COUNTED for some documents: their groups and terms."""
    words, ids, lengths = word_ids(texts)
    if not len(ids):
        return
    names = sorted(set(groups))
    number = {g: k for k, g in enumerate(names)}
    doc = np.repeat(np.arange(len(texts)), lengths)
    each, tf = summed(doc * len(words) + ids, np.ones(len(ids), np.int64))
    of = np.array([number[g] for g in groups])[each // len(words)]
    key, tf, df = summed(of * len(words) + each % len(words), tf, np.ones(len(each), np.int64))
    group, term = key // len(words), key % len(words)
    part = np.array([slice_of(w, slices) for w in words])
    langs = sorted({g[0] for g in names})
    lang = np.array([langs.index(g[0]) for g in names])
    order = np.argsort(lang[group] * slices + part[term], kind="stable")
    group, term, tf, df = group[order], term[order], tf[order], df[order]
    where, starts = np.unique(lang[group] * slices + part[term], return_index=True)
    for w, a, b in zip(where.tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True):
        (gs, g), (ts, t) = np.unique(group[a:b], return_inverse=True), np.unique(term[a:b], return_inverse=True)
        yield langs[w // slices], w % slices, [names[k][1] for k in gs.tolist()], b"\n".join(words[k] for k in ts.tolist()), pack(g), pack(t), pack(tf[a:b]), pack(df[a:b])


def _counts(docs: DataFrame, slices: int) -> DataFrame:
    kinds = arrow_schema(COUNTED)

    def run(batches):
        import pyarrow as pa

        groups, texts, held = [], [], 0

        def sent():
            rows = list(_counted(groups, texts, slices))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)
            groups.clear()
            texts.clear()

        for batch in batches:
            for part in parts(batch, 2):
                for lang, source, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    groups.append((lang, source))
                    texts.append(terms(text))
                    held += len(texts[-1])
                if held >= CHUNK:
                    yield from sent()
                    held = 0
        yield from sent()

    return docs.mapInArrow(run, COUNTED)


def _merged(min_docs: int):
    """All packed rows of one language and slice -> its vectors, the language's own first."""
    kinds = arrow_schema(VECTORS)

    def run(table):
        import pyarrow as pa

        lang, part = table.column("lang")[0].as_py(), table.column("slice")[0].as_py()
        sources, words = {}, {}
        s, t, tf, df = [], [], [], []
        for row in table.to_batches():
            for k in range(len(row)):
                names = [sources.setdefault(x, len(sources)) for x in row.column("sources")[k].as_py()]
                known = [words.setdefault(x, len(words)) for x in row.column("terms")[k].as_py().split(b"\n")]
                s.append(np.array(names)[unpack(row.column("source")[k].as_py())[0]])
                t.append(np.array(known)[unpack(row.column("term")[k].as_py())[0]])
                tf += unpack(row.column("tf")[k].as_py())
                df += unpack(row.column("df")[k].as_py())
        s, t, tf, df = map(np.concatenate, (s, t, tf, df))
        _, docs = summed(np.concatenate([t, np.arange(len(words))]), np.concatenate([df, np.zeros(len(words), np.int64)]))
        names = list(words)
        kept = sorted((k for k in np.flatnonzero(docs >= min_docs).tolist()), key=names.__getitem__)
        v = len(kept)
        place = np.full(len(words), -1)
        place[kept] = np.arange(v)
        use = place[t] >= 0
        at, n = summed(s[use] * v + place[t[use]], tf[use])
        _, whole = summed(at % v, n) if v else (None, np.empty(0, np.int64))
        out = [(lang, part, "", True, int(whole.sum()), v, pack(np.arange(v), whole), b"\n".join(names[k] for k in kept))] if v else []
        for name, k in sources.items():
            a, b = np.searchsorted(at, [k * v, (k + 1) * v])
            if b > a:
                out.append((lang, part, name, False, int(n[a:b].sum()), v, pack(at[a:b] - k * v, n[a:b]), None))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [()] * len(kinds), kinds, strict=True)], schema=kinds)

    return run


class Member:
    """A group in one slice: where its terms are, their shares, and the share of all others."""

    def __init__(self, source: str, vector: bytes | None, n: int, v: int):
        self.source = source
        self.at, counts = unpack(vector) if vector else (np.empty(0, np.int64),) * 2
        self.share, self.rest = shares(counts, n, v), shares(0, n, v)

    def over(self, at: np.ndarray) -> np.ndarray:
        out = np.full(len(at), self.rest)
        out[np.searchsorted(at, self.at)] = self.share
        return out


def meeting(a: Member, b: Member, size: int) -> tuple[int, int]:
    """Divergence of a from b and of b from a over the size terms of a slice."""
    at = np.union1d(a.at, b.at)
    p, q = a.over(at), b.over(at)
    others = size - len(at)
    return int(divergence(p, q).sum()) + others * int(divergence(a.rest, b.rest)), int(divergence(q, p).sum()) + others * int(divergence(b.rest, a.rest))


def own_terms(a: Member, whole: np.ndarray, names: list[bytes], top: int) -> list[tuple[int, bytes]]:
    """The top (divergence, term) of a's terms that it has more often than its language, by value, then term."""
    q = whole[a.at]
    use = a.share > q
    f, at = divergence(a.share[use], q[use]), a.at[use]
    if len(f) > top:
        least = np.partition(f, len(f) - top)[len(f) - top]
        f, at = f[f >= least], at[f >= least]
    return [(-x, names[k]) for x, k in heapq.nsmallest(top, zip((-f).tolist(), at.tolist(), strict=True))]


def _meetings(top: int):
    """Rows of a partition in order of (lang, slice, block, turn): the language's vector, the residents, then visitors by round."""
    kinds = arrow_schema(MET)

    def run(batches):
        import pyarrow as pa

        here, residents, whole, names = None, [], None, []
        for batch in batches:
            out = []
            for k in range(len(batch)):
                lang, part, block, turn, source, n, size, v, vector, listed = (c[k].as_py() for c in batch.columns)
                if (lang, part, block) != here:
                    here, residents, whole, names = (lang, part, block), [], None, []
                if turn == -2:
                    whole, names = shares(unpack(vector)[1], n, v), listed.split(b"\n")
                    continue
                one = Member(source, vector, n, v)
                for other in residents:
                    f, g = meeting(one, other, size)
                    out += [(lang, one.source, "pair", other.source, f), (lang, other.source, "pair", one.source, g)]
                if turn == -1:
                    residents.append(one)
                    out += [(lang, source, "term", t.decode("utf-8", "surrogatepass"), f) for f, t in own_terms(one, whole, names, top)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)

    return run


def tournament(blocks: int) -> list[tuple[int, int, int]]:
    """(round, host, visitor) of every meeting of two blocks, each once: the circle method, with one block idle a round if they are odd in number."""
    n = blocks + blocks % 2
    out = []
    for r in range(n - 1):
        for i in range(n - 1):
            j = (2 * r - i) % (n - 1)
            if j == i:
                j = n - 1
                host, guest = (i, j) if r % 2 else (j, i)
            elif 2 * ((i - j) % (n - 1)) < n:
                host, guest = i, j
            else:
                continue
            if max(host, guest) < blocks:
                out.append((r, host, guest))
    return out


#: The same for one visitor, as SQL over its block, the turn (round), and `last`, the number of the last player: its opponent, and whether that one hosts.
_OPPONENT = "CASE WHEN block = last THEN turn WHEN pmod(2 * turn - block, last) = block THEN last ELSE pmod(2 * turn - block, last) END"
_TRAVELS = "CASE WHEN block = last THEN turn % 2 = 1 WHEN host = last THEN turn % 2 = 0 ELSE 2 * pmod(host - block, last) <= last END"


def divergences(documents: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank); see the module."""
    spark = documents.sparkSession
    workers_find_package(spark)
    q = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    docs = documents.select(q(lang_col).alias("lang"), q(source_col).alias("source"), q(text_col).alias("text"))
    with scratch():
        groups = written(docs.groupBy("lang", "source").agg(F.sum(F.octet_length("text").cast("long")).alias("bytes")), "groups")
        slices = 1 + (groups.agg(F.sum("bytes")).first()[0] or 0) // SLICE_BYTES
        vectors = _counts(docs, slices).groupBy("lang", "slice").applyInArrow(_merged(min_docs), VECTORS)
        vectors = written(vectors, "vectors")
        whole = vectors.where("whole")
        langs = whole.groupBy("lang").agg(F.sum("v").alias("v"), F.sum("n").alias("whole_n"))
        of = groups.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).join(langs, "lang", "left")
        own = vectors.where("NOT whole").groupBy("lang", "source").agg(F.sum("n").alias("n"))
        placed = groups.join(own, ["lang", "source"], "left").join(of, "lang").withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
        placed = written(placed.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), "v", "block", "blocks"), "placed")

        # Every group has a row in every slice of its language, with a vector where it has terms there.
        there = whole.select("lang", "slice", F.col("v").alias("size"))
        members = placed.join(there, "lang").join(vectors.where("NOT whole").select("lang", "slice", "source", "vector"), ["lang", "slice", "source"], "left")
        members = written(members, "members")
        columns = ["source", "n", "size", "v", "vector"]
        home = members.select("lang", "slice", "block", F.lit(-1).alias("turn"), *columns, F.lit(None).cast("binary").alias("terms"))
        guests = members.where("blocks > 1").withColumn("last", F.expr("blocks - 1 + blocks % 2"))
        guests = guests.withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("last") - 1))).withColumn("host", F.expr(_OPPONENT)).where(f"host < blocks AND {_TRAVELS}")
        guests = guests.select("lang", "slice", F.col("host").alias("block"), "turn", *columns, F.lit(None).cast("binary").alias("terms"))
        first = whole.select("lang", "slice", "terms", "vector", F.col("v").alias("size")).join(of.select("lang", "v", "whole_n", "blocks"), "lang")
        first = first.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        first = first.select("lang", "slice", "block", F.lit(-2).alias("turn"), F.lit("").alias("source"), F.col("whole_n").alias("n"), "size", "v", "vector", "terms")
        met = first.unionByName(home).unionByName(guests).repartition("lang", "slice", "block").sortWithinPartitions("lang", "slice", "block", "turn", "source")
        met = written(met.mapInArrow(_meetings(top), MET), "met")

        pairs = met.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
        empty = placed.where("v IS NULL")
        zero = empty.join(empty.select("lang", F.col("source").alias("item")), "lang").where("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
        by = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
        ranked = pairs.unionByName(zero).withColumn("rank", F.row_number().over(by))
        best = met.where("part = 'term'").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
        return keep(ranked.unionByName(best), "divergences")


def oracle(min_docs: int = 3, top: int = 200) -> str:
    """DuckDB twin of the query over documents."""
    rank = "CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank"
    share = lambda c, n: f"1 + ({UNIT} * ({c} + 1)) // ({n} + v)"
    f = "(p - q) * (p - q) // q"
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS c FROM w GROUP BY ALL HAVING count(DISTINCT id) >= {min_docs}),
l AS (SELECT lang, count(*) AS v, CAST(sum(c) AS BIGINT) AS nl FROM k GROUP BY lang),
c AS (SELECT w.lang, w.source, w.term, count(*) AS c FROM w JOIN k USING (lang, term) GROUP BY ALL),
n AS (SELECT lang, source, CAST(sum(c) AS BIGINT) AS n FROM c GROUP BY ALL),
g AS (SELECT lang, source, coalesce(n, 0) AS n, coalesce(v, 0) AS v, nl FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN n USING (lang, source) LEFT JOIN l USING (lang)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, {share("coalesce(c.c, 0)", "n")} AS p, {share("k.c", "nl")} AS q FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
t AS (SELECT lang, source, term AS item, {f} AS value FROM p WHERE c > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, {rank} FROM o
UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, {rank} FROM t) WHERE rank <= {top}"""
