"""MinHash near-dedup by tensored banding, with links confirmed on the full shingle sets.

Two small collections of `side` sketches are made of `rows` minima each. A
table key is a pair (sketch i of the first, sketch j of the second), so
side * side tables cost only 2 * side * rows minima a document: about the
square root of what independent tables of 2 * rows minima would cost. A pair of
similarity s shares a key with probability (1 - (1 - s^rows)^side)^2, which is
0.99993 at s = 0.8 with the defaults.

Candidates are never all pairs of a table's group. Equal sets are collapsed
first. Each group then links its members to its smallest one; links are
confirmed. Only members that this leaves in another component than the smallest
one are compared further, with the other components of their group: a single one as a
pair, a larger one as a whole, in blocks of full sets. Groups with CROWD such
components or more are joined to families by their members, and a family is compared
in blocks, so that no pairs are written for them: that meets every pair that their keys name, and others of the family. What is left out this way is links inside a component that is
already connected.

Empty or null texts have no shingles and link with nothing. Where an id repeats, each distinct (id, text)
is compared and placed apart; rows that are the same share their place. Every row of documents has a row. A null id
gets a null component and links with nothing. Other columns are carried through, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import Held, block_roots, components, keep, per_text, scratch, unused, worker_cache, written

WORD_CACHE = 100_000
BLOCK, COLUMNS = 384, 4096
#: Groups with so many components besides the smallest's are compared in blocks instead of pair by pair, which would write the square of them. Blocks meet all pairs that the keys name, and more.
CROWD = 32
SKETCH_BITS = 64
#: Share of the pairs at the threshold that the pre-test on SKETCH_BITS one-bit minima may lose.
LOST = 1e-6


def bits_apart(threshold: float) -> int:
    """Of SKETCH_BITS one-bit minima, a pair of similarity s differs in each with probability (1 - s) / 2. The most that all but LOST of the pairs at the threshold differ in: 20 at 0.8."""
    p, rest = (1 - threshold) / 2, 1.0
    for k in range(SKETCH_BITS):
        rest -= math.comb(SKETCH_BITS, k) * p**k * (1 - p) ** (SKETCH_BITS - k)
        if rest <= LOST:
            return k
    return SKETCH_BITS


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift), element-wise."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@worker_cache
def _words() -> Held:
    """Word -> 64-bit hash."""
    return Held(lambda word: int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little"), WORD_CACHE)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's width-word shingles (a shorter text: its whole word sequence)."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    got = _words()
    h = np.fromiter(map(got.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    width = min(width, len(h))
    x = np.full(n, width, np.uint64)
    for k in range(width):
        x = _mix(x * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(x)


@cache
def _multipliers(count: int) -> np.ndarray:
    rng = np.random.default_rng(20_240_613)
    return rng.integers(1, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minima(hashes: np.ndarray, count: int) -> np.ndarray:
    """count minima of the set, each under a multiply-and-mix of its own."""
    out = np.empty(count, np.uint64)
    mult = _multipliers(count)
    step = max(1, 200_000 // max(1, len(hashes)))
    for at in range(0, count, step):
        m = mult[at : at + step, None]
        x = hashes[None, :] * m
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        out[at : at + step] = x.min(axis=1)
    return out


def signature(hashes: np.ndarray, side: int, rows: int) -> tuple[int, list[int], list[int]]:
    """The 64 one-bit minima packed in a long, and the two collections of sketches."""
    need = 2 * side * rows
    low = minima(hashes, max(need, SKETCH_BITS))
    bits = ((low[:SKETCH_BITS] >> np.uint64(7)) & np.uint64(1)).astype(np.uint8)
    sketch = int(np.packbits(bits).view(">i8")[0])
    m = low[:need].reshape(2 * side, rows)
    x = np.arange(2 * side, dtype=np.uint64)
    for k in range(rows):
        x = _mix(x * np.uint64(0x9E3779B97F4A7C15) + m[:, k])
    x = x.view(np.int64)
    return sketch, x[:side].tolist(), x[side:].tolist()


def _signatures(docs: DataFrame, width: int, side: int, rows: int) -> DataFrame:
    def run(texts):
        out = []
        for text in texts:
            s = shingle_hashes(text, width)
            if not len(s):
                out.append((0, 0, 0, 0, [], []))
                continue
            d = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
            out.append((len(s), int(d[0]), int(d[1]), *signature(s, side, rows)))
        return out

    return written(per_text(docs, "id", "text", run, "n_shingles int, h1 long, h2 long, sketch long, a array<long>, b array<long>", (_words,)), "signatures")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    return per_text(docs, "id", "text", lambda texts: [(shingle_hashes(t, width).view(np.int64),) for t in texts], "hashes array<long>", (_words,))


def _near(threshold: float) -> str:
    """What any linked pair meets, from sizes and the packed bits alone."""
    apart = bits_apart(threshold)
    pct = round(threshold * 100)
    return f"100 * least(xn, yn) >= {pct} * greatest(xn, yn) AND bit_count(xs ^ ys) <= {apart}"


def _confirmed(pairs: DataFrame, docs: DataFrame, width: int, threshold: float) -> DataFrame:
    """Of pairs(x, y), distinct, those whose full sets meet the threshold. Texts are read again for the ids in pairs only."""
    pct = round(threshold * 100)
    ids = written(pairs.select(F.col("x").alias("id")).unionByName(pairs.select(F.col("y").alias("id"))).distinct(), "ids")
    sets = written(_sets(docs.join(ids, "id", "left_semi"), width), "sets")
    left = pairs.join(sets.select(F.col("id").alias("x"), F.col("hashes").alias("xh")), "x")
    both = left.join(sets.select(F.col("id").alias("y"), F.col("hashes").alias("yh")), "y")
    shared = F.size(F.array_intersect("xh", "yh"))
    return both.where(100 * shared >= pct * (F.size("xh") + F.size("yh") - shared)).select(F.col("x").alias("a"), F.col("y").alias("b"))


def _linked_block(threshold: float):
    """Rows of one block: queries and members, each with its set -> each row that has a link, and the smallest id it is connected to here."""
    pct = round(threshold * 100)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q, m = pdf[pdf["query"]], pdf[~pdf["query"]]
        if not len(q) or not len(m):
            return pd.DataFrame({"a": [], "b": []}).astype("int64")
        shared = np.zeros((len(q), len(m)), np.float32)
        both = np.intersect1d(np.concatenate(q["hashes"].tolist()), np.concatenate(m["hashes"].tolist()))

        def cells(sets):
            sizes = [len(h) for h in sets]
            row, h = np.repeat(np.arange(len(sizes)), sizes), np.concatenate(list(sets))
            at = np.minimum(np.searchsorted(both, h), max(len(both) - 1, 0))
            ok = both[at] == h if len(both) else np.zeros(len(h), bool)
            return row[ok], at[ok]

        (qr, qc), (mr, mc) = cells(q["hashes"]), cells(m["hashes"])
        for lo in range(0, len(both), COLUMNS):
            a, b = np.zeros((len(q), COLUMNS), np.float32), np.zeros((len(m), COLUMNS), np.float32)
            use = (qc >= lo) & (qc < lo + COLUMNS)
            a[qr[use], qc[use] - lo] = 1
            use = (mc >= lo) & (mc < lo + COLUMNS)
            b[mr[use], mc[use] - lo] = 1
            shared += a @ b.T
        n, k = q["hashes"].map(len).to_numpy(np.int64), m["hashes"].map(len).to_numpy(np.int64)
        shared = shared.astype(np.int64)
        qi, mi = q["id"].to_numpy(np.int64), m["id"].to_numpy(np.int64)
        linked = (100 * shared >= pct * (n[:, None] + k[None, :] - shared)) & (qi[:, None] != mi[None, :])
        rq, rm = block_roots(linked, qi, mi)
        return pd.DataFrame({"a": np.concatenate([qi[linked.any(1)], mi[linked.any(0)]]), "b": np.concatenate([rq[linked.any(1)], rm[linked.any(0)]])})

    return run


def _linked_in_blocks(sides: DataFrame, docs: DataFrame, width: int, threshold: float) -> DataFrame:
    """Connections between the queries and the members of each c in sides(c, id, query), by their full sets.

    They are compared in blocks of about BLOCK by BLOCK, so no task holds a whole c and no pairs are written; a block returns at
    most a row for each of its rows.
    """
    both = written(sides.distinct(), "sides")
    parts = written(both.groupBy("c").agg(F.ceil(F.count_if("query") / BLOCK).cast("int").alias("nq"), F.ceil(F.count_if(~F.col("query")) / BLOCK).cast("int").alias("nm")), "parts")
    sets = written(_sets(docs.join(written(both.select("id").distinct(), "ids"), "id", "left_semi"), width), "sets")
    dealt = both.join(parts, "c").withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("query"), F.col("nq")).otherwise(F.col("nm"))).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("query"), F.col("nm")).otherwise(F.col("nq")) - 1)))
    dealt = dealt.select("c", "query", "id", F.when(F.col("query"), F.col("own")).otherwise(F.col("other")).alias("bq"), F.when(F.col("query"), F.col("other")).otherwise(F.col("own")).alias("bm"))
    return dealt.join(sets, "id").groupBy("c", "bq", "bm").applyInPandas(_linked_block(threshold), "a long, b long")


def _placed(docs: DataFrame, sigs: DataFrame, width: int, threshold: float) -> DataFrame:
    """(id, component_id) of the ids in docs(id, text), distinct or null, that have a link; sigs: their signatures."""
    real = sigs.where("id IS NOT NULL AND n_shingles > 0")

    # Equal sets: one representative, the smallest id.
    key = ["n_shingles", "h1", "h2"]
    same = written(real.groupBy(*key).agg(F.min("id").alias("rep"), F.count("*").alias("c")).where("c > 1").drop("c"), "same")
    copies = written(real.select("id", *key).join(same, key).where("id <> rep").select("id", "rep"), "copies")
    reps = real.join(copies.select("id"), "id", "left_anti")

    # side * side keys a representative; groups of two or more.
    keyed = (
        reps.select("id", "a", F.posexplode("b").alias("j", "kb"))
        .select("id", "j", "kb", F.posexplode("a").alias("i", "ka"))
        .select(F.xxhash64("i", "j", "ka", "kb").alias("k"), "id")
    )
    groups = written(keyed.groupBy("k").agg(F.min("id").alias("p"), F.count("*").alias("c")).where("c > 1").select("k", "p"), "groups")
    members = written(keyed.join(groups, "k"), "members")
    short = reps.select("id", F.col("n_shingles").alias("n"), "sketch")

    def described(pairs: DataFrame) -> DataFrame:
        x = short.select(F.col("id").alias("x"), F.col("n").alias("xn"), F.col("sketch").alias("xs"))
        y = short.select(F.col("id").alias("y"), F.col("n").alias("yn"), F.col("sketch").alias("ys"))
        return pairs.join(x, "x").join(y, "y").where(_near(threshold)).select("x", "y")

    stars = written(described(members.where("id <> p").select(F.col("p").alias("x"), F.col("id").alias("y")).distinct()), "stars")
    links = written(_confirmed(stars, docs, width, threshold), "links")
    found = components(links)

    # Members not confirmed with their group's smallest: against the other components of the group, each named once.
    of = written(found.groupBy("component_id").agg(F.count("*").alias("size")), "sizes")
    of = found.join(of, "component_id").select("id", "component_id", "size")
    own = members.join(of, "id", "left").select("k", "id", "p", F.coalesce("component_id", "id").alias("c"), F.coalesce("size", F.lit(1)).alias("size"))
    head = own.join(found.select(F.col("id").alias("p"), F.col("component_id").alias("pc")), "p", "left").withColumn("pc", F.coalesce("pc", "p"))
    mixed = written(head.join(short, "id").withColumn("odd", F.col("c") != F.col("pc")), "mixed")
    if mixed.where("odd").limit(1).count():
        found = _rest(docs, mixed, short, found, links, width, threshold)

    # Copies take the component of their representative.
    of = found.select(F.col("id").alias("rep"), F.col("component_id").alias("rc"))
    copied = copies.join(of, "rep", "left").select("id", F.coalesce("rc", "rep").alias("component_id"))
    return written(found.unionByName(copied), "placed")


def _rest(docs: DataFrame, mixed: DataFrame, short: DataFrame, found: DataFrame, links: DataFrame, width: int, threshold: float) -> DataFrame:
    """The components after the odd members of mixed have been compared with the other components of their groups."""
    odd = mixed.where("odd").select("k", F.col("id").alias("y"), F.col("c").alias("yc"), F.col("size").alias("ysize"), F.col("n").alias("yn"), F.col("sketch").alias("ys"))
    # Groups with many such members are taken together where they share members, and compared in blocks.
    crowded = written(odd.groupBy("k").agg(F.countDistinct("yc").alias("n")).where(F.col("n") >= CROWD).select("k"), "crowded")
    extra = docs.sparkSession.createDataFrame([], "a long, b long")
    if crowded.limit(1).count():
        full = written(mixed.join(crowded, "k", "left_semi").select("id", "p", "odd"), "full")
        families = components(full.select(F.col("id").alias("a"), F.col("p").alias("b")))
        families = families.select("id", F.col("component_id").alias("c"))
        sides = full.where("odd").select("id").join(families, "id").select("c", "id", F.lit(True).alias("query")).unionByName(families.select("c", "id", F.lit(False).alias("query")))
        extra = _linked_in_blocks(sides, docs, width, threshold)
    odd, mixed = odd.join(crowded, "k", "left_anti"), mixed.join(crowded, "k", "left_anti")
    alone = F.col("size") == 1
    there = mixed.select("k", F.col("c").alias("x"), "size", "odd", F.when(alone, F.col("n")).alias("xn"), F.when(alone, F.col("sketch")).alias("xs"))
    # The others: a component of one as a pair (not the smallest, which was compared; of two such, once), a larger one in blocks as well.
    single = f"size = 1 AND odd AND (ysize > 1 OR x < y) AND {_near(threshold)}"
    met = there.where("size > 1 OR odd").distinct().alias("o").join(odd.alias("d"), F.expr(f"o.k = d.k AND x <> yc AND (size > 1 OR ({single}))"))
    met = written(met.select("x", "y", "size").distinct(), "met")
    if met.where("size > 1").limit(1).count():
        large = met.where("size > 1").select(F.col("x").alias("c"), F.col("y").alias("id"), F.lit(True).alias("query"))
        members = found.join(large.select(F.col("c").alias("component_id")).distinct(), "component_id", "left_semi")
        sides = large.unionByName(members.select(F.col("component_id").alias("c"), "id", F.lit(False).alias("query")))
        extra = extra.unionByName(_linked_in_blocks(sides, docs, width, threshold))
    extra = written(extra.unionByName(_confirmed(met.where("size = 1").select("x", "y"), docs, width, threshold)), "extra")
    return components(links.unionByName(extra)) if extra.limit(1).count() else found


def _named(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2")]


def _classes(documents: DataFrame, id_col: str, text_col: str, width: int, threshold: float, side: int, rows: int) -> tuple[DataFrame, bool]:
    """(id, n_shingles, component_id, first, ...) and whether an id repeats; first: nothing of its group has a smaller (id, text).

    If an id repeats there is a row for each distinct (id, text), with the text's hashes t1 and t2 and how often it comes, `times`; null ids have a row each time.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sigs = _signatures(docs, width, side, rows)
    if not sigs.groupBy("id").count().where("id IS NOT NULL AND count > 1").limit(1).count():
        out = sigs.join(_placed(docs, sigs, width, threshold), "id", "left").withColumn("component_id", F.coalesce("component_id", "id"))
        return out.withColumn("first", F.col("id").isNull() | (F.col("id") == F.col("component_id"))).select("id", "n_shingles", "component_id", "first"), False
    # Each distinct (id, text) is a node; texts are the smaller the earlier in the alphabet, null first.
    nodes = docs.where("id IS NOT NULL").groupBy("id", "text").agg(F.count("*").cast("int").alias("times"))
    nodes = nodes.select(F.monotonically_increasing_id().alias("node"), F.col("id").alias("doc"), "text", "times")
    nodes = written(nodes, "nodes")
    texts = nodes.select(F.col("node").alias("id"), "text")
    node_sigs = _signatures(texts, width, side, rows)
    placed = _placed(texts, node_sigs, width, threshold).select(F.col("id").alias("node"), F.col("component_id").alias("c"))
    short = node_sigs.select(F.col("id").alias("node"), "n_shingles")
    every = nodes.join(short, "node").join(placed, "node", "left").withColumn("c", F.coalesce("c", "node"))
    key = F.struct(F.col("doc"), F.col("text").isNotNull().alias("real"), F.coalesce("text", F.lit("")).alias("text"), F.col("node"))
    low = written(every.groupBy("c").agg(F.min("doc").alias("component_id")), "lowest")
    # Only the texts of a group's smallest id are compared.
    heads = every.join(low, "c").where("doc = component_id").groupBy("c").agg(F.min(key).getField("node").alias("head"))
    heads = written(heads, "heads")
    out = every.join(low, "c").join(heads, "c").select(F.col("doc").alias("id"), "n_shingles", "component_id", (F.col("node") == F.col("head")).alias("first"), *_named(F.col("text")), "times")
    nulls = sigs.where("id IS NULL").select("id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("first"), F.lit(0).cast("long").alias("t1"), F.lit(0).cast("long").alias("t2"), F.lit(1).alias("times"))
    return written(out.unionByName(nulls), "classes"), True


def near_duplicates(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    threshold: float = 0.8,
    side: int = 10,
    rows: int = 2,
) -> DataFrame:
    """(id, n_shingles, component_id), a row for each row of documents. component_id is the smallest id of the group. See the module for the method."""
    with scratch():
        found, repeats = _classes(documents, id_col, text_col, width, threshold, side, rows)
        if repeats:
            found = found.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times"))))
        return keep(found.select("id", F.col("n_shingles").cast("long").alias("n_shingles"), "component_id"), "near-duplicates")


def keep_first(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8, side: int = 10, rows: int = 2) -> DataFrame:
    """documents with one row for each group of near duplicates: that with the smallest id, and of its texts the smallest. Rows with a null id stay.

    Rows that are the same stay as often as they come, if they are kept; rows with one id and different texts are judged apart.
    """
    id_, t1, t2 = unused(documents.columns, "gone", "t1", "t2")
    with scratch():
        found, repeats = _classes(documents, id_col, text_col, width, threshold, side, rows)
        gone = keep(found.where("NOT first").select(F.col("id").alias(id_), *([F.col("t1").alias(t1), F.col("t2").alias(t2)] if repeats else [])), "gone")
    same = F.col(f"`{id_col}`").cast("long") == F.col(id_)
    if repeats:
        for name, h in zip((t1, t2), _named(F.col(f"`{text_col}`").cast("string")), strict=True):
            same &= h == F.col(name)
    return documents.join(gone, same, "left_anti")
