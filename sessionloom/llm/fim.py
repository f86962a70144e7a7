"""Fill-in-middle transformation over an index of distinct texts.

A text is cut into lines. The index has a row for each distinct text: the ends of
its lines in code points, as an Elias-Fano list, made once for all copies (each task
makes a list for a text that it hasn't seen, and equal ones are joined into one). The index is
joined back to the documents and each document selects its two seeded cuts from the list, without looking for lines again.

Copies meet by a 64-bit hash and their length, and the content is verified: a document takes the cuts only if
its own text has as many lines in all, as many before each cut, and a line's end at each cut. One that
shares hash and length with another text, and so fails, gets a list of its own, so results don't depend on hashes.

The prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1) of the n lines, the middle after the larger; h1 to h4 are
the first four 8-digit groups of the sha256 of `seed:id`. Null texts are empty; empty texts and those that hold a marker stay as they are (`plain`).
A null id counts as the text ''. Rows that repeat are transformed each; other columns are carried only if asked for by `keep`.
The join is on the text's key alone, so adaptive execution can split a text's copies; lists are about two bits and the logarithm of a line's length for each line.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import arrow_schema, keep, parts, scratch, unused, workers_find_package

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM = 7, 100, 50
#: Keys that a task remembers while it makes lists; more than these are made again, and joined after.
SEEN = 200_000
_HEAD = struct.Struct("<QB")
_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1).astype(np.int64)


def ends(text: str) -> np.ndarray:
    """The code points up to the end of each line; the last line may lack its line feed."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.flatnonzero(code == 10) + 1
    return at if not len(code) or (len(at) and at[-1] == len(code)) else np.append(at, len(code))


def elias_fano(values: np.ndarray) -> bytes:
    """Rising positive numbers: the low bits of each side by side, the high ones in unary."""
    n = len(values)
    low = max(0, int(values[-1] // n).bit_length() - 1) if n else 0
    x = values.astype(np.int64)
    bits = ((x[:, None] >> np.arange(low)) & 1).astype(np.uint8)
    high = np.zeros((int(x[-1] >> low) if n else 0) + n, np.uint8)
    high[(x >> low) + np.arange(n)] = 1
    return _HEAD.pack(n, low) + np.packbits(bits.ravel(), bitorder="little").tobytes() + np.packbits(high, bitorder="little").tobytes()


def size(made: bytes) -> int:
    return _HEAD.unpack_from(made)[0]


def select(made: bytes, k: int) -> int:
    """The k-th number of the list, from 1; 0 for k = 0."""
    if not k:
        return 0
    n, low = _HEAD.unpack_from(made)
    split = _HEAD.size + (n * low + 7) // 8
    high = np.frombuffer(made, np.uint8, offset=split)
    upto = np.cumsum(_ONES[high])
    byte = int(np.searchsorted(upto, k))
    inside = np.flatnonzero(np.unpackbits(high[byte : byte + 1], bitorder="little"))
    at = 8 * byte + int(inside[k - 1 - (int(upto[byte - 1]) if byte else 0)])
    first = (k - 1) * low
    word = int.from_bytes(made[_HEAD.size + first // 8 : _HEAD.size + (first + low + 7) // 8], "little")
    return (at - (k - 1) << low) | (word >> first % 8) & ((1 << low) - 1)


def _key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h"), F.char_length(text).cast("long").alias("n_chars")]


def text_index(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """(h, n_chars, n, ends): a row for each distinct text, n its lines and ends their Elias-Fano list. Only lists are shuffled, no texts."""
    workers_find_package(documents.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = documents.select(*_key(text), text.alias("text"))
    schema = "h long, n_chars long, n long, ends binary"
    kinds = arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for part in parts(batch, 2):
                out = []
                for key, i in zip(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True), range(len(part)), strict=True):
                    if key not in seen:
                        seen.add(key)
                        made = elias_fano(ends(part.column(2)[i].as_py()))
                        out.append((*key, size(made), made))
                if len(seen) > SEEN:
                    seen.clear()
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)

    lists = rows.mapInArrow(run, schema)
    return lists.groupBy("h", "n_chars").agg(F.min(F.struct("n", "ends")).alias("l")).select("h", "n_chars", "l.n", "l.ends")


def _cuts(made: pd.Series, h1: pd.Series, h2: pd.Series) -> pd.DataFrame:
    """Lines before each cut and where they end."""
    out = []
    for m, x, y in zip(made, h1, h2, strict=True):
        n = size(m) + 1
        a, b = sorted((x % n, y % n))
        out.append((a, b, select(m, a), select(m, b)))
    return pd.DataFrame(out, columns=["a", "b", "prefix_end", "middle_end"])


def _own(text: pd.Series) -> pd.Series:
    """The list of each text; null stays."""
    return text.map(lambda t: None if t is None else elias_fano(ends(t)))


def _lines(text: Column) -> Column:
    whole = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))
    return (whole + F.when((text != "") & ~F.endswith(text, F.lit("\n")), 1).otherwise(0)).cast("long")


def _fits(text: Column, end: Column, lines: Column) -> Column:
    before = F.substr(text, F.lit(1), end.cast("int"))
    return (_lines(before) == lines) & (F.char_length(before) == end) & ((end == 0) | (end == F.char_length(text)) | F.endswith(before, F.lit("\n")))


def transform(documents: DataFrame, index: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_cols: tuple[str, ...] = (), seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """(id_col, *keep_cols, n, form, prefix_chars, middle_chars, output), a row for each row of documents; index: text_index of them."""
    q = lambda c: F.col(f"`{c}`")
    text_, h, chars, *hs = unused([id_col, *keep_cols, "n", "ends"], "text", "h", "n_chars", "h1", "h2", "h3", "h4")
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(q(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    text = F.coalesce(q(text_col).cast("string"), F.lit(""))
    rows = documents.select(q(id_col), *[q(c) for c in keep_cols], text.alias(text_), *[k.alias(name) for k, name in zip(_key(text), (h, chars), strict=True)])
    own, cut, listed, lines = unused(rows.columns + ["n", "ends", *hs], "own", "cut", "listed", "lines")
    rows = rows.join(index.select(F.col("h").alias(h), F.col("n_chars").alias(chars), F.col("n").alias(lines), F.col("ends").alias(listed)), [h, chars])
    rows = rows.withColumns({name: F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k, name in enumerate(hs)})
    cuts, owns = F.pandas_udf(_cuts, "struct<a: long, b: long, prefix_end: long, middle_end: long>"), F.pandas_udf(_own, "binary")
    rows = rows.withColumn(cut, cuts(q(listed), q(hs[0]), q(hs[1])))
    # The content is verified; texts that only share hash and length take their own list.
    good = (q(lines) == _lines(q(text_))) & _fits(q(text_), q(f"{cut}`.`prefix_end"), q(f"{cut}`.`a")) & _fits(q(text_), q(f"{cut}`.`middle_end"), q(f"{cut}`.`b"))
    rows = rows.withColumn(own, owns(F.when(~good, q(text_))))
    rows = rows.withColumn(cut, F.when(q(own).isNull(), q(cut)).otherwise(cuts(F.coalesce(q(own), q(listed)), q(hs[0]), q(hs[1]))))
    n = F.when(q(own).isNull(), q(lines)).otherwise(_lines(q(text_)))
    start, end = q(f"{cut}`.`prefix_end").cast("int"), q(f"{cut}`.`middle_end").cast("int")
    marked = F.contains(q(text_), F.lit(PREFIX)) | F.contains(q(text_), F.lit(SUFFIX)) | F.contains(q(text_), F.lit(MIDDLE))
    form = F.when((q(text_) == "") | marked | (q(hs[2]) % 100 >= rate), "plain").when(q(hs[3]) % 100 < spm, "spm").otherwise("psm")
    prefix, middle, suffix = F.substr(q(text_), F.lit(1), start), F.substr(q(text_), start + 1, end - start), F.substr(q(text_), end + 1)
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    output = F.when(form == "plain", q(text_)).when(form == "psm", psm).otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    return rows.select(
        q(id_col), *[q(c) for c in keep_cols], n.alias("n"), form.alias("form"),
        F.when(form != "plain", start.cast("long")).alias("prefix_chars"), F.when(form != "plain", (end - start).cast("long")).alias("middle_chars"), output.alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output of that form was made from. A text with markers is plain, so a marker's first place is its own."""
    psm = F.regexp_replace(output, f"(?s)^{PREFIX}(.*?){SUFFIX}(.*?){MIDDLE}(.*)$", "$1$3$2")
    spm = F.regexp_replace(output, f"(?s)^{SUFFIX}(.*?){PREFIX}(.*?){MIDDLE}(.*)$", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_cols: tuple[str, ...] = (), **how) -> DataFrame:
    """transform() with the index of the documents themselves, which is written once."""
    with scratch():
        index = keep(text_index(documents, text_col), "text-index")
    return transform(documents, index, id_col, text_col, keep_cols, **how)


def oracle(seed: int = SEED, rate: int = RATE, spm: int = SPM) -> str:
    """DuckDB twin of the query over documents, by lists of lines."""
    part = lambda k: f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT)"
    marked = " OR ".join(f"contains(t, '{m}')" for m in (PREFIX, SUFFIX, MIDDLE))
    piece = lambda lo, hi: f"coalesce(array_to_string(u[{lo}:{hi}], ''), '')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
l AS (SELECT *, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') AS u FROM d),
n AS (SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, least({part(0)} % (len(u) + 1), {part(1)} % (len(u) + 1)) AS a, greatest({part(0)} % (len(u) + 1), {part(1)} % (len(u) + 1)) AS b,
      CASE WHEN t = '' OR {marked} OR {part(2)} % 100 >= {rate} THEN 'plain' WHEN {part(3)} % 100 < {spm} THEN 'spm' ELSE 'psm' END AS form FROM l),
p AS (SELECT doc_id, n, form, t, {piece(1, "a")} AS p, {piece("a + 1", "b")} AS m, {piece("b + 1", "n")} AS s FROM n)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM p"""
