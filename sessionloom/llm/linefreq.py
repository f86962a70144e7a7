"""Site-relative line frequency, in DataFrame functions only.

Pages are grouped by host; a line's ratio is the share of the host's pages that
hold it. Lines over `ratio` that stand on at least `min_pages` pages are
dropped from every page of that host. Blank lines, of white space (0x09 to 0x0D, 0x20) alone, are never dropped and not counted as boilerplate.

Lines are compared by two 64-bit hashes with different seeds, counted once a page, with map-side
partial sums, so a hot host spreads over all tasks. A host has fewer such lines than its mean lines a
page divided by the ratio, so a host's list stays short; lists are joined to pages by host, where
Spark broadcasts them if their size allows and else splits a hot host's rows. A page's lines meet its host's list by a hashed
intersection of first hashes, and only what is in that is compared by both.

A null text stays null and is a page without lines; a null host is a host of its own; a page left without lines
becomes the empty text. Rows that repeat are pages each. Columns keep their names and order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import keep, unused


def _name(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(7), line).alias("h2"))


def _real(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\x0b\x0c\r")) != ""


def _let(value: Column, then) -> Column:
    """then(value) with the value computed once, even where `then` uses it for each element of an array."""
    return F.transform(F.array(value), then)[0]


def boilerplate(pages: DataFrame, host_col: str, text_col: str, ratio: float, min_pages: int) -> DataFrame:
    """(host, bad array<struct<h1, h2>>) of the hosts that have boilerplate lines."""
    rows = pages.select(F.col(f"`{host_col}`").cast("string").alias("host"), F.split(F.col(f"`{text_col}`"), "\n").alias("lines"))
    names = F.transform(F.array_distinct(F.filter("lines", _real)), _name)
    counts = rows.select("host", F.explode(names).alias("l")).groupBy("host", "l.h1", "l.h2").agg(F.count("*").alias("n"))
    totals = rows.groupBy("host").agg(F.count("*").alias("pages"))
    frequent = counts.where(F.col("n") >= min_pages).alias("c").join(totals.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host")))
    frequent = frequent.where(F.col("n") / F.col("pages") > ratio)
    return frequent.groupBy("c.host").agg(F.collect_list(F.struct("h1", "h2")).alias("bad"))


def drop_boilerplate(
    pages: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = 0.1, min_pages: int = 3, counts: tuple[str, str] | None = None
) -> DataFrame:
    """pages without their host's boilerplate lines; with counts, two more columns of these names: lines before, and lines dropped."""
    columns, text = pages.columns, F.col(f"`{text_col}`")
    host, bad, kept = unused(columns, "host", "bad", "kept")
    lists = keep(boilerplate(pages, host_col, text_col, ratio, min_pages), "boilerplate").toDF(host, bad)
    joined = pages.join(lists, F.col(f"`{host_col}`").cast("string").eqNullSafe(F.col(host)), "left")

    def left(lines: Column) -> Column:
        firsts = F.array_intersect(F.transform(lines, lambda x: _name(x)["h1"]), F.transform(bad, lambda x: x["h1"]))
        hits = lambda h: F.filter(bad, lambda x: F.array_contains(h, x["h1"]))
        rest = lambda hit: F.filter(lines, lambda x: ~_real(x) | ~F.array_contains(hit, _name(x)))
        return _let(firsts, lambda h: F.when(F.size(h) == 0, lines).otherwise(_let(hits(h), rest)))

    lines = F.split(text, "\n")
    joined = joined.withColumn(kept, F.when(F.col(bad).isNull(), lines).otherwise(_let(lines, left)))
    new = F.when(F.col(bad).isNull(), text).otherwise(F.array_join(kept, "\n"))
    out = [new.alias(c) if c == text_col else F.col(f"`{c}`") for c in columns]
    if counts:
        n = F.when(text.isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")
        now = F.when(text.isNull(), F.lit(0)).otherwise(F.size(kept)).cast("long")
        out += [n.alias(counts[0]), (n - now).alias(counts[1])]
    return joined.select(*out)


def oracle(ratio: float, min_pages: int) -> str:
    """DuckDB twin of the query over documents, host = source."""
    blank = "' ' || chr(9) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT DISTINCT r, source, line FROM (SELECT r, source, unnest(lines) AS line FROM d) WHERE trim(line, {blank}) <> ''),
t AS (SELECT source, count(*) AS pages FROM d GROUP BY source),
b AS (SELECT l.source, l.line FROM l JOIN t ON l.source IS NOT DISTINCT FROM t.source
      GROUP BY l.source, l.line, t.pages HAVING count(*) >= {min_pages} AND count(*) / t.pages::DOUBLE > {ratio}::DOUBLE),
s AS (SELECT source, list(line) AS bad FROM b GROUP BY source),
k AS (SELECT d.doc_id, d.source, d.text, coalesce(len(d.lines), 0)::BIGINT AS n_lines, s.bad,
      CASE WHEN s.bad IS NULL THEN d.lines ELSE list_filter(d.lines, lambda x: trim(x, {blank}) = '' OR NOT list_contains(s.bad, x)) END AS kept
      FROM d LEFT JOIN s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, source, n_lines, n_lines - coalesce(len(kept), 0) AS n_dropped,
       CASE WHEN bad IS NULL THEN text ELSE coalesce(array_to_string(kept, chr(10)), '') END AS text FROM k"""
