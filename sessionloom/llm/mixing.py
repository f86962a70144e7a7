"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions only.

Documents hang in a tree domain - language - source. A token budget goes down
the tree by the nodes' weights. A node takes no more than `max_epochs` times its
tokens; what it can't take goes to its siblings in proportion to their weights (water
filling: with children by capacity over weight, the level is the largest of (budget - capacity so far) /
(weight - weight so far)), and only what all of them can't take is missing from
their parent, whose own siblings get it, as a parent's capacity is the sum of its children's that have a weight. A node's share is rounded down to whole tokens,
so a mix falls short of its budget by less than a token a node; budgets are exact up to 2^53 tokens. The level is found in sums over steps
of the ratio first, then among the ratios of two steps, so the children of one parent are never sorted as a whole.

A leaf with target T and n tokens gives T div n whole epochs, then a prefix of one
more: documents in the order of md5(seed, epoch, id) as long as fewer tokens than
the rest stand before them. The prefix ends in one of 4096 hash buckets a leaf, found from bucket sums; only that
bucket's rows are sorted. So a hot leaf is never in one task, and texts are never shuffled.

A token is a run of non-blank characters. Null texts have none; null languages or sources
are the name ''. Rows that repeat an id share their fate and count each. Weights
are whole numbers; names without one have `default`; weight 0 gives nothing. Columns keep their names and order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.llm.common import keep, scratch, unused, written

LEVELS = ("__domain", "__lang", "__leaf")
DOMAIN_SQL = "coalesce('d' || CAST(floor(CAST(nullif(regexp_extract(source, '^src([0-9]+)$', 1), '') AS INT) / 5) AS INT), 'other')"
WEIGHTS: dict[str, dict[str, int]] = {"domain": {"d0": 40, "d1": 30, "d2": 20, "d3": 10}, "lang": {"en": 50, "de": 20, "fr": 20, "es": 10}, "source": {}}
TOKEN = "[^\\x09-\\x0D\\x20]+"


def _weight(name: str, weights: dict[str, int], default: int) -> Column:
    return reduce(lambda rest, kv: F.when(F.col(name) == kv[0], F.lit(kv[1])).otherwise(rest), weights.items(), F.lit(default)).cast("long")


#: Steps of capacity over weight to each doubling; at most 64 times as many rows a parent are looked at in one place.
STEPS = 64


def _fill(nodes: DataFrame, parents: list[str]) -> DataFrame:
    """nodes(parents, cap, w, budget) of w > 0 with `got`: the parent's budget, water-filled over its children.

    The level (budget - capacity before) / (weight - weight before), over children by rising ratio, first rises, then falls. Where it is largest at
    the start of a step, its peak is in that step or the one before.
    """
    ratio = F.col("cap") / F.col("w")
    # Used three times, and by the level below again: a table, or plans would grow threefold with each level.
    some = written(nodes.withColumns({"ratio": ratio, "step": F.floor(F.log2(ratio + 1) * STEPS).cast("int")}), "level")
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    group = Window.partitionBy(*(parents or [F.lit(0)]))
    steps = some.groupBy(*parents, "step").agg(F.sum("cap").alias("c"), F.sum("w").alias("s"), F.max("budget").alias("budget"))
    steps = steps.withColumns({"caps": before("c", group.orderBy("step")), "ws": before("s", group.orderBy("step")), "all": F.sum("s").over(group)})
    steps = steps.withColumn("level", (F.col("budget") - F.col("caps")) / (F.col("all") - F.col("ws")))
    nth = F.row_number().over(group.orderBy("step"))
    steps = steps.withColumn("nth", nth).withColumn("peak", F.max(F.struct("level", -F.col("nth"))).over(group))
    steps = steps.where("nth IN (-peak.col2, -peak.col2 - 1)").select(*parents, "step", "caps", "ws", "all")
    same = some.groupBy(*parents, "step", "ratio").agg(F.sum("cap").alias("c"), F.sum("w").alias("s"), F.max("budget").alias("budget"))
    inside = Window.partitionBy(*parents, "step").orderBy("ratio")
    levels = same.join(steps, [*parents, "step"]).withColumn("level", (F.col("budget") - F.col("caps") - before("c", inside)) / (F.col("all") - F.col("ws") - before("s", inside)))
    level = levels.groupBy(*parents).agg(F.max("level").alias("level"))
    met = some.join(level, parents) if parents else some.crossJoin(F.broadcast(level))  # one row
    return met.withColumn("got", F.least("cap", F.floor(F.col("w") * F.col("level"))).cast("long")).drop("level", "ratio", "step")


def budgets(leaves: DataFrame, weights: dict[str, dict[str, int]], share: float, max_epochs: int, default: int = 10) -> DataFrame:
    """leaves(__domain, __lang, __leaf, n) with `target` tokens, without those of weight 0 at some level. One row a leaf: sizes are those of the tree, not of the corpus."""
    d, lang, s = LEVELS
    total = F.broadcast(leaves.agg(F.floor(F.sum("n") * F.lit(float(share))).cast("long").alias("budget")))  # one row
    w = {name: _weight(name, weights.get(level, {}), default) for level, name in (("domain", d), ("lang", lang), ("source", s))}
    some = leaves.where((w[d] > 0) & (w[lang] > 0) & (w[s] > 0)).withColumn("cap", F.col("n") * max_epochs)
    top = some.groupBy(d).agg(F.sum("cap").alias("cap")).crossJoin(total).withColumn("w", w[d])
    top = _fill(top, []).select(d, F.col("got").alias("budget"))
    mid = some.groupBy(d, lang).agg(F.sum("cap").alias("cap")).join(top, d).withColumn("w", w[lang])
    mid = _fill(mid, [d]).select(d, lang, F.col("got").alias("budget"))
    low = some.join(mid, [d, lang]).withColumn("w", w[s])
    return _fill(low, [d, lang]).select(*LEVELS, "n", F.col("got").alias("target"))


def _key(id_: Column, seed: int, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"))


def mix(
    documents: DataFrame,
    domain: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    weights: dict[str, dict[str, int]] = WEIGHTS,
    share: float = 0.6,
    max_epochs: int = 3,
    seed: int = 11,
    names: tuple[str, str, str] = ("domain", "n_tokens", "copies"),
) -> DataFrame:
    """documents with three more columns: domain, tokens, and how many times the mix takes the row (0: not at all)."""
    q = lambda c: F.col(f"`{c}`")
    domain = F.expr(DOMAIN_SQL) if domain is None else domain
    columns = documents.columns
    own = unused(columns, *LEVELS, "__tokens", "__full", "__cut")
    *levels, tokens, full, cut_key = own
    tagged = documents.withColumns(
        {
            levels[0]: F.coalesce(domain, F.lit("")),
            levels[1]: F.coalesce(q(lang_col).cast("string"), F.lit("")),
            levels[2]: F.coalesce(q(source_col).cast("string"), F.lit("")),
            tokens: F.coalesce(F.regexp_count(q(text_col), F.lit(TOKEN)), F.lit(0)).cast("long"),
        }
    )
    with scratch():
        light = written(tagged.select(*[q(c).alias(name) for c, name in zip(levels, LEVELS, strict=True)], q(id_col).alias("id"), q(tokens).alias("__tokens")), "tokens")
        verdict = keep(_verdict(light, weights, share, max_epochs, seed), "mix").toDF(*levels, full, cut_key)
    placed = tagged.join(verdict, levels, "left")
    extra = F.when(_key(q(id_col), seed, q(full)) <= q(cut_key), F.lit(1)).otherwise(F.lit(0))
    copies = F.coalesce(q(full) + extra, F.lit(0)).cast("long")
    return placed.select(*[q(c) for c in columns], q(levels[0]).alias(names[0]), q(tokens).alias(names[1]), copies.alias(names[2]))


def _verdict(light: DataFrame, weights: dict[str, dict[str, int]], share: float, max_epochs: int, seed: int) -> DataFrame:
    """(*LEVELS, full, cut) of each leaf in light(*LEVELS, id, __tokens): its whole epochs, and the last key that one more takes (null: none)."""
    leaves = written(light.groupBy(*LEVELS).agg(F.sum("__tokens").alias("n")), "leaves")
    plan = written(
        budgets(leaves, weights, share, max_epochs).withColumns(
            {"full": F.when(F.col("n") > 0, F.floor(F.col("target") / F.greatest("n", F.lit(1)))).otherwise(0).cast("long")}
        ).withColumn("rest", F.col("target") - F.col("full") * F.col("n")),
        "plan",
    )
    # Where each leaf's prefix ends: the bucket, then the key.
    keyed = light.join(plan.where("rest > 0"), list(LEVELS)).select(*LEVELS, "rest", "__tokens", _key(F.col("id"), seed, F.col("full")).alias("key"))
    keyed = keyed.withColumn("bucket", F.substring("key", 1, 3))
    sums = keyed.groupBy(*LEVELS, "rest", "bucket").agg(F.sum("__tokens").alias("t"))
    run = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = sums.withColumn("before", F.coalesce(F.sum("t").over(run), F.lit(0))).where("before < rest")
    ends = ends.groupBy(*LEVELS, "rest").agg(F.max(F.struct("bucket", "before")).alias("b")).select(*LEVELS, "rest", "b.bucket", "b.before")
    last = keyed.join(written(ends, "ends"), [*LEVELS, "rest", "bucket"])
    inside = Window.partitionBy(*LEVELS).orderBy("key")
    cut = last.groupBy(*LEVELS, "rest", "before", "key").agg(F.sum("__tokens").alias("t"))
    cut = cut.withColumn("through", F.sum("t").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    cut = cut.where(F.col("before") + F.col("through") - F.col("t") < F.col("rest")).groupBy(*LEVELS).agg(F.max("key").alias("cut"))
    return plan.join(cut, list(LEVELS), "left").select(*LEVELS, "full", "cut")


def taken(documents: DataFrame, **how) -> DataFrame:
    """documents as the mix takes them: a row each time, none for 0. Columns stay."""
    columns = documents.columns
    names = unused(columns, "domain", "tokens", "copies", "copy")
    mixed = mix(documents, names=tuple(names[:3]), **how)
    times = mixed.where(F.col(names[2]) > 0).withColumn(names[3], F.explode(F.sequence(F.lit(1), F.col(names[2]).cast("int"))))
    return times.select(*[F.col(f"`{c}`") for c in columns])


def _case(name: str, weights: dict[str, int], default: int) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items())
    return f"CASE {name} {whens} ELSE {default} END" if whens else str(default)


def oracle(weights: dict[str, dict[str, int]] = WEIGHTS, share: float = 0.6, max_epochs: int = 3, seed: int = 11, default: int = 10) -> str:
    """DuckDB twin of the query over documents, by plain running sums over each whole leaf."""

    def fill(source: str, parents: str, name: str) -> str:
        over = f"PARTITION BY {parents}" if parents else ""
        before = f"OVER ({over} ORDER BY cap / w::DOUBLE, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        lvl = f"SELECT *, (budget - coalesce(sum(cap) {before}, 0))::DOUBLE / (sum(w) OVER ({over}) - coalesce(sum(w) {before}, 0))::DOUBLE AS lvl FROM {source} WHERE w > 0"
        return f"SELECT *, least(cap, floor(w * lmax)::BIGINT) AS got FROM (SELECT *, max(lvl) OVER ({over}) AS lmax FROM ({lvl}))"

    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {DOMAIN_SQL} AS domain,
           coalesce(len(regexp_extract_all(text, '{TOKEN}')), 0)::BIGINT AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS n, ({max_epochs} * sum(n_tokens))::BIGINT AS cap FROM d GROUP BY ALL),
open AS (SELECT * FROM leaves WHERE {_case("domain", weights["domain"], default)} > 0 AND {_case("lang", weights["lang"], default)} > 0 AND {_case("source", weights["source"], default)} > 0),
n1 AS (SELECT domain, sum(cap)::BIGINT AS cap, (SELECT floor(sum(n)::DOUBLE * {share}::DOUBLE)::BIGINT FROM leaves) AS budget, {_case("domain", weights["domain"], default)} AS w FROM open GROUP BY domain),
f1 AS ({fill("n1", "", "domain")}),
n2 AS (SELECT l.domain, l.lang, sum(l.cap)::BIGINT AS cap, any_value(f1.got) AS budget, any_value({_case("l.lang", weights["lang"], default)}) AS w FROM open l JOIN f1 ON l.domain = f1.domain GROUP BY l.domain, l.lang),
f2 AS ({fill("n2", "domain", "lang")}),
n3 AS (SELECT l.domain, l.lang, l.source, l.n, l.cap, f2.got AS budget, {_case("l.source", weights["source"], default)} AS w FROM open l JOIN f2 ON l.domain = f2.domain AND l.lang = f2.lang),
f3 AS ({fill("n3", "domain, lang", "source")}),
p AS (SELECT domain, lang, source, got, CASE WHEN n > 0 THEN got // n ELSE 0 END AS epochs, CASE WHEN n > 0 THEN got - (got // n) * n ELSE got END AS rest FROM f3),
k AS (SELECT d.*, p.epochs, p.rest, md5('{seed}:' || p.epochs || ':' || d.doc_id) AS key FROM d LEFT JOIN p USING (domain, lang, source)),
c AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k)
SELECT doc_id, domain, lang, source, n_tokens, (coalesce(epochs, 0) + CASE WHEN before < rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM c"""
