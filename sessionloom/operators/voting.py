"""Candidate lists by weighted votes: seeds of a session vote through matrices.

A VoteSource says which matrix, which seed list, how many of each list, and what a
vote counts. All sources are evaluated by one plan: seeds x sources
(a small broadcast table) joined once with all matrices, positions by one
window, and one sum. `i` is a vote's position in its source, over the seeds in
order; `size` the source's number of votes; `n` the length of the seed list; `pos` the seed's, `rank` the item's position.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionloom.functions.expr import UNIT
from sessionloom.functions.hold import held
from sessionloom.functions.stretches import spread

#: What an event's own vote is multiplied by.
TYPE_WEIGHT = {0: 1, 1: 6, 2: 3}
#: Seeds of a task; each calls up to some tens of votes from several sources.
SEEDS_A_TASK = 50_000


@dataclass(frozen=True)
class VoteSource:
    matrix: str
    seeds: str
    cap: int
    weight: str = "1"  # SQL over i, n (seeds in the list), pos, rank
    double: bool = False  # the first vote of every `cap` counts twice
    head: int = 0  # 2, 2, 1, 1, ... repeated for every full `cap` votes, the rest is dropped; the value is `w`
    limit: int = 1_000_000  # only the first seeds of the list
    lone: bool = False  # only for sessions with one distinct item


@dataclass(frozen=True)
class VoteSpec:
    name: str
    long_from: int  # sessions with so many distinct items or more take the long way
    start: float  # of the long way's weights by position
    long: tuple[VoteSource, ...]
    short: tuple[VoteSource, ...]
    second: VoteSource | None  # from the best new item so far, short way only
    top: int = 50
    seen: str = "drop"  # what becomes of the session's own items: drop, keep first
    long_seen: str = "drop"
    pad: bool = False
    long_seed_votes: tuple[tuple[str, float], ...] = ()
    short_seed_votes: tuple[tuple[str, float], ...] = ()


def _decay(base: str, step: str, cap: int) -> str:
    return f"{base} - {step} * floor(i / {cap})"


def _m(low: str, cap: int) -> str:
    return f"({low} + (1 - {low}) * (n - floor(i / {cap})) / n)"


#: The three suggesters' sources, caps and weights.
FAST = VoteSpec(
    "fast",
    15,
    0.1,
    (VoteSource("220", "all", 20, "0.6", limit=2), VoteSource("217", "last_of_sub", 15, "0.3"), VoteSource("115", "all", 20, "0.6", limit=2)),
    (
        VoteSource("701", "all", 30, "w", head=30, lone=True),
        VoteSource("93", "all", 20, _m("0.1", 20), double=True),
        VoteSource("217", "all", 20, double=True, limit=2),
        VoteSource("115", "all", 20, double=True, limit=2),
        VoteSource("235", "last_sub", 10, _decay("1", "0.1", 10), double=True),
        VoteSource("232", "last_of_sub", 20, double=True),
    ),
    VoteSource("220", "best", 10, double=True),
)
CLICKS = VoteSpec(
    "clicks",
    15,
    0.1,
    (VoteSource("220", "all", 40, "0.6", limit=2), VoteSource("217", "last_of_sub", 30, "0.3"), VoteSource("115", "all", 40, "0.6", limit=2)),
    (
        VoteSource("157", "day", 40),
        VoteSource("93", "fast", 20, "0.5"),
        VoteSource("701", "all", 30, "w", head=30, lone=True),
        VoteSource("93", "all", 1_000_000, "greatest(1 - 0.35 * pos, 0.001) * greatest(1 - 0.005 * (rank - 1), 0.01)"),
        VoteSource("217", "all", 40, double=True, limit=2),
        VoteSource("115", "all", 40, double=True, limit=2),
        VoteSource("235", "last_sub", 20, _decay("1", "0.1", 20), double=True),
        VoteSource("232", "last_of_sub", 40, double=True),
    ),
    VoteSource("220", "best", 20, double=True),
    seen="keep",
    long_seen="votes",
    pad=True,
)
ORDERS = VoteSpec(
    "orders",
    20,
    0.5,
    (
        VoteSource("90", "buys", 40, "0.05", double=True),
        VoteSource("99", "buys", 40, "0.1", double=True),
        VoteSource("116", "all", 40, "0.05", double=True),
        VoteSource("220", "all", 20, "0.05", double=True, limit=1),
        VoteSource("226", "buys", 20, "0.05", double=True, limit=1),
        VoteSource("217", "last_of_sub", 5, "0.25", double=True),
        VoteSource("217", "first_of_sub", 5, "0.125", double=True),
        VoteSource("155", "day", 40, "0.05", double=True),
        VoteSource("116", "fast", 20, "0.05", double=True),
        VoteSource("239", "fast", 20, "0.05", double=True),
    ),
    (
        VoteSource("95", "all", 30, f"w * {_m('0.25', 30)}", head=30),
        VoteSource("90", "buys", 30, "w / 2", head=30),
        VoteSource("116", "all", 30, f"w * {_m('0.25', 30)}", head=30),
        VoteSource("99", "buys", 30, "w / 2", head=30),
        VoteSource("155", "day", 40, "1", head=40),
        VoteSource("116", "fast", 20, f"w * {_m('0.25', 20)}", head=20),
        VoteSource("239", "fast", 20, f"w * {_m('0.25', 20)}", head=20),
        VoteSource("220", "all", 55, "w", head=55, limit=1),
        VoteSource("701", "all", 20, "w", head=20, lone=True),
        VoteSource("700", "all", 20, "w", head=20, lone=True),
        VoteSource("226", "buys", 20, "w", head=20, limit=1),
        VoteSource("239", "half_hour", 20, "2 * w / n", head=20),
        VoteSource("235", "last_sub", 5, _decay("0.5", "0.05", 5), double=True),
        VoteSource("232", "last_of_sub", 55, _decay("w", "0.1", 55), head=55),
        VoteSource("232", "first_of_sub", 10, _decay("w / 2", "0.05", 10), head=10),
    ),
    None,
    seen="keep",
    long_seen="votes",
    long_seed_votes=(("first_of_sub", 0.5), ("last_of_sub", 0.5), ("fast", 0.05)),
    short_seed_votes=(("fast", 1.0),),
)
SPECS = {s.name: s for s in (FAST, CLICKS, ORDERS)}
MATRICES = sorted({v.matrix for s in SPECS.values() for v in (*s.long, *s.short, *([s.second] if s.second else []))})


def double_sql(text: str) -> str:
    """Numbers of a weight expression as doubles, so that all engines compute it the same."""
    return re.sub(r"(?<![\w.])(\d+(?:\.\d+)?)(?![\w.])", r"CAST(\1 AS DOUBLE)", text)


def value_sql(source: VoteSource) -> str:
    """What a vote counts that stays."""
    w = f"(CASE WHEN (i % {source.head}) < 2 THEN 2 ELSE 1 END)" if source.head else ""
    text = source.weight.replace("w", w) if source.head else source.weight
    value = f"CAST(round(({double_sql(text)}) * CAST({UNIT} AS DOUBLE)) AS BIGINT)"
    if source.double:
        value = f"{value} * CASE WHEN i % {source.cap} = 0 THEN 2 ELSE 1 END"
    return value


def weight_sql(source: VoteSource) -> str:
    """The same, null beyond the last full block."""
    keep = f"i < {source.head} * floor(size / {source.head})" if source.head else None
    return f"CASE WHEN {keep} THEN {value_sql(source)} END" if keep else value_sql(source)


def _table(spark: SparkSession, sources: list[tuple[int, bool, VoteSource]]) -> DataFrame:
    """A row a source, made by the JVM, so that no Python worker starts for it."""
    kinds = {"src": "int", "long": "boolean", "matrix": "string", "list": "string", "cap": "int", "lim": "int", "lone": "boolean", "head": "int"}
    rows = [F.struct(*[F.lit(v).cast(t).alias(c) for (c, t), v in zip(kinds.items(), (k, long, s.matrix, s.seeds, s.cap, s.limit, s.lone, s.head), strict=True)]) for k, long, s in sources]
    return F.broadcast(spark.range(1).select(F.inline(F.array(*rows))))


def _votes(seeds: DataFrame, matrices: DataFrame, sources: list[tuple[int, bool, VoteSource]]) -> DataFrame:
    """(session, aid, v, first) of the sources' votes, summed by item, with the first vote's source and position; seeds(session, list, aid, pos, n, long, lone), which should be held.

    Seeds are dealt by session, so that votes are numbered and summed where they are made.
    """
    spark, seeds = seeds.sparkSession, spread(seeds, "session", SEEDS_A_TASK)
    s = _table(spark, sources)
    asked = seeds.join(s, (seeds["list"] == s["list"]) & (seeds["long"] == s["long"]) & (F.col("pos") < F.col("lim")) & (~s["lone"] | seeds["lone"])).select("session", "src", "cap", "head", "pos", "n", "matrix", seeds["aid"])
    m = matrices.select("matrix", F.col("aid_x").alias("aid"), "aid_y", "rank")
    all_ = Window.partitionBy("session", "src")
    got = asked.join(m, ["matrix", "aid"]).where("rank <= cap")
    got = got.withColumn("i", F.row_number().over(all_.orderBy("pos", "rank")) - 1).withColumn("size", F.count("*").over(all_))
    # What is beyond a source's last full block goes by its columns, so that weights are worked out once, for what stays; equal ones are one branch.
    got = got.where("head = 0 OR i < head * floor(size / head)")
    same: dict[str, list[int]] = {}
    for k, _, source in sources:
        same.setdefault(value_sql(source), []).append(k)
    value = reduce(lambda chain, w: chain.when(F.col("src").isin(w[1]), F.expr(w[0])), same.items(), F)
    return _summed(got.select("session", F.col("aid_y").alias("aid"), value.alias("v"), _first(F.col("src"), F.col("i"))))


def _first(src: Column, i: Column) -> Column:
    """A vote's source and position as one number, so that the first is found by hash."""
    return (src.cast("long") * (1 << 40) + i).alias("first")


def _summed(votes: DataFrame) -> DataFrame:
    return votes.groupBy("session", "aid").agg(F.sum("v").alias("v"), F.min("first").alias("first"))


def _ranked(votes: DataFrame) -> DataFrame:
    """Votes summed by item, with their rank in the session: more first, then the earlier first vote."""
    summed = _summed(votes)
    return summed.withColumn("place", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("v"), "first")))


def suggest(events: DataFrame, seeds: DataFrame, matrices: DataFrame, spec: VoteSpec, fast: DataFrame | None = None, popular: DataFrame | None = None, hold: Callable[[DataFrame], DataFrame] = held) -> DataFrame:
    """(session, aid, pos): each session's suggestions in order.

    seeds as sessions.seed_lists returns them; matrices(matrix, aid_x, aid_y, rank); fast: suggestions of FAST, whose first
    ten are the list `fast`; popular(aid, pos): what pads a short list; hold keeps what is read twice.
    """
    if fast is not None:
        seeds = seeds.unionByName(fast.where("pos < 10").select("session", F.lit("fast").alias("list"), "aid", "pos"))
    sizes = seeds.where("list = 'all'").groupBy("session").agg(F.count("*").alias("n_all"))
    whole = Window.partitionBy("session", "list")
    seeds = seeds.withColumn("n", F.count("*").over(whole)).join(sizes, "session").withColumns({"long": F.col("n_all") >= spec.long_from, "lone": F.col("n_all") == 1})
    # Tables from step to step, so that no plan holds those before it.
    seeds, sizes = hold(seeds), hold(sizes)
    sources = [(10 + k, True, s) for k, s in enumerate(spec.long)] + [(10 + k, False, s) for k, s in enumerate(spec.short)]
    sources = [(k + (100 if not long else 0), long, s) for k, long, s in sources]
    votes = hold(_votes(seeds, matrices, sources))
    along, all_ = Window.partitionBy("session").orderBy("ts", "eid"), Window.partitionBy("session")
    at, count = F.row_number().over(along) - 1, F.count("*").over(all_)
    exponent = F.lit(spec.start) + F.lit(1 - spec.start) * F.when(F.col("cnt") > 1, F.col("i").cast("double") / (F.col("cnt") - 1)).otherwise(F.lit(0.0))
    kind = F.when(F.col("type") == 1, F.lit(float(TYPE_WEIGHT[1]))).when(F.col("type") == 2, F.lit(float(TYPE_WEIGHT[2]))).otherwise(F.lit(float(TYPE_WEIGHT[0])))
    own = events.withColumns({"i": at, "cnt": count}).join(sizes.where(F.col("n_all") >= spec.long_from), "session")
    own = own.select("session", "aid", F.round((F.pow(F.lit(2.0), exponent) - 1) * kind * F.lit(float(UNIT))).cast("long").alias("v"), _first(F.lit(0), F.col("i")))
    votes = votes.unionByName(own)
    for order, (long, given) in enumerate(((True, spec.long_seed_votes), (False, spec.short_seed_votes))):
        for k, (name, w) in enumerate(given):
            src = 1 + k if name != "fast" else 60 + 100 * order
            # The short way's own votes for `fast` come after its 7th source.
            src = 116 if name == "fast" and not long else src
            votes = votes.unionByName(seeds.where((F.col("list") == name) & (F.col("long") == F.lit(long))).select("session", "aid", F.lit(round(w * UNIT)).cast("long").alias("v"), _first(F.lit(src), F.col("pos") + 1000)))
    seen = seeds.where("list = 'all'").select("session", "aid", F.col("pos").alias("seen"))
    if spec.second:
        first = _ranked(votes).where("place = 1").join(seen, ["session", "aid"], "left_anti")
        first = first.join(sizes.where(F.col("n_all") < spec.long_from), "session")
        best = first.select("session", F.lit("best").alias("list"), "aid", F.lit(0).alias("pos"), F.lit(1).cast("long").alias("n"), F.lit(False).alias("long"), F.lit(False).alias("lone"))
        votes = votes.unionByName(_votes(hold(best), matrices, [(200, False, spec.second)]))
    ranked = hold(_ranked(votes).where(F.col("place") <= spec.top)).join(seen, ["session", "aid"], "left").join(sizes, "session")
    long = F.col("n_all") >= spec.long_from
    keep_votes = F.lit(spec.long_seen == "votes") & long
    new = ranked.where(keep_votes | F.col("seen").isNull()).select("session", "aid", F.lit(1).alias("part"), F.col("place").alias("o"))
    lists = new
    if spec.seen == "keep":
        short = seen.join(sizes.where(F.col("n_all") < spec.long_from), "session")
        lists = lists.unionByName(short.select("session", "aid", F.lit(0).alias("part"), F.col("seen").alias("o")))
    placed = lists.withColumn("pos", F.row_number().over(Window.partitionBy("session").orderBy("part", "o"))).where(F.col("pos") <= spec.top).select("session", "aid", (F.col("pos") - 1).alias("pos"))
    if popular is None:
        return placed
    placed = hold(placed)
    have = sizes.select("session").join(placed.groupBy("session").agg(F.count("*").alias("have")), "session", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    want = F.lit(spec.top) if spec.pad else F.lit(1)
    pads = have.where(F.col("have") < want).crossJoin(F.broadcast(popular.where(F.col("pos") < spec.top).select(F.col("aid").alias("p_aid"), F.col("pos").alias("p_pos"))))
    pads = pads.where(F.col("p_pos") < want - F.col("have")).select("session", F.col("p_aid").alias("aid"), (F.col("have") + F.col("p_pos")).cast("int").alias("pos"))
    return placed.unionByName(pads)
