"""Item-to-item matrices from pairs of events in one session; a matrix is a CovisSpec.

Pairs of one session are joined on the session, deduplicated by a min or max over the
same distribution (no further shuffle), weighted, summed per pair of items with map-side
partials, and cut to the best N of each item. Weights are summed as whole numbers (see
functions.expr.UNIT), so matrices don't depend on partitioning.

A long session is never joined with itself event by event:
* positions at most `reach` apart meet in one window over the session, so that nothing but the events is shuffled;
* events less than `within` seconds apart meet by an equi-join on (session, bucket of that width), a bucket with itself and its neighbours; where weights don't look at time either,
  an item's events in a bucket are one row, with its first and last time;
* where the pair condition doesn't look at time, events are collapsed to the one of each item that would be picked anyway; where it asks that y is later,
  y is the item's latest event, and x is found among its item's events, which are one sorted array, by binary search.

What is left is one row for each pair of items of a session. Sessions with over BLOCK items are cut into blocks of items by hash, and each pair of blocks is a key of its own, so a hot
session spreads over many tasks. A pair of items stands in one pair of blocks only, so it still counts once.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.expr import UNIT

DAY = 86_400
#: Items of a session that are paired in one task.
BLOCK = 512


@dataclass(frozen=True)
class CovisSpec:
    """Expressions are SQL over x.* (left event), y.* (right event), with {t_min} and {t_max} of the data."""

    name: str
    top_n: int
    weight: str = "1"
    pair: str = "true"
    left: str = "true"
    right: str = "true"
    since_days: int | None = None  # only events after t_max less so many days
    started_days: int | None = None  # only sessions that begin after that
    tail: int | None = None
    y_first: bool = False  # y only where its item comes for the first time
    x_first: bool = False  # x only the session's first event
    key: tuple[str, ...] = ("x.session",)  # with both items: what counts once
    latest: bool = True  # of equal keys the latest x, then the latest y; else the earliest
    closest: bool = False  # of equal keys the smallest time apart
    reach: int = 0  # only events so many positions apart, at most (0: any)
    within: int = 0  # only events less than so many seconds apart (0: any)
    ahead: bool = False  # with reach or within: only y after x


def _half(hours: int) -> str:
    return f"pow(CAST(0.5 AS DOUBLE), CAST(abs(y.ts - x.ts) AS DOUBLE) / CAST({hours * 3600} AS DOUBLE))"


_RECENT = "(CAST(1 AS DOUBLE) + CAST(3 AS DOUBLE) * CAST(x.ts - {t_min} AS DOUBLE) / CAST({t_max} - {t_min} AS DOUBLE))"
_BUYS = "type IN (1, 2)"
_IN_DAY = "abs(x.ts - y.ts) < 86400 AND x.aid <> y.aid"
_APART = "x.aid <> y.aid"
_LATER = "y.ts > x.ts"


def _case(*weights: float) -> str:
    return "CASE y.type " + " ".join(f"WHEN {k} THEN CAST({w} AS DOUBLE)" for k, w in enumerate(weights)) + " END"


#: The matrices' filters, pairs, weights and sizes.
SPECS = {
    s.name: s
    for s in (
        CovisSpec("temporal", 20, _RECENT, _IN_DAY, tail=30),
        CovisSpec("type136", 20, _case(1, 3, 6), _IN_DAY, tail=30),
        CovisSpec("carts_orders", 20, "1", _IN_DAY, _BUYS, _BUYS, tail=30),
        CovisSpec("type0590", 20, _case(0.5, 9, 0.5), _IN_DAY, tail=30),
        CovisSpec("93", 80, f"{_RECENT} * {_half(1)}", _IN_DAY, tail=30),
        CovisSpec("115", 40, _half(1), since_days=21),
        CovisSpec("116", 40, f"{_half(1)} * {_case(0, 1, 1)}", _LATER, since_days=28),
        CovisSpec("217", 40, "1", _APART, reach=1, y_first=True, latest=False),
        CovisSpec("220", 80, "1", _APART, reach=2, y_first=True, latest=False),
        CovisSpec("226", 80, "1", _APART, _BUYS, _BUYS, reach=3, ahead=True, y_first=True, latest=False),
        CovisSpec("232", 80, _half(1), _APART, reach=3, y_first=True, latest=False),
        CovisSpec("235", 80, _half(1), _APART, reach=6, y_first=True, latest=False),
        CovisSpec("239", 20, _half(1), _LATER, right=_BUYS, key=("x.session div {chunk}",), closest=True, within=7200, ahead=True),
        CovisSpec("700", 40, "1", _APART, right="type > 0", started_days=21, x_first=True, key=("x.session", "y.type"), latest=False),
        CovisSpec("701", 40, _half(1), _APART, started_days=21, x_first=True, key=("x.session", "y.type"), latest=False),
        CovisSpec("155", 40, _half(6), _LATER, right=_BUYS),
        CovisSpec("157", 80, _half(6)),
        CovisSpec("90", 40, "1", _APART, _BUYS, _BUYS, latest=False, within=14 * DAY),
        CovisSpec("95", 40, f"{_half(1)} * {_case(1, 4, 4)}", _APART, tail=30, latest=False),
        CovisSpec("99", 40, _half(1), _APART, _BUYS, _BUYS, since_days=28, latest=False),
    )
}
#: The four parameterised matrices come with 40 items too.
SPECS |= {f"{n}_40": replace(SPECS[n], name=f"{n}_40", top_n=40) for n in ("temporal", "type136", "carts_orders", "type0590")}


def prepared(events: DataFrame) -> DataFrame:
    """events with what several matrices ask of a whole session: its start, and each event's place from either end. Hold it, and covisitation() takes these from there."""
    whole = Window.partitionBy("session")
    along, back = whole.orderBy("ts", "eid"), whole.orderBy(F.desc("ts"), F.desc("eid"))
    return events.select("session", "aid", "ts", "type", "eid").withColumns({"t0": F.min("ts").over(whole), "k": F.row_number().over(along), "back": F.row_number().over(back)})


def covisitation(events: DataFrame, spec: CovisSpec, t_min: int, t_max: int, chunk: int = 50_000, top_n: int | None = None) -> DataFrame:
    """(aid_x, aid_y, wgt_e9, rank): the spec's best items for each item; top_n 0 keeps all."""
    names = {"t_min": t_min, "t_max": t_max, "chunk": chunk}
    whole = Window.partitionBy("session")
    along, back = whole.orderBy("ts", "eid"), whole.orderBy(F.desc("ts"), F.desc("eid"))
    # Places in the session hold for specs that leave no event of a session out before they are asked for.
    known = {"t0", "k", "back"} <= set(events.columns) and spec.since_days is None and (spec.left == "true" or spec.left != spec.right)
    e = events if known else events.select("session", "aid", "ts", "type", "eid")
    if spec.since_days is not None:
        e = e.where(F.col("ts") > t_max - spec.since_days * DAY)
    if spec.left == spec.right:
        e = e.where(spec.left)
    if spec.started_days is not None:
        e = (e if known else e.withColumn("t0", F.min("ts").over(whole))).where(F.col("t0") > t_max - spec.started_days * DAY)
    if spec.tail:
        e = (e if known else e.withColumn("back", F.row_number().over(back))).where(F.col("back") <= spec.tail)
    if spec.x_first or spec.reach:
        e = e if known and not spec.tail else e.withColumn("k", F.row_number().over(along))
    e = e.select("session", "aid", "ts", "type", "eid", *(["k"] if spec.x_first or spec.reach else []))
    left, right = e.where(spec.left), e.where(spec.right)
    if spec.x_first:
        left = left.where("k = 1")
    if spec.y_first and not spec.reach:
        right = right.withColumn("nth", F.row_number().over(Window.partitionBy("session", "aid").orderBy("ts", "eid"))).where("nth = 1").drop("nth")
    timeless = spec.pair in ("true", _APART) and not (spec.reach or spec.closest or spec.within)
    later = spec.pair == _LATER and spec.latest and not (spec.reach or spec.closest or spec.within)
    if timeless and not spec.x_first:
        left = _representatives(left, spec, False)
    if (timeless or later) and not spec.y_first:
        right = _representatives(right, spec, "y.type" in spec.key)
    if spec.reach:
        pairs = _near_in_place(e, spec)
    elif spec.within:
        pairs = _near_in_time(left, right, spec)
    elif later:
        pairs = _before(left, right)
    elif timeless:
        pairs = _in_blocks(left, right, F.expr(spec.pair))
    else:
        pairs = left.alias("x").join(right.alias("y"), F.expr(f"x.session = y.session AND ({spec.pair})"))
    keys = [F.expr(k.format(**names)).alias(f"key{i}") for i, k in enumerate(spec.key)]
    order = ["x.ts", "x.eid", "y.ts", "y.eid", "y.type"]
    near = F.struct(F.abs(F.col("y.ts") - F.col("x.ts")).alias("apart"), *[F.col(c).alias(c.replace(".", "_")) for c in order])
    pick = F.max if spec.latest and not spec.closest else F.min
    if not spec.closest:
        near = F.struct(*[F.col(c).alias(c.replace(".", "_")) for c in order])
    once = pairs.select(*keys, F.col("x.aid").alias("aid_x"), F.col("y.aid").alias("aid_y"), near.alias("at"))
    if not (timeless or later):  # else each pair comes once already
        once = once.groupBy(*[f"key{i}" for i in range(len(keys))], "aid_x", "aid_y").agg(pick("at").alias("at"))
    weight = spec.weight.format(**names)
    for side in ("x", "y"):
        for c in ("ts", "eid", "type"):
            weight = weight.replace(f"{side}.{c}", f"at.{side}_{c}")
    summed = once.select("aid_x", "aid_y", F.expr(f"CAST(round(({weight}) * CAST({UNIT} AS DOUBLE)) AS BIGINT)").alias("w")).groupBy("aid_x", "aid_y").agg(F.sum("w").alias("wgt_e9"))
    return best(summed, spec.top_n if top_n is None else top_n)


def _representatives(events: DataFrame, spec: CovisSpec, by_type: bool) -> DataFrame:
    """Of each session's events of one item (and type) the one that a pair would be represented by: the latest or the earliest."""
    pick = F.max if spec.latest else F.min
    keys = ["session", "aid", *(["type"] if by_type else [])]
    one = events.groupBy(*keys).agg(pick(F.struct("ts", "eid", *([] if by_type else ["type"]))).alias("at"))
    return one.select(*keys, "at.*")


def _in_blocks(left: DataFrame, right: DataFrame, pair: Column) -> DataFrame:
    """x and y of one session, each item of a side at most a few times. Sessions of over BLOCK items are paired block by block.

    The table of such sessions has at most a row for each BLOCK rows; whether it is broadcast is left to its size.
    """
    large = left.groupBy("session").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select(F.col("session").alias("of"), F.ceil(F.col("n") / BLOCK).cast("int").alias("b"))

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        side = side.join(large, F.col("session") == F.col("of"), "left").withColumn("b", F.coalesce("b", F.lit(1)))
        side = side.withColumns({own: F.pmod(F.xxhash64("aid"), F.col("b")).cast("int"), other: F.explode(F.sequence(F.lit(0), F.col("b") - 1))})
        return side.drop("of", "b")

    x, y = dealt(left, "bx", "by").alias("x"), dealt(right, "by", "bx").alias("y")
    return x.join(y, F.expr("x.session = y.session AND x.bx = y.bx AND x.by = y.by") & pair)


def _before(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each y (one of an item and session) with, of every item, the latest x before it, by binary search in the item's sorted events."""
    runs = left.groupBy("session", "aid").agg(F.array_sort(F.collect_list(F.struct("ts", "eid", "type"))).alias("xs"))
    runs = runs.withColumn("steps", F.sequence(F.floor(F.log2(F.size("xs").cast("double"))).cast("int"), F.lit(0), F.lit(-1)))
    met = _in_blocks(runs, right, F.expr("x.xs[0].ts < y.ts"))
    upto = lambda low, k: low + F.call_function("shiftleft", F.lit(1), k)
    found = F.aggregate("x.steps", F.lit(0), lambda low, k: F.when((upto(low, k) <= F.size("x.xs")) & (F.get("x.xs", upto(low, k) - 1)["ts"] < F.col("y.ts")), upto(low, k)).otherwise(low))
    at = F.get("x.xs", found - 1)
    x = [F.col("x.session"), F.col("x.aid"), at["ts"].alias("ts"), at["eid"].alias("eid"), at["type"].alias("type")]
    return met.select(F.struct(*x).alias("x"), F.struct("y.session", "y.aid", "y.ts", "y.eid", "y.type").alias("y"))


def _near_in_place(events: DataFrame, spec: CovisSpec) -> DataFrame:
    """x and y of one session at most spec.reach places apart that meet the pair condition; each event sees its neighbours through a window, in the session's own partition."""
    e = events.withColumn("y", F.expr(spec.right))
    if spec.y_first:
        e = e.withColumn("y", F.col("y") & (F.row_number().over(Window.partitionBy("session", "aid", "y").orderBy("ts", "eid")) == 1))
    along = Window.partitionBy("session").orderBy("k")
    one = F.when(F.col("y"), F.struct("session", "aid", "ts", "type", "eid"))
    steps = [d for d in range(-spec.reach, spec.reach + 1) if d > 0 or (d < 0 and not spec.ahead)]
    near = e.withColumn("one", one).withColumns({f"y{k}": F.lead("one", d).over(along) if d > 0 else F.lag("one", -d).over(along) for k, d in enumerate(steps)}).where(spec.left)
    met = near.select(F.struct("session", "aid", "ts", "type", "eid").alias("x"), F.explode(F.array_compact(F.array(*[f"y{k}" for k in range(len(steps))]))).alias("y"))
    return met.where(spec.pair)


def _near_in_time(left: DataFrame, right: DataFrame, spec: CovisSpec) -> DataFrame:
    """x and y of one session less than spec.within seconds apart (y later, with ahead) that meet the pair condition.

    Buckets are as wide as the interval, so events that near are in one or in neighbouring buckets.
    """
    bucket = F.floor(F.col("ts") / spec.within)
    left, right = left.withColumn("bucket", bucket), right.withColumn("bucket", bucket)
    near = f"y.ts - x.ts < {spec.within}" + ("" if spec.ahead else f" AND x.ts - y.ts < {spec.within}")
    if not any(f"{side}.{c}" in spec.weight for side in "xy" for c in ("ts", "eid", "type")) and not spec.closest and not spec.ahead and all(k == "x.session" for k in spec.key):
        # Only whether two items come that near counts: in a bucket they do, across a border if the last of one and the first of the other do.
        ends = lambda side: side.groupBy("session", "aid", "bucket").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.min(F.struct("ts", "eid", "type")).alias("first")).select("session", "aid", "bucket", "lo", "hi", "first.*")
        left, right = ends(left), ends(right)
        near = f"(x.bucket = y.bucket OR greatest(y.lo - x.hi, x.lo - y.hi) < {spec.within})"
    to = [0, 1] if spec.ahead else [-1, 0, 1]
    left = left.withColumn("to", F.explode(F.array(*[F.col("bucket") + d for d in to])))
    return left.alias("x").join(right.alias("y"), F.expr(f"x.session = y.session AND x.to = y.bucket AND {near} AND ({spec.pair})"))


def best(pairs: DataFrame, n: int) -> DataFrame:
    """pairs(aid_x, aid_y, wgt_e9) with their rank for aid_x, the best n only (0: all)."""
    w = Window.partitionBy("aid_x").orderBy(F.desc("wgt_e9"), "aid_y")
    ranked = pairs.withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= n) if n else ranked


def merge(matrices: list[DataFrame], n: int = 0) -> DataFrame:
    """The sum of matrices, a missing pair counting 0."""
    out = matrices[0].select("aid_x", "aid_y", "wgt_e9")
    for m in matrices[1:]:
        out = out.unionByName(m.select("aid_x", "aid_y", "wgt_e9"))
    return best(out.groupBy("aid_x", "aid_y").agg(F.sum("wgt_e9").alias("wgt_e9")), n)


def adjacency(matrix: DataFrame) -> DataFrame:
    """(aid, candidates): each item's list in order. Lists hold at most the matrix's N."""
    return matrix.groupBy(F.col("aid_x").alias("aid")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "aid_y"))), lambda x: x["aid_y"]).alias("candidates"))
