"""Splits, labels and everything that looks along one session."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from sessionloom.functions.expr import arithmetic_hash

DAY = 86_400


def whole() -> WindowSpec:
    return Window.partitionBy("session")


def along() -> WindowSpec:
    return whole().orderBy("ts", "eid")


def back() -> WindowSpec:
    return whole().orderBy(F.desc("ts"), F.desc("eid"))


def split_time(events: DataFrame, days: int) -> DataFrame:
    """One row: the last event's time less so many days."""
    return events.agg((F.max("ts") - days * DAY).alias("split_ts"))


def _against_split(events: DataFrame, days: int) -> DataFrame:
    """Events with their session's first and last time and the split time (one row, broadcast)."""
    seen = events.withColumns({"first_ts": F.min("ts").over(whole()), "last_ts": F.max("ts").over(whole())})
    return seen.crossJoin(F.broadcast(split_time(events, days)))


def train_part(events: DataFrame, days: int = 7) -> DataFrame:
    """Events before the split, of sessions that begin at or before it."""
    return _against_split(events, days).where("first_ts <= split_ts AND ts < split_ts").select(events.columns)


def test_part(events: DataFrame, days: int = 7) -> DataFrame:
    """Whole sessions that begin after the split."""
    return _against_split(events, days).where("first_ts > split_ts").select(events.columns)


def straddling_part(events: DataFrame, days: int = 7) -> DataFrame:
    """What training cuts off: events from the split on of sessions around it, if there are two or more."""
    late = _against_split(events, days).where("first_ts < split_ts AND last_ts > split_ts AND ts >= split_ts")
    return late.withColumn("n", F.count("*").over(whole())).where("n > 1").select(events.columns)


def ground_truth(events: DataFrame, drop_zero_aid: bool = True) -> DataFrame:
    """Labels from strictly later events: the next click, the sets of later carts and orders. The last event has none.

    With drop_zero_aid a next click on item 0 counts as none.
    """
    # Read from the end, what is later comes first: frames that only grow are carried along instead of being computed for each row.
    later = back().rowsBetween(Window.unboundedPreceding, -1)
    of = lambda t: F.when(F.col("type") == t, F.col("aid"))
    out = events.withColumns(
        {
            "label_click": F.last(of(0), ignorenulls=True).over(later),
            "label_carts": F.array_sort(F.collect_set(of(1)).over(later)),
            "label_orders": F.array_sort(F.collect_set(of(2)).over(later)),
            "back": F.row_number().over(back()),
        }
    ).where("back > 1")
    if drop_zero_aid:
        out = out.withColumn("label_click", F.when(F.col("label_click") != 0, F.col("label_click")))
    return out.drop("back")


def cut_sessions(events: DataFrame, seed: int = 42, drop_zero_aid: bool = True) -> tuple[DataFrame, DataFrame]:
    """(kept events, labels at the cut): each session of two events or more is cut after 1 to n - 1 of them, by a hash of its id."""
    n = F.count("*").over(whole())
    placed = events.withColumns({"n": n, "pos": F.row_number().over(along())}).where("n > 1")
    placed = placed.withColumn("cut", 1 + arithmetic_hash(F.col("session"), seed, F.col("n") - 1))
    # Only what comes after the cut is gathered, once for each session.
    of = lambda t: F.when(F.col("type") == t, F.col("aid"))
    click = F.min(F.when(F.col("type") == 0, F.struct("ts", "eid", "aid")))["aid"]
    labels = placed.where("pos > cut").groupBy("session").agg(click.alias("label_click"), F.array_sort(F.collect_set(of(1))).alias("label_carts"), F.array_sort(F.collect_set(of(2))).alias("label_orders"))
    if drop_zero_aid:
        labels = labels.withColumn("label_click", F.when(F.col("label_click") != 0, F.col("label_click")))
    return placed.where("pos <= cut").select(events.columns), labels


def labels_to_long(labels: DataFrame) -> DataFrame:
    """(session, type, ground_truth) of labels by column; a class without items has no row."""
    carts, orders = F.when(F.size("label_carts") > 0, F.col("label_carts")), F.when(F.size("label_orders") > 0, F.col("label_orders"))
    clicks = F.when(F.col("label_click").isNotNull(), F.array("label_click"))
    rows = [F.struct(F.lit(name).alias("type"), c.cast("array<long>").alias("ground_truth")) for name, c in (("clicks", clicks), ("carts", carts), ("orders", orders))]
    return labels.select("session", F.inline(F.array(*rows))).where("ground_truth IS NOT NULL")


def with_buys(rows: DataFrame, events: DataFrame) -> DataFrame:
    """rows of sessions that have an event other than a click."""
    return rows.join(events.where("type <> 0").select("session").distinct(), "session", "left_semi")


def subsessions(events: DataFrame, gap: int = 7200) -> DataFrame:
    """`d`: pauses of more than gap seconds so far."""
    cut = events.withColumn("cut", F.coalesce((F.col("ts") - F.lag("ts").over(along()) > gap).cast("long"), F.lit(0)))
    return cut.withColumn("d", F.sum("cut").over(along())).drop("cut")


def subsessions_inclusive(events: DataFrame, gap: int = 7200) -> DataFrame:
    """`d` counts pauses of gap seconds or more; the first event's own time counts as its pause, so it opens 1."""
    step = F.least(F.greatest(F.col("ts") - F.coalesce(F.lag("ts").over(along()), F.lit(0)), F.lit(0)), F.lit(DAY))
    cut = events.withColumn("cut", (step >= gap).cast("long"))
    return cut.withColumn("d", F.sum("cut").over(along())).drop("cut")


def subsession_flags(events: DataFrame, gap: int = 7200) -> DataFrame:
    """`a`, `b`: first and last of its sub-session; `day` since the first event of all."""
    sub = Window.partitionBy("session", "d")
    first, last = sub.orderBy("ts", "eid"), sub.orderBy(F.desc("ts"), F.desc("eid"))
    start = F.broadcast(events.agg(F.min("ts").alias("t0")))
    out = subsessions(events, gap).crossJoin(start)
    return out.withColumns({"a": (F.row_number().over(first) == 1).cast("int"), "b": (F.row_number().over(last) == 1).cast("int"), "day": F.floor((F.col("ts") - F.col("t0")) / DAY).cast("long")}).drop("t0")


def tail(events: DataFrame, n: int = 30) -> DataFrame:
    """The n most recent events of each session."""
    return events.withColumn("back", F.row_number().over(back())).where(F.col("back") <= n).drop("back")


def started_after(events: DataFrame, since: int) -> DataFrame:
    """Events of sessions that begin after a time."""
    return events.withColumn("first_ts", F.min("ts").over(whole())).where(F.col("first_ts") > since).drop("first_ts")


def last_items(events: DataFrame, n: int = 5, types: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """last_0 .. last_{n-1}: a session's most recent items as columns, -1 where it is shorter."""
    # The rank itself is filtered on: of rank - 1 the optimiser wouldn't see that n rows a session are enough.
    recent = events.where(F.col("type").isin(*types)).withColumn("p", F.row_number().over(back())).where(F.col("p") <= n)
    return recent.groupBy("session").agg(*[F.coalesce(F.max(F.when(F.col("p") == i + 1, F.col("aid"))), F.lit(-1)).alias(f"last_{i}") for i in range(n)])


def next_pairs(events: DataFrame, steps: tuple[int, ...] = (1,)) -> DataFrame:
    """(aid, aid_next) at the given distances along a session; several distances give distinct pairs."""
    out = None
    for s in steps:
        one = events.select("session", "aid", F.lead("aid", s).over(along()).alias("aid_next")).where("aid_next IS NOT NULL")
        out = one if out is None else out.unionByName(one)
    return out if len(steps) == 1 else out.select("aid", "aid_next").distinct()


def lag_frame(events: DataFrame, n: int = 10, gap: int = 7200) -> DataFrame:
    """Clicks with the n items before them in their sub-session (-1 where there is none), and 8-hour slots; the first click is left out."""
    sub = Window.partitionBy("session", "d").orderBy("ts", "eid")
    start = F.broadcast(events.agg(F.min("ts").alias("t0")))
    cols = {f"lag{i}": F.lag("aid", i, -1).over(sub) if i else F.col("aid") for i in range(n + 1)}
    out = subsessions_inclusive(events, gap).withColumns(cols).where("type = 0 AND lag1 >= 0").crossJoin(start)
    return out.withColumn("hour", F.floor((F.col("ts") - F.col("t0")) / 28_800).cast("long")).drop("t0", "aid")


def running_stats(events: DataFrame) -> DataFrame:
    """Position from 0, running length, and running count of the item, from the most recent on."""
    upto = back().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    item = Window.partitionBy("session", "aid").orderBy(F.desc("ts"), F.desc("eid"))
    return events.withColumns({"pos": F.row_number().over(back()) - 1, "len": F.count("*").over(upto), "aid_count": F.row_number().over(item), "max_aid": F.max("aid").over(upto)})


SEEDS = {
    "all": "true",
    "last_sub": "d = max_d",
    "first_of_sub": "a = 1",
    "last_of_sub": "b = 1",
    "half_hour": "ts >= max_ts - 1800",
    "day": "ts >= max_ts - 86400",
    "buys": "type IN (1, 2)",
}


def seed_lists(events: DataFrame, gap: int = 7200) -> DataFrame:
    """(session, list, aid, pos): each list's distinct items, the most recent first, from position 0."""
    flagged = subsession_flags(events, gap).withColumns({"max_d": F.max("d").over(whole()), "max_ts": F.max("ts").over(whole())})
    which = F.array_compact(F.array(*[F.when(F.expr(cond), F.lit(name)) for name, cond in SEEDS.items()]))
    rows = flagged.select("session", "aid", "ts", "eid", F.explode(which).alias("list"))
    last = rows.groupBy("session", "list", "aid").agg(F.max(F.struct("ts", "eid")).alias("at"))
    recent = Window.partitionBy("session", "list").orderBy(F.desc("at"))
    return last.select("session", "list", "aid", (F.row_number().over(recent) - 1).alias("pos"))
