"""Ranking features of (session, candidates) pairs. All sums are of doubles unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from sessionloom.functions.expr import by_type, clip255, dot, ratio, unit
from sessionloom.functions.hold import held
from sessionloom.functions.stretches import cut_points, spread, stretch
from sessionloom.operators.candidates import CLASSES
from sessionloom.operators.sessions import back, whole

#: Weight by event type.
TYPE_163 = {0: 1, 1: 6, 2: 3}
#: Pairs of a task where each meets the items of its session.
PAIRS_A_TASK = 250_000
#: Rows of a task in ranks(), which may have hundreds of columns.
RANKED_A_TASK = 20_000
#: Pairs of a part in widened(), which has hundreds of columns of them in memory.
WIDENED_A_PART = 10_000
EVENT_WEIGHTS = ("w_pos_log", "w_type_163", "w_lastday", "w_time", "w_recsys")


def _numbered(events: DataFrame, stretches: int = 1024) -> DataFrame:
    """events with `nth`, their number among the item's events by session, the most recent of a session first.

    Sessions are cut into stretches of about equally many events by a quantile sketch; an item's events before a stretch are counted by an aggregate, and
    only those within it are numbered by a window, so an item with very many events spreads over many tasks, whatever the ids are. Events are held, as they are read more than once.
    """
    events = held(events, "events")
    e = events.withColumn("stretch", stretch(F.col("session"), cut_points(events, "session", stretches)))
    before = Window.partitionBy("aid").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = e.groupBy("aid", "stretch").agg(F.count("*").alias("n")).select(F.col("aid").alias("of"), F.col("stretch").alias("at"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("aid", "stretch").orderBy("session", F.desc("ts"), F.desc("eid"))
    met = e.withColumn("nth", F.row_number().over(within)).join(counts, F.col("aid").eqNullSafe(F.col("of")) & F.col("stretch").eqNullSafe(F.col("at")))
    return met.withColumn("nth", F.col("nth") + F.col("before")).drop("stretch", "before", "of", "at")


def event_weights(events: DataFrame, no_click: bool = False) -> DataFrame:
    """Events with five weights; the most recent event is position 0.

    The running length is position + 1, so w_pos_log is 1 for the most recent event and 2^0.1 - 1 for all others.
    """
    upto = back().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e = _numbered(events).withColumns({"pos": F.row_number().over(back()) - 1, "len": F.count("*").over(upto), "last_ts": F.max("ts").over(whole())})
    apart = F.col("last_ts") - F.col("ts")
    one = F.lit(1.0)
    kind = by_type(F.col("type"), TYPE_163)
    w_time = one / F.ln(F.lit(2.0) + F.floor(apart / 60))
    w_pos, w_sess, w_aid = one / F.ln(F.lit(2.0) + F.col("pos")), one / F.ln(one + F.col("len")), one / F.ln(one + F.col("nth"))
    weights = {
        "w_pos_log": F.when(F.col("pos") == 0, one).otherwise(F.pow(F.lit(2.0), F.lit(0.1)) - 1),
        "w_type_163": kind,
        "w_lastday": (apart < 86_400).cast("double"),
        "w_time": w_time,
        "w_recsys": w_time * w_pos * w_sess * w_aid,
    }
    if no_click:
        weights = {k: w * (F.col("type") != 0).cast("double") for k, w in weights.items()}
    return e.withColumns(weights).drop("pos", "len", "last_ts", "nth")


def session_weights(events: DataFrame, no_click: bool = False) -> DataFrame:
    """The five weights summed by (session, candidates)."""
    return event_weights(events, no_click).groupBy("session", F.col("aid").alias("candidates")).agg(*[F.sum(w).alias(w) for w in EVENT_WEIGHTS])


def with_weights(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """pairs with weights; where there are none, half of the smallest that any pair has."""
    joined = pairs.join(weights, ["session", "candidates"], "left")
    least = F.broadcast(joined.agg(*[(F.min(w) / 2).alias(f"half_{w}") for w in EVENT_WEIGHTS]))
    return joined.crossJoin(least).select(*[c for c in joined.columns if c not in EVENT_WEIGHTS], *[F.coalesce(w, f"half_{w}").alias(w) for w in EVENT_WEIGHTS])


def weighted_popularity(events: DataFrame, suffix: str = "") -> DataFrame:
    """(aid, {class}_{weight}{suffix}): the events' weights summed by item and class; one aggregate for all of them."""
    e = event_weights(events)
    return e.groupBy("aid").agg(*[F.sum(F.when(F.col("type") == k, F.col(w)).otherwise(0.0)).alias(f"{c}_{w}{suffix}") for k, c in enumerate(CLASSES) for w in EVENT_WEIGHTS])


def _shares(rows: DataFrame, keys: list[str], value: str, times: int) -> DataFrame:
    """rows with `share`, their part of the keys' total, times a number. Totals are summed with map-side partials and joined; Spark broadcasts them by their size."""
    totals = rows.groupBy(*keys).agg(F.sum(value).alias("total"))
    return rows.join(totals, keys).withColumn("share", F.col(value) * times / F.col("total"))


def with_hours(events: DataFrame, t0: int, shift: int = 7200) -> DataFrame:
    """events with what popularity counts by: `n` (1), the local `day` since t0 and the local `hour`."""
    local = F.col("ts") + shift
    return events.withColumns({"n": F.lit(1).cast("long"), "day": _day(F.col("ts"), t0, shift), "hour": local - local % 3600})


def _counts(rows: DataFrame, *keys: str) -> DataFrame:
    """Sums of n by keys; of events, which have none, their number."""
    return rows.groupBy(*keys).agg((F.sum("n") if "n" in rows.columns else F.count("*")).alias("n"))


def popularity_week(events: DataFrame) -> DataFrame:
    """(aid, type, popularity_week): share of the type's events, times 10,000. Events, or sums n of them by with_hours()."""
    n = _counts(events, "aid", "type")
    return _shares(n, ["type"], "n", 10_000).select("aid", "type", F.col("share").alias("popularity_week"))


def _day(ts: Column, t0: int, shift: int) -> Column:
    return F.floor((ts + shift - t0) / 86_400).cast("long")


def popularity_day(events: DataFrame, t0: int, shift: int = 7200) -> DataFrame:
    """(aid, type, day, popularity_day): share of the day's events of the type, times 10,000; days are local, shift seconds ahead."""
    n = _counts(events if "day" in events.columns else with_hours(events, t0, shift), "aid", "type", "day")
    return _shares(n, ["type", "day"], "n", 10_000).select("aid", "type", "day", F.col("share").alias("popularity_day"))


def popularity_hour(events: DataFrame, shift: int = 7200) -> DataFrame:
    """(aid, type, hour, popularity_hour): events of the hour and its neighbours, at hours with events only, as share of all such sums, times 100."""
    n = _counts(events if "hour" in events.columns else with_hours(events, 0, shift), "aid", "type", "hour")
    around = Window.partitionBy("aid", "type").orderBy("hour").rangeBetween(-3600, 3600)
    rolled = n.withColumn("r", F.sum("n").over(around))
    return _shares(rolled, ["type", "hour"], "r", 100).select("aid", "type", "hour", F.col("share").alias("popularity_hour"))


def popularity(pairs: DataFrame, events: DataFrame, t0: int, shift: int = 7200) -> DataFrame:
    """pairs with week, day and hour popularity of the candidate for each class, at the session's last event, and hour/day, day/week ratios."""
    local = F.col("last_ts") + shift
    at = events.groupBy("session").agg(F.max("ts").alias("last_ts")).select("session", _day(F.col("last_ts"), t0, shift).alias("day"), (local - local % 3600).alias("hour"))
    out = pairs.join(at, "session", "left")

    def wide(df: DataFrame, keys: list[str], value: str) -> DataFrame:
        # Held, so that the planner knows their size: pairs are not shuffled by item, of which some are in most sessions, for small ones.
        return held(df.groupBy(F.col("aid").alias("candidates"), *keys).agg(*[F.max(F.when(F.col("type") == k, F.col(value))).alias(f"{value}_{c}") for k, c in enumerate(CLASSES)]), value)

    out = out.join(wide(popularity_week(events), [], "popularity_week"), "candidates", "left")
    out = out.join(wide(popularity_day(events, t0, shift), ["day"], "popularity_day"), ["candidates", "day"], "left")
    out = out.join(wide(popularity_hour(events, shift), ["hour"], "popularity_hour"), ["candidates", "hour"], "left")
    found = {}
    for c in CLASSES:
        w, d, h = (F.coalesce(f"popularity_{p}_{c}", F.lit(0.0)) for p in ("week", "day", "hour"))
        found |= {f"popularity_week_{c}": w, f"popularity_day_{c}": d, f"popularity_hour_{c}": h, f"popularity_hour_day_{c}": ratio(h, d), f"popularity_day_week_{c}": ratio(d, w)}
    return out.select(*pairs.columns, *[v.alias(k) for k, v in found.items()])


def per_event(pairs: DataFrame, events: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """pairs x the distinct items of their session, with how many events each item has (`cnt`) and the session has (`total`), and the item's weights.

    Pairs, which should be held, are dealt to tasks by session and stay there: what is summed by pair needs no further shuffle.
    """
    items = events.groupBy("session", "aid").agg(F.count("*").alias("cnt"))
    items = items.withColumn("total", F.sum("cnt").over(whole()))
    if weights is not None:
        items = items.join(weights.withColumnRenamed("candidates", "aid"), ["session", "aid"], "left")
    return spread(pairs, "session", PAIRS_A_TASK).join(items, "session", "left")


def _aggregates(value: Column, name: str) -> list[Column]:
    """mean, sum and max over a session's events of a value that events of one item share."""
    return [(F.sum(value * F.col("cnt")) / F.max("total")).alias(f"{name}_mean"), F.sum(value * F.col("cnt")).alias(f"{name}_sum"), F.max(value).alias(f"{name}_max")]


def covisitation_features(pairs: DataFrame, events: DataFrame, matrix: DataFrame | dict[str, DataFrame], weights: DataFrame, name: str = "m") -> DataFrame:
    """pairs with mean, sum and max over the session's events of the matrix weight to the candidate, plain and times each event weight.

    Several matrices by name are one table of edges with a column each, so that pairs, events and weights are joined once for all of them.
    Events are collapsed to items first, and the matrix is joined inside: events without an edge count as 0 through `total`.
    """
    matrices = matrix if isinstance(matrix, dict) else {name: matrix}
    edges = None
    for k, m in enumerate(matrices.values()):
        one = m.select(F.col("aid_x").alias("aid"), F.col("aid_y").alias("candidates"), F.lit(k).alias("k"), (F.col("wgt_e9") / F.lit(1e9)).alias("w"))
        edges = one if edges is None else edges.unionByName(one)
    edges = edges.groupBy("aid", "candidates").agg(*[F.max(F.when(F.col("k") == k, F.col("w"))).alias(f"w{k}") for k in range(len(matrices))])
    e = per_event(pairs.select("session", "candidates"), events, weights).join(edges, ["aid", "candidates"])
    value = lambda k, x: F.coalesce(f"w{k}", F.lit(0.0)) * (F.coalesce(x, F.lit(0.0)) if x else F.lit(1.0))
    cols = [c for k, n in enumerate(matrices) for x in ("", *EVENT_WEIGHTS) for c in _aggregates(value(k, x), f"{n}_{x}" if x else n)]
    found = e.groupBy("session", "candidates").agg(*cols)
    names = [c for c in found.columns if c not in ("session", "candidates")]
    return pairs.join(found, ["session", "candidates"], "left").na.fill(0.0, names)


def count_actions(pairs: DataFrame, events: DataFrame) -> DataFrame:
    """pairs with how often the session has the candidate: all events, and each class; up to 255.

    Both meet in tasks whose number follows that of the events, which should be held.
    """
    e = spread(events.select("session", F.col("aid").alias("candidates"), "type"), ["session", "candidates"])
    n = e.groupBy("session", "candidates").agg(F.count("*").alias("n_all"), *[F.count_if(F.col("type") == k).alias(f"n_{c}") for k, c in enumerate(CLASSES)])
    out = pairs.join(n, ["session", "candidates"], "left")
    return out.select(*pairs.columns, *[clip255(F.coalesce(c, F.lit(0))).alias(f"candidate_{c[2:]}_before") for c in ("n_all", *[f"n_{c}" for c in CLASSES])])


def session_counts(events: DataFrame) -> DataFrame:
    """(session, n_views, n_clicks, n_carts, n_orders), up to 255."""
    n = events.groupBy("session").agg(F.count("*").alias("n_views"), *[F.count_if(F.col("type") == k).alias(f"n_{c}") for k, c in enumerate(CLASSES)])
    return n.select("session", *[clip255(F.col(c)).alias(c) for c in n.columns[1:]])


def ranks(features: DataFrame, names: list[str], most: int = 255) -> DataFrame:
    """features, which should be held, with {name}_rank: descending in the session, ties take the smallest, missing and NaN last, up to `most`.

    Rows are dealt by session once and keep all their columns; each feature is ranked in Arrow batches of whole sessions, so there are no expressions, rows or arrays by feature.
    """
    at = [features.columns.index(c) for c in names]
    schema = StructType([*features.schema.fields, *[StructField(f"{c}_rank", LongType()) for c in names]])
    dealt = spread(features, "session", RANKED_A_TASK).sortWithinPartitions("session").toDF(*[f"c{k}" for k in range(len(features.columns))])
    return dealt.mapInArrow(_ranked(features.columns.index("session"), at, [f.name for f in schema.fields], most), schema)


def _ranked(session: int, at: list[int], names: list[str], most: int):
    """Arrow batches in order of the column `session` -> with the ranks of the columns `at`."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def starts(batch):
            of = batch.column(session).dictionary_encode(null_encoding="encode").indices.to_numpy()
            return np.r_[True, of[1:] != of[:-1]]

        def done(held):
            batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            found = _session_ranks(np.stack([_doubles(batch.column(k)) for k in at]), np.flatnonzero(starts(batch)), most) if at else []
            return pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, found)], names)

        held = []  # the last session so far
        for batch in batches:
            if not batch.num_rows:
                continue
            last = int(np.flatnonzero(starts(batch))[-1])
            if last:
                yield done([*held, batch.slice(0, last)])
                held = []
            elif held and held[-1].column(session)[-1] != batch.column(session)[0]:
                yield done(held)
                held = []
            held.append(batch.slice(last))
        if held:
            yield done(held)

    return run


def _doubles(column):
    """An Arrow column as doubles, null as NaN."""
    import pyarrow as pa

    return column.cast(pa.float64(), safe=False).fill_null(float("nan")).to_numpy(zero_copy_only=False)


def _session_ranks(values, starts, most: int):
    """(features x rows, in order of session) -> ranks within the stretches of rows that begin at starts: descending, ties take the smallest, NaN last."""
    import numpy as np

    out = np.empty(values.shape, np.int64)
    for a, b in zip(starts, [*starts, values.shape[1]][1:], strict=True):
        v = -values[:, a:b]
        order = np.argsort(v, axis=1)
        v = np.take_along_axis(v, order, 1)
        first = np.zeros(v.shape, np.int64)
        first[:, 1:] = np.where((v[:, 1:] != v[:, :-1]) & ~(np.isnan(v[:, 1:]) & np.isnan(v[:, :-1])), np.arange(1, b - a), 0)
        np.put_along_axis(out[:, a:b], order, np.minimum(most, np.maximum.accumulate(first, axis=1) + 1), 1)
    return out


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(aid, vec) scaled to length one."""
    return vectors.select("aid", unit(F.col("vec")).alias("vec"))


def similarities(rows: DataFrame, vectors: DataFrame, a: str, b: str, missing: float | None = 0.0) -> DataFrame:
    """rows with `sim`, the dot product of the unit vectors of items a and b; `missing` where there is no vector. Distinct pairs are computed once and held, so that the planner knows their size and leaves rows where they are if it can."""
    pairs = rows.select(F.col(a).alias("sa"), F.col(b).alias("sb")).distinct()
    va, vb = vectors.select(F.col("aid").alias("sa"), F.col("vec").alias("va")), vectors.select(F.col("aid").alias("sb"), F.col("vec").alias("vb"))
    sims = held(pairs.join(va, "sa").join(vb, "sb").select("sa", "sb", dot(F.col("va"), F.col("vb")).alias("sim")), "sims")
    return rows.join(sims, (rows[a] == sims["sa"]) & (rows[b] == sims["sb"]), "left").drop("sa", "sb").withColumn("sim", F.coalesce("sim", F.lit(missing).cast("double")))


def last_item_similarity(pairs: DataFrame, last: DataFrame, vectors: DataFrame, n: int = 5, name: str = "sim") -> DataFrame:
    """pairs with {name}_last_0 ..: similarity to the session's last items; -1 where the session is shorter."""
    long = last.select("session", F.posexplode(F.array(*[F.col(f"last_{i}") for i in range(n)])).alias("i", "aid")).where("aid >= 0")
    rows = similarities(pairs.select("session", "candidates").join(long, "session"), vectors, "candidates", "aid")
    wide = rows.groupBy("session", "candidates").agg(*[F.max(F.when(F.col("i") == i, F.col("sim"))).alias(f"{name}_last_{i}") for i in range(n)])
    return pairs.join(wide, ["session", "candidates"], "left").na.fill(-1.0, [f"{name}_last_{i}" for i in range(n)])


def factor_features(pairs: DataFrame, events: DataFrame, vectors: DataFrame, weights: DataFrame, name: str = "mf") -> DataFrame:
    """pairs, which are distinct, with mean, sum and max over events of (similarity + 1) times each event weight; 0 without a vector."""
    rows = similarities(per_event(pairs, events, weights), vectors, "candidates", "aid", missing=None)
    s = F.coalesce(F.col("sim") + 1, F.lit(0.0))
    cols = [c for w in EVENT_WEIGHTS for c in _aggregates(s * F.coalesce(w, F.lit(0.0)), f"{name}_{w}")]
    found = rows.groupBy(*pairs.columns).agg(*cols)
    return found.na.fill(0.0, [c for c in found.columns if c not in pairs.columns])


def position_weights(events: DataFrame) -> DataFrame:
    """Events with type_mp, last (1 for the most recent), wgt_1 and wgt_2, which are largest for the oldest events."""
    e = events.withColumns({"nth": F.row_number().over(back()), "n": F.count("*").over(whole())})
    kind = by_type(F.col("type"), {0: 0.5, 1: 9, 2: 0.5})

    def w(start: float) -> Column:
        low = F.pow(F.lit(2.0), F.lit(start)) - 1
        return (low + (F.lit(1.0) - low) * (F.col("nth") - 1) / F.col("n")) * kind

    return e.withColumns({"type_mp": kind, "last": (F.col("nth") == 1).cast("int"), "wgt_1": w(0.1), "wgt_2": w(0.5)}).drop("nth", "n")


def sequence_features(pairs: DataFrame, events: DataFrame, vectors: DataFrame, name: str = "w2v", floor: float = 0.5) -> DataFrame:
    """pairs with seven aggregates of the similarity (0 under floor) to the session's events; weighted sums are over 1 + matches."""
    w = position_weights(events).groupBy("session", "aid").agg(F.count("*").alias("cnt"), F.sum("wgt_1").alias("s1"), F.sum("wgt_2").alias("s2"), F.sum("type_mp").alias("st"), F.max("last").alias("last"))
    rows = similarities(pairs.select("session", "candidates").join(w, "session"), vectors, "candidates", "aid").withColumn("sim", F.when(F.col("sim") < floor, 0.0).otherwise(F.col("sim")))
    s, hits = F.col("sim"), F.sum(F.when(F.col("sim") > 0, F.col("cnt")).otherwise(0))
    found = rows.groupBy("session", "candidates").agg(
        F.max(s).alias(f"{name}_max"),
        (F.sum(s * F.col("cnt")) / (1 + hits)).alias(f"{name}_mean"),
        hits.alias(f"{name}_count"),
        (F.sum(s * F.col("s1")) / (1 + hits)).alias(f"{name}_wgt_1"),
        (F.sum(s * F.col("s2")) / (1 + hits)).alias(f"{name}_wgt_2"),
        F.max(s * F.col("last")).alias(f"{name}_last"),
        (F.sum(s * F.col("st")) / (1 + hits)).alias(f"{name}_type"),
    )
    names = [c for c in found.columns if c not in ("session", "candidates")]
    return pairs.join(found, ["session", "candidates"], "left").na.fill(0.0, [c for c in names if c != f"{name}_count"]).na.fill(0, [f"{name}_count"])


def session_items(events: DataFrame) -> DataFrame:
    """(session, aid) with all that features know of a session's item: cnt and the session's total; the five weights, plain and (nc_) without clicks; position
    weights s1, s2, st and last; r0 .. r4 and b0 .. b4, whether it is the session's last item but so many, of all events and of carts and orders.
    """
    kinds = Window.partitionBy("session", F.col("type") != 0).orderBy(F.desc("ts"), F.desc("eid"))
    e = event_weights(position_weights(events)).withColumns({"p": F.row_number().over(back()) - 1, "pb": F.when(F.col("type") != 0, F.row_number().over(kinds) - 1)})
    nc = lambda w: F.sum(F.when(F.col("type") != 0, F.col(w)).otherwise(0.0)).alias(f"nc_{w}")
    cols = [F.sum(w).alias(w) for w in EVENT_WEIGHTS] + [nc(w) for w in EVENT_WEIGHTS]
    cols += [F.count("*").alias("cnt"), F.sum("wgt_1").alias("s1"), F.sum("wgt_2").alias("s2"), F.sum("type_mp").alias("st"), F.max("last").alias("last")]
    cols += [F.coalesce(F.max(F.col(p) == i), F.lit(False)).alias(f"{x}{i}") for x, p in (("r", "p"), ("b", "pb")) for i in range(5)]
    return e.groupBy("session", "aid").agg(*cols).withColumn("total", F.sum("cnt").over(whole()))


def wide_names(sets: list[str], matrices: list[str]) -> list[str]:
    """The columns of widened(): 27 for each set of vectors, as last_item_similarity, factor_features and sequence_features make them, 18 for each matrix, as covisitation_features."""
    three = lambda n: [f"{n}_{a}" for a in ("mean", "sum", "max")]
    by_set = [[*[f"{n}_last_{i}" for i in range(5)], *[c for w in EVENT_WEIGHTS for c in three(f"{n}_{w.removeprefix('w_')}")], *[f"{n}_seq_{x}" for x in ("max", "mean", "count", "wgt_1", "wgt_2", "last", "type")]] for n in sets]
    return [*sum(by_set, []), *[c for n in matrices for x in ("", *EVENT_WEIGHTS) for c in three(f"matrix_{n}_{x}" if x else f"matrix_{n}")]]


def item_values(met: DataFrame, sets: dict[str, tuple[DataFrame, bool]], mats: DataFrame, matrices: list[str]) -> DataFrame:
    """(candidates, aid, v): for distinct item pairs, an array of the similarities by each set of unit vectors, null where one has none, and the weights by each matrix, null without an edge."""
    # All sets are one wide row an item, joined to each end once.
    wide = reduce(DataFrame.unionByName, [vectors.select("aid", F.lit(k).alias("k"), "vec") for k, (vectors, _) in enumerate(sets.values())])
    wide = wide.groupBy("aid").agg(*[F.first(F.when(F.col("k") == k, F.col("vec")), ignorenulls=True).alias(f"v{k}") for k in range(len(sets))])
    out = met.select("candidates", "aid").distinct()
    for side, of in (("a", "candidates"), ("b", "aid")):
        out = out.join(wide.select(F.col("aid").alias(of), *[F.col(f"v{k}").alias(f"{side}{k}") for k in range(len(sets))]), of, "left")
    edges = mats.where(F.col("matrix").isin(matrices)).groupBy(F.col("aid_x").alias("aid"), F.col("aid_y").alias("candidates"))
    edges = edges.agg(*[F.max(F.when(F.col("matrix") == n, F.col("wgt_e9") / F.lit(1e9))).alias(f"w{k}") for k, n in enumerate(matrices)])
    sims = [F.when(F.col(f"a{k}").isNotNull() & F.col(f"b{k}").isNotNull(), dot(F.col(f"a{k}"), F.col(f"b{k}"))) for k in range(len(sets))]
    return out.join(edges, ["candidates", "aid"], "left").select("candidates", "aid", F.array(*sims, *[F.col(f"w{k}") for k in range(len(matrices))]).alias("v"))


def widened(pairs: DataFrame, items: DataFrame, sets: dict[str, tuple[DataFrame, bool]], mats: DataFrame, matrices: list[str], ranked: list[str], floor: float = 0.5, most: int = 255) -> DataFrame:
    """pairs, which should be held, with the columns of wide_names(), and {name}_rank as by ranks() of those and of the pairs' own that are `ranked`.

    items: session_items(). A set that is marked is of carts and orders: its last items are those, its weights without clicks. Values of distinct item pairs are computed once for all sets and matrices.
    Sessions are dealt to parts; a part's pairs, items and values meet in one Arrow group, where an item's values are summed over sessions' items as arrays, so no row by
    pair and item and no half-made wide row is ever shuffled.
    """
    n = max(pairs.sparkSession.sparkContext.defaultParallelism, -(-pairs.count() // WIDENED_A_PART))
    part = F.pmod(F.xxhash64("session"), F.lit(n)).alias("part")
    met = held(pairs.select(part, "session", "candidates").join(items.select("session", "aid"), "session").select("part", "candidates", "aid").distinct(), "met")
    values = met.join(held(item_values(met, sets, mats, matrices), "values"), ["candidates", "aid"])
    cells = [*EVENT_WEIGHTS, *[f"nc_{w}" for w in EVENT_WEIGHTS], "cnt", "total", "s1", "s2", "st", "last", *[f"{x}{i}" for x in "rb" for i in range(5)]]
    rows = items.select(part, F.lit(True).alias("item"), F.col("session").alias("a"), F.col("aid").alias("b"), F.array(*[F.col(c).cast("double") for c in cells]).alias("v"))
    rows = rows.unionByName(values.select("part", F.lit(False).alias("item"), F.col("candidates").alias("a"), F.col("aid").alias("b"), "v"))
    made = wide_names(list(sets), matrices)
    schema = StructType([*pairs.schema.fields, *[StructField(c, DoubleType()) for c in made], *[StructField(f"{c}_rank", LongType()) for c in ranked]])
    dealt = lambda d: d.repartition(n, "part").groupBy("part")
    run = _widened(pairs.columns, cells, [buys for _, buys in sets.values()], len(matrices), made, ranked, floor, most)
    return dealt(pairs.select("*", part)).cogroup(dealt(rows)).applyInArrow(run, schema)


def _widened(columns: list[str], cells: list[str], buys: list[bool], matrices: int, made: list[str], ranked: list[str], floor: float, most: int):
    """(a part's pairs, its items and values) -> the pairs with what is made of them."""

    def run(pairs, rows):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        pairs = pairs.take(pc.sort_indices(pairs, [("session", "ascending")])).combine_chunks()

        def whole(column):
            """(an id column as numbers, which are there)"""
            return column.fill_null(0).to_numpy(), column.is_valid().to_numpy()

        def parted(rows, width):
            """(a, b, which b are there, values by row, which are null) in order of a and b."""
            rows = rows.filter(pc.is_valid(rows["a"]))
            a, (b, there) = rows["a"].to_numpy(), whole(rows["b"])
            flat = pa.chunked_array(rows["v"], pa.list_(pa.float64())).combine_chunks().flatten()
            order = np.lexsort((b, a))
            by_row = lambda x: np.ascontiguousarray(x.to_numpy(zero_copy_only=False).reshape(-1, width)[order].T)
            return a[order], b[order], there[order], by_row(flat), by_row(flat.is_null())

        of, aid, there, item, gone = parted(rows.filter(rows["item"]), len(cells))
        item[gone] = 0.0
        i = dict(zip(cells, item, strict=True))
        one, other, _, value, none = parted(rows.filter(pc.invert(rows["item"])), len(buys) + matrices)
        value, none = np.c_[value, np.full(len(value), np.nan)], np.c_[none, np.full(len(none), True)]  # the last stands for pairs without values
        ones, others = np.unique(one), np.unique(other)
        key = np.searchsorted(ones, one) * len(others) + np.searchsorted(others, other)

        def code(known, x):
            at = np.searchsorted(known, x)
            return np.where(np.r_[known, 0][at] == x, at, -1) if len(known) else np.full(len(x), -1)

        (session, named), (candidate, sure) = whole(pairs["session"]), whole(pairs["candidates"])
        candidate, aid = np.where(sure, code(ones, candidate), -1), np.where(there, code(others, aid), -1)
        low = np.searchsorted(of, session)
        size = np.where(named, np.searchsorted(of, session, "right") - low, 0)
        fill = np.array([-1.0 if "_last_" in c and not c.startswith("matrix_") else 0.0 for c in made])[:, None]
        out = np.repeat(fill, len(session), axis=1)
        some = np.flatnonzero(size)
        ends = np.cumsum(size[some])
        begin = 0
        while begin < len(some):  # pairs that have some 50,000 items
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + 50_000, "right")))
            at = some[begin:end]
            start = np.cumsum(size[at]) - size[at]
            pair = np.repeat(at, size[at])
            k = np.arange(len(pair)) - np.repeat(start, size[at]) + low[pair]
            wanted = np.where((candidate[pair] >= 0) & (aid[k] >= 0), candidate[pair] * len(others) + aid[k], -1)
            v = np.searchsorted(key, wanted)
            v = np.where((v < len(key)) & (np.r_[key, -2][v] == wanted), v, len(key))
            cnt, total = i["cnt"][k], i["total"][low[at]]
            total_of = lambda x, start=start: np.add.reduceat(x, start, axis=-1)
            most_of = lambda x, start=start: np.maximum.reduceat(x, start, axis=-1)
            weights = {b: np.stack([i[f"nc_{w}" if b else w][k] for w in EVENT_WEIGHTS]) for b in (False, True)}
            found = []

            def three(x, cnt=cnt, total=total, total_of=total_of, most_of=most_of, found=found):
                sums = total_of(x * cnt)
                found.extend(np.stack([sums / total, sums, most_of(x)], axis=1).reshape(-1, sums.shape[1]))

            for j, b in enumerate(buys):
                sim, absent = value[j][v], none[j][v]
                known = np.where(absent, 0.0, sim)
                near = np.where(known < floor, 0.0, known)
                for x in range(5):
                    last = most_of(np.where(i[f"{'b' if b else 'r'}{x}"][k] > 0, known, -np.inf))
                    found.append(np.where(last == -np.inf, -1.0, last))
                three(np.where(absent, 0.0, sim + 1) * weights[b])
                hits = total_of(np.where((near > 0) | np.isnan(near), cnt, 0.0))
                over = lambda x, near=near, hits=hits, total_of=total_of: total_of(near * x) / (1 + hits)
                found += [most_of(near), over(cnt), hits, over(i["s1"][k]), over(i["s2"][k]), most_of(near * i["last"][k]), over(i["st"][k])]
            plain = np.r_[np.ones((1, len(k))), weights[False]]
            for j in range(len(buys), len(buys) + matrices):
                three(np.where(none[j][v], 0.0, value[j][v]) * plain)
            out[:, at] = found
            begin = end
        np.copyto(out, fill, where=np.isnan(out))
        new = np.flatnonzero(np.r_[True, (session[1:] != session[:-1]) | (named[1:] != named[:-1])]) if len(session) else []
        row = {c: k for k, c in enumerate(made)}
        ranks = _session_ranks(np.stack([out[row[c]] if c in row else _doubles(pairs[c]) for c in ranked]), new, most)
        return pa.Table.from_arrays([*[pairs[c] for c in columns], *map(pa.array, out), *map(pa.array, ranks)], [*columns, *made, *[f"{c}_rank" for c in ranked]])

    return run


def correlated(features: DataFrame, names: list[str], over: float = 0.99) -> DataFrame:
    """(a, b, corr) of feature pairs that correlate over a bound; all coefficients come from one Gram matrix of the features. Missing values count as 0."""
    made = VectorAssembler(inputCols=[f"f{k}" for k in range(len(names))], outputCol="v").transform(features.select(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(f"f{k}") for k, c in enumerate(names)]))
    corr = Correlation.corr(made, "v").first()[0].toArray()  # as many rows as there are features
    rows = [(a, b, float(corr[i, j])) for i, a in enumerate(names) for j, b in enumerate(names) if i < j and corr[i, j] > over]
    return features.sparkSession.createDataFrame(rows, "a string, b string, corr double")
