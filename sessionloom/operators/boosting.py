"""Boosted trees that stop on the held-out AUC or on the recall of each session's best, over values or over byte codes of them; a search for their settings."""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from math import log, prod

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions import hold
from sessionloom.functions.expr import arithmetic_hash
from sessionloom.functions.hold import held, scratch
from sessionloom.functions.stretches import SKETCH, stretch

#: Codes of values are -127 to 127, rising; that of a missing one.
MISSING = -128
#: Rows with margins -> (features, residual, weight, n) of those for training; rows with margins -> what decides, of those held out.
Slope, Measure = Callable[[DataFrame], DataFrame], Callable[[DataFrame], float]


def _number(c: str) -> Column:
    """A column as double, NaN as null."""
    return F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double"))


def code_cuts(features: DataFrame, names: list[str], bins: int = 255) -> dict[str, list[float]]:
    """Each feature's cut points between codes, with about as many values between any two: one pass with a quantile sketch a feature. What comes to the driver is bins - 1 numbers a feature."""
    ranks = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    sketches = features.agg(*[F.kll_sketch_agg_double(_number(c), F.lit(SKETCH)).alias(f"s{k}") for k, c in enumerate(names)], *[F.count(_number(c)).alias(f"n{k}") for k, c in enumerate(names)])
    got = sketches.select(*[F.when(F.col(f"n{k}") > 0, F.kll_sketch_get_quantile_double(f"s{k}", ranks)).alias(f"q{k}") for k in range(len(names))]).first()
    return {c: sorted(set(got[k] or [])) for k, c in enumerate(names)}


def coded(features: DataFrame, cuts: dict[str, list[float]]) -> DataFrame:
    """features with the columns of cuts as byte codes, MISSING for null and NaN. Stored once, any feature is read at a byte a value."""
    code = lambda c: F.coalesce(stretch(_number(c), cuts[c], "double") - 127, F.lit(MISSING)).cast("tinyint")
    return features.select(*[code(c).alias(c) if c in cuts else F.col(f"`{c}`") for c in features.columns])


def auc(scored: DataFrame, label: str, score: str = "pred", keys: tuple[str, ...] = (), buckets: int = 65_536, times: str | None = None) -> DataFrame:
    """(*keys, auc): the chance that a positive's score, from 0 to 1, is over a negative's, ties counting half. Scores are counted in buckets, so no rows are sorted; null without both kinds. times: a column that says for how many a row stands."""
    bucket = F.least(F.floor(F.col(score) * buckets), F.lit(buckets - 1))
    one = F.col(times) if times else F.lit(1).cast("long")
    n = scored.groupBy(*keys, bucket.alias("b")).agg(F.sum(one * (F.col(label) == 1).cast("long")).alias("p"), F.sum(one * (F.col(label) != 1).cast("long")).alias("n"))
    # At most as many rows as there are buckets.
    under = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    n = n.withColumn("less", F.coalesce(F.sum("n").over(under), F.lit(0)))
    won = F.sum(F.col("p").cast("double") * (F.col("less") + F.col("n") / 2))
    return n.groupBy(*keys).agg(F.try_divide(won, F.sum("p").cast("double") * F.sum("n")).alias("auc"))


@dataclass
class Boosted:
    """Trees with their leaves' values; `history` has the held-out AUC (or recall) after each round that was tried, the model its best rounds only."""

    names: list[str]
    base: float
    trees: list[DecisionTreeRegressionModel] = field(default_factory=list)
    leaves: list[list[float]] = field(default_factory=list)
    history: list[float] = field(default_factory=list)

    def margin(self, features: DataFrame, rounds: int | None = None) -> DataFrame:
        """features with `margin`, the log odds by so many rounds (all)."""
        rows = _assembled(features, self.names).withColumn("margin", F.lit(self.base))
        for tree, values in list(zip(self.trees, self.leaves, strict=True))[:rounds]:
            rows = _grown(rows, tree, values)
        return rows.drop("features")

    def score(self, features: DataFrame, rounds: int | None = None) -> DataFrame:
        """(session, candidates, pred)"""
        return self.margin(features, rounds).select("session", "candidates", _chance(F.col("margin")).alias("pred"))


def _chance(margin: Column) -> Column:
    return 1 / (1 + F.exp(-margin))


def _assembled(features: DataFrame, names: list[str]) -> DataFrame:
    """features with a vector. Each feature stands in it twice, with missing values at either end, so that a split can send them to the side where they belong."""
    kinds, far = dict(features.dtypes), 1e300
    value = lambda c: F.nullif(F.col(f"`{c}`"), F.lit(MISSING).cast("tinyint")).cast("double") if kinds[c] == "tinyint" else _number(c)
    columns = {f"f{k}{side}": F.coalesce(value(c), F.lit(end)) for k, c in enumerate(names) for side, end in (("a", -far), ("b", far))}
    return VectorAssembler(inputCols=list(columns), outputCol="features").transform(features.withColumns(columns)).drop(*columns)


def _grown(rows: DataFrame, tree: DecisionTreeRegressionModel, values: list[float]) -> DataFrame:
    seen = tree.transform(rows)
    return seen.withColumn("margin", F.col("margin") + F.get(F.array(*[F.lit(v) for v in values]), F.col("leaf").cast("int"))).drop("leaf", "step")


def _logistic(rows: DataFrame) -> DataFrame:
    """What a round of logistic boosting fits: a row's residual, and p (1 - p)."""
    p = _chance(F.col("margin"))
    return rows.where("NOT held_out").select("features", (F.col("label") - p).alias("residual"), (p * (1 - p)).alias("weight"), "n")


def _places(rows: DataFrame) -> DataFrame:
    """rows with `place`, 1 for a session's best margin; ties by candidate."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("margin"), "candidates")))


def _swaps(rows: DataFrame, k: int) -> DataFrame:
    """What a round of ranking fits: gradients of the pairs of a session's hit and miss of which just one is among the best k, as only a swap of those changes the recall.

    A pair weighs what its swap changes, 1 / min(k, hits). Margins of the other side are arrays of the session's own candidates, so a row is never joined with another.
    """
    session = Window.partitionBy("session")
    top, hit = F.col("place") <= k, F.col("label") == 1
    others = {f"{a}{b}": F.collect_list(F.when((hit if a == "hit" else ~hit) & (top if b == "in" else ~top), F.col("margin"))).over(session) for a in ("hit", "miss") for b in ("in", "out")}
    rows = _places(rows).withColumns({**others, "hits": F.sum("label").over(session)})
    # Only where both sides of the border have what could be swapped.
    against = F.when(hit, F.when(top, F.col("missout")).otherwise(F.col("missin"))).otherwise(F.when(top, F.col("hitout")).otherwise(F.col("hitin")))
    sign = F.when(hit, F.lit(1.0)).otherwise(F.lit(-1.0))
    wrong = lambda m: 1 / (1 + F.exp(sign * (F.col("margin") - m)))
    total = lambda f: F.aggregate(F.transform(against, f), F.lit(0.0), lambda x, y: x + y) / F.greatest(F.least(F.col("hits"), F.lit(float(k))), F.lit(1.0))
    return rows.select("features", (sign * total(wrong)).alias("residual"), total(lambda m: wrong(m) * (1 - wrong(m))).alias("weight"))


def _recall(rows: DataFrame, k: int) -> float:
    """Hits among the best k of each session over hits, of which at most k of a session count; nan without any."""
    one = _places(rows).groupBy("session").agg(F.sum(F.when(F.col("place") <= k, F.col("label"))).alias("found"), F.least(F.sum("label"), F.lit(float(k))).alias("hits"))
    got = one.agg(F.sum("found"), F.sum("hits")).first()
    return got[0] / got[1] if got[1] else float("nan")


def _held_auc(rows: DataFrame) -> float:
    now = auc(rows.where("held_out").select("label", _chance(F.col("margin")).alias("pred"), "n"), "label", times="n").first()
    return now.auc if now and now.auc is not None else float("nan")


def _split(features: DataFrame, target: str, names: list[str], held_share: float, seed: int, *more: str) -> tuple[DataFrame, list[str]]:
    """((*more, label, held_out, and the features under short names), those names)"""
    keep = F.coalesce(F.col(f"`{target}`"), F.lit(0)).cast("double").alias("label")
    short = [f"v{k}" for k in range(len(names))]
    values = [F.col(f"`{c}`").alias(v) for c, v in zip(names, short, strict=True)]
    return features.select(*more, keep, (arithmetic_hash(F.col("session"), seed, 1000) < int(1000 * held_share)).alias("held_out"), *values), short


def _laid_out(features: DataFrame, target: str, names: list[str], held_share: float, seed: int) -> DataFrame:
    """(features, label, held_out, n): rows that are alike are one, with their number, as they have one margin in every round.

    Of byte codes there are few, so that rounds don't grow with the rows. Rows are counted with map-side partials.
    """
    rows, short = _split(features, target, names, held_share, seed)
    return _assembled(rows.groupBy("label", "held_out", *short).agg(F.count("*").alias("n")), short).drop(*short)


def _start(rows: DataFrame, names: list[str]) -> tuple[Boosted, int]:
    """(a model of no rounds that gives the share of ones, training rows)"""
    n, ones = rows.where("NOT held_out").agg(F.coalesce(F.sum("n"), F.lit(0)), F.sum(F.col("label") * F.col("n"))).first()
    share = min(max(((ones or 0.0) + 0.5) / (n + 1.0), 1e-9), 1 - 1e-9)
    return Boosted(list(names), log(share / (1 - share))), n


def _round(model: Boosted, rows: DataFrame, slope: Slope, measure: Measure, total: int, depth: int, rate: float, ridge: float, least: int, seed: int) -> DataFrame:
    """rows, a held table, with the margins after one more round of the model, as a new held table in its place. total: training rows.

    A row counts as often as its n says. So `least`, a number of rows, is a share of their weight; of fewer than two such parts there is nothing to split.
    """
    own = slope(rows)
    share = (least - 0.5) / total if least > 1 else 0.0
    tree = DecisionTreeRegressor(labelCol="residual", predictionCol="step", leafCol="leaf", weightCol="n", maxDepth=depth if 2 * least <= total else 0, maxBins=256, minWeightFractionPerNode=min(share, 0.499), seed=seed)
    grown = tree.fit(own)
    g, h = (F.sum(F.col(c) * F.col("n")).alias(c[0]) for c in ("residual", "weight"))
    sums = {int(r.leaf): r.r / (r.w + ridge) for r in grown.transform(own).groupBy("leaf").agg(g, h).collect()}  # a row a leaf
    values = [rate * sums.get(k, 0.0) for k in range(grown.numNodes // 2 + 1)]
    after = held(_grown(rows, grown, values), "margins")
    hold.drop(rows)
    model.trees.append(grown)
    model.leaves.append(values)
    model.history.append(measure(after))
    return after


def _until_best(model: Boosted, rows: DataFrame, rounds: int | None, patience: int, **how) -> Boosted:
    """Rounds until the measure hasn't risen for `patience` of them; the model's best ones stay. rounds: at most so many; None leaves it to the measure, or makes `patience` rounds where nothing is held out."""
    best = 0
    while rounds is None or len(model.history) < rounds:
        rows = _round(model, rows, **how)
        now = model.history[-1]
        if now != now or best == 0 or not now <= model.history[best - 1]:  # nan: no held-out rows to stop on
            best = len(model.history)
            if now != now and rounds is None and best >= patience:
                break
        elif len(model.history) - best >= patience:
            break
    model.trees, model.leaves = model.trees[:best], model.leaves[:best]
    return model


def boosted(
    features: DataFrame, target: str, names: list[str], rounds: int | None = None, patience: int = 10, depth: int = 4, rate: float = 0.3, held_share: float = 0.2, ridge: float = 1.0, least: int = 1, seed: int = 42
) -> Boosted:
    """Logistic boosting on (session, candidates, target, names): a part of the sessions is held out, and after each round the AUC on it decides.

    Training stops when it hasn't risen for `patience` rounds (or after `rounds`, if given), and the rounds up to the best are kept. Each round fits a tree to the residuals and sets its leaves to
    a Newton step, sum of residuals over sum of p (1 - p); margins are a table, written once a round.
    """
    with scratch():
        rows = _laid_out(features, target, names, held_share, seed)
        model, n = _start(rows, names)
        rows = held(rows.withColumn("margin", F.lit(model.base)), "margins")
        return _until_best(model, rows, rounds if n else 0, patience, slope=_logistic, measure=_held_auc, total=n, depth=depth, rate=rate, ridge=ridge, least=least, seed=seed)


def ranked(
    features: DataFrame, target: str, names: list[str], k: int = 20, rounds: int | None = None, patience: int = 10, depth: int = 4, rate: float = 0.3, held_share: float = 0.2, ridge: float = 1.0, least: int = 1, seed: int = 42
) -> Boosted:
    """Boosting for the recall among each session's best k, which is also what decides when to stop; `history` has it for the held-out sessions.

    As boosted(), but a round fits the gradients of swapped pairs (see _swaps), so what all candidates of a session have in common teaches nothing. A session's candidates,
    of which there are as many as were suggested, meet in one task; where a session has no more than k, none can be swapped and it is left alone.

    Rows of equal features have one margin, so trees are grown on these kinds, by their rows' mean gradients, and margins are a table of kinds. Sessions without a hit have neither
    gradients nor a part in the recall, nor have training sessions that are left alone: their rows count in the kinds only and are in no round's windows.
    """
    with scratch():
        rows, short = _split(features, target, names, held_share, seed, "session", "candidates")
        kinds = rows.groupBy(*short).agg(F.count_if(~F.col("held_out")).alias("n")).withColumn("kind", F.monotonically_increasing_id())
        kinds = held(_assembled(kinds, short), "kinds")
        session = Window.partitionBy("session")
        some = rows.withColumns({"hits": F.sum("label").over(session), "all": F.count("*").over(session)}).where((F.col("hits") > 0) & (F.col("held_out") | (F.col("all") > k)))
        alike = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in short]
        some = some.alias("x").join(kinds.alias("y"), reduce(lambda a, b: a & b, alike)).select("session", "candidates", "label", "held_out", "kind")
        some = held(some, "swapped")
        model = Boosted(list(names), 0.0)
        n = kinds.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        rows = held(kinds.drop(*short).withColumn("margin", F.lit(model.base)), "margins")

        def now(rows: DataFrame, which: str) -> DataFrame:
            return some.where(which).join(rows.select("kind", "margin"), "kind")

        def slope(rows: DataFrame) -> DataFrame:
            each = _swaps(now(rows, "NOT held_out").withColumn("features", F.col("kind")), k)
            sums = each.groupBy(F.col("features").alias("kind")).agg(F.sum("residual").alias("r"), F.sum("weight").alias("w"))
            mean = lambda c: (F.coalesce(c, F.lit(0.0)) / F.col("n"))
            return held(rows.where("n > 0").join(sums, "kind", "left").select("features", mean("r").alias("residual"), mean("w").alias("weight"), "n"), "slopes")

        how = {"total": n, "depth": depth, "rate": rate, "ridge": ridge, "least": least, "seed": seed}
        return _until_best(model, rows, rounds if n else 0, patience, slope=slope, measure=lambda rows: _recall(now(rows, "held_out"), k), **how)


USUAL = {"depth": 4, "rate": 0.3, "ridge": 1.0, "least": 1}
#: What a search draws its settings from.
SPACE: dict[str, tuple] = {"depth": (2, 3, 4, 5, 6), "rate": (0.05, 0.1, 0.2, 0.3, 0.5, 1.0), "ridge": (0.1, 1.0, 10.0), "least": (1, 5, 20)}


def settings(space: dict[str, tuple], trials: int, seed: int) -> list[dict]:
    """So many different settings of a space (all, if it has fewer), the same for a seed."""
    total, rng = prod(len(v) for v in space.values()), random.Random(seed)
    out = []
    for at in rng.sample(range(total), min(trials, total)):
        one = {}
        for name, values in space.items():
            at, i = divmod(at, len(values))
            one[name] = values[i]
        out.append(one)
    return out


def halving(
    features: DataFrame, target: str, names: list[str], trials: int = 20, first: int = 4, share: int = 2, most: int = 64, space: dict[str, tuple] = SPACE, held_share: float = 0.2, seed: int = 42
) -> tuple[Boosted, DataFrame]:
    """(the best trial's model, (trial, rung, rounds, auc, depth, rate, ridge, least)): a search by successive halving.

    All trials get `first` rounds; of each rung the best 1 / share go on, to `share` times as many rounds, until one is left or `most` rounds are done. All are trained and judged
    on the same sessions, by their best held-out AUC so far (ties by trial). The laid out features are one table; a trial that goes on gets its margins from its trees again, so
    there is one table of margins at a time, however many trials there are.
    """
    drawn = settings(space, trials, seed)
    with scratch():
        base = held(_laid_out(features, target, names, held_share, seed), "laid-out")
        start, n = _start(base, names)
        models = [Boosted(list(names), start.base) for _ in drawn]
        alive, rounds, table = list(range(len(drawn))), min(first, most) if n else 0, []
        for rung in range(1, 65):
            for t in alive:
                rows = base.withColumn("margin", F.lit(start.base))
                for tree, values in zip(models[t].trees, models[t].leaves, strict=True):
                    rows = _grown(rows, tree, values)
                rows = held(rows, "margins")
                while len(models[t].trees) < rounds:
                    rows = _round(models[t], rows, _logistic, _held_auc, n, seed=seed, **{**USUAL, **drawn[t]})
                hold.drop(rows)
            value = {t: max((v for v in models[t].history if v == v), default=0.0) for t in alive}
            alive.sort(key=lambda t: (-value[t], t))
            table += [(t, rung, rounds, value[t], drawn[t]) for t in alive]
            if len(alive) <= 1 or rounds >= most or not rounds:
                break
            alive, rounds = alive[: -(-len(alive) // share)], min(most, rounds * share)
        won = models[alive[0]]
        best = won.history.index(max(won.history)) + 1 if won.history and won.history[0] == won.history[0] else len(won.trees)
        won.trees, won.leaves = won.trees[:best], won.leaves[:best]
    kinds = "trial int, rung int, rounds int, auc double, depth int, rate double, ridge double, least int"
    return won, features.sparkSession.createDataFrame([(*r[:4], *[type(v)({**USUAL, **r[4]}[c]) for c, v in USUAL.items()]) for r in table], kinds)
