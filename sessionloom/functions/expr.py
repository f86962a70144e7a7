"""Column expressions that several operators use, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights are summed as whole multiples of 1e-9, so sums don't depend on the order of rows.
UNIT = 1_000_000_000


def q(name: str) -> Column:
    """A column whose name may hold dots or other signs."""
    return F.col(f"`{name}`")


def fixed(w: Column) -> Column:
    """A weight as a whole multiple of 1e-9."""
    return F.round(w * F.lit(float(UNIT))).cast("long")


def half_life(seconds: Column, hours: float) -> Column:
    """0.5 to the power of |seconds| over the half-life."""
    return F.pow(F.lit(0.5), F.abs(seconds).cast("double") / F.lit(float(hours * 3600)))


def clip255(c: Column) -> Column:
    """Unsigned 8-bit saturation, kept as a whole number."""
    return F.least(F.greatest(c, F.lit(0)), F.lit(255)).cast("long")


def dot(a: Column, b: Column) -> Column:
    """Sum of products in array order, as double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column, floor: float = 1e-12) -> Column:
    """A vector over its length (plus a floor, so that zero stays zero)."""
    norm = F.sqrt(dot(v, v)) + F.lit(floor)
    return F.transform(v, lambda x: x.cast("double") / norm)


def by_type(kind: Column, weights: dict[int, float]) -> Column:
    """A number for each event type."""
    out = F.lit(None).cast("double")
    for k, w in weights.items():
        out = F.when(kind == k, F.lit(float(w))).otherwise(out)
    return out


def ratio(a: Column, b: Column) -> Column:
    """a / b, with 0 where that is undefined or missing."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def arithmetic_hash(c: Column, seed: int, buckets: Column | int) -> Column:
    """A spread of whole numbers over buckets that any SQL engine computes the same."""
    return F.pmod(F.pmod(c, F.lit(1_000_003)) * F.lit(7_919) + F.lit(seed), F.lit(1_000_003)) % buckets
