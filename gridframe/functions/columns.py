"""Scalar and aggregate column expressions shared by the operators.

All of them are built-in Spark expressions, so they stay inside whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str, digits: int | None = None) -> Column:
    """The value, or NULL where it is NaN or infinite; optionally rounded half to even."""
    c = as_col(c).cast("double")
    kept = F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
    return kept if digits is None else F.bround(kept, digits)


def strip(c: Column) -> Column:
    """Text without white space, line breaks included, at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clamp01(c: Column) -> Column:
    return F.least(F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def ratio(part: Column, total: Column) -> Column:
    """part / total, 0 where the total is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), total.cast("double")), F.lit(0.0))


def share(condition: Column) -> Column:
    """Aggregate: share of rows where the condition holds; NULL conditions count as not held."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def count_where(condition: Column) -> Column:
    """Aggregate: number of rows where the condition holds."""
    return F.sum(F.when(condition, 1).otherwise(0)).cast("bigint")


def pearson(x: Column, y: Column, min_pairs: int = 2) -> Column:
    """Aggregate: correlation over rows where both are present; NULL if too few pairs or no spread."""
    px, py = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    r = F.try_divide(F.covar_pop(px, py), F.stddev_pop(px) * F.stddev_pop(py))
    return F.when(F.count(px) >= min_pairs, r)


def r_squared(y: Column, x: Column) -> Column:
    """Aggregate: coefficient of determination, 0 where y has no spread."""
    py, px = F.when(x.isNotNull(), y), F.when(y.isNotNull(), x)
    return F.when(F.var_pop(py) == 0, F.lit(0.0)).otherwise(F.regr_r2(py, px))


def axis_direction(x_energy: Column, y_energy: Column) -> Column:
    """Dominant axis of squared gradients; an axis dominates when 1.25 times the other."""
    return (
        F.when(x_energy.isNull() | y_energy.isNull(), F.lit(None).cast("string"))
        .when(x_energy + y_energy == 0, "flat")
        .when(x_energy > y_energy * 1.25, "east-west")
        .when(y_energy > x_energy * 1.25, "north-south")
        .otherwise("mixed")
    )


def anisotropy(x_energy: Column, y_energy: Column) -> Column:
    spread = F.try_divide(F.abs(x_energy - y_energy), x_energy + y_energy)
    return F.when(x_energy.isNotNull() & y_energy.isNotNull(), F.coalesce(spread, F.lit(0.0)))


def compass(gx: Column, gy: Column) -> Column:
    """Eight-way direction of a mean gradient vector; sectors of 45 degrees centred on east."""
    sector = F.floor(F.pmod(F.degrees(F.atan2(gy, gx)) + F.lit(382.5), F.lit(360.0)) / 45).cast("int")
    names = F.array(*[F.lit(n) for n in ("E", "NE", "N", "NW", "W", "SW", "S", "SE")])
    return (
        F.when(gx.isNull() | gy.isNull(), F.lit(None).cast("string"))
        .when(F.hypot(gx, gy) < 1e-12, "flat")
        .otherwise(F.get(names, sector))
    )


def coverage_label(missing_ratio: Column) -> Column:
    return (
        F.when(missing_ratio.isNull(), "unknown coverage")
        .when(missing_ratio == 0, "complete grid")
        .when(missing_ratio < 0.05, "nearly complete grid")
        .when(missing_ratio < 0.3, "moderate missing regions")
        .otherwise("large fixed or invalid regions")
    )


def hsv(red: Column, green: Column, blue: Column) -> tuple[Column, Column, Column]:
    """Hue, saturation and value of channels scaled to 0..1. On ties blue wins over green over red."""
    top, low = F.greatest(red, green, blue), F.least(red, green, blue)
    spread = top - low
    turn = (
        F.when(spread <= 1e-12, 0.0)
        .when(top == blue, (red - green) / spread + 4)
        .when(top == green, (blue - red) / spread + 2)
        .otherwise(F.pmod((green - blue) / spread, F.lit(6.0)))
    )
    present = red.isNotNull() & green.isNotNull() & blue.isNotNull()
    saturation = F.when(top > 1e-12, spread / top).otherwise(0.0)
    return F.when(present, turn / 6), F.when(present, saturation), F.when(present, top)


def bin_index(v: Column, low: float | Column, high: float | Column, bins: int) -> Column:
    """Equal-width bin of a value, the last bin closed; NULL outside the range or where the range is empty.

    A first guess is corrected by one against the bin edges themselves.
    """
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    step = (high - low) / bins
    guess = F.least(F.floor(F.try_divide(v - low, high - low) * bins), F.lit(bins - 1)).cast("int")
    over = (guess < bins - 1) & (v >= low + (guess + 1) * step)
    under = v < low + guess * step
    moved = guess + F.when(over, 1).otherwise(0) - F.when(under, 1).otherwise(0)
    return F.when((v >= low) & (v <= high), moved.cast("int"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return ratio(dot(a, b), norm(a) * norm(b))


def unite(*lists: Column) -> Column:
    """Concatenation of lists in order, without repeats, NULLs or empty strings."""
    merged = F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in lists])
    return F.array_distinct(F.filter(merged, lambda s: s.isNotNull() & (s != "")))


def first_match(rules: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """Value of the first rule whose condition holds."""
    chain = None
    for condition, value in rules:
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    return chain.otherwise(F.lit(default) if not isinstance(default, Column) else default)


def compact_number(v: Column) -> Column:
    """Three significant digits as text, 'NA' for missing values."""
    return F.when(finite(v).isNotNull(), F.format_string("%.3g", finite(v))).otherwise("NA")
