"""Missing data: masks, filling, summaries."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from gridframe.functions.columns import count_where, ratio, share
from gridframe.model import Grid

FIXED_SHARE = 0.8
NARROW = 64
ROW_BAND = 32
"""Rows handled together in the second pass of the nearest fill; bounds a task's group to 32 rows."""


def missing_masks(grid: Grid, threshold: float = FIXED_SHARE) -> DataFrame:
    """(grid_id, y, x, missing_share, fixed_missing, valid_region) over all steps and variables."""
    per_cell = grid.cells.groupBy("grid_id", "y", "x").agg(share(F.col("v").isNull()).alias("missing_share"))
    fixed = F.col("missing_share") >= threshold
    return per_cell.withColumns({"fixed_missing": fixed, "valid_region": ~fixed})


def _last_seen(value: Column, keys: list[str], order: Column) -> Column:
    """Latest present value up to each row. Looking ahead is the same in reverse order: a growing frame costs one step
    per row, a shrinking one would start over for every row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def fill_nearest(
    df: DataFrame, keys: tuple[str, ...] = ("grid_id", "t", "var"), all_missing: float | None = None, width: int | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Each missing cell takes the value of the nearest present cell of its slice, by index distance.

    Ties go to the smaller row, then the smaller column. The distance transform is separable: windows along
    columns find the nearest present cell above and below; then each row picks among its columns
    (Felzenszwalb and Huttenlocher 2012). Rows known to be at most ``NARROW`` wide (patches, small images) are
    compared whole inside Spark; wider rows build the lower envelope of their sources in time linear in the
    row, in bands of 32 rows. No task sees a whole map. Slices without any value stay missing, or become
    ``all_missing``. Keeps ``v_original`` and sets ``filled``; narrow rows also keep the columns named in ``keep``.
    """
    keys = list(keys)
    here = F.when(F.col("v").isNotNull(), F.struct("y", "v"))
    near = df.withColumn("_a", _last_seen(here, [*keys, "x"], F.col("y"))).withColumn("_b", _last_seen(here, [*keys, "x"], F.col("y").desc()))
    above, below = F.col("y") - F.col("_a.y"), F.col("_b.y") - F.col("y")
    take_above = F.col("_b").isNull() | (above <= below)
    source = F.when(take_above, F.col("_a")).otherwise(F.col("_b"))
    sourced = near.withColumn("_s", source).select(*keys, "y", "x", "v", *keep, F.col("_s.y").alias("_sy"), F.col("_s.v").alias("_sv"))
    filled = _narrow_rows(sourced, keys, keep) if width is not None and width <= NARROW else _wide_rows(sourced, keys)
    v = F.coalesce(F.col("v"), F.col("nearest"))
    if all_missing is not None:
        v = F.coalesce(v, F.lit(all_missing))
    return filled.select(
        *keys, "y", "x", v.alias("v"), F.col("v").alias("v_original"),
        (F.col("v").isNull() & v.isNotNull()).alias("filled"), *keep,
    )


def _narrow_rows(sourced: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    rows = sourced.groupBy(*keys, "y").agg(F.collect_list(F.struct("x", "v", "_sy", "_sv", *keep)).alias("_row"))
    sources = F.filter("_row", lambda s: s["_sv"].isNotNull())

    def nearest(cell: Column) -> Column:
        def offer(s: Column) -> Column:
            across, along = s["x"] - cell["x"], s["_sy"] - F.col("y")
            return F.struct((across * across + along * along).alias("d"), s["_sy"].alias("sy"), s["x"].alias("sx"), s["_sv"].alias("sv"))

        return F.array_min(F.transform("_sources", offer))["sv"]

    picked = F.transform(
        "_row", lambda c: F.struct(c["x"].alias("x"), c["v"].alias("v"), F.when(c["v"].isNull(), nearest(c)).alias("nearest"), *[c[k].alias(k) for k in keep])
    )
    return rows.withColumn("_sources", sources).select(*keys, "y", F.inline(picked))


def _wide_rows(sourced: DataFrame, keys: list[str]) -> DataFrame:
    columns = [*keys, "y", "x", "v"]
    types = dict(sourced.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in columns) + ", nearest double"
    staged = sourced.withColumns({"_sy": F.col("_sy").cast("double"), "_band": F.floor(F.col("y") / ROW_BAND)})
    return staged.groupBy(*keys, "_band").applyInPandas(_across(columns), schema)


def _across(columns: list[str]):
    def fill(band: pd.DataFrame) -> pd.DataFrame:
        band = band.sort_values(["y", "x"], kind="stable")
        rows = band["y"].nunique()
        shape = (rows, len(band) // rows)
        y = band["y"].to_numpy(float).reshape(shape)
        sy = band["_sy"].to_numpy(float).reshape(shape)
        value = band["_sv"].to_numpy(float).reshape(shape).copy()
        own = (sy - y) ** 2
        for r in np.flatnonzero(np.isfinite(own).any(axis=1) & (own != 0).any(axis=1)):
            gaps, nearest = _row_sources(own[r], sy[r])
            value[r, gaps] = value[r, nearest]
        out = band[columns].copy()
        out["nearest"] = value.reshape(-1)
        return out

    return fill


def _row_sources(own: np.ndarray, sy: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Columns of a row's gaps, and for each the column whose source is nearest; ties by row, then column.

    ``own`` is the squared distance to the nearest source within the column. Over x, every source is a parabola, and the lower envelope
    of all of them is built once from left to right, so time is linear in the row. Between a gap and a present cell beside
    it nothing farther can win, so present cells inside present stretches are left out.
    """
    gap = own != 0
    beside = gap.copy()
    beside[1:] |= gap[:-1]
    beside[:-1] |= gap[1:]
    at = np.flatnonzero(beside & np.isfinite(own))
    xs, heights, ys = at.tolist(), own[at].astype(np.int64).tolist(), sy[at].astype(np.int64).tolist()
    hull: list[int] = []
    since: list[float] = []  # where a parabola takes over from the one before; equal bounds stay, as ties need all of them
    for i, x in enumerate(xs):
        bound = -np.inf
        while hull:
            p = hull[-1]
            bound = (heights[i] + x * x - heights[p] - xs[p] * xs[p]) / (2 * (x - xs[p]))
            if len(hull) == 1 or bound >= since[-1]:
                break
            hull.pop()
            since.pop()
        hull.append(i)
        since.append(bound)
    since.append(np.inf)
    gaps, nearest, k = np.flatnonzero(gap), [], 0
    for x in gaps.tolist():
        while since[k + 1] < x:
            k += 1
        best, j = None, k
        while best is None or since[j] <= x:
            i = hull[j]
            offer = (heights[i] + (x - xs[i]) ** 2, ys[i], xs[i])
            best = offer if best is None or offer < best else best
            j += 1
        nearest.append(best[2])
    return gaps, nearest


def fill_mean(
    map_df: DataFrame, replace_outside: bool = False, region: str | None = None, small: Callable[[DataFrame], DataFrame] = lambda df: df
) -> DataFrame:
    """Missing cells take the mean of the map.

    With ``replace_outside`` the mean is taken inside the boolean column ``region`` and cells outside it are
    replaced too.
    """
    inside = F.col(region) if region is not None else F.lit(True)
    usable = F.when(inside, F.col("v")) if replace_outside else F.col("v")
    means = map_df.groupBy("grid_id", "var").agg(F.avg(usable).alias("_mean"))
    return map_df.join(small(means), ["grid_id", "var"]).withColumn("v", F.coalesce(usable, F.col("_mean"), F.lit(0.0))).drop("_mean")


def fill_linear(
    df: DataFrame, keys: tuple[str, ...] = ("grid_id", "t", "var"), fallback: str | None = "nearest", width: int | None = None
) -> DataFrame:
    """Gaps between two present cells of a row are interpolated linearly, then those of a column.

    What remains (edges, empty rows) is left missing or filled from the nearest cell.
    """
    keys = list(keys)

    def along(frame: DataFrame, axis: str, across: str) -> DataFrame:
        here = F.when(F.col("v").isNotNull(), F.struct(F.col(axis).alias("p"), F.col("v").alias("v")))
        frame = frame.withColumn("_l", _last_seen(here, [*keys, across], F.col(axis)))
        frame = frame.withColumn("_r", _last_seen(here, [*keys, across], F.col(axis).desc()))
        part = F.try_divide((F.col(axis) - F.col("_l.p")).cast("double"), (F.col("_r.p") - F.col("_l.p")).cast("double"))
        between = F.col("_l.v") + part * (F.col("_r.v") - F.col("_l.v"))
        return frame.withColumn("v", F.coalesce(F.col("v"), between)).drop("_l", "_r")

    staged = df.select(*keys, "y", "x", "v", F.col("v").alias("_before"))
    done = along(along(staged, "x", "y"), "y", "x")
    if fallback == "nearest":
        rest = fill_nearest(done.select(*keys, "y", "x", "v"), tuple(keys), width=width).select(*keys, "y", "x", "v")
        before = staged.select(*keys, "y", "x", "_before")
        done = rest.join(before, [*keys, "y", "x"])
    return done.select(
        *keys, "y", "x", "v", F.col("_before").alias("v_original"),
        (F.col("_before").isNull() & F.col("v").isNotNull()).alias("filled"),
    )


def fill(grid: Grid, method: str | None = "nearest") -> Grid:
    """The grid with gaps filled; cells keep ``v_original`` and ``filled``."""
    if method is None:
        cells = grid.cells.withColumns({"v_original": F.col("v"), "filled": F.lit(False)})
    elif method == "nearest":
        cells = fill_nearest(grid.cells, width=grid.shape[2])
    elif method == "linear":
        cells = fill_linear(grid.cells, fallback=None)
    elif method == "linear_then_nearest":
        cells = fill_linear(grid.cells, width=grid.shape[2])
    else:
        raise ValueError("fill method is one of nearest, linear, linear_then_nearest, None")
    return grid.with_cells(cells)


def fill_summary(filled: Grid, masks: DataFrame) -> DataFrame:
    """Counts of originally missing, filled and permanently missing cells per grid."""
    counts = filled.cells.groupBy("grid_id").agg(
        count_where(F.col("v_original").isNull()).alias("missing_count"),
        count_where(F.col("filled")).alias("filled_count"),
    )
    fixed = masks.groupBy("grid_id").agg(count_where(F.col("fixed_missing")).alias("fixed_count"))
    return counts.join(fixed, "grid_id")


def missing_summary(filled: Grid, masks: DataFrame) -> DataFrame:
    """Overall missing share, share of permanently missing cells, filled count."""
    cells = filled.cells.groupBy("grid_id").agg(
        share(F.col("v_original").isNull()).alias("missing_ratio"), count_where(F.col("filled")).alias("filled_count")
    )
    fixed = masks.groupBy("grid_id").agg(share(F.col("fixed_missing")).alias("fixed_ratio"))
    return cells.join(fixed, "grid_id")


def missing_strategy(grid: Grid, value: str = "v", threshold: float = FIXED_SHARE) -> DataFrame:
    """Suggested treatment per variable: fixed_nearest, linear or none."""
    per_cell = grid.cells.groupBy("grid_id", "var", "y", "x").agg(
        count_where(F.col(value).isNull()).alias("gone"), F.count(F.lit(1)).alias("n")
    )
    fixed = ratio(F.col("gone"), F.col("n")) >= threshold
    per_var = per_cell.groupBy("grid_id", "var").agg(
        ratio(F.sum("gone"), F.sum("n")).alias("missing_ratio"), share(fixed).alias("fixed_ratio")
    )
    code: Column = (
        F.when(F.col("fixed_ratio") > 0.05, "fixed_nearest").when(F.col("missing_ratio") > 0, "linear").otherwise("none")
    )
    return per_var.withColumn("strategy", code)


def fill_recommendations(masks: DataFrame) -> DataFrame:
    """Recommendation codes per grid; one more when over a fifth of the cells are permanently missing."""
    base = F.array(F.lit("nearest_for_fixed_gaps"), F.lit("linear_for_sparse_gaps"), F.lit("keep_fixed_mask"))
    fixed = masks.groupBy("grid_id").agg(share(F.col("fixed_missing")).alias("fixed_ratio"))
    extra = F.array(F.lit("report_with_and_without_mask"))
    return fixed.withColumn("codes", F.when(F.col("fixed_ratio") > 0.2, F.concat(base, extra)).otherwise(base))
