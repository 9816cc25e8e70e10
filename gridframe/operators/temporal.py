"""Change over time: trends, change points, periodicity, anomalies, similar slices, drivers.

A series (one value per step) is bounded by the length of the time axis; series work is grouped by series.
Work on stacks is one grouped pass per cell.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from gridframe.functions.columns import pearson, r_squared
from gridframe.model import CELL, MAP, Grid
from gridframe.operators.aggregates import series_mean, top_rows
from gridframe.operators.stencil import diffs, smooth_series
from gridframe.operators.tiles import sorted_groups
from gridframe.session import cut_lineage



# --- trends of series ------------------------------------------------------------------------------------

def linear_trend(series: DataFrame, keys: Sequence[str] = MAP) -> DataFrame:
    """Slope, intercept and r2 against the step index, with a sign label; one step only has slope 0."""
    x, y = F.col("t").cast("double"), F.col("v")
    px = F.when(y.isNotNull(), x)
    fit = series.groupBy(*keys).agg(
        F.count("v").alias("n"), F.regr_slope(y, px).alias("s"), F.regr_intercept(y, px).alias("i"), r_squared(y, px).alias("r")
    )
    enough = F.col("n") >= 2
    label = F.when(~enough, "single_time_step").when(F.col("s") > 0, "increase").when(F.col("s") < 0, "decrease").otherwise("stable")
    return fit.select(
        *keys, "n", F.when(enough, F.col("s")).otherwise(0.0).alias("slope"),
        F.when(enough, F.col("i")).alias("intercept"), F.when(enough, F.col("r")).alias("r2"), label.alias("trend"),
    )


def classify_trend(series: DataFrame, keys: Sequence[str] = MAP) -> DataFrame:
    """Trend with a tolerance and a summary of the series; present values are re-indexed 0..n-1."""
    numbered = diffs(series, keys)
    summary = numbered.groupBy(*keys).agg(
        F.count("v").alias("n"), F.avg("v").alias("series_mean"), (F.max("v") - F.min("v")).alias("series_range"),
        F.min_by("v", "i").alias("first_value"), F.max_by("v", "i").alias("last_value"),
        F.regr_slope("v", F.col("i").cast("double")).alias("fit"), F.stddev_pop("d").alias("wobble"),
    )
    everyone = series.select(*keys).distinct().join(summary, [*keys], "left").fillna(0, ["n"])
    n, change = F.col("n"), F.col("fit") * (F.col("n") - 1)
    tolerance = F.greatest(F.col("series_range") * 0.02, F.abs("series_mean") * 0.001, F.lit(1e-12))
    label = (
        F.when(n == 0, "no_data").when(n == 1, "single_time_step").when(change > tolerance, "increase")
        .when(change < -tolerance, "decrease").otherwise("stable")
    )
    one = n == 1
    return everyone.select(
        *keys, "n", label.alias("trend"), F.when(one, 0.0).otherwise(F.col("fit")).alias("slope"),
        F.when(one, 0.0).otherwise(F.col("wobble")).alias("volatility"), "series_mean", "series_range",
        F.when(n > 1, F.col("first_value")).alias("first_value"), F.when(n > 1, F.col("last_value")).alias("last_value"),
    )


def change_points(series: DataFrame, keys: Sequence[str] = MAP, n: int | None = 10) -> DataFrame:
    """First ``n`` steps (None: all) whose change is at least max(2 std, 90th percentile of changes)."""
    stepped = diffs(series, keys)
    bounds = stepped.groupBy(*keys).agg(
        F.count("v").alias("n"), F.stddev_pop("d").alias("spread"), F.percentile(F.abs("d"), F.lit(0.9)).alias("p90")
    ).where((F.col("n") >= 3) & (F.col("spread") > 0))
    jumps = stepped.join(bounds, [*keys]).where(F.abs("d") >= F.greatest(2 * F.col("spread"), F.col("p90")))
    first = jumps if n is None else top_rows(jumps, keys, [F.col("i")], n)
    return first.select(*keys, "t", "i", F.col("d").alias("delta"))


#: What a series shows: number of values, their spread, the power left without the trend, the best lag and its strength, the median step.
PERIODS = "grid_id string, var string, n long, spread double, power double, lag int, strength double, step_days double"


def _autocorrelation(e: np.ndarray) -> np.ndarray:
    """Sums of products of a series with itself at every lag, by fast Fourier transform; twelve decimals of the sum at lag 0."""
    size = 1 << (2 * len(e) - 1).bit_length()
    power = np.abs(np.fft.rfft(e, size)) ** 2
    sums = np.fft.irfft(power, size)[: len(e)]
    return np.round(sums / sums[0], 12)


def _best_lag(v: np.ndarray, max_lag: int | None) -> tuple[float, float, int | None, float | None]:
    """Spread, power without the trend, the strongest local peak of the autocorrelation from lag 2 on, the smaller lag on ties."""
    n, spread = len(v), float(v.std()) if len(v) else 0.0
    if n < 6 or not v.max() > v.min():
        return (0.0 if n and v.max() == v.min() else spread), 0.0, None, None
    i = np.arange(n) - (n - 1) / 2
    e = v - v.mean()
    e = e - i * (i @ e) / (i @ i)
    e -= e.mean()
    power = float(e @ e)
    if power <= n * (1e-14 * np.abs(v).max()) ** 2:  # only rounding is left
        return spread, 0.0, None, None
    r = _autocorrelation(e)[2 : (n // 2 if max_lag is None else min(n // 2, max_lag)) + 1]
    if not len(r):
        return spread, power, None, None
    peak = np.ones(len(r), bool)
    peak[1:] &= r[1:] >= r[:-1]
    peak[:-1] &= r[:-1] >= r[1:]
    at = int(np.argmax(np.where(peak, r, -np.inf)))
    return spread, power, at + 2, float(r[at])


def periodicity(grid: Grid, series: DataFrame, max_lag: int | None = None) -> DataFrame:
    """Strongest repeating lag of the detrended series and its name from the median time step.

    Series are brought together by one shuffle, each at most as long as the time axis; all lags of a series come from one Fourier transform.
    """
    line = grid.with_time(series).select("grid_id", "var", "t", "v", F.unix_micros("ts").alias("u"))
    line = line.repartition(*MAP).sortWithinPartitions(*MAP, "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in PERIODS.split(", ")]
        for table, starts in sorted_groups(batches, MAP):
            v, u = (table.column(c).to_numpy().astype(np.float64) for c in ("v", "u"))
            rows = []
            for start, stop in zip(starts, [*starts[1:], len(v)], strict=True):
                there = ~np.isnan(v[start:stop])
                times = u[start:stop][there]
                steps = np.diff(times[~np.isnan(times)])
                spread, power, lag, strength = _best_lag(v[start:stop][there], max_lag)
                days = float(np.median(steps)) / 86400e6 if len(steps) else None
                rows.append((table.column("grid_id")[int(start)].as_py(), table.column("var")[int(start)].as_py(), int(there.sum()), spread, power, lag, strength, days))
            kinds = (pa.string(), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    found = line.mapInArrow(run, PERIODS)
    n, enough = F.col("n"), (F.col("n") >= 6) & (F.col("spread") > 0)
    days = F.col("lag") * F.col("step_days")
    name = (
        F.when(days.between(0.8, 1.2), "daily").when(days.between(6, 8), "weekly").when(days.between(27, 32), "monthly")
        .when(days.between(80, 100), "seasonal").when(days.between(350, 380), "annual")
        .otherwise(F.format_string("lag_%d_steps", "lag"))
    )
    label = (
        F.when(n == 0, "unknown").when(n == 1, "single_time_step").when(~enough, "insufficient_data")
        .when(F.col("power") == 0, "none_detected").when(F.col("strength") < 0.3, "none_detected").otherwise(name)
    )
    return found.select(*MAP, "n", "lag", "strength", label.alias("periodicity"))


def temporal_features(grid: Grid, mask: DataFrame | None = None) -> DataFrame:
    """Per variable: trend summary, periodicity and number of change points. The series are computed once."""
    series = cut_lineage(series_mean(grid, mask))
    points = change_points(series, n=None).groupBy(*MAP).agg(F.count(F.lit(1)).alias("change_points"))
    rows = classify_trend(series).join(periodicity(grid, series).select(*MAP, "periodicity"), MAP, "left").join(points, MAP, "left")
    return rows.fillna(0, ["change_points"]).withColumn("is_primary", F.col("var") == grid.primary)


# --- maps of change -----------------------------------------------------------------------------------------

def trend_map(grid: Grid) -> DataFrame:
    """Per cell: sum of centred step times deviation from the cell's mean, over the full axis' sum of squares.

    Missing values count as no deviation; one grouped pass.
    """
    x, squares = _centred()
    there = F.col("v").isNotNull()
    total = F.sum(x * F.col("v")) - F.avg("v") * F.sum(F.when(there, x))
    maps = grid.with_dims(grid.cells).groupBy(*CELL, "n_t").agg(total.alias("total"))
    return maps.select(*CELL, F.coalesce(F.col("total") / squares, F.lit(0.0)).alias("v"))


def _centred() -> tuple[Column, Column]:
    """Step less the middle of its grid's own axis, and the sum of squares of these; 1 for a single step."""
    n = F.col("n_t").cast("double")
    return F.col("t") - (n - 1) / 2, F.when(n > 1, n * (n * n - 1) / 12).otherwise(1.0)


def cell_maps(grid: Grid, t: int | None = None) -> DataFrame:
    """All per-cell maps in one pass over the stack: mean, std, trend, the chosen slice, z and difference from
    the mean (z is 0 where the std is at most 1e-9)."""
    chosen = F.col("n_t") - 1 if t is None else F.lit(t)
    x, squares = _centred()
    there = F.col("v").isNotNull()
    aggs = [
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.max(F.when(F.col("t") == chosen, F.col("v"))).alias("v"),
        (F.sum(x * F.col("v")) - F.avg("v") * F.sum(F.when(there, x))).alias("trend"),
    ]
    if "in_region" in grid.cells.columns:
        aggs.append(F.max("in_region").alias("in_region"))
    maps = grid.with_dims(grid.cells).groupBy(*CELL, "n_t").agg(*aggs)
    maps = maps.withColumn("trend", F.coalesce(F.col("trend") / squares, F.lit(0.0))).drop("n_t")
    z = F.when(F.col("std") > 1e-9, (F.col("v") - F.col("mean")) / F.col("std")).otherwise(0.0)
    return maps.withColumns({"z": z, "diff": F.col("v") - F.col("mean")})


def anomaly_z(grid: Grid, t: int | None = None) -> DataFrame:
    return cell_maps(grid, t).select(*CELL, F.col("z").alias("v"))


def anomaly_diff(grid: Grid, t: int | None = None) -> DataFrame:
    return cell_maps(grid, t).select(*CELL, F.col("diff").alias("v"))


def difference_map(grid: Grid) -> DataFrame:
    """Last slice minus first slice."""
    last, first = F.col("t") == F.col("n_t") - 1, F.col("t") == 0
    change = F.max(F.when(last, F.col("v"))) - F.max(F.when(first, F.col("v")))
    return grid.with_dims(grid.cells).groupBy(*CELL).agg(change.alias("v"))


# --- anomalies, retrieval, drivers ------------------------------------------------------------------------------

def anomaly_days(series: DataFrame, n: int = 8, sigma: float = 2.0) -> DataFrame:
    """Steps furthest from the smoothed series."""
    residual = smooth_series(series, sigma=sigma).withColumn("residual", F.col("v") - F.col("smoothed"))
    order = [F.abs(F.round("residual", 9)).desc_nulls_last(), F.col("t").desc()]
    return top_rows(residual, MAP, order, n).select(*MAP, "t", F.col("v").alias("mean"), "residual", "rank")


def daily_trend(series: DataFrame) -> DataFrame:
    """Slope of the series (more than two steps, no gap), direction, first and last mean."""
    gapless = F.count("v") == F.count(F.lit(1))
    slope = F.when(gapless & (F.count(F.lit(1)) > 2), F.regr_slope("v", F.col("t").cast("double")))
    fit = series.groupBy(*MAP).agg(
        F.bround(slope, 6).alias("slope"), F.min_by("v", "t").alias("first_mean"), F.max_by("v", "t").alias("last_mean")
    )
    s = F.coalesce("slope", F.lit(0.0))
    label = F.when(s > 0, "increase").when(s < 0, "decrease").otherwise("stable")
    return fit.withColumns({"delta": F.col("last_mean") - F.col("first_mean"), "direction": label})


def similar_slices(grid: Grid, t: int | None = None, n: int = 8, min_cells: int = 200) -> DataFrame:
    """Slices most correlated with the chosen one over cells present in both, with the RMSE."""
    end = F.col("n_t") - 1
    chosen = end if t is None else F.least(F.lit(max(0, t)), end)
    present = grid.with_dims(grid.cells.where(F.col("v").isNotNull())).select(*CELL, "t", "v", chosen.alias("chosen"))
    target = present.where("t = chosen").select(*CELL, F.col("v").alias("target"))
    met = present.where("t != chosen").join(target, CELL)
    d = F.col("target") - F.col("v")
    scores = met.groupBy(*MAP, "t").agg(
        F.count(F.lit(1)).alias("cells"), F.bround(pearson(F.col("target"), F.col("v")), 4).alias("similarity"),
        F.bround(F.sqrt(F.avg(d * d)), 4).alias("rmse"),
    ).where((F.col("cells") >= min_cells) & F.col("similarity").isNotNull())
    key = F.coalesce(F.nullif("similarity", F.lit(0.0)), F.lit(-1.0))
    return top_rows(scores, MAP, [key.desc(), F.col("t")], n)


def driver_correlation(daily: DataFrame, target: str, n: int = 12, min_pairs: int = 3) -> DataFrame:
    """Variables whose daily means correlate most with the target's."""
    wanted = daily.where(F.col("var") == target).select("grid_id", "t", F.col("mean").alias("target"))
    met = daily.where(F.col("var") != target).join(wanted, ["grid_id", "t"])
    r = F.bround(pearson(F.col("target"), F.col("mean"), min_pairs), 4)
    scores = met.groupBy("grid_id", "var").agg(r.alias("correlation")).where(F.col("correlation").isNotNull())
    return top_rows(scores, ["grid_id"], [F.abs("correlation").desc(), F.col("var")], n)
