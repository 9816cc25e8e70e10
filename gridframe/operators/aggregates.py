"""Aggregates: statistics, correlation, maps over time, series over space, feature rows.

All are hash aggregates with map-side combining, keyed by grid, so a grid that holds most of the rows
still spreads over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridframe.functions.columns import count_where, ratio, share
from gridframe.model import CELL, MAP, Grid
from gridframe.operators.missing import fill_nearest, missing_strategy
from gridframe.operators.moments import pair_moments
from gridframe.operators.quantile import agg_with_quantiles, group_quantiles
from gridframe.operators.stencil import gradient


def _moments(v: Column) -> list[Column]:
    return [F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std")]


def with_units(grid: Grid, df: DataFrame) -> DataFrame:
    """Adds the unit and the position of the variable."""
    unit = F.coalesce(*[F.when(F.col("var") == v, F.lit(u)) for v, u in grid.units.items()], F.lit(None).cast("string"))
    return df.withColumns({"unit": unit, "pos": grid.position()})


# --- statistics -----------------------------------------------------------------------------------

def statistics(grid: Grid, value: str = "v", missing: str = "v") -> DataFrame:
    """Per variable: min, max, mean, std, median, p05, p95, missing share, number of present values."""
    stats = agg_with_quantiles(
        grid.cells, MAP,
        [*_moments(F.col(value)), share(F.col(missing).isNull()).alias("missing_ratio"), F.count(value).alias("n")],
        {value: {"p05": 0.05, "median": 0.5, "p95": 0.95}}, grid.stack_cells,
    )
    return with_units(grid, stats)


def overall_statistics(grid: Grid, value: str = "v") -> DataFrame:
    """Rows for each variable and, with ``var`` NULL, for all variables of a grid together."""
    rolled = grid.cells.rollup("grid_id", "var").agg(*_moments(F.col(value)), F.count(value).alias("n"))
    return rolled.where(F.col("grid_id").isNotNull())


def profile(filled: Grid) -> DataFrame:
    """Profile per variable of a filled grid (cells with v_original and filled)."""
    base = filled.cells.groupBy(*MAP).agg(
        count_where(F.col("v_original").isNull()).alias("missing_count"),
        share(F.col("v_original").isNull()).alias("missing_ratio"),
        count_where(F.col("filled")).alias("filled_count"),
        *_moments(F.col("v")),
    )
    strategy = missing_strategy(filled, "v_original").select(*MAP, "strategy")
    sized = filled.with_dims(base.join(strategy, MAP))
    return with_units(filled, sized)


def correlation(grid: Grid) -> DataFrame:
    """(grid_id, left, right, r) for all ordered pairs of variables over cells where both are present; NULL for under two cells or no spread."""
    pairs = _named(grid, pair_moments(grid)).withColumn("r", _pearson())
    both = F.array(F.struct("left", "right"), F.struct(F.col("right").alias("left"), F.col("left").alias("right")))
    ordered = pairs.select("grid_id", F.explode(F.array_distinct(both)).alias("e"), "r")
    return ordered.select("grid_id", "e.left", "e.right", "r")


def _named(grid: Grid, pairs: DataFrame) -> DataFrame:
    names = F.lit(list(grid.variables))
    return pairs.withColumns({side: F.get(names, F.col(f"{side}_pos")) for side in ("left", "right")})


def _pearson() -> Column:
    spread = F.sqrt("left2") * F.sqrt("right2")
    return F.when(F.col("n") >= 2, F.try_divide(F.col("both"), spread))


def pivot(grid: Grid, names: Sequence[str] | None = None) -> DataFrame:
    """One row per (grid_id, t, y, x) with a column per variable."""
    names = grid.variables if names is None else names
    picks = [F.max(F.when(F.col("var") == n, F.col("v"))).alias(n) for n in names]
    return grid.cells.where(F.col("var").isin(list(names))).groupBy("grid_id", "t", "y", "x").agg(*picks)


def pair_vars(grid: Grid, a: str, b: str) -> DataFrame:
    """(grid_id, t, y, x, a, b) where both variables are present."""
    wide = pivot(grid, [a, b])
    return wide.where(F.col(f"`{a}`").isNotNull() & F.col(f"`{b}`").isNotNull()).select(
        "grid_id", "t", "y", "x", F.col(f"`{a}`").alias("a"), F.col(f"`{b}`").alias("b")
    )


# --- maps over time, series over space ---------------------------------------------------------------

def mean_map(grid: Grid) -> DataFrame:
    return grid.cells.groupBy(*CELL).agg(F.avg("v").alias("v"))


def std_map(grid: Grid) -> DataFrame:
    return grid.cells.groupBy(*CELL).agg(F.stddev_pop("v").alias("v"))


def series_mean(grid: Grid, mask: DataFrame | None = None) -> DataFrame:
    """Mean of each slice, NULL for empty slices; inside the valid region if a mask is given."""
    cells = grid.cells
    if mask is not None:
        cells = cells.join(mask.select("grid_id", "y", "x", "valid_region"), ["grid_id", "y", "x"])
        cells = cells.withColumn("v", F.when(F.col("valid_region"), F.col("v")))
    return cells.groupBy(*MAP, "t").agg(F.avg("v").alias("v"))


def series_stats(grid: Grid) -> DataFrame:
    """Per slice: mean, 95th percentile, maximum."""
    return agg_with_quantiles(
        grid.cells, [*MAP, "t"], [F.avg("v").alias("mean"), F.max("v").alias("max")], {"v": {"p95": 0.95}}, grid.map_cells
    )


def hotspot_share(grid: Grid, q: float = 0.9) -> DataFrame:
    """Per slice: share of all cells of the grid at or above the quantile of the mean map."""
    thresholds = group_quantiles(mean_map(grid), MAP, "v", {"threshold": q}, grid.map_cells)
    marked = grid.cells.join(grid.per_map(thresholds), MAP)
    return marked.groupBy(*MAP, "t").agg(share(F.col("v") >= F.col("threshold")).alias("hotspot_share"))


def daily_matrix(grid: Grid) -> DataFrame:
    """(grid_id, t, var, mean, p95) for every slice and variable."""
    return series_stats(grid).select("grid_id", "t", "var", "mean", "p95")


def quality(grid: Grid) -> DataFrame:
    """Share of present values, region cells and all cells; cells carry ``in_region``."""
    per_cell = grid.cells.groupBy("grid_id", "y", "x").agg(
        F.count("v").alias("present"), F.count(F.lit(1)).alias("n"), F.max("in_region").alias("in_region")
    )
    return per_cell.groupBy("grid_id").agg(
        ratio(F.sum("present"), F.sum("n")).alias("finite_ratio"),
        count_where(F.col("in_region")).alias("region_cells"),
        F.count(F.lit(1)).alias("total_cells"),
    )


# --- grid description ----------------------------------------------------------------------------------

def space_resolution(grid: Grid) -> DataFrame:
    """Median non-zero step of each axis."""
    def step(axis: DataFrame, index: str, coordinate: str, name: str) -> DataFrame:
        line = Window.partitionBy("grid_id").orderBy(index)
        d = F.abs(F.col(coordinate) - F.lag(coordinate).over(line))
        stepped = axis.select("grid_id", d.alias("d"))
        return stepped.groupBy("grid_id").agg(F.percentile(F.when(F.col("d") > 0, F.col("d")), F.lit(0.5)).alias(name))

    return step(grid.lon_axis(), "x", "lon", "lon_step").join(step(grid.lat_axis(), "y", "lat", "lat_step"), "grid_id", "full")


def time_resolution(grid: Grid) -> DataFrame:
    """Median step in seconds and days with a label in days, hours or seconds."""
    axis = grid.time_axis()
    known = axis.where(F.col("ts").isNotNull())
    line = Window.partitionBy("grid_id").orderBy("t")
    d = (F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(line)) / 1e6
    steps = known.select("grid_id", d.alias("d")).groupBy("grid_id").agg(F.percentile("d", F.lit(0.5)).alias("seconds"))
    counts = axis.groupBy("grid_id").agg(F.count(F.lit(1)).alias("n"))
    s = F.col("seconds")

    def amount(unit: int, name: str) -> Column:
        k = (s / unit).cast("bigint")
        return F.concat(k.cast("string"), F.when(k == 1, f" {name}").otherwise(f" {name}s"))

    label = (
        F.when(F.col("n") <= 1, "single time")
        .when(s.isNull(), "unknown")
        .when(s % 86400 == 0, amount(86400, "day"))
        .when(s % 3600 == 0, amount(3600, "hour"))
        .otherwise(F.concat(F.format_string("%s", s.cast("bigint")), F.lit(" seconds")))
    )
    return counts.join(steps, "grid_id", "left").select(
        "grid_id", "seconds", (s / 86400.0).alias("days"), label.alias("label")
    )


def grid_spec(grid: Grid) -> DataFrame:
    """Axis sizes, bounds, time coverage, reference system."""
    lat = grid.lat_axis().groupBy("grid_id").agg(F.count(F.lit(1)).alias("n_lat"), F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"))
    lon = grid.lon_axis().groupBy("grid_id").agg(F.count(F.lit(1)).alias("n_lon"), F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"))
    time = grid.time_axis().groupBy("grid_id").agg(
        F.count(F.lit(1)).alias("n_time"), F.min_by("label", "t").alias("time_start"), F.max_by("label", "t").alias("time_end")
    )
    constants = {"n_variables": F.lit(len(grid.variables)), "crs": F.lit(grid.crs), "grid_type": F.lit(grid.grid_type)}
    return lat.join(lon, "grid_id").join(time, "grid_id").withColumns(constants)


def hottest(grid: Grid) -> DataFrame:
    """Cell with the largest mean per variable; the first in raster order on ties."""
    placed = mean_map(grid).where(F.col("v").isNotNull())
    order = F.struct("v", -F.col("y"), -F.col("x"))
    best = placed.groupBy(*MAP).agg(F.max_by(F.struct("y", "x", "v"), order).alias("b"))
    return grid.with_coords(best.select(*MAP, "b.y", "b.x", F.col("b.v").alias("value")))


def first_last(grid: Grid) -> DataFrame:
    """Mean of the first and last slice and the change between them."""
    return series_mean(grid).groupBy(*MAP).agg(
        F.min_by("v", "t").alias("first_mean"), F.max_by("v", "t").alias("last_mean"),
        (F.max_by("v", "t") - F.min_by("v", "t")).alias("delta"),
    )


# --- feature rows -----------------------------------------------------------------------------------------

def _scaled(centre: Column, low: Column, high: Column) -> Column:
    return F.coalesce(F.try_divide(centre - low, high - low), F.lit(0.0))


def block_features(grid: Grid, block: tuple[int, int] = (32, 32), missing: str = "v") -> DataFrame:
    """Per fixed-size block and variable: mean, std, min, max, missing share, gradient of the block's mean
    map, and the block's normalised centre and relative size."""
    bh, bw = block
    at = {"block_y": F.floor(F.col("y") / bh).cast("int"), "block_x": F.floor(F.col("x") / bw).cast("int")}
    keys = ["grid_id", "block_y", "block_x", "var"]
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    stats = grid.cells.withColumns(at).groupBy(*keys).agg(
        zero(F.avg("v")).alias("mean"), zero(F.stddev_pop("v")).alias("std"), zero(F.min("v")).alias("min"),
        zero(F.max("v")).alias("max"), share(F.col(missing).isNull()).alias("missing_ratio"),
    )
    maps = mean_map(grid).withColumns(at).select(*keys, "y", "x", "v")
    sloped = gradient(fill_nearest(maps, tuple(keys), all_missing=0.0, width=min(bw, grid.shape[2])), keys)
    slopes = sloped.groupBy(*keys).agg(
        zero(F.avg("g")).alias("gradient"), F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"),
        F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"),
    )
    rows = grid.with_dims(stats.join(slopes, keys))
    if grid.axis_y is None and grid.axis_x is None:
        placed = rows.withColumns({
            "cy": _scaled((F.col("y0") + F.col("y1") - 1) / 2, F.lit(0.0), F.col("n_y") - F.lit(1.0)),
            "cx": _scaled((F.col("x0") + F.col("x1") - 1) / 2, F.lit(0.0), F.col("n_x") - F.lit(1.0)),
        })
    else:
        lat = grid.lat_axis().withColumn("block_y", F.floor(F.col("y") / bh).cast("int"))
        lon = grid.lon_axis().withColumn("block_x", F.floor(F.col("x") / bw).cast("int"))
        for axis, part, coordinate, out in ((lat, "block_y", "lat", "cy"), (lon, "block_x", "lon", "cx")):
            span = axis.groupBy("grid_id").agg(F.min(coordinate).alias("lo"), F.max(coordinate).alias("hi"))
            mid = axis.groupBy("grid_id", part).agg(F.avg(coordinate).alias("mid")).join(span, "grid_id")
            rows = rows.join(mid.select("grid_id", part, _scaled(F.col("mid"), F.col("lo"), F.col("hi")).alias(out)), ["grid_id", part])
        placed = rows
    return placed.select(
        *keys, "y0", "y1", "x0", "x1", "mean", "std", "min", "max", "missing_ratio", "gradient", "cy", "cx",
        ((F.col("y1") - F.col("y0")) / F.col("n_y")).alias("height"), ((F.col("x1") - F.col("x0")) / F.col("n_x")).alias("width"),
    )


def time_features(grid: Grid, mask: DataFrame | None = None) -> DataFrame:
    """Per slice and variable: mean, std, min, max, mean gradient, inside the valid region."""
    cells = grid.cells.select("grid_id", "t", "var", "y", "x", "v")
    if mask is not None:
        cells = cells.join(mask.select("grid_id", "y", "x", "valid_region"), ["grid_id", "y", "x"])
        cells = cells.withColumn("v", F.when(F.col("valid_region"), F.col("v"))).drop("valid_region")
    keys = ["grid_id", "t", "var"]
    sloped = gradient(fill_nearest(cells, tuple(keys), all_missing=0.0, width=grid.shape[2]), keys)
    v = F.col("v_original")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return sloped.groupBy(*keys).agg(
        zero(F.avg(v)).alias("mean"), zero(F.stddev_pop(v)).alias("std"), zero(F.min(v)).alias("min"),
        zero(F.max(v)).alias("max"), zero(F.avg("g")).alias("gradient"),
    )


def relation_features(grid: Grid) -> DataFrame:
    """Per pair of variables: correlation, ratio of means, mean absolute difference, std of the difference, pairs.

    With a single variable: its mean and std with 1, 0, 0.
    """
    names = grid.variables
    if len(names) == 1:
        only = grid.cells.groupBy("grid_id").agg(F.avg("v").alias("f0"), F.stddev_pop("v").alias("f1"))
        return only.select(
            "grid_id", F.lit(names[0]).alias("left"), F.lit(names[0]).alias("right"), "f0", "f1",
            F.lit(1.0).alias("f2"), F.lit(0.0).alias("f3"), F.lit(0.0).alias("f4"),
        )
    pairs = _named(grid, pair_moments(grid, away=True).where("left_pos < right_pos"))
    enough = F.col("n") >= 2
    apart = F.greatest(F.col("left2") + F.col("right2") - 2 * F.col("both"), F.lit(0.0))
    return pairs.select(
        "grid_id", "left", "right", _pearson().alias("f0"), F.when(enough, F.try_divide("mean_left", "mean_right")).alias("f1"),
        F.when(enough, F.col("away") / F.col("n")).alias("f2"), F.when(enough, F.sqrt(apart / F.col("n"))).alias("f3"), F.col("n").alias("f4"),
    )


def across_variables(spatial: DataFrame, temporal: DataFrame) -> DataFrame:
    """Means of the spatial features and volatility over variables, and counts of trend labels as text."""
    features = ("hotspot_count", "gradient_strength", "anisotropy", "connected_domains", "boundary_change")
    means = spatial.groupBy("grid_id").agg(*[F.avg(c).alias(f"mean_{c}") for c in features])
    wobble = temporal.groupBy("grid_id").agg(F.avg("volatility").alias("mean_volatility"))
    counts = temporal.groupBy("grid_id", "trend").agg(F.count(F.lit(1)).alias("n"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("trend", "n"))), lambda s: F.concat_ws(":", s["trend"], s["n"].cast("string"))), ",")
    trends = counts.groupBy("grid_id").agg(listed.alias("trend_counts"))
    return means.join(wobble, "grid_id").join(trends, "grid_id")


def variable_cards(daily: DataFrame, selected: str) -> DataFrame:
    """Mean and slope of each variable's daily means; the slope needs more than two steps of the grid and no gap."""
    whole = (F.count("mean") == F.count(F.lit(1))) & (F.count(F.lit(1)) > 2)
    slope = F.when(whole, F.regr_slope("mean", F.col("t").cast("double")))
    cards = daily.groupBy(*MAP).agg(F.avg("mean").alias("mean"), slope.alias("trend"))
    return cards.withColumn("selected", F.col("var") == selected)


def label_distribution(blocks: DataFrame, labels: Sequence[str], column: str = "primary_label") -> DataFrame:
    """Count of each label per grid, zero for absent labels."""
    counted = blocks.groupBy("grid_id").agg(*[count_where(F.col(column) == v).alias(v) for v in labels])
    entries = [F.struct(F.lit(v).alias("label"), F.col(v).alias("n")) for v in labels]
    return counted.select("grid_id", F.explode(F.array(*entries)).alias("e")).select("grid_id", "e.label", "e.n")


def robust_scale(map_df: DataFrame, map_cells: int, keys: Sequence[str] = MAP, small: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Median, median absolute deviation, and max(1.4826 MAD, std, 1e-9)."""
    centre = agg_with_quantiles(map_df, keys, [F.stddev_pop("v").alias("std")], {"v": {"median": 0.5}}, map_cells)
    away = map_df.join(small(centre), [*keys]).withColumn("away", F.abs(F.col("v") - F.col("median")))
    mad = group_quantiles(away, keys, "away", {"mad": 0.5}, map_cells)
    scale = F.greatest(1.4826 * F.col("mad"), F.col("std"), F.lit(1e-9))
    return centre.join(mad, [*keys]).select(*keys, "median", "mad", scale.alias("outlier_scale"))


def log_summary(log: DataFrame, messages: int | None = None) -> DataFrame:
    """Per run: number of events, distinct tools in order of first use, messages in order (the first ``messages`` events' ones)."""
    firsts = log.where(F.col("tool") != "").groupBy("run_id", "tool").agg(F.min(F.struct("time", "seq")).alias("k"))
    tools = firsts.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("k", "tool")))["tool"].alias("tools"))
    early = log if messages is None else top_rows(log, ["run_id"], [F.col("time"), F.col("seq")], messages)
    said = early.where(F.col("message") != "").groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("time", "seq", "message")))["message"].alias("messages"))
    counts = log.groupBy("run_id").agg(F.count(F.lit(1)).alias("event_count"))
    return counts.join(tools, "run_id", "left").join(said, "run_id", "left")


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First n rows of each group; Spark keeps only n per group before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def strongest_partner(correlations: DataFrame, primary: str) -> DataFrame:
    """Variable most correlated, in absolute value, with the primary one."""
    others = correlations.where((F.col("left") == primary) & (F.col("right") != primary) & F.col("r").isNotNull())
    best = others.groupBy("grid_id").agg(F.max_by(F.struct("right", "r"), F.struct(F.abs("r"), F.col("right"))).alias("b"))
    return best.select("grid_id", F.lit(primary).alias("variable"), F.col("b.right").alias("partner"), F.col("b.r").alias("r"))
