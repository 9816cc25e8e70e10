"""Features of grids whose variables are image channels. One row per grid; images are keyed by grid_id."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridframe.functions import rules
from gridframe.functions.columns import bin_index, first_match, hsv, ratio
from gridframe.model import MAP, Grid
from gridframe.operators.embed import colorfulness
from gridframe.operators.missing import fill_nearest
from gridframe.operators.quantile import agg_with_quantiles, group_quantiles
from gridframe.operators.stencil import gradient, texture
from gridframe.session import cut_lineage

IMAGE = ["grid_id"]


def is_image(grid: Grid) -> bool:
    return grid.grid_type == "image" or bool({v.lower() for v in grid.variables} & set(rules.IMAGE_CHANNELS))


def image_grids(variables: DataFrame) -> DataFrame:
    """(grid_id, is_image) from a table of (grid_id, var): any channel name makes an image."""
    hit = F.lower("var").isin(list(rules.IMAGE_CHANNELS))
    return variables.groupBy("grid_id").agg(F.max(hit).alias("is_image"))


def has_color(grid: Grid) -> bool:
    return {"red", "green", "blue"} <= {v.lower() for v in grid.variables}


def pixels(grid: Grid) -> DataFrame:
    """(grid_id, y, x, intensity[, red, green, blue]): channel means over time and the intensity map."""
    names = {v.lower(): v for v in reversed(grid.variables)}
    channel = lambda n: F.avg(F.when(F.col("var") == names[n], F.col("v")))
    keys = ["grid_id", "y", "x"]
    color = {n: channel(n) for n in ("red", "green", "blue")} if has_color(grid) else {}
    if "intensity" in names:
        light = {"intensity": channel("intensity")}
    elif color:
        light = {}
    else:
        per_step = grid.cells.groupBy(*keys, "t").agg(F.avg("v").alias("v"))
        return per_step.groupBy(*keys).agg(F.avg("v").alias("intensity"))
    wide = grid.cells.groupBy(*keys).agg(*[c.alias(n) for n, c in {**light, **color}.items()])
    if not light:
        luma = sum((w * F.col(n) for w, n in zip(rules.LUMA, ("red", "green", "blue"))), F.lit(0.0))
        wide = wide.withColumn("intensity", luma)
    return wide


def intensity(grid: Grid) -> DataFrame:
    return pixels(grid).select("grid_id", "y", "x", F.col("intensity").alias("v"))


def edge_stats(grid: Grid, sloped: DataFrame) -> DataFrame:
    """Share of present pixels at or above the 90th gradient percentile, that threshold, mean and p95 strength."""
    present = sloped.where(F.col("v").isNotNull())
    stats = agg_with_quantiles(
        present, IMAGE, [F.avg("g").alias("mean_edge_strength"), F.count(F.lit(1)).alias("n")],
        {"g": {"edge_threshold_p90": 0.9, "p95_edge_strength": 0.95}}, grid.map_cells,
    )
    strong = present.join(grid.per_map(stats.select("grid_id", "edge_threshold_p90")), "grid_id").where(F.col("g") >= F.col("edge_threshold_p90"))
    counts = strong.groupBy("grid_id").agg(F.count(F.lit(1)).alias("k"))
    return stats.join(counts, "grid_id", "left").withColumn("edge_density", ratio(F.coalesce("k", F.lit(0)), F.col("n"))).drop("k", "n")


def texture_label(mean: Column) -> Column:
    return first_match([(mean.isNull(), "unknown texture"), (mean < 5, rules.TEXTURE_NAMES[0]), (mean < 20, rules.TEXTURE_NAMES[1])], rules.TEXTURE_NAMES[2])


def texture_stats(grid: Grid, sloped: DataFrame) -> DataFrame:
    """Mean and p95 of the local standard deviation (5 x 5) and local entropy (7 x 7) on present pixels, with a label.

    ``sloped`` carries the gap-free intensity in ``filled`` and the original in v.
    """
    sized = grid.with_dims(sloped.select("grid_id", "y", "x", "v", "filled"))
    textured = texture(sized, "filled", IMAGE, small=grid.per_map, shape=grid.shape[1:])
    present = textured.where(F.col("v").isNotNull()).select("grid_id", "local_std", "entropy")
    stats = agg_with_quantiles(
        present, IMAGE, [F.avg("local_std").alias("local_std_mean"), F.avg("entropy").alias("local_entropy_mean")],
        {"local_std": {"local_std_p95": 0.95}, "entropy": {"local_entropy_p95": 0.95}}, grid.map_cells,
    )
    return stats.withColumn("texture_label", texture_label(F.col("local_std_mean")))


def histogram(df: DataFrame, value: str, bins: int, low: float, high: float, keys: Sequence[str] = IMAGE, out: str = "counts") -> DataFrame:
    """Counts per equal-width bin as an array with zeros, the last bin closed; values outside are not counted."""
    placed = df.select(*keys, bin_index(F.col(value), low, high, bins).alias("bin"))
    tallies = [F.sum(F.when(F.col("bin") == i, 1).otherwise(0)).cast("bigint") for i in range(bins)]
    return placed.groupBy(*keys).agg(F.array(*tallies).alias(out))


def image_summary(grid: Grid, maps: DataFrame) -> DataFrame:
    """Size, aspect ratio, intensity statistics."""
    v = F.col("intensity")
    stats = maps.groupBy("grid_id").agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), (F.max(v) - F.min(v)).alias("dynamic_range")
    )
    sized = grid.with_dims(stats)
    return sized.select(
        "grid_id", F.col("n_x").alias("width"), F.col("n_y").alias("height"), (F.col("n_x") / F.col("n_y")).alias("aspect_ratio"),
        F.lit(len(grid.variables)).alias("channel_count"), "mean", "std", "min", "max", "dynamic_range",
    )


def channel_summary(grid: Grid) -> DataFrame:
    return grid.cells.groupBy(*MAP).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))


def to_hsv(maps: DataFrame) -> DataFrame:
    h, s, v = hsv(F.col("red") / 255.0, F.col("green") / 255.0, F.col("blue") / 255.0)
    return maps.withColumns({"hue": h, "saturation": s, "value": v})


def dominant_color(counts: Column) -> Column:
    """Name of the fullest hue bin, the first on ties."""
    names = F.array(*[F.lit(n) for n in rules.HUE_NAMES])
    top = F.array_max(counts)
    return F.when(F.coalesce(top, F.lit(0)) == 0, "unknown").otherwise(F.get(names, (F.array_position(counts, top) - 1).cast("int")))


def hsv_stats(grid: Grid, maps: DataFrame, bins: int = 12) -> DataFrame:
    """Circular mean hue, saturation and value statistics, hue histogram, colourfulness, dominant colour."""
    turned = to_hsv(maps)
    angle = F.col("hue") * 2 * math.pi
    stats = agg_with_quantiles(
        turned, IMAGE,
        [
            F.avg(F.sin(angle)).alias("_s"), F.avg(F.cos(angle)).alias("_c"), F.avg("saturation").alias("mean_saturation"), F.avg("value").alias("mean_value"),
            F.coalesce(colorfulness(F.col("red"), F.col("green"), F.col("blue")), F.lit(0.0)).alias("colorfulness"),
        ],
        {"saturation": {"p95_saturation": 0.95}}, grid.map_cells,
    )
    hue = F.pmod(F.atan2("_s", "_c"), F.lit(2 * math.pi)) / (2 * math.pi)
    counts = histogram(turned, "hue", bins, 0.0, 1.0, out="hue_counts")
    return stats.join(counts, "grid_id").withColumns({"mean_hue": hue, "dominant_color": dominant_color(F.col("hue_counts"))}).drop("_s", "_c")


def scale_map(grid: Grid, map_df: DataFrame, mode: str, keys: Sequence[str] = MAP) -> DataFrame:
    """A map scaled for display.

    "channel": 0..255 whole numbers, as is where values already fit; "minmax": 0..1; "clip": 0..1 between the 5th and 95th
    percentile; "spread": the same between the 2nd and 98th; "symmetric": 0..1 around zero.
    """
    v = F.col("v")
    probs = {"clip": {"a": 0.05, "b": 0.95}, "spread": {"a": 0.02, "b": 0.98}}.get(mode)
    if probs is not None:
        limits = group_quantiles(map_df, keys, "v", probs, grid.map_cells)
    else:
        low, high = (-F.max(F.abs(v)), F.max(F.abs(v))) if mode == "symmetric" else (F.min(v), F.max(v))
        limits = map_df.groupBy(*keys).agg(low.alias("a"), high.alias("b"))
    if mode == "spread":
        limits = limits.withColumn("b", F.when(F.col("a") == F.col("b"), F.col("a") + 1.0).otherwise(F.col("b")))
    a, b = F.col("a"), F.col("b")
    part = F.try_divide(v - a, b - a)
    inside = F.least(F.greatest(part, F.lit(0.0)), F.lit(1.0))
    present = v.isNotNull()
    if mode == "channel":
        fits = (a >= 0) & (b <= 255)
        level = F.when(fits, v).when(a == b, F.lit(127.0)).otherwise(part * 255.0)
        scaled = F.when(present, F.bround(F.least(F.greatest(level, F.lit(0.0)), F.lit(255.0)), 0)).otherwise(0.0)
    elif mode == "minmax":
        scaled = F.when(present, F.coalesce(part, F.lit(0.0))).otherwise(0.0)
    elif mode == "clip":
        scaled = F.when(a.isNull() | (b - a < 1e-12), 0.0).when(present, inside)
    elif mode in ("spread", "symmetric"):
        scaled = F.when(present, inside)
    else:
        raise ValueError(f"unknown mode {mode}")
    steps = grid.shape[0] if "t" in keys else 1
    return map_df.join(grid.per_map(limits, steps), [*keys]).withColumn("v", scaled).drop("a", "b")


def filled_intensity(grid: Grid, maps: DataFrame | None = None) -> DataFrame:
    """Intensity with gaps filled (``filled``), the original (v), and the gradient (g)."""
    plain = intensity(grid) if maps is None else maps.select("grid_id", "y", "x", F.col("intensity").alias("v"))
    full = fill_nearest(plain, ("grid_id",), all_missing=0.0, width=grid.shape[2])
    sloped = gradient(full, IMAGE)
    return cut_lineage(sloped.select("grid_id", "y", "x", F.col("v").alias("filled"), F.col("v_original").alias("v"), "g"))


def image_features(grid: Grid) -> DataFrame:
    """All image features, one row per grid. An image without a present intensity keeps its size; what it lacks is NULL."""
    maps = cut_lineage(pixels(grid))
    sloped = filled_intensity(grid, maps)
    rows = image_summary(grid, maps).join(edge_stats(grid, sloped), "grid_id", "left").join(texture_stats(grid, sloped), "grid_id", "left")
    rows = rows.withColumn("texture_label", F.coalesce("texture_label", texture_label(F.col("local_std_mean"))))
    rows = rows.join(histogram(maps, "intensity", 16, 0.0, 255.0), "grid_id", "left")
    if has_color(grid):
        rows = rows.join(hsv_stats(grid, maps), "grid_id", "left")
    return rows
