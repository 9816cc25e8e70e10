"""Stencils on maps and series: gradients, boundaries, smoothing, spatial autocorrelation.

Gradients, boundaries and Gaussian smoothing are windows along one axis at a time, partitioned by a single row, column or series; box
filters work on tiles with a halo. Maps are dense: one row per (keys, y, x).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from gridframe.functions.columns import anisotropy, axis_direction
from gridframe.model import MAP, Grid
from gridframe.operators import tiles
from gridframe.operators.missing import fill_nearest
from gridframe.operators.quantile import agg_with_quantiles
from gridframe.session import cut_lineage


def lines(keys: Sequence[str]):
    """Windows along rows and along columns."""
    return Window.partitionBy(*keys, "y").orderBy("x"), Window.partitionBy(*keys, "x").orderBy("y")


def _slope(v: Column, along) -> Column:
    before, after = F.lag(v).over(along), F.lead(v).over(along)
    return (
        F.when(before.isNotNull() & after.isNotNull(), (after - before) / 2)
        .when(after.isNotNull(), after - v)
        .when(before.isNotNull(), v - before)
    )


def gradient(map_df: DataFrame, keys: Sequence[str] = MAP, value: str = "v", neighbours: str | None = None) -> DataFrame:
    """Adds gy, gx and their length g: central differences inside, one-sided at the edges, unit spacing.

    The map must have no gaps; g is NULL where an axis has one cell. With ``neighbours`` the right and lower
    neighbour of that column are added as _right and _below from the same two windows.
    """
    row, column = lines(keys)
    along = {"gx": _slope(F.col(value), row)}
    across = {"gy": _slope(F.col(value), column)}
    if neighbours is not None:
        along["_right"] = F.lead(neighbours).over(row)
        across["_below"] = F.lead(neighbours).over(column)
    return map_df.withColumns(along).withColumns(across).withColumn("g", F.hypot("gx", "gy"))


def filled_gradient(map_df: DataFrame, keys: Sequence[str] = MAP, width: int | None = None) -> DataFrame:
    """Nearest fill, then gradient; v holds the original value, NULL where it was missing."""
    filled = fill_nearest(map_df, tuple(keys), all_missing=0.0, width=width)
    return gradient(filled, keys).drop("v", "filled").withColumnRenamed("v_original", "v")


def gradient_stats(
    sloped: DataFrame, map_cells: int, keys: Sequence[str] = MAP, small: Callable[[DataFrame], DataFrame] = lambda df: df
) -> DataFrame:
    """Mean and 95th percentile of the gradient on present cells, anisotropy, dominant axis,
    and the mean gradient of high-gradient cells (at or above the 90th percentile, wherever they lie)."""
    present = sloped.withColumn("gp", F.when(F.col("v").isNotNull(), F.col("g")))
    on = lambda c: F.when(F.col("v").isNotNull(), F.col(c))
    stats = agg_with_quantiles(
        present, keys,
        [
            F.avg("gp").alias("gradient_strength"),
            F.avg(on("gx") * on("gx")).alias("x_energy"),
            F.avg(on("gy") * on("gy")).alias("y_energy"),
        ],
        {"gp": {"gradient_p90": 0.9, "gradient_p95": 0.95}}, map_cells,
    )
    edge = (
        sloped.join(small(stats.select(*keys, "gradient_p90")), [*keys])
        .where(F.col("g") >= F.col("gradient_p90"))
        .groupBy(*keys).agg(F.avg("g").alias("boundary_change"))
    )
    return stats.join(edge, [*keys], "left").select(
        *keys, "gradient_strength", "gradient_p95",
        anisotropy(F.col("x_energy"), F.col("y_energy")).alias("anisotropy"),
        axis_direction(F.col("x_energy"), F.col("y_energy")).alias("direction"),
        "boundary_change",
    )


def mask_boundary(masked: DataFrame, mask: str, keys: Sequence[str] = MAP) -> DataFrame:
    """Adds ``boundary``: dilation xor erosion of a mask with rook neighbours; outside the map counts as false."""
    row, column = lines(keys)
    m = F.col(mask)

    def beside(fn, along) -> Column:
        return F.coalesce(fn(m).over(along), F.lit(False))

    across = masked.withColumns({"_w": beside(F.lag, row), "_e": beside(F.lead, row)})
    around = across.withColumns({"_n": beside(F.lag, column), "_s": beside(F.lead, column)})
    cells = [m, F.col("_w"), F.col("_e"), F.col("_n"), F.col("_s")]
    grown, shrunk = cells[0], cells[0]
    for c in cells[1:]:
        grown, shrunk = grown | c, shrunk & c
    return around.withColumn("boundary", grown != shrunk).drop("_w", "_e", "_n", "_s")


# --- smoothing -----------------------------------------------------------------------------------

def _mirrored(df: DataFrame, axis: str, size: Column, radius: Column | int) -> DataFrame:
    """Adds copies of cells at mirrored positions (d c b a | a b c d | d c b a) up to ``radius`` outside.

    The mirror image repeats with period 2n, so axes shorter than the radius work too.
    """
    radius = F.lit(radius) if isinstance(radius, int) else radius
    turns = F.ceil(radius / (2 * size)).cast("int") + 1
    images = F.flatten(
        F.transform(
            F.sequence(-turns, turns),
            lambda m: F.array(F.col(axis) + 2 * size * m, -1 - F.col(axis) + 2 * size * m),
        )
    )
    near = F.filter(images, lambda p: (p >= -radius) & (p <= size - 1 + radius))
    return df.withColumn(axis, F.explode(near))


def _one_tile(shape: tuple[int, int] | None, tile: int) -> bool:
    return shape is not None and max(shape) <= tile


def box_mean(df: DataFrame, values: Sequence[str], n: int, keys: Sequence[str], shape: tuple[int, int] | None = None, tile: int = tiles.TILE) -> DataFrame:
    """Replaces each value by its mean over an n by n box with mirrored edges. Needs n_y and n_x; ``shape`` bounds them where known."""
    half = n // 2

    def compute(blocks: tiles.Blocks, _) -> tiles.Blocks:
        return {v: tiles.box_means(block, n) for v, block in blocks.items()}

    return tiles.on_tiles(df, keys, values, half, n - 1 - half, values, compute, one_tile=_one_tile(shape, tile), tile=tile)


def local_std(df: DataFrame, value: str, n: int, keys: Sequence[str], out: str = "local_std", shape: tuple[int, int] | None = None, tile: int = tiles.TILE) -> DataFrame:
    """sqrt(max(E[v^2] - E[v]^2, 0)) over an n by n box; other columns are kept. Needs n_y and n_x."""
    half = n // 2

    def compute(blocks: tiles.Blocks, _) -> tiles.Blocks:
        return {out: tiles.box_std(blocks[value], n)}

    return tiles.on_tiles(df, keys, [value], half, n - 1 - half, [out], compute, one_tile=_one_tile(shape, tile), tile=tile)


def _span(df: DataFrame, value: str, keys: Sequence[str], small: Callable[[DataFrame], DataFrame], one_tile: bool) -> tuple[DataFrame, list[str]]:
    """The map with its least and largest value as _lo and _hi; a map that fits one tile finds them there."""
    if one_tile:
        return df, []
    span = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return df.join(small(span), [*keys]), ["_lo", "_hi"]


def _limits(block: np.ndarray, maps: tiles.Blocks) -> tuple[np.ndarray, np.ndarray]:
    if "_lo" in maps:
        return maps["_lo"].astype(float), maps["_hi"].astype(float)
    return np.fmin.reduce(block, axis=(1, 2)), np.fmax.reduce(block, axis=(1, 2))


def local_entropy(
    df: DataFrame, value: str, keys: Sequence[str], bins: int = 16, n: int = 7, small: Callable[[DataFrame], DataFrame] = lambda df: df, shape: tuple[int, int] | None = None,
    tile: int = tiles.TILE,
) -> DataFrame:
    """Adds ``entropy``: entropy of min-max quantised levels in an n by n box, scaled to 0..1; 0 on flat maps. Needs n_y and n_x."""
    half, one = n // 2, _one_tile(shape, tile)
    placed, limits = _span(df, value, keys, small, one)

    def compute(blocks: tiles.Blocks, maps: tiles.Blocks) -> tiles.Blocks:
        return {"entropy": tiles.box_entropy(blocks[value], *_limits(blocks[value], maps), n, bins)}

    return tiles.on_tiles(placed, keys, [value], half, n - 1 - half, ["entropy"], compute, limits, one, tile).drop("_lo", "_hi")


def texture(
    df: DataFrame, value: str, keys: Sequence[str], std_box: int = 5, entropy_box: int = 7, bins: int = 16,
    small: Callable[[DataFrame], DataFrame] = lambda df: df, shape: tuple[int, int] | None = None, tile: int = tiles.TILE,
) -> DataFrame:
    """Adds ``local_std`` and ``entropy`` over boxes of odd sizes, in one pass over the tiles. Needs n_y and n_x."""
    reach, one = max(std_box, entropy_box) // 2, _one_tile(shape, tile)
    placed, limits = _span(df, value, keys, small, one)

    def compute(blocks: tiles.Blocks, maps: tiles.Blocks) -> tiles.Blocks:
        block = blocks[value]
        inner = [block[:, cut : block.shape[1] - cut, cut : block.shape[2] - cut] for cut in (reach - std_box // 2, reach - entropy_box // 2)]
        return {"local_std": tiles.box_std(inner[0], std_box), "entropy": tiles.box_entropy(inner[1], *_limits(block, maps), entropy_box, bins)}

    return tiles.on_tiles(placed, keys, [value], reach, reach, ["local_std", "entropy"], compute, limits, one, tile).drop("_lo", "_hi")


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [w / sum(raw) for w in raw]


def gaussian_kernel(sigma: Column, max_radius: int, truncate: float = 4.0) -> Column:
    """Weights for offsets -max_radius..max_radius of a sigma that may differ by grid; zero beyond its own radius."""
    own = F.floor(truncate * sigma + 0.5)
    raw = F.transform(
        F.sequence(F.lit(-max_radius), F.lit(max_radius)),
        lambda k: F.when(F.abs(k) <= own, F.exp(-0.5 * (k / sigma) * (k / sigma))).otherwise(0.0),
    )
    total = F.aggregate(raw, F.lit(0.0), lambda s, w: s + w)
    return F.transform(raw, lambda w: w / total)


def _weighted(df: DataFrame, axis: str, value: str, size: str, kernel: Column, radius: int, keys: Sequence[str], out: str):
    line = Window.partitionBy(*keys).orderBy(axis).rowsBetween(-radius, radius)
    products = F.zip_with(F.collect_list(value).over(line), kernel, lambda v, w: v * w)
    padded = _mirrored(df, axis, F.col(size), radius)
    inside = (F.col(axis) >= 0) & (F.col(axis) < F.col(size))
    return padded.withColumn("_p", products).where(inside).withColumn(
        out, F.aggregate("_p", F.lit(0.0), lambda s, p: s + p)
    ).drop("_p")


def _fixed(sigma: float) -> tuple[Column, int]:
    weights = gaussian_weights(sigma)
    return F.array(*[F.lit(w) for w in weights]), len(weights) // 2


def smooth_series(series: DataFrame, value: str = "v", sigma: float = 2.0, keys: Sequence[str] = MAP, out: str = "smoothed"):
    """Gaussian smoothing along t with mirrored ends. A series with a gap is NULL throughout, as a
    gap spreads through the whole filter."""
    whole = Window.partitionBy(*keys)
    sized = series.withColumns({"_n": F.count(F.lit(1)).over(whole), "_present": F.count(value).over(whole)})
    smoothed = _weighted(sized, "t", value, "_n", *_fixed(sigma), keys, out)
    return smoothed.withColumn(out, F.when(F.col("_present") == F.col("_n"), F.col(out))).drop("_n", "_present")


def smooth_map(
    df: DataFrame, value: str, sigma: float | Column, keys: Sequence[str], out: str = "smoothed", max_sigma: float | None = None
) -> DataFrame:
    """Gaussian smoothing along rows, then columns, with mirrored edges. Needs n_y and n_x.

    ``sigma`` may be a column; then ``max_sigma`` bounds it.
    """
    if isinstance(sigma, Column):
        radius = int(4.0 * max_sigma + 0.5)
        df, kernel = df.withColumn("_kernel", gaussian_kernel(sigma, radius)), F.col("_kernel")
    else:
        kernel, radius = _fixed(sigma)
    first = _weighted(df, "y", value, "n_y", kernel, radius, [*keys, "x"], out)
    return _weighted(first, "x", out, "n_x", kernel, radius, [*keys, "y"], out).drop("_kernel")


def min_max(df: DataFrame, value: str, keys: Sequence[str], out: str | None = None, small: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Scales to 0..1 per group; 0 where a group has no spread."""
    span = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    scaled = F.coalesce(F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    return df.join(small(span), [*keys]).withColumn(out or value, scaled).drop("_lo", "_hi")


# --- differences and autocorrelation -------------------------------------------------------------

def diffs(series: DataFrame, keys: Sequence[str] = MAP, value: str = "v") -> DataFrame:
    """Present values of a series, numbered from 0, with the change from the previous one."""
    line = Window.partitionBy(*keys).orderBy("t")
    present = series.where(F.col(value).isNotNull())
    return present.withColumns({"i": F.row_number().over(line) - 1, "d": F.col(value) - F.lag(value).over(line)})


def volatility(series: DataFrame, keys: Sequence[str] = MAP) -> DataFrame:
    return diffs(series, keys).groupBy(*keys).agg(F.stddev_pop("d").alias("volatility"))


def neighbour_edges(mask: DataFrame, keys: Sequence[str] = MAP) -> DataFrame:
    """(keys, y, x, y2, x2): rook-adjacent pairs of cells of a mask, each pair once."""
    right = F.struct(F.col("y").alias("y2"), (F.col("x") + 1).alias("x2"))
    down = F.struct((F.col("y") + 1).alias("y2"), F.col("x").alias("x2"))
    wanted = mask.select(*keys, "y", "x", F.explode(F.array(right, down)).alias("n")).select(*keys, "y", "x", "n.y2", "n.x2")
    there = mask.select(*keys, F.col("y").alias("y2"), F.col("x").alias("x2"))
    return wanted.join(there, [*keys, "y2", "x2"])


def moran_value(v: Column, right: Column, below: Column) -> Column:
    """Aggregate: Moran's I with rook neighbours and symmetric weights; NULL for under four present
    cells, no spread, or no neighbours. Values should be shifted towards 0 beforehand."""
    n, mean = F.count(v), F.avg(v)
    pairs_v = [F.when(o.isNotNull(), v) for o in (right, below)]
    pairs_o = [F.when(v.isNotNull(), o) for o in (right, below)]
    zero = F.lit(0.0)
    cross = F.coalesce(F.sum(pairs_v[0] * pairs_o[0]), zero) + F.coalesce(F.sum(pairs_v[1] * pairs_o[1]), zero)
    one = sum((F.coalesce(F.sum(F.when(o.isNotNull(), p)), zero) for p, o in zip(pairs_v, pairs_o)), zero)
    two = sum((F.coalesce(F.sum(F.when(p.isNotNull(), o)), zero) for p, o in zip(pairs_v, pairs_o)), zero)
    count = F.count(pairs_v[0] * pairs_o[0]) + F.count(pairs_v[1] * pairs_o[1])
    centred = cross - mean * (one + two) + mean * mean * count
    spread = F.var_pop(v) * n
    value = F.try_divide(n.cast("double"), 2 * count.cast("double")) * 2 * centred / F.when(spread > 1e-12, spread)
    return F.when(n >= 4, value)


def moran(map_df: DataFrame, keys: Sequence[str] = MAP, by: Sequence[str] = (), small: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Moran's I per map, or per part of a map named by the columns ``by``."""
    groups = [*keys, *by]
    centre = map_df.groupBy(*keys).agg(F.avg("v").alias("_c"))
    shifted = map_df.join(small(centre), [*keys]).withColumn("_v", F.col("v") - F.col("_c"))
    row, column = lines(groups)
    placed = shifted.withColumn("_right", F.lead("_v").over(row)).withColumn("_below", F.lead("_v").over(column))
    return placed.groupBy(*groups).agg(moran_value(F.col("_v"), F.col("_right"), F.col("_below")).alias("moran_i"))


def map_gradient_stats(grid: Grid, map_df: DataFrame) -> DataFrame:
    return gradient_stats(cut_lineage(filled_gradient(map_df, width=grid.shape[2])), grid.map_cells, small=grid.per_map)
