"""Connected regions of boolean maps and what is derived from them.

Labelling works in two steps. Cells are grouped into square tiles of fixed size and labelled tile by tile,
so a task sees at most ``TILE`` x ``TILE`` cells. Where maps span several tiles, labels that touch across
a tile border form a graph far smaller than the map, and its components are found by alternating large-star and
small-star rounds (Kiveris et al. 2014) with the lineage cut after each round. Maps that fit one tile, which the
driver knows from the axis sizes, skip the second step.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gridframe.model import MAP, Grid
from gridframe.operators.aggregates import mean_map, top_rows
from gridframe.operators.quantile import group_quantiles
from gridframe.operators.selection import slice_at
from gridframe.operators.stencil import filled_gradient, gradient_stats, mask_boundary
from gridframe.session import cut_lineage

TILE = 256
MAX_ROUNDS = 60


# --- labelling --------------------------------------------------------------------------------------

def components(
    mask: DataFrame, keys: Sequence[str], shape: tuple[int, int, int], tile: int = TILE, layer: str | None = None, barrier: str | None = None
) -> DataFrame:
    """Adds ``component`` to the cells of a mask: the smallest raster position y * width + x of its region.

    Cells are 4-connected when they agree on ``keys``, on the integer column ``layer`` (several masks over one map) and
    on the integer column ``barrier`` (parts of a map that do not connect, such as blocks). Layers and barriers
    share a tile, so small parts do not become small tasks. Other columns of ``mask`` are kept.
    """
    keys = list(keys)
    _, n_y, n_x = shape
    position = F.col("y").cast("bigint") * n_x + F.col("x")
    tiled = mask.withColumns({
        "_ty": F.floor(F.col("y") / tile).cast("int"), "_tx": F.floor(F.col("x") / tile).cast("int"), "component": position,
        "_layer": (F.col(layer) if layer else F.lit(0)).cast("bigint"), "_part": (F.col(barrier) if barrier else F.lit(0)).cast("bigint"),
    })
    local = tiled.groupBy(*keys, "_ty", "_tx").applyInPandas(_label_tile, tiled.schema)
    if n_y <= tile and n_x <= tile:
        return local.select(*mask.columns, "component")
    local = cut_lineage(local)
    keys = [*keys, "_layer", "_part"]
    roots = _star_roots(_border_edges(local, keys, tile), keys)
    joined = local.join(roots, [*keys, "component"], "left")
    return joined.withColumn("component", F.coalesce("root", "component")).select(*mask.columns, "component")


def _label_tile(cells: pd.DataFrame) -> pd.DataFrame:
    """Labels the cells of one tile by runs: horizontal runs are joined where they overlap vertically."""
    cells = cells.sort_values(["_layer", "y", "x"], kind="stable", ignore_index=True)
    layer, part = cells["_layer"].to_numpy(), cells["_part"].to_numpy()
    y, x = cells["y"].to_numpy(np.int64), cells["x"].to_numpy(np.int64)
    width, height = x.max() + 2, y.max() + 2
    place = (layer * height + y) * width + x
    new_run = np.r_[True, (np.diff(place) != 1) | (np.diff(part) != 0)]
    run = np.cumsum(new_run) - 1
    under = np.searchsorted(place, place + width)
    hit = np.minimum(under, len(place) - 1)
    met = (place[hit] == place + width) & (part[hit] == part)
    pairs = np.unique(np.c_[run[met], run[hit[met]]], axis=0)
    parent = np.arange(run[-1] + 1)
    # Hook the larger root below the smaller one and shorten paths until nothing changes.
    while len(pairs):
        a, b = parent[pairs[:, 0]], parent[pairs[:, 1]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        if (low == high).all():
            break
        np.minimum.at(parent, high, low)
        while (parent[parent] != parent).any():
            parent = parent[parent]
    first_cell = np.flatnonzero(new_run)
    cells["component"] = cells["component"].to_numpy()[first_cell[parent[run]]]
    return cells


def _border_edges(local: DataFrame, keys: list[str], tile: int) -> DataFrame:
    """(keys, a, b): pairs of labels that touch across a tile border; only border cells take part."""
    edges = None
    for axis in ("x", "y"):
        last = local.where(F.col(axis) % tile == tile - 1).withColumn(axis, F.col(axis) + 1)
        near = last.select(*keys, "y", "x", F.col("component").alias("a"))
        far = local.where(F.col(axis) % tile == 0).select(*keys, "y", "x", F.col("component").alias("b"))
        met = near.join(far, [*keys, "y", "x"]).select(*keys, "a", "b")
        edges = met if edges is None else edges.unionByName(met)
    return edges.distinct()


def _star_roots(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, component, root): smallest label of each connected set of labels."""

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        flipped = pairs.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))
        both = pairs.unionByName(flipped) if large else pairs.select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy(*keys, "a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        spread = both.join(least, [*keys, "a"])
        moved = spread.where(F.col("b") > F.col("a") if large else F.col("b") != F.col("m")).select(*keys, F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            moved = moved.unionByName(least.select(*keys, "a", F.col("m").alias("b")))
        return moved.where(F.col("a") != F.col("b")).distinct()

    def mark(pairs: DataFrame):
        return pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*keys, "a", "b").cast("decimal(38,0)"))).first()

    pairs = cut_lineage(edges.where(F.col("a") != F.col("b")))
    seen = mark(pairs)
    for _ in range(MAX_ROUNDS):
        pairs = cut_lineage(star(star(pairs, True), False))
        now = mark(pairs)
        if now == seen:
            return pairs.select(*keys, F.col("a").alias("component"), F.col("b").alias("root"))
        seen = now
    raise RuntimeError("component merging did not settle")


def component_stats(labelled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of components and size of the largest, per group."""
    sizes = labelled.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("cells"))
    return sizes.groupBy(*keys).agg(F.count(F.lit(1)).alias("components"), F.max("cells").alias("largest"))


def component_table(grid: Grid, labelled: DataFrame, keys: Sequence[str] = MAP, n: int | None = 10, by_peak: bool = False) -> DataFrame:
    """Per component: cells, centroid in index and coordinates, mean, peak and its place, bounding box.

    The first ``n`` by cells (then by peak if ``by_peak``); ties in raster order.
    """
    placed = grid.with_coords(labelled)
    top = F.max_by(F.struct("y", "x", "lat", "lon"), F.struct("v", -F.col("y"), -F.col("x")))
    table = placed.groupBy(*keys, "component").agg(
        F.count(F.lit(1)).alias("cells"), F.avg("y").alias("cy"), F.avg("x").alias("cx"),
        F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.avg("v").alias("mean"), F.max("v").alias("peak"),
        top.alias("p"), F.min("lon").alias("lon_min"), F.min("lat").alias("lat_min"),
        F.max("lon").alias("lon_max"), F.max("lat").alias("lat_max"),
    )
    table = table.select(
        *[c for c in table.columns if c != "p"], F.col("p.y").alias("peak_y"), F.col("p.x").alias("peak_x"),
        F.col("p.lat").alias("peak_lat"), F.col("p.lon").alias("peak_lon"),
    )
    if n is None:
        return table
    order = [F.col("cells").desc()] + ([F.round("peak", 6).desc()] if by_peak else []) + [F.col("component")]
    return top_rows(table, keys, order, n)


# --- hotspots ------------------------------------------------------------------------------------------

def hotspot_mask(grid: Grid, map_df: DataFrame, q: float = 0.9) -> DataFrame:
    """Adds ``threshold`` (quantile of present values) and ``hot``."""
    thresholds = group_quantiles(map_df, MAP, "v", {"threshold": q}, grid.map_cells)
    return map_df.join(grid.per_map(thresholds), MAP).withColumn("hot", F.coalesce(F.col("v") >= F.col("threshold"), F.lit(False)))


def hotspots(grid: Grid, map_df: DataFrame, q: float = 0.9) -> DataFrame:
    """Cells of the hotspot mask with their component."""
    hot = hotspot_mask(grid, map_df, q).where("hot").select(*MAP, "y", "x", "v")
    return components(hot, MAP, grid.shape)


def high_domains(grid: Grid, map_df: DataFrame) -> DataFrame:
    """Number of regions at or above mean + std."""
    bounds = map_df.groupBy(*MAP).agg((F.avg("v") + F.stddev_pop("v")).alias("bound"))
    high = map_df.join(grid.per_map(bounds), MAP).where(F.col("v") >= F.col("bound")).select(*MAP, "y", "x")
    return component_stats(components(high, MAP, grid.shape), MAP).select(*MAP, F.col("components").alias("connected_domains"))


def spatial_anomaly(grid: Grid, threshold: float = 2.0) -> DataFrame:
    """z map of the last slice: adds ``z``, 0 where the slice has no spread."""
    last = slice_at(grid)
    bounds = last.groupBy(*MAP).agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    z = F.when(F.col("v").isNotNull(), F.coalesce(F.try_divide(F.col("v") - F.col("m"), F.col("s")), F.lit(0.0)))
    return last.join(grid.per_map(bounds), MAP).select(*MAP, "y", "x", "v", z.alias("z")).withColumn("odd", F.abs("z") >= threshold)


def anomaly_components(grid: Grid, n: int = 10) -> DataFrame:
    """Regions of the last slice at least two standard deviations from its mean."""
    odd = spatial_anomaly(grid).where("odd").select(*MAP, "y", "x", "v")
    return component_table(grid, components(odd, MAP, grid.shape), n=n)


def hotspot_trajectory(grid: Grid, q: float = 0.9) -> DataFrame:
    """Per slice: threshold, cell count and centroid of the cells at or above the slice's quantile."""
    keys = [*MAP, "t"]
    thresholds = group_quantiles(grid.cells, keys, "v", {"threshold": q}, grid.map_cells)
    hot = grid.cells.join(grid.per_map(thresholds, grid.shape[0]), keys).where(F.col("v") >= F.col("threshold"))
    return hot.groupBy(*keys).agg(
        F.avg("y").alias("cy"), F.avg("x").alias("cx"), F.count(F.lit(1)).alias("cells"), F.max("threshold").alias("threshold")
    )


def spatial_features(grid: Grid, q: float = 0.9, mask: DataFrame | None = None) -> DataFrame:
    """One row per variable: hotspots, high domains, gradient, anisotropy, direction, change along hotspot borders.

    The mean map and its gradient are each computed once.
    """
    mean = mean_map(grid)
    if mask is not None:
        valid = mask.select("grid_id", "y", "x", "valid_region")
        mean = mean.join(valid, ["grid_id", "y", "x"]).withColumn("v", F.when(F.col("valid_region"), F.col("v"))).drop("valid_region")
    mean = cut_lineage(mean)
    marked = hotspot_mask(grid, mean, q)
    hot = marked.where("hot").select(*MAP, "y", "x", "v")
    counts = component_stats(components(hot, MAP, grid.shape), MAP).select(*MAP, F.col("components").alias("hotspot_count"))
    sloped = cut_lineage(filled_gradient(mean.select(*MAP, "y", "x", "v"), width=grid.shape[2]))
    stats = gradient_stats(sloped, grid.map_cells, small=grid.per_map).drop("boundary_change").withColumnRenamed("gradient_p95", "gradient_strength_p95")
    edged = mask_boundary(marked.select(*MAP, "y", "x", "hot", "threshold"), "hot")
    border = (
        edged.where("boundary").join(sloped.select(*MAP, "y", "x", "v", "g"), [*MAP, "y", "x"])
        .where(F.col("v").isNotNull()).groupBy(*MAP).agg(F.avg("g").alias("boundary_change"))
    )
    thresholds = marked.groupBy(*MAP).agg(F.max("threshold").alias("threshold"))
    rows = thresholds
    for part in (counts, high_domains(grid, mean), stats, border):
        rows = rows.join(part, MAP, "left")
    empty = F.col("threshold").isNull()
    blank = {c: F.when(~empty, F.col(c)) for c in ("gradient_strength", "gradient_strength_p95", "anisotropy", "direction")}
    return rows.fillna(0, ["hotspot_count", "connected_domains"]).withColumns(blank)
