"""The whole analysis of one variable, and the feature bundle of a grid, as sets of lazy tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridframe.functions import rules
from gridframe.functions.columns import coverage_label
from gridframe.model import MAP, Grid
from gridframe.operators import aggregates as agg, blocks as blk, embed as emb, image as img, missing as mis
from gridframe.operators import regions as reg, requests as req, selection as sel, temporal as tem
from gridframe.session import cut_lineage

TASK_TABLES: Mapping[str, tuple[str, ...]] = {
    "anomaly_detection": ("anomaly_z_map",),
    "trend_analysis": ("mean_map", "series", "trajectory"),
    "source_tracing": ("mean_map", "series", "trajectory", "hotspot_cells"),
    "comparison": ("difference_map",),
    "clustering": ("mean_map", "hotspot_mask", "hotspot_cells"),
    "attribution": ("mean_map", "hotspot_mask", "pairs"),
    "correlation_analysis": ("mean_map", "hotspot_mask", "pairs"),
}
DEFAULT_TABLES = ("mean_map", "hotspot_mask")
OVER_TIME = ("trend_analysis", "source_tracing", "comparison")


class Tables(Mapping[str, DataFrame]):
    """Named tables, each built when it is first asked for."""

    def __init__(self, makers: Mapping[str, Callable[[], DataFrame]]):
        self._makers, self._made = dict(makers), {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


def stats_of(df: DataFrame, cells: int, keys: Sequence[str] = MAP) -> DataFrame:
    """min, max, mean, std, p05, p50, p95 rounded to six digits."""
    v = F.col("v")
    rows = agg.agg_with_quantiles(
        df, keys, [F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std")],
        {"v": {"p05": 0.05, "p50": 0.5, "p95": 0.95}}, cells,
    )
    return rows.select(*keys, *[F.bround(c, 6).alias(c) for c in ("min", "max", "mean", "std", "p05", "p50", "p95")])


def analyze(
    grid: Grid,
    var: str | None = None,
    region: str | None = None,
    t: int | None = None,
    task: str | None = None,
    boxes: Sequence[tuple] = rules.REGION_BOXES,
    block_rows: int = 9,
    block_cols: int = 14,
    min_similar_cells: int = 200,
    mask: DataFrame | None = None,
    display_points: int | None = None,
    pair_rows: int | None = None,
    hotspot_rows: int | None = None,
) -> Mapping[str, DataFrame]:
    """Tables of the analysis of a variable in a region for one step; with a task, only those it needs.

    All tables are whole. Where asked for, the four tables for display keep at most ``display_points`` rows and columns of a map, ``pairs`` about ``pair_rows`` rows, and
    ``hotspots`` the first ``hotspot_rows`` regions of a map.

    Cells outside the valid region of ``mask`` (as ``missing_masks`` returns it) count as missing. The tasks that compare steps
    fall back on the mean map where no grid has a second step.

    The masked cells of the variable are computed once and shared. A table is built when it is asked for, so a caller
    pays for what it reads.
    """
    var = var or grid.primary
    subset = sel.prepare(grid, var, region, mask, boxes)
    subset = subset.with_cells(cut_lineage(subset.cells))
    if task is not None:
        return _for_task(grid, subset, var, task, pair_rows)
    mean = lambda: agg.mean_map(subset)
    series = lambda: agg.series_mean(subset)
    out: Tables

    def display(column: str):
        whole = lambda: out["maps"].select(*MAP, "y", "x", F.col(column).alias("v"))
        return whole if display_points is None else lambda: sel.downsample(subset, whole(), display_points)

    out = Tables({
        "statistics_overall": lambda: stats_of(subset.cells, subset.stack_cells),
        "statistics_slice": lambda: stats_of(out["maps"], subset.map_cells),
        "statistics_mean_map": lambda: stats_of(mean(), subset.map_cells),
        "maps": lambda: tem.cell_maps(subset, t),
        "mean_display": display("mean"), "slice_display": display("v"), "trend_display": display("trend"), "anomaly_display": display("z"),
        "trend": lambda: tem.daily_trend(series()),
        "quality": lambda: agg.quality(subset),
        "series": lambda: agg.series_stats(subset).join(agg.hotspot_share(subset), [*MAP, "t"]),
        "anomaly_days": lambda: subset.with_time(tem.anomaly_days(series())),
        "hotspots": lambda: reg.component_table(subset, reg.hotspots(subset, mean()), n=hotspot_rows, by_peak=True),
        "blocks": lambda: cut_lineage(blk.block_table(subset, t, block_rows, block_cols)),
        "top_blocks": lambda: blk.top_blocks(out["blocks"]),
        "block_labels": lambda: blk.block_labels(out["blocks"]),
        "recommendations": lambda: blk.recommend(out["block_labels"]),
        "similar_slices": lambda: tem.similar_slices(subset, t, min_cells=min_similar_cells),
        "daily": lambda: cut_lineage(agg.daily_matrix(grid)),
        "correlations": lambda: tem.driver_correlation(out["daily"], var),
        "variables": lambda: agg.variable_cards(out["daily"], var),
        "facts": lambda: req.narrative_facts(out["trend"], out["correlations"], out["blocks"]),
    })
    return out


def _for_task(grid: Grid, subset: Grid, var: str, task: str, pair_rows: int | None) -> Mapping[str, DataFrame]:
    mean = agg.mean_map(subset)

    other = sel.secondary_variable(grid, var)

    def pairs() -> DataFrame:
        both = subset.with_cells(
            subset.cells.drop("in_region").unionByName(grid.one(other).cells.select("grid_id", "t", "var", "y", "x", "v")), variables=(var, other)
        )
        found = agg.pair_vars(both, var, other)
        return found if pair_rows is None else sel.thin(both, found, pair_rows)

    makers = {
        "mean_map": lambda: mean,
        "anomaly_z_map": lambda: reg.spatial_anomaly(subset),
        "series": lambda: subset.with_time(agg.series_mean(subset)),
        "trajectory": lambda: reg.hotspot_trajectory(subset),
        "difference_map": lambda: tem.difference_map(subset),
        "hotspot_mask": lambda: reg.hotspot_mask(subset, mean),
        "hotspot_cells": lambda: reg.hotspots(subset, mean),
        "pairs": pairs,
    }
    names = TASK_TABLES.get(task, DEFAULT_TABLES)
    if task in OVER_TIME:
        if subset.shape[0] <= 1:
            names = (*DEFAULT_TABLES, *(n for n in names if n == "hotspot_cells"))
        elif subset.dims is not None:  # grids of one step beside longer ones have a mean map only
            names = tuple(dict.fromkeys(("mean_map", *names)))
            makers = {name: (maker if name == "mean_map" else _of_several_steps(subset, maker)) for name, maker in makers.items()}
    return Tables({name: makers[name] for name in names if name != "pairs" or other is not None})


def describe(grid: Grid, fill: str | None = "nearest") -> Mapping[str, DataFrame]:
    """What a loaded grid is: masks, filled cells, profiles, axes, coverage."""
    filled = mis.fill(grid, fill)
    filled = filled.with_cells(cut_lineage(filled.cells))
    masks = cut_lineage(mis.missing_masks(grid))
    return Tables({
        "cells": lambda: filled.cells,
        "masks": lambda: masks,
        "profiles": lambda: agg.profile(filled),
        "spec": lambda: agg.grid_spec(grid),
        "space_resolution": lambda: agg.space_resolution(grid),
        "time_resolution": lambda: agg.time_resolution(grid),
        "missing": lambda: mis.missing_summary(filled, masks),
        "recommendations": lambda: mis.fill_recommendations(masks),
        "hottest": lambda: agg.hottest(filled),
        "change": lambda: agg.first_last(filled),
    })


def extract_features(
    grid: Grid, block: tuple[int, int] = (32, 32), dim: int = 8, q: float = 0.9, fill: str | None = "nearest", patches: bool = True, max_tokens: int | None = None
) -> Mapping[str, DataFrame]:
    """The feature tables of a grid: statistics, correlation, spatial, temporal, embeddings, image, patches, labels, and what they say of the primary variable.

    ``hotspots`` has all regions at or above the quantile ``q`` of the mean map, ``change_points`` all steps that stand out, with their times. With
    ``max_tokens``, patches are enlarged so that about as many cover a map.
    """
    whole = mis.fill(grid, fill)
    whole = whole.with_cells(cut_lineage(whole.cells))
    valid = cut_lineage(mis.missing_masks(grid))
    out: Tables
    makers: dict[str, Callable[[], DataFrame]] = {
        "statistics": lambda: agg.statistics(whole, missing="v_original"),
        "overall": lambda: agg.overall_statistics(whole),
        "correlation": lambda: agg.correlation(whole),
        "strongest_partner": lambda: agg.strongest_partner(out["correlation"], grid.primary),
        "spatial": lambda: reg.spatial_features(whole, q, valid),
        "temporal": lambda: tem.temporal_features(whole, valid),
        "hotspots": lambda: reg.component_table(whole, reg.hotspots(whole, cut_lineage(_valid(agg.mean_map(whole), valid)), q), n=None),
        "change_points": lambda: whole.with_time(tem.change_points(agg.series_mean(whole, valid), n=None)),
        "coverage": lambda: out["statistics"].select(*MAP, "missing_ratio", coverage_label(F.col("missing_ratio")).alias("coverage")),
        "facts": lambda: _facts(whole, out),
        "across_variables": lambda: agg.across_variables(out["spatial"], out["temporal"]),
        "labels": lambda: req.semantic_labels(out["spatial"].join(out["temporal"], MAP)),
        "block_embedding": lambda: emb.block_embedding(whole, block, dim, "v_original"),
        "time_slice_embedding": lambda: emb.time_slice_embedding(whole, dim, valid),
        "relation_embedding": lambda: emb.relation_embedding(whole, dim),
    }
    if img.is_image(grid):
        makers["image"] = lambda: img.image_features(whole)
    if patches:
        makers["patches"] = lambda: cut_lineage(emb.encode(whole, block, max(16, dim * 4), 4, valid, max_tokens))
        makers["top_patches"] = lambda: emb.top_patches(out["patches"])
        makers["attention_edges"] = lambda: emb.attention_edges(out["patches"])
        makers["saliency_summary"] = lambda: emb.saliency_summary(out["patches"])
    out = Tables(makers)
    return out


def _of_several_steps(grid: Grid, maker: Callable[[], DataFrame]) -> Callable[[], DataFrame]:
    """A table without the grids that have one step only."""
    return lambda: maker().join(grid.dims_table().where("n_t > 1").select("grid_id"), "grid_id", "left_semi")


def _valid(map_df: DataFrame, mask: DataFrame) -> DataFrame:
    valid = mask.select("grid_id", "y", "x", "valid_region")
    return map_df.join(valid, ["grid_id", "y", "x"]).withColumn("v", F.when(F.col("valid_region"), F.col("v"))).drop("valid_region")


def _facts(grid: Grid, tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per grid: its size, and of the primary variable coverage, patterns in words, hotspots, trend and the strongest relation; of images, size, edges and texture."""
    primary = F.col("var") == grid.primary
    rows = grid.dims_table().select("grid_id", F.lit(grid.primary).alias("variable"), "n_t", "n_y", "n_x")
    labels = tables["labels"].where(primary).select("grid_id", "hotspot_count", "trend", "spatial_pattern", "temporal_pattern")
    partner = tables["strongest_partner"].select("grid_id", "partner", F.col("r").alias("partner_r"))
    rows = rows.join(tables["coverage"].where(primary).select("grid_id", "missing_ratio", "coverage"), "grid_id", "left").join(labels, "grid_id", "left").join(partner, "grid_id", "left")
    if "image" in tables:
        rows = rows.join(tables["image"].select("grid_id", "width", "height", "edge_density", "texture_label"), "grid_id", "left")
    if "saliency_summary" in tables:
        rows = rows.join(tables["saliency_summary"].select("grid_id", "tokens", F.col("p95").alias("saliency_p95")), "grid_id", "left")
    return rows


def flags(spatial: DataFrame, statistics: DataFrame, steps: int, image: bool, anomalies: DataFrame | None = None) -> DataFrame:
    """Cautions per variable from its missing share, the number of steps, the kind of grid and the anomalies found."""
    rows = spatial.select(*MAP).join(statistics.select(*MAP, "missing_ratio"), MAP)
    count: Column = F.lit(None).cast("bigint")
    if anomalies is not None:
        found = anomalies.groupBy(*MAP).agg(F.count(F.lit(1)).alias("anomalies"))
        rows = rows.join(found, MAP, "left").fillna(0, ["anomalies"])
        count = F.col("anomalies")
    return rows.withColumn("risks", req.risk_flags(F.col("missing_ratio"), F.lit(steps), F.lit(image), count)).select(*MAP, "risks")
