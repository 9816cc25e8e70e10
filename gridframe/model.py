"""The data model: grids as long-form DataFrames of cells.

``cells`` holds one row per (grid, time step, variable, row, column). Cells are dense: a missing
value is a row whose ``v`` is NULL, never an absent row. One ``Grid`` may hold any number of grids,
told apart by ``grid_id``; every operator works on all of them in one job.

What the driver knows is only the size of the axes, the variable names and small rule tables.
Sizes decide which physical route an operator takes, so no group is collected unbounded.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CELLS = "grid_id string, t int, var string, y int, x int, v double"
BROADCAST_ROWS = 100_000
CELLS_PER_TASK = 2_000_000
CELL = ["grid_id", "var", "y", "x"]
MAP = ["grid_id", "var"]
SERIES = ["grid_id", "var"]


@dataclass(frozen=True)
class Grid:
    cells: DataFrame
    variables: tuple[str, ...]
    shape: tuple[int, int, int]
    """Time steps, rows, columns; the largest over all grids where they differ."""
    dims: DataFrame | None = None
    """(grid_id, n_t, n_y, n_x) where grids differ in size; None where all have ``shape``."""
    axis_t: DataFrame | None = None
    """(grid_id, t, ts, label); None means steps without a known time."""
    axis_y: DataFrame | None = None
    """(grid_id, y, lat); None means index coordinates."""
    axis_x: DataFrame | None = None
    ids: DataFrame | None = None
    """(grid_id) of every grid, where known without reading cells."""
    n_grids: int | None = None
    """Number of grids, where known; bounds the size of per-grid tables."""
    units: Mapping[str, str | None] = field(default_factory=dict)
    long_names: Mapping[str, str | None] = field(default_factory=dict)
    crs: str = "EPSG:4326/inferred"
    coordinate_system: str = "geographic_or_projected"
    grid_type: str = "spatiotemporal_grid"

    @property
    def spark(self) -> SparkSession:
        return self.cells.sparkSession

    @property
    def primary(self) -> str:
        return self.variables[0]

    @property
    def map_cells(self) -> int:
        """Upper bound on cells in one map."""
        return self.shape[1] * self.shape[2]

    @property
    def stack_cells(self) -> int:
        """Upper bound on cells of one variable over all steps."""
        return self.shape[0] * self.map_cells

    def with_cells(self, cells: DataFrame, **changes) -> "Grid":
        return replace(self, cells=cells, **changes)

    def with_dims(self, df: DataFrame) -> DataFrame:
        """Adds n_t, n_y, n_x: constants where all grids have one size, a join on grid_id otherwise."""
        if self.dims is None:
            n_t, n_y, n_x = self.shape
            return df.withColumns({"n_t": F.lit(n_t), "n_y": F.lit(n_y), "n_x": F.lit(n_x)})
        return df.join(self.dims.select("grid_id", "n_t", "n_y", "n_x"), "grid_id")

    def dims_table(self) -> DataFrame:
        if self.dims is not None:
            return self.dims.select("grid_id", "n_t", "n_y", "n_x")
        return self.with_dims(self.ids if self.ids is not None else self.cells.select("grid_id").distinct())

    def per_map(self, df: DataFrame, rows: int = 1) -> DataFrame:
        """A table of at most ``rows`` rows per grid and variable, marked for broadcast where that is a known small number."""
        return bounded(df, None if self.n_grids is None else self.n_grids * len(self.variables) * rows)

    def lat_axis(self) -> DataFrame:
        if self.axis_y is not None:
            return self.axis_y
        steps = F.explode(F.sequence(F.lit(0), F.col("n_y") - 1))
        return self.dims_table().select("grid_id", steps.alias("y")).withColumn("lat", F.col("y").cast("double"))

    def lon_axis(self) -> DataFrame:
        if self.axis_x is not None:
            return self.axis_x
        steps = F.explode(F.sequence(F.lit(0), F.col("n_x") - 1))
        return self.dims_table().select("grid_id", steps.alias("x")).withColumn("lon", F.col("x").cast("double"))

    def time_axis(self) -> DataFrame:
        if self.axis_t is not None:
            return self.axis_t
        steps = F.explode(F.sequence(F.lit(0), F.col("n_t") - 1))
        none = F.lit(None)
        return self.dims_table().select(
            "grid_id", steps.alias("t"), none.cast("timestamp").alias("ts"), none.cast("string").alias("label")
        )

    def with_lat(self, df: DataFrame, key: str = "y", name: str = "lat") -> DataFrame:
        if self.axis_y is None:
            return df.withColumn(name, F.col(key).cast("double"))
        axis = self.axis_y.select("grid_id", F.col("y").alias(key), F.col("lat").alias(name))
        return df.join(axis, ["grid_id", key], "left")

    def with_lon(self, df: DataFrame, key: str = "x", name: str = "lon") -> DataFrame:
        if self.axis_x is None:
            return df.withColumn(name, F.col(key).cast("double"))
        axis = self.axis_x.select("grid_id", F.col("x").alias(key), F.col("lon").alias(name))
        return df.join(axis, ["grid_id", key], "left")

    def with_coords(self, df: DataFrame) -> DataFrame:
        return self.with_lon(self.with_lat(df))

    def with_time(self, df: DataFrame) -> DataFrame:
        if self.axis_t is None:
            return df.withColumns({"ts": F.lit(None).cast("timestamp"), "label": F.lit(None).cast("string")})
        return df.join(self.axis_t.select("grid_id", "t", "ts", "label"), ["grid_id", "t"], "left")

    def position(self, c: Column | str = "var") -> Column:
        """Order of a variable; the first one is the primary variable."""
        names = F.array(*[F.lit(n) for n in self.variables])
        return F.array_position(names, F.col(c) if isinstance(c, str) else c) - 1

    def one(self, var: str) -> "Grid":
        """The grid restricted to one variable; the filter reaches the scan."""
        return replace(self, cells=self.cells.where(F.col("var") == var), variables=(var,))


def bounded(df: DataFrame, rows: int | None) -> DataFrame:
    """Marks a table for broadcast if its number of rows is known and small; otherwise the join is left to Spark, which
    measures the sides at run time."""
    return F.broadcast(df) if rows is not None and rows <= BROADCAST_ROWS else df


def spread(rows: DataFrame, cells: int, *keys: str) -> DataFrame:
    """Distributes a small table that is about to be expanded into ``cells`` rows."""
    parts = min(10_000, cells // CELLS_PER_TASK)
    return rows.repartition(parts, *keys) if parts > 1 else rows


def skeleton(ids: DataFrame, variables: Sequence[str], shape: tuple[int, int, int]) -> DataFrame:
    """Every cell address of the given grids, made by nested expansion of the axes, without a join.

    Large grids are spread over tasks once their rows are listed, before the columns are.
    """
    n_t, n_y, n_x = shape
    names = F.array(*[F.lit(v) for v in variables])
    rows = (
        ids.select("grid_id", F.explode(F.sequence(F.lit(0), F.lit(n_t - 1))).alias("t"))
        .select("grid_id", "t", F.explode(names).alias("var"))
        .select("grid_id", "t", "var", F.explode(F.sequence(F.lit(0), F.lit(n_y - 1))).alias("y"))
    )
    rows = spread(rows, n_t * n_y * n_x * len(variables), "grid_id", "t", "y")
    return rows.select("grid_id", "t", "var", "y", F.explode(F.sequence(F.lit(0), F.lit(n_x - 1))).alias("x"))
