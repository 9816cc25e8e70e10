"""Writing cells and results."""

from __future__ import annotations

import io
import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridframe.model import MAP, Grid
from gridframe.session import cut_lineage
from gridframe.sources.files import file_system


def write_cells(grid: Grid, path: str, masks: DataFrame | None = None, mode: str = "errorifexists", buckets: int = 32) -> None:
    """Values with their missing, filled and permanently-missing flags, partitioned by variable and hash bucket of the grid.

    Files are sorted by grid, step and row, so filters on these skip row groups. Buckets are rebalanced: small ones share
    a task, and a bucket with one huge grid is split over several.
    """
    cells = grid.cells
    original = F.col("v_original") if "v_original" in cells.columns else F.col("v")
    out = cells.withColumn("orig_missing", original.isNull())
    if "filled" not in cells.columns:
        out = out.withColumn("filled", F.lit(False))
    if masks is not None:
        out = out.join(masks.select("grid_id", "y", "x", "fixed_missing"), ["grid_id", "y", "x"])
    out = out.withColumn("bucket", F.pmod(F.hash("grid_id"), F.lit(buckets))).hint("rebalance", "var", "bucket")
    out.sortWithinPartitions("var", "bucket", "grid_id", "t", "y", "x").write.mode(mode).partitionBy("var", "bucket").parquet(path)


def write_arrays(grid: Grid, folder: str) -> DataFrame:
    """One .npz file per grid and step with an array [y, x] per variable, NaN for missing values, and the axes that the grid has; returns (file, bytes).

    A file is named by its grid, and by its step or the label of it. A task holds one step. Files appear under their names when they are whole, so a
    task that runs twice leaves one file.
    """
    system, base = file_system(folder)
    system.create_dir(base, recursive=True)
    cells = grid.with_dims(grid.with_time(grid.cells.select("grid_id", "t", "var", "y", "x", "v")))
    if grid.axis_y is not None:
        cells = grid.with_lat(cells)
    if grid.axis_x is not None:
        cells = grid.with_lon(cells)

    def write(table: pa.Table) -> pa.Table:
        system, base = file_system(folder)
        first = table.slice(0, 1).to_pylist()[0]
        y, x, v = (table.column(c).to_numpy().astype(t) for c, t in (("y", np.int64), ("x", np.int64), ("v", np.float64)))
        names = np.array(table.column("var").to_pylist())
        arrays = {}
        for name in sorted(set(names)):
            at = names == name
            arrays[name] = np.full((first["n_y"], first["n_x"]), np.nan)
            arrays[name][y[at], x[at]] = v[at]
        for axis, place, size in (("lat", y, first["n_y"]), ("lon", x, first["n_x"])):
            if axis in table.column_names:
                arrays[axis] = np.zeros(size)
                arrays[axis][place] = table.column(axis).to_numpy()
        buffer = io.BytesIO()
        np.savez(buffer, **arrays)
        label = first["label"] or f"{first['t']:08d}"
        name = f"{first['grid_id']}_{label.replace('/', '-')}.npz"
        temporary = f"{base}/_{uuid.uuid4().hex}"
        with system.open_output_stream(temporary, compression=None) as out:
            out.write(buffer.getvalue())
        system.move(temporary, f"{base}/{name}")
        return pa.table({"file": [name], "bytes": pa.array([buffer.tell()], pa.int64())})

    return cut_lineage(cells.groupBy("grid_id", "t").applyInArrow(write, "file string, bytes long"))


def write_results(df: DataFrame, path: str, mode: str = "errorifexists", preview: int | None = None) -> None:
    """One JSON object per row; vectors whole, or cut to their length and first values if ``preview`` is given."""
    json_rows(df, preview).write.mode(mode).text(path)


def json_rows(df: DataFrame, preview: int | None = 4) -> DataFrame:
    """Rows as JSON text; each array of numbers becomes its length and first values, or stays whole if ``preview`` is None."""
    parts = []
    for name, kind in df.dtypes:
        if preview is not None and kind in ("array<double>", "array<float>"):
            parts += [F.size(name).alias(f"{name}_dim"), F.slice(name, 1, preview).alias(f"{name}_preview")]
        else:
            parts.append(F.col(name))
    return df.select(F.to_json(F.struct(*parts)).alias("value"))


def map_summaries(map_df: DataFrame, keys: Sequence[str] = MAP) -> DataFrame:
    """What an export holds in place of a map: its shape and range."""
    return map_df.groupBy(*keys).agg(
        (F.max("y") + 1).alias("n_y"), (F.max("x") + 1).alias("n_x"), F.min("v").alias("min"), F.max("v").alias("max")
    )


def to_matrix(blocks: DataFrame, value: str, rows: int, cols: int) -> DataFrame:
    """(grid_id, var, matrix): values by row and column, NULL where there is no block.

    A matrix has rows x cols entries, both fixed by the caller.
    """
    order = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    lines = blocks.groupBy(*MAP, "row").agg(F.map_from_entries(F.collect_list(F.struct(F.col("col"), F.col(value)))).alias("by_col"))
    filled = lines.select(*MAP, "row", F.transform(order(cols), lambda c: F.try_element_at("by_col", c)).alias("line"))
    grids = filled.groupBy(*MAP).agg(F.map_from_entries(F.collect_list(F.struct("row", "line"))).alias("by_row"))
    empty = F.transform(order(cols), lambda c: F.lit(None).cast(dict(blocks.dtypes)[value]))
    return grids.select(*MAP, F.transform(order(rows), lambda r: F.coalesce(F.try_element_at("by_row", r), empty)).alias("matrix"))
