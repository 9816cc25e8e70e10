"""Grids from tables and text files."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gridframe.functions.columns import finite, strip
from gridframe.model import CELLS, Grid, bounded, skeleton, spread
from gridframe.operators.numbering import numbered
from gridframe.operators.selection import clean_name, resolve_axes, value_columns
from gridframe.session import cut_lineage
from gridframe.sources.files import empty_files, listed_files
from gridframe.sources.jsonrows import matrix_rows


def read_cells(spark: SparkSession, path: str, format: str = "parquet", **options) -> DataFrame:
    """Cells from files with the declared schema; NaN and infinite values become NULL. Filters on var, t, y, x reach the scan."""
    reader = spark.read.schema(CELLS).options(**options)
    return reader.format(format).load(path).withColumn("v", finite("v"))


def grid_of(cells: DataFrame, **fields) -> Grid:
    """Wraps dense cells; NaN and infinite values become NULL. Sizes and variables not given are measured with one aggregate."""
    cells = cells.withColumn("v", finite("v"))
    if "shape" not in fields or "variables" not in fields:
        row = cells.agg(
            F.max("t").alias("t"), F.max("y").alias("y"), F.max("x").alias("x"), F.array_sort(F.collect_set("var")).alias("vars")
        ).first()
        fields.setdefault("shape", (row["t"] + 1, row["y"] + 1, row["x"] + 1))
        fields.setdefault("variables", tuple(row["vars"]))
    return Grid(cells, **fields)


def from_points(
    points: DataFrame, variables: Sequence[str], shape: tuple[int, int, int], ids: DataFrame | None = None, **fields
) -> Grid:
    """Grid from points that already carry (grid_id, t, y, x) and a column per variable.

    Points in one cell are averaged. Empty cells are added in the same grouping, so the raw points are
    shuffled once, after map-side averaging; a crowded cell is combined before it moves.
    """
    keys = ["grid_id", "t", "y", "x"]
    wide = points.select(*keys, *[finite(v).alias(v) for v in variables])
    ids = points.select("grid_id").distinct() if ids is None else ids
    gap = {v: F.lit(None).cast("double") for v in variables}
    empty = skeleton(ids, ["-"], shape).withColumns(gap).select(*keys, *variables)
    means = wide.unionByName(empty).groupBy(*keys).agg(*[F.avg(v).alias(v) for v in variables])
    pairs = ", ".join(f"'{v}', `{v}`" for v in variables)
    long = means.selectExpr(*keys, f"stack({len(variables)}, {pairs}) as (var, v)")
    return Grid(long.select("grid_id", "t", "var", "y", "x", "v"), tuple(variables), shape, ids=ids, **fields)


def snapped(coordinate: Column | str, step: float) -> Column:
    """The multiple of ``step`` that a coordinate lies nearest to, halves upwards."""
    c = F.col(coordinate) if isinstance(coordinate, str) else coordinate
    return F.floor(c.cast("double") / step + 0.5) * F.lit(float(step))


def rasterize(
    df: DataFrame,
    values: Sequence[str] | None = None,
    grid_id: str = "grid",
    step: float | tuple[float, float] | None = None,
    most_cells: int | None = 10**11,
    steps: DataFrame | None = None,
    **fields,
) -> Grid:
    """Points with lat, lon and optional time columns (found by alias) become a dense grid.

    Axes are the sorted distinct coordinates. Scattered points, each with coordinates of its own, would span as many rows and columns as there
    are points: ``step`` (a number, or one for lat and one for lon) moves them to the nearest multiple of a cell size first. Points that
    meet in a cell are averaged. A grid of more than ``most_cells`` cells (time x lat x lon) is an error that names the three sizes.

    ``steps`` (grid_id, time) adds steps that may have no points.

    The raw points are read once; the averaged points, far fewer, are kept and feed the axes. Coordinates of all grids and axes are ranked
    in one sort by range partitions, so no task needs all of one grid.
    """
    named = resolve_axes(df)
    if "grid_id" not in named.columns:
        named = named.withColumn("grid_id", F.lit(grid_id))
    timed = "time" in named.columns
    if not timed:
        named = named.withColumn("time", F.lit(None).cast("timestamp"))
    values = list(values or value_columns(named))
    if not values:
        raise ValueError("no numeric value columns")
    if step is not None:
        d_lat, d_lon = step if isinstance(step, tuple) else (step, step)
        named = named.withColumns({"lat": snapped("lat", d_lat), "lon": snapped("lon", d_lon)})
    means = named.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).groupBy("grid_id", "time", "lat", "lon").agg(
        *[F.avg(finite(v)).alias(v) for v in values]
    )
    means = cut_lineage(means)

    # One row per grid, axis and coordinate; unused fields are NULL.
    fields_of = {"t": ("time",), "y": ("lat",), "x": ("lon",)}
    entries = F.array(*[
        F.struct(F.lit(axis).alias("axis"), *[(F.col(c) if c in used else F.lit(None).cast(named.schema[c].dataType)).alias(c) for c in ("time", "lat", "lon")])
        for axis, used in fields_of.items() if timed or axis != "t"
    ])
    places = means.select("grid_id", F.explode(entries).alias("e")).select("grid_id", "e.*").distinct()
    if timed:  # rows without a time have no step
        places = places.where("axis <> 't' OR time IS NOT NULL")
    if steps is not None:
        none = {c: F.lit(None).cast(named.schema[c].dataType) for c in ("lat", "lon")}
        more = steps.select("grid_id", F.lit("t").alias("axis"), F.col("time").cast(named.schema["time"].dataType).alias("time")).withColumns(none)
        places = places.unionByName(more).distinct()
    ranked = numbered(places, ["grid_id", "axis", "time", "lat", "lon"])
    starts = ranked.groupBy("grid_id", "axis").agg(F.min("position").alias("first"), F.count(F.lit(1)).cast("int").alias("n"))
    starts = cut_lineage(starts)
    per_grid = starts.groupBy("grid_id").agg(*[
        F.coalesce(F.max(F.when(F.col("axis") == a, F.col("n"))), F.lit(1)).alias(f"n_{a}") for a in ("t", "y", "x")
    ])
    largest = per_grid.agg(F.max("n_t"), F.max("n_y"), F.max("n_x"), F.count(F.lit(1)), F.max(F.col("n_t").cast("double") * F.col("n_y") * F.col("n_x"))).first()
    if most_cells is not None and (largest[4] or 0) > most_cells:
        raise ValueError(f"a grid would have up to {largest[0]} steps x {largest[1]} rows x {largest[2]} columns, over {most_cells} cells; give a step to snap coordinates to")
    n_grids = largest[3]
    ranks = ranked.join(bounded(starts, 3 * n_grids).drop("n"), ["grid_id", "axis"]).withColumn("i", (F.col("position") - F.col("first")).cast("int"))

    def axis(name: str, coordinate: str) -> DataFrame:
        return ranks.where(F.col("axis") == name).select("grid_id", coordinate, F.col("i").alias(name))

    axis_y, axis_x = axis("y", "lat"), axis("x", "lon")
    indexed = means.join(bounded(axis_y, n_grids * largest[1]), ["grid_id", "lat"]).join(bounded(axis_x, n_grids * largest[2]), ["grid_id", "lon"])
    if timed:
        axis_t = axis("t", "time")
        indexed = indexed.join(bounded(axis_t, n_grids * largest[0]), ["grid_id", "time"])
    else:
        indexed = indexed.withColumn("t", F.lit(0))
        axis_t = per_grid.select("grid_id", F.lit(0).alias("t"), F.lit(None).cast("timestamp").alias("time"))
    stepped = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    lines = per_grid.select("grid_id", "n_y", "n_x", F.explode(stepped("n_t")).alias("t")).select(
        "grid_id", "n_x", "t", F.explode(stepped("n_y")).alias("y")
    )
    spaced = spread(lines, int(largest[4] or 0), "grid_id", "t", "y")
    empty = spaced.select("grid_id", "t", "y", F.explode(stepped("n_x")).alias("x")).withColumns({v: F.lit(None).cast("double") for v in values})
    keys = ["grid_id", "t", "y", "x"]
    wide = indexed.select(*keys, *values).unionByName(empty.select(*keys, *values))
    dense = wide.groupBy(*keys).agg(*[F.max(v).alias(v) for v in values])
    pairs = ", ".join(f"'{v}', `{v}`" for v in values)
    cells = dense.selectExpr(*keys, f"stack({len(values)}, {pairs}) as (var, v)")
    ts = F.try_to_timestamp(F.col("time").cast("string"))
    label = F.coalesce(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.col("time").cast("string"))
    return Grid(
        cells.select("grid_id", "t", "var", "y", "x", "v"), tuple(values), tuple(largest[:3]), dims=per_grid, n_grids=n_grids,
        axis_t=axis_t.select("grid_id", "t", ts.alias("ts"), label.alias("label")),
        axis_y=axis_y.select("grid_id", "y", F.col("lat").cast("double").alias("lat")),
        axis_x=axis_x.select("grid_id", "x", F.col("lon").cast("double").alias("lon")), **fields,
    )


def override_coords(grid: Grid, lat: DataFrame | None = None, lon: DataFrame | None = None, time: DataFrame | None = None) -> Grid:
    """The grid with replaced axis tables (grid_id, y, lat), (grid_id, x, lon), (grid_id, t, ts, label)."""
    changes = {"axis_y": lat, "axis_x": lon, "axis_t": time}
    return grid.with_cells(grid.cells, **{k: v for k, v in changes.items() if v is not None})


# --- matrices in text files -----------------------------------------------------------------------------

def numbered_lines(spark: SparkSession, path: str, glob: str = "*", name: Column | None = None) -> DataFrame:
    """(grid_id, line, txt): the lines of text files with their number, from 0; blank lines at the end of a file are left out.

    A file is read in splits, by as many tasks as it has. Spark numbers rows within a partition; the rows of a split follow each other there, so
    a line's number is its place after the first of its split plus the lines of the splits before, one count per split.
    ``name`` is an expression over ``_metadata`` that names the grid of a file; by default the file name without its suffix.
    """
    rows = spark.read.option("pathGlobFilter", glob).text(path).select(
        (_stem() if name is None else name).alias("grid_id"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"), F.col("value").alias("txt"),
    )
    written = F.max(F.when(F.trim("txt") != "", F.col("_at")))
    splits = rows.groupBy("_file", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"), written.alias("_last"))
    splits = cut_lineage(splits)
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    placed = splits.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first"))
    ends = placed.groupBy("_file").agg(F.max(F.col("_last") + F.col("_offset")).alias("_end"))
    count = splits.count()
    lines = rows.join(bounded(placed.select("_file", "_block", "_offset"), count), ["_file", "_block"]).join(bounded(ends, count), "_file")
    return lines.withColumn("line", F.col("_at") + F.col("_offset")).where(F.col("line") <= F.col("_end")).select("grid_id", "line", "txt")


def matrix_cells(files: DataFrame, text: str = "value", separator: str = ",") -> DataFrame:
    """Cells of comma-separated matrices, one per row of ``files`` (grid_id, text): row = y, column = x.

    Columns with any text that is not a number are dropped, as is a header line.
    """
    lines = files.select("grid_id", F.posexplode(F.split(F.regexp_replace(F.col(text), r"\s+$", ""), r"\r?\n")).alias("line", "txt"))
    return line_cells(lines, separator)


def line_cells(lines: DataFrame, separator: str = ",") -> DataFrame:
    """Cells of matrices given by lines (grid_id, line, txt)."""
    parts = lines.select("grid_id", "line", F.posexplode(F.split("txt", separator)).alias("col", "raw"))
    blank = F.lower(F.trim("raw")).isin("", "nan", "na", "null", "inf", "-inf")
    numbers = parts.withColumn("v", finite(F.expr("try_cast(trim(raw) as double)"))).withColumn("text", F.col("v").isNull() & ~blank)
    # A first line holding any text is a header.
    heads = numbers.where(F.col("line") == 0).groupBy("grid_id").agg(
        F.max(F.when(F.col("text"), 1).otherwise(0)).alias("header")
    )
    body = numbers.join(heads, "grid_id").where(F.col("line") >= F.col("header"))
    columns = body.groupBy("grid_id", "col").agg(F.max("text").alias("text_column")).where(~F.col("text_column"))
    line = Window.partitionBy("grid_id").orderBy("col")
    places = columns.select("grid_id", "col", (F.row_number().over(line) - 1).cast("int").alias("x"))
    return body.join(places, ["grid_id", "col"]).select(
        "grid_id", F.lit(0).alias("t"), F.lit("value").alias("var"), (F.col("line") - F.col("header")).cast("int").alias("y"), "x", "v"
    )


def read_matrix_csv(spark: SparkSession, path: str, glob: str = "*.csv", name: Column | None = None) -> Grid:
    """One grid per file, named by the file name without its suffix or by ``name``; a large file is read by many tasks."""
    return sized(line_cells(numbered_lines(spark, path, glob, name)))


#: Cells of JSON matrices, or why there are none.
JSON_CELLS = f"{CELLS}, error string"


def _json_cells(batches: Iterator[pa.RecordBatch], strict: bool) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in JSON_CELLS.split(", ")]

    def packed(grid_id: str, t: int, first: int, rows: list[list]) -> pa.RecordBatch:
        width = len(rows[0])
        v = np.array([math.nan if x is None else x for r in rows for x in r], dtype=np.float64)
        n = len(v)
        y, x = np.divmod(np.arange(n, dtype=np.int32), np.int32(max(width, 1)))
        bad = ~np.isfinite(v)
        columns = [pa.array([grid_id] * n), pa.array(np.full(n, t, np.int32)), pa.array(["value"] * n), pa.array(y + np.int32(first)), pa.array(x), pa.array(v, mask=bad), pa.nulls(n, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names)

    for batch in batches:
        for grid_id, text in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
            rows, at, first = [], 0, 0
            try:
                for t, y, row in matrix_rows(text or ""):
                    if rows and (t != at or len(rows) * len(row) >= 100_000):
                        yield packed(grid_id, at, first, rows)
                        rows = []
                    if not rows:
                        at, first = t, y
                    rows.append(row)
                if rows:
                    yield packed(grid_id, at, first, rows)
            except ValueError as error:
                if strict:
                    raise ValueError(f"no matrix in {grid_id}: {error}") from None
                columns = [pa.array([grid_id]), *[pa.nulls(1, k) for k in (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.float64())], pa.array([str(error)[:300]])]
                yield pa.RecordBatch.from_arrays(columns, names)


def parse_matrix_json(files: DataFrame, text: str = "value", strict: bool = False) -> DataFrame:
    """Rows of JSON_CELLS for files (grid_id, text): their cells while they are parsed, and a row with ``error`` for a file that
    can't be; with ``strict`` such a file is an error of the job."""
    return files.select("grid_id", F.col(text).alias("text")).mapInArrow(lambda batches: _json_cells(batches, strict), JSON_CELLS)


def matrix_json_cells(files: DataFrame, text: str = "value", skip_unreadable: bool = False) -> DataFrame:
    """Cells of JSON matrices: a bare array, or an object with ``data``, else ``grid``, else ``values``;
    two-dimensional [y][x] or three-dimensional [t][y][x].

    A file that is no such matrix raises an error that names it; with ``skip_unreadable`` it is left out whole (``json_errors`` lists them).
    """
    cells = [f.split()[0] for f in CELLS.split(", ")]
    if not skip_unreadable:
        return parse_matrix_json(files, text, strict=True).select(*cells)
    parsed = cut_lineage(parse_matrix_json(files, text))
    return parsed.where("error IS NULL").join(parsed.where("error IS NOT NULL").select("grid_id"), "grid_id", "left_anti").select(*cells)


def json_errors(files: DataFrame, text: str = "value") -> DataFrame:
    """(grid_id, error) for the files that hold no matrix."""
    return parse_matrix_json(files, text).where("error IS NOT NULL").select("grid_id", "error")


def _json_files(spark: SparkSession, path: str, glob: str, name: Column | None) -> DataFrame:
    grid_id = (_stem() if name is None else name).alias("grid_id")
    written = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True).select(grid_id, "value")
    return written.unionByName(empty_files(spark, path, glob).select(grid_id, F.lit("").alias("value")))


def read_matrix_json(spark: SparkSession, path: str, glob: str = "*.json", skip_unreadable: bool = False, name: Column | None = None) -> Grid:
    """One grid per file (of up to 2 GB), named by the file name without its suffix or by ``name``. See ``matrix_json_cells`` for files that are no matrix."""
    return sized(matrix_json_cells(_json_files(spark, path, glob, name), skip_unreadable=skip_unreadable))


def read_json_errors(spark: SparkSession, path: str, glob: str = "*.json", name: Column | None = None) -> DataFrame:
    """(grid_id, error) for the files that ``read_matrix_json`` can't read."""
    return json_errors(_json_files(spark, path, glob, name))


def sized(cells: DataFrame, **fields) -> Grid:
    """Grid over cells of differing sizes, with a dims table."""
    dims = cells.groupBy("grid_id").agg(
        (F.max("t") + 1).alias("n_t"), (F.max("y") + 1).alias("n_y"), (F.max("x") + 1).alias("n_x")
    )
    largest = dims.agg(F.max("n_t"), F.max("n_y"), F.max("n_x"), F.count(F.lit(1))).first()
    names = fields.pop("variables", ("value",))
    return Grid(cells, tuple(names), tuple(largest[:3]), dims=dims, n_grids=largest[3], **fields)


# --- many files along time ----------------------------------------------------------------------------------

def _stem() -> Column:
    return F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")


def time_of_name(name: Column) -> Column:
    """The first valid date in a file name: yyyymmdd anywhere, else yyyy-mm-dd anywhere."""
    def first(width: int, pattern: str, form: str) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(name) - width + 1))
        tokens = F.filter(F.transform(starts, lambda s: F.substr(name, s, F.lit(width))), lambda k: k.rlike(pattern))
        return F.get(F.filter(F.transform(tokens, lambda k: F.try_to_timestamp(k, F.lit(form))), lambda t: t.isNotNull()), 0)

    return F.coalesce(first(8, r"^\d{8}$", "yyyyMMdd"), first(10, r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"))


#: Stands between the name of a file and its own time in the key of a step.
BETWEEN = "\u0001"


def read_series(
    spark: SparkSession, path: str, schema: str | None = None, format: str = "parquet", glob: str = "*", grid_id: str = "grid", name: Column | None = None,
    step: float | tuple[float, float] | None = None, **options,
) -> Grid:
    """One grid from the files of a folder, one after the other by name along time.

    ``format`` "arrays" takes .npy and .npz files (see ``gridframe.sources.series``). Any other format is a table of points with latitude and longitude, found by
    alias, and numeric columns; all others make no variable. A file is one step, named by the date in its name, else by the name; with a time
    column of its own it has a step for each of its times. Steps come from the listing, so a file without rows keeps its step. ``name`` is an expression over ``_metadata`` that
    names a file; by default the file name without its suffix. Rows of files with equal names belong together. ``step`` snaps coordinates to a cell size.
    """
    if format == "arrays":
        from gridframe.sources.series import array_series

        return array_series(spark, path, glob if glob != "*" else "*.np[yz]", grid_id)
    stem = _stem() if name is None else name
    reader = spark.read.format(format).option("pathGlobFilter", glob).options(**options)
    rows = resolve_axes((reader.schema(schema) if schema else reader).load(path).select("*", stem.alias("_stem")))
    at = F.lit("")
    if "time" in rows.columns:
        at = F.coalesce(F.date_format(F.col("time").cast("string").try_cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.col("time").cast("string"), at)
    key = F.concat("_stem", F.lit(BETWEEN), at)
    values = value_columns(rows)
    points = rows.select(F.lit(grid_id).alias("grid_id"), key.alias("time"), "lat", "lon", *values)
    listed = listed_files(spark, path, glob).select(F.lit(grid_id).alias("grid_id"), F.concat(stem, F.lit(BETWEEN)).alias("time")).distinct()
    grid = rasterize(points, values, step=step, steps=listed if "time" not in rows.columns else _unseen(listed, points))
    parts = F.split("label", BETWEEN)
    own, file = F.nullif(F.get(parts, F.lit(1)), F.lit("")), F.get(parts, F.lit(0))
    ts = F.when(own.isNotNull(), own.try_cast("timestamp")).otherwise(time_of_name(file))
    day = F.when(own.isNotNull() & (F.date_trunc("day", ts) != ts), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(ts, "yyyy-MM-dd"))
    axis_t = cut_lineage(grid.axis_t.select("grid_id", "t", ts.alias("ts"), F.coalesce(day, own, file).alias("label")))
    return grid.with_cells(grid.cells, axis_t=axis_t)


def _unseen(listed: DataFrame, points: DataFrame) -> DataFrame:
    """Files of the listing that have no rows."""
    seen = points.select(F.concat(F.split_part("time", F.lit(BETWEEN), F.lit(1)), F.lit(BETWEEN)).alias("time")).distinct()
    return listed.join(seen, "time", "left_anti").select("grid_id", "time")


def concat_time(grids: Sequence[Grid]) -> Grid:
    """Grids on one pair of space axes, one after the other along time."""
    first, offset, parts, axes = grids[0], 0, [], []
    for g in grids:
        parts.append(g.cells.withColumn("t", F.col("t") + offset))
        axes.append(g.time_axis().withColumn("t", F.col("t") + offset))
        offset += g.shape[0]
    cells, axis = parts[0], axes[0]
    for p, a in zip(parts[1:], axes[1:]):
        cells, axis = cells.unionByName(p), axis.unionByName(a)
    return first.with_cells(cells, shape=(offset, *first.shape[1:]), axis_t=axis)


def renamed(cells: DataFrame, names: Mapping[str, str] | None = None) -> DataFrame:
    """Variable names cleaned of paths and blanks, then mapped."""
    var = clean_name(F.col("var"))
    for old, new in (names or {}).items():
        var = F.when(F.col("var") == old, F.lit(new)).otherwise(var)
    return cells.withColumn("var", var)
