"""Many array files along time as one grid; only the members and steps that are asked for are opened.

A first job reads headers and coordinates, not values. It gives a plan, a table of strips of maps: step, variable, file, member and the place in it. The
cells are this table with the values that a function reads for each strip. Step and variable are columns of the plan, so Spark applies filters
on ``t`` and ``var`` to it before anything is read; a task seeks to its strips. Files are opened through pyarrow's file systems (shared
mounts, object stores, HDFS). A Python data source with filter pushdown would say the same, but in Spark 4.1 it keeps the filters
of one scan for the next scan of the same table.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gridframe.functions import rules
from gridframe.model import Grid
from gridframe.operators.numbering import numbered
from gridframe.operators.selection import match_name
from gridframe.session import cut_lineage
from gridframe.sources.arrays import axis_letters
from gridframe.sources.files import file_system, listed_files

#: Cells of a partition of the plan, and of a strip, about; a strip has one row of a map at least.
CELLS_PER_PARTITION, STRIP = 1 << 20, 1 << 16

#: A row per member and variable of a file, or per coordinate; ``error`` names why a file holds no arrays.
HEADS = "path string, member string, var string, axes string, n_t int, n_y int, n_x int, values array<double>, labels array<string>, error string"


class Member:
    """One array of an open .npy or .npz file; steps are read without the rest where the layout allows it."""

    def __init__(self, file, place: str):
        self.stream = zipfile.ZipFile(file).open(place) if place else file
        version = np.lib.format.read_magic(self.stream)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        self.shape, self.fortran, self.dtype = read(self.stream)
        self.start = self.stream.tell()

    def whole(self) -> np.ndarray:
        if self.dtype.hasobject:
            raise ValueError("arrays of objects are not read")
        self.stream.seek(self.start)
        flat = np.frombuffer(self.stream.read(self.dtype.itemsize * int(np.prod(self.shape, dtype=np.int64))), self.dtype)
        return flat.reshape(self.shape, order="F" if self.fortran else "C")

    def strip(self, letters: str, t: int, v: int, top: int, rows: int) -> np.ndarray:
        """Rows of the map [y, x] of step t and variable v."""
        lead = [{"t": t, "v": v}[a] for a in letters[:-2]] if letters.endswith("yx") else None
        if lead is None or self.fortran or self.dtype.hasobject:
            index = tuple({"t": t, "v": v}.get(a, slice(None)) for a in letters)
            return self.whole()[index][top : top + rows]
        at = 0
        for place, size in zip(lead, self.shape, strict=False):
            at = at * size + place
        height, width = self.shape[-2:]
        self.stream.seek(self.start + (at * height + top) * width * self.dtype.itemsize)
        return np.frombuffer(self.stream.read(rows * width * self.dtype.itemsize), self.dtype).reshape(rows, width)


def _places(file) -> dict[str, str]:
    """Array names and their places in an archive; one without a name for a plain array."""
    if not zipfile.is_zipfile(file):
        file.seek(0)
        return {"": ""}
    return {place.removesuffix(".npy"): place for place in zipfile.ZipFile(file).namelist()}


def file_heads(path: str, file) -> list[tuple]:
    """Rows of HEADS of one file."""
    places = _places(file)
    shapes, rows, lengths = {}, [], {"y": 0, "x": 0, "t": 0}
    for name, place in places.items():
        file.seek(0)
        shapes[name] = Member(file, place).shape
    for axis, aliases in (("x", rules.LON_NAMES), ("y", rules.LAT_NAMES), ("t", rules.TIME_NAMES)):
        name = match_name([n for n in places if n], aliases)
        if not name:
            continue
        found = np.atleast_1d(Member(file, places[name]).whole())
        shapes.pop(name, None)
        if found.ndim > 1:  # given for every cell: the first column or row has the axis
            found = found[:, 0] if axis == "y" else found.reshape(-1, found.shape[-1])[0]
        lengths[axis] = len(found)
        text = None if axis != "t" else (np.datetime_as_string(found, unit="s") if found.dtype.kind == "M" else found.astype(str)).tolist()
        rows.append((path, name, name, axis, None, None, None, found.astype(float).tolist() if axis != "t" else None, text, None))
    fields = {n: s for n, s in shapes.items() if len(s) >= 2}
    if not fields:
        raise ValueError("no arrays of two or more dimensions")
    first = next(iter(fields.values()))
    for name, shape in fields.items():
        if name:
            letters = axis_letters(shape, lengths["y"] or first[-2], lengths["x"] or first[-1], lengths["t"])
        elif len(shape) > 4:
            raise ValueError("more than four dimensions")
        else:
            letters = "tvyx" if len(shape) == 4 else "tyx"[-len(shape):]
        size = dict(zip(letters, shape, strict=True))
        var = name.rsplit("/", 1)[-1].replace(" ", "_") or "value"
        for v in [f"var_{i}" for i in range(size["v"])] if "v" in size else [var]:
            rows.append((path, places[name], v, letters, size.get("t", 1), size["y"], size["x"], None, None, None))
    return rows


def series_heads(files: DataFrame) -> DataFrame:
    """HEADS of the files named in ``path``; a file that can't be read, an empty one too, has one row with ``error``."""

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (*[pa.string()] * 4, *[pa.int32()] * 3, pa.list_(pa.float64()), pa.list_(pa.string()), pa.string())
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    system, place = file_system(path)
                    with system.open_input_file(place) as file:
                        rows = file_heads(path, file)
                except (ValueError, EOFError, zipfile.BadZipFile) as error:
                    rows = [(path, *[None] * 8, str(error)[:300])]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in HEADS.split(", ")])

    return files.select("path").mapInArrow(heads, HEADS)


def _maps(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    """Values of strips (path, member, axes, step, variable, first row, rows, columns), NaN where there is no file for them."""
    opened, member, source = None, None, None
    for batch in batches:
        out = []
        for path, place, letters, step, v, top, rows, columns in zip(*batch, strict=True):
            if path is None:
                out.append(np.full(rows * columns, np.nan))
                continue
            if (path, place) != source:
                if opened is not None:
                    opened.close()
                system, inner = file_system(path)
                opened = system.open_input_file(inner)
                member, source = Member(opened, place), (path, place)
            out.append(member.strip(letters, int(step), int(v), int(top), int(rows)).astype(np.float64).ravel())
        yield pd.Series(out, dtype=object)
    if opened is not None:
        opened.close()


def array_series(spark: SparkSession, path: str, glob: str = "*.np[yz]", grid_id: str = "grid", time_of: Column | None = None) -> Grid:
    """One grid of all array files of a folder, one after the other by file name.

    A file has one step, or as many as its time axis; times of its own name its steps, else the date in its file name does, else the name. A file that holds no
    arrays, an empty one too, keeps its step with all values missing, as does a variable that a file lacks. Files whose maps differ in size are an
    error that names them. Latitude and longitude are those of the first file that has them.
    """
    from gridframe.sources.tabular import time_of_name

    heads = cut_lineage(series_heads(listed_files(spark, path, glob, recursive=True)))
    fields = heads.where(F.length("axes") > 1)
    sizes = fields.agg(F.max("n_y"), F.max("n_x"), F.min_by("path", "path"), F.array_sort(F.collect_set("var"))).first()
    if not sizes[3]:
        raise ValueError(f"no arrays in {path}")
    n_y, n_x, names = sizes[0], sizes[1], sizes[3]
    other = fields.where((F.col("n_y") != n_y) | (F.col("n_x") != n_x)).agg(F.min("path"), F.count_distinct("path")).first()
    if other[1]:
        raise ValueError(f"{other[1]} files have maps of another size than {n_y} x {n_x}, the first is {other[0]}")

    # Steps of the files in order of their names, then the entry of each step and variable.
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    own = heads.where("axes = 't'").select("path", "labels")
    per_file = heads.groupBy("path").agg(F.greatest(F.coalesce(F.max("n_t"), F.lit(1)), F.lit(1)).alias("steps")).join(own, "path", "left")
    before = Window.orderBy("stem", "path").rowsBetween(Window.unboundedPreceding, -1)
    placed = per_file.withColumn("stem", stem).withColumn("first", F.coalesce(F.sum("steps").over(before), F.lit(0)).cast("int"))
    placed = cut_lineage(placed)
    steps = placed.select("path", "stem", "labels", "first", F.explode(F.sequence(F.lit(0), F.col("steps") - 1)).alias("step"))
    label = F.get("labels", F.col("step"))
    named = time_of_name(F.col("stem")) if time_of is None else time_of
    ts = F.when(label.rlike(r"^\d{4}-\d"), label.try_cast("timestamp")).when(label.isNull(), named)
    axis_t = steps.select(
        F.lit(grid_id).alias("grid_id"), (F.col("first") + F.col("step")).alias("t"), ts.alias("ts"),
        F.coalesce(F.when(label.isNull() | ts.isNotNull(), F.date_format(ts, "yyyy-MM-dd")), label, F.col("stem")).alias("label"),
    )
    axis_t = cut_lineage(axis_t)
    count = axis_t.count()
    every = steps.select("path", "first", "step", F.explode(F.lit(list(names))).alias("var"))
    v = F.when(F.col("axes").contains("v"), F.regexp_extract("var", r"(\d+)$", 1).cast("int")).otherwise(F.lit(0))
    entries = every.join(fields.select("path", "var", "member", "axes", "n_t"), ["path", "var"], "left").withColumn("there", F.col("step") < F.col("n_t"))
    given = lambda c: F.when(F.col("there"), c)
    rows = max(1, STRIP // max(1, n_x))
    plan = entries.select(
        F.lit(grid_id).alias("grid_id"), (F.col("first") + F.col("step")).alias("t"), "var", given(F.col("path")).alias("path"), given(F.col("member")).alias("member"),
        given(F.col("axes")).alias("axes"), "step", v.alias("v"), F.explode(F.sequence(F.lit(0), F.lit(max(n_y - 1, 0)), F.lit(rows))).alias("top"),
    ).withColumn("rows", F.least(F.lit(rows), n_y - F.col("top")))
    # Neighbouring strips share a partition, so that a task opens few files and returns a bounded number of cells.
    pieces = -(-count * len(names) * -(-n_y // rows) // max(1, CELLS_PER_PARTITION // STRIP))
    placed_strips = numbered(plan, ["path", "member", "step", "v", "top"], "_at")
    size = max(1, CELLS_PER_PARTITION // STRIP)
    plan = cut_lineage(placed_strips.repartitionById(pieces, F.floor(F.col("_at") / size).cast("int")).drop("_at"))
    read = F.pandas_udf(_maps, "array<double>")
    strips = plan.select("grid_id", "t", "var", "top", read("path", "member", "axes", "step", "v", "top", "rows", F.lit(n_x)).alias("values"))
    # The outer form: else Spark would ask for the size of the values first, and read them twice.
    cells = strips.select("grid_id", "t", "var", "top", F.posexplode_outer("values").alias("i", "raw")).select(
        "grid_id", "t", "var", (F.col("top") + F.floor(F.col("i") / n_x)).cast("int").alias("y"), (F.col("i") % n_x).alias("x"),
        F.when(F.abs("raw") <= rules.FILL_LIMIT, F.col("raw")).alias("v"),
    )

    def axis(letter: str, column: str, name: str, size: int) -> DataFrame | None:
        found = heads.where(F.col("axes") == letter).orderBy("path").limit(1).select("values").first()
        if found is None:
            return None
        if len(found[0]) != size:
            raise ValueError(f"{len(found[0])} values of {name} for maps of {size}")
        return spark.createDataFrame([(grid_id, i, float(c)) for i, c in enumerate(found[0])], f"grid_id string, {letter} int, {name} double")

    return Grid(
        cells, tuple(names), (count, n_y, n_x), n_grids=1, axis_t=axis_t, axis_y=axis("y", "values", "lat", n_y), axis_x=axis("x", "values", "lon", n_x),
        ids=spark.range(1).select(F.lit(grid_id).alias("grid_id")),
    )
