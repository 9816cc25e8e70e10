"""Grids from array files: .npy and .npz, one file per grid, decoded inside tasks.

A first pass reads the headers and the coordinate arrays alone and yields them as rows; names, sizes and axes of the grid come
from that table. Values are decoded by a second pass, one array at a time.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridframe.functions import rules
from gridframe.model import CELLS, Grid
from gridframe.operators.selection import match_name
from gridframe.session import cut_lineage

#: A row per array: its axes as letters (t, v, y, x; one letter for coordinates), its lengths, and the values of coordinates.
HEADS = "grid_id string, member string, var string, axes string, n_t int, n_y int, n_x int, values array<double>, labels array<string>"
_HEADS = pa.schema(
    [*((c, pa.string()) for c in ("grid_id", "member", "var", "axes")), *((c, pa.int32()) for c in ("n_t", "n_y", "n_x")), ("values", pa.list_(pa.float64())), ("labels", pa.list_(pa.string()))]
)
#: Cells, or coordinates, of small files that are handed on together; a larger slice goes alone.
TOGETHER = 1 << 16


def axis_letters(shape: tuple[int, ...], n_y: int, n_x: int, n_t: int) -> str:
    """Which axis is which, one letter each, told apart by the known lengths (0 where unknown)."""
    known = {"y": n_y, "x": n_x, "t": n_t}
    for letters, must in (("yx", ""), ("tyx", "yx"), ("yxt", "yx"), ("tyx", "t")):
        if len(letters) == len(shape) and all(known[a] and known[a] == n for a, n in zip(letters, shape, strict=True) if a in must):
            return letters
    raise ValueError(f"cannot tell the axes of an array of shape {shape}")


def _shape(stream) -> tuple[int, ...]:
    """Shape in the header of an array; its values are not read."""
    read = np.lib.format.read_array_header_1_0 if np.lib.format.read_magic(stream) == (1, 0) else np.lib.format.read_array_header_2_0
    return read(stream)[0]


def _members(content: bytes) -> dict[str, Callable]:
    """Array names of a .npz file and what opens them; one without a name for .npy."""
    source = io.BytesIO(content)
    if not zipfile.is_zipfile(source):
        return {"": partial(io.BytesIO, content)}
    packed = zipfile.ZipFile(source)
    return {place.removesuffix(".npy"): partial(packed.open, place) for place in packed.namelist()}


def _values(member: Callable) -> np.ndarray:
    with member() as stream:
        return np.lib.format.read_array(stream, allow_pickle=False)


def _heads(path: str, members: dict[str, Callable]) -> list[dict]:
    """Rows of HEADS for one file, coordinates first."""
    grid_id = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    shapes = {}
    for name, member in members.items():
        with member() as stream:
            shapes[name] = _shape(stream)
    rows, lengths = [], {"y": 0, "x": 0, "t": 0}
    for axis, aliases in (("x", rules.LON_NAMES), ("y", rules.LAT_NAMES), ("t", rules.TIME_NAMES)):
        name = match_name([n for n in members if n], aliases)
        if not name:
            continue
        found = _values(members[name])
        shapes.pop(name, None)
        # Coordinates given for every cell: the first row or column has the axis.
        found = found[:, 0] if found.ndim == 2 and axis == "y" else found.reshape(-1, found.shape[-1])[0] if found.ndim > 1 else np.atleast_1d(found)
        lengths[axis] = len(found)
        plain = found.astype(float).tolist() if axis != "t" else None
        labels = (np.datetime_as_string(found, unit="s").tolist() if found.dtype.kind == "M" else found.astype(str).tolist()) if axis == "t" else None
        rows.append({"grid_id": grid_id, "member": name, "var": name, "axes": axis, "n_t": None, "n_y": None, "n_x": None, "values": plain, "labels": labels})
    fields = {n: s for n, s in shapes.items() if len(s) >= 2}
    if not fields:
        raise ValueError(f"no arrays of two or more dimensions in {path}")
    first = next(iter(fields.values()))
    for name, shape in fields.items():
        if name:
            letters = axis_letters(shape, lengths["y"] or first[-2], lengths["x"] or first[-1], lengths["t"])
        elif len(shape) > 4:
            raise ValueError(f"{path} has more than four dimensions")
        else:
            letters = "tvyx" if len(shape) == 4 else "tyx"[-len(shape):]
        size = dict(zip(letters, shape, strict=True))
        var = name.rsplit("/", 1)[-1].replace(" ", "_") or "value"
        for v in [f"var_{i}" for i in range(size["v"])] if "v" in size else [var]:
            rows.append({"grid_id": grid_id, "member": name, "var": v, "axes": letters, "n_t": size.get("t", 1), "n_y": size["y"], "n_x": size["x"], "values": None, "labels": None})
    return rows


def array_heads(files: DataFrame) -> DataFrame:
    """Names, axes, sizes and coordinates of array files given as (path, content)."""

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for path, content in _files(batches):
            for row in _heads(path, _members(content)):
                rows.append(row)
                held += 1 + len(row["values"] or row["labels"] or ())
            if held >= TOGETHER:
                yield pa.RecordBatch.from_pylist(rows, _HEADS)
                rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, _HEADS)

    return files.select("path", "content").mapInArrow(heads, HEADS)


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for batch in batches:
        for path, content in zip(*batch.columns, strict=True):
            yield path.as_py(), content.as_py()


@lru_cache(4)
def _places(n_y: int, n_x: int) -> tuple[np.ndarray, np.ndarray]:
    y, x = np.indices((n_y, n_x), dtype=np.int32)
    return y.ravel(), x.ravel()


def _together(slices: list[tuple[str, int, str, np.ndarray]]) -> pa.RecordBatch:
    """Cells of some slices, given as (grid_id, t, var, values)."""
    ids, steps, names, fields = zip(*slices, strict=True)
    at = np.repeat(np.arange(len(fields)), [f.size for f in fields])
    y, x = (np.concatenate(c) for c in zip(*(_places(*f.shape) for f in fields), strict=True))
    values = np.concatenate([f.ravel() for f in fields])
    columns = [pa.array(ids, pa.string()).take(pa.array(at)), pa.array(np.array(steps, np.int32)[at]), pa.array(names, pa.string()).take(pa.array(at)), pa.array(y), pa.array(x)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(values, mask=~(np.abs(values) <= rules.FILL_LIMIT))], ["grid_id", "t", "var", "y", "x", "v"])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for path, content in _files(batches):
        members = _members(content)
        member, array = None, None
        for head in _heads(path, members):
            letters = head["axes"]
            if len(letters) == 1:
                continue
            if head["member"] != member:
                member, array = head["member"], _values(members[head["member"]])
            part = array.transpose([letters.index(a) for a in "vtyx" if a in letters]).reshape(-1, head["n_t"], head["n_y"], head["n_x"])
            for t, field in enumerate(part[int(head["var"].removeprefix("var_")) if "v" in letters else 0]):
                held.append((head["grid_id"], t, head["var"], field.astype(float)))
                n += field.size
                if n >= TOGETHER:
                    yield _together(held)
                    held, n = [], 0
    if held:
        yield _together(held)


def array_cells(files: DataFrame) -> DataFrame:
    """Cells of array files given as (path, content). A task decodes one array at a time and yields slice by slice, small slices together."""
    return files.select("path", "content").mapInArrow(_cells, CELLS)


def read_arrays(spark: SparkSession, path: str, glob: str = "*.np[yz]") -> Grid:
    """One grid per .npy or .npz file: [y, x], [t, y, x] or [t, variable, y, x]; in .npz, coordinates and times by name."""
    return arrays_grid(spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path))


def arrays_grid(files: DataFrame) -> Grid:
    """Grid of array files given as (path, content).

    Latitude, longitude and time arrays become the axes of their grid. A file without one keeps indexes there; times that are no
    dates keep their text as the label of the step. The driver sees the variable names and the largest sizes.
    """
    heads = cut_lineage(array_heads(files))
    fields = heads.where(F.length("axes") > 1)
    dims = fields.groupBy("grid_id").agg(F.max("n_t").alias("n_t"), F.max("n_y").alias("n_y"), F.max("n_x").alias("n_x"))
    largest = dims.agg(F.max("n_t"), F.max("n_y"), F.max("n_x"), F.count(F.lit(1))).first()
    names = fields.agg(F.array_sort(F.collect_set("var"))).first()[0]
    with_axis = {r["axes"] for r in heads.where(F.length("axes") == 1).select("axes").distinct().collect()}

    def axis(letter: str, column: str) -> DataFrame:
        given = heads.where(F.col("axes") == letter).select("grid_id", column)
        steps = F.posexplode(F.sequence(F.lit(0), F.col(f"n_{letter}") - 1)).alias(letter, "_i")
        return dims.join(given, "grid_id", "left").select("grid_id", column, steps).withColumn("found", F.get(column, F.col(letter)))

    axes = {}
    for letter, name in (("y", "lat"), ("x", "lon")):
        if letter in with_axis:
            axes[f"axis_{letter}"] = axis(letter, "values").select("grid_id", letter, F.coalesce("found", F.col(letter).cast("double")).alias(name))
    if "t" in with_axis:
        # Plain numbers are no dates.
        ts = F.when(F.col("found").rlike(r"^\d{4}-\d"), F.col("found").try_cast("timestamp"))
        dated = axis("t", "labels").withColumn("ts", ts)
        axes["axis_t"] = dated.select("grid_id", "t", "ts", F.coalesce(F.date_format("ts", "yyyy-MM-dd"), "found").alias("label"))
    return Grid(array_cells(files), tuple(names), tuple(largest[:3]), dims=dims, n_grids=largest[3], **axes)


def array_axes(files: DataFrame) -> DataFrame:
    """(grid_id, axis, i, value): latitude and longitude arrays found in .npz files."""
    name = F.when(F.col("axes") == "y", "lat").otherwise("lon").alias("axis")
    return array_heads(files).where("axes IN ('y', 'x')").select("grid_id", name, F.posexplode("values").alias("i", "value"))
