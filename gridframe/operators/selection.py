"""Choosing and reshaping: coordinates, variables, regions, slices, thinning."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridframe.functions import rules
from gridframe.functions.columns import finite, strip
from gridframe.model import MAP, Grid, skeleton


# --- coordinate columns -------------------------------------------------------------------

def match_name(names: Iterable[str], aliases: Sequence[str]) -> str | None:
    """First column equal to an alias, else the first that contains one."""
    names = list(names)
    exact = [n for n in names if n.lower() in aliases]
    partial = [n for n in names if any(a in n.lower() for a in aliases)]
    return (exact + partial + [None])[0]


def resolve_axes(df: DataFrame) -> DataFrame:
    """Renames the coordinate columns to lat, lon and, if there is one, time."""
    found = {
        "lon": match_name(df.columns, rules.LON_NAMES),
        "lat": match_name(df.columns, rules.LAT_NAMES),
        "time": match_name(df.columns, rules.TIME_NAMES),
    }
    if found["lat"] is None or found["lon"] is None:
        raise ValueError("no latitude/longitude columns found")
    return df.withColumnsRenamed({old: new for new, old in found.items() if old is not None})


def value_columns(df: DataFrame) -> list[str]:
    """Numeric columns that are not coordinates."""
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    return [
        name
        for name, kind in df.dtypes
        if name not in ("lat", "lon", "time", "grid_id") and (kind in numeric or kind.startswith("decimal"))
    ]


def clean_name(name: Column) -> Column:
    """Last part of a path, blanks as underscores."""
    return F.regexp_replace(F.element_at(F.split(name, "/"), -1), " ", "_")


def flatten_dims(df: DataFrame, dims: Sequence[str], var: str = "var") -> DataFrame:
    """Extra dimensions become part of the variable name: name[dim=value,...]."""
    parts = [F.concat(F.lit(f"{d}="), F.col(d).cast("string")) for d in dims]
    name = F.concat(F.col(var), F.lit("["), F.concat_ws(",", *parts), F.lit("]"))
    return df.withColumn(var, name).drop(*dims)


def null_fill(cells: DataFrame, fills: Mapping[str, Sequence[float]] | None = None) -> DataFrame:
    """Huge values and each variable's declared fill values become NULL."""
    v = finite("v")
    bad = F.abs(v) > rules.FILL_LIMIT
    for var, values in (fills or {}).items():
        bad = bad | ((F.col("var") == var) & v.isin([float(f) for f in values]))
    return cells.withColumn("v", F.when(~bad, v))


def densify(grid: Grid, ids: DataFrame | None = None) -> Grid:
    """Adds a NULL cell for every missing address.

    Present and empty addresses are stacked and grouped once, which is one shuffle with
    map-side combining, rather than joined.
    """
    ids = grid.cells.select("grid_id").distinct() if ids is None else ids
    empty = skeleton(ids, grid.variables, grid.shape).withColumn("v", F.lit(None).cast("double"))
    cells = grid.cells.select(*empty.columns).unionByName(empty)
    return grid.with_cells(cells.groupBy("grid_id", "t", "var", "y", "x").agg(F.max("v").alias("v")))


# --- variables --------------------------------------------------------------------------------

def missing_variables(requested: DataFrame, available: DataFrame) -> DataFrame:
    """Requested names that are not available."""
    return requested.select("var").distinct().join(available.select("var").distinct(), "var", "left_anti")


def select_vars(grid: Grid, names: Sequence[str] | None) -> Grid:
    """The named variables in the order asked for; an error if one is absent."""
    if not names:
        return grid
    absent = sorted(set(names) - set(grid.variables))
    if absent:
        raise ValueError(f"variables not in grid: {absent}")
    return grid.with_cells(grid.cells.where(F.col("var").isin(list(names))), variables=tuple(names))


def secondary_variable(grid: Grid, chosen: str) -> str | None:
    return next((v for v in grid.variables if v != chosen), None)


def resolve_variable(
    requests: DataFrame,
    variables: Sequence[str],
    text: str = "name",
    aliases: Sequence[tuple[str, str]] = rules.SELECT_ALIASES,
    default: str | None = rules.DEFAULT_VARIABLE,
) -> DataFrame:
    """Adds ``resolved``: exact name, alias, alias inside the text, part of a name, else the default.

    The candidate lists are fixed and small, so the ranked match is one projection: no join.
    """
    fallback = default if default in variables else variables[0]
    name = strip(F.col(text))
    lowered = F.lower(name)
    usable = [(a, v) for a, v in aliases if v in variables]
    exact = F.when(name.isin(list(variables)), name)
    steps = [exact]
    for condition in (lambda a: lowered == a, lambda a: lowered.contains(a)):
        steps += [F.when(condition(a), F.lit(v)) for a, v in usable]
    steps += [F.when(F.lit(v.lower()).contains(lowered), F.lit(v)) for v in variables]
    chosen = F.coalesce(*steps, F.lit(fallback))
    return requests.withColumn("resolved", F.when(name.isNull() | (name == ""), fallback).otherwise(chosen))


def match_available(candidate: Column, variables: Sequence[str]) -> Column:
    """The available name equal to the candidate, else one containing it or contained in it, else NULL."""
    lowered = F.lower(candidate)
    equal = [F.when(lowered == v.lower(), F.lit(v)) for v in variables]
    part = [F.when(F.lit(v.lower()).contains(lowered) | lowered.contains(v.lower()), F.lit(v)) for v in variables]
    return F.coalesce(*equal, *part)


# --- regions ----------------------------------------------------------------------------------

def region_table(spark, boxes: Sequence[tuple] = rules.REGION_BOXES) -> DataFrame:
    schema = "region string, lon_min double, lon_max double, lat_min double, lat_max double"
    return spark.createDataFrame([tuple(b) for b in boxes], schema)


def region_mask(grid: Grid, name: str, boxes: Sequence[tuple] = rules.REGION_BOXES) -> DataFrame:
    """(grid_id, y, x) of the cells in a named box, bounds included; everything for unknown or open boxes.

    The box is applied to the two axis tables; the kept columns of a grid travel as one array and are
    expanded next to each kept row.
    """
    box = next((b for b in boxes if b[0] == name and b[1] is not None), None)
    lat, lon = grid.lat_axis(), grid.lon_axis()
    if box is not None:
        lat = lat.where(F.col("lat").between(box[3], box[4]))
        lon = lon.where(F.col("lon").between(box[1], box[2]))
    columns = lon.groupBy("grid_id").agg(F.collect_list("x").alias("xs"))
    return lat.select("grid_id", "y").join(columns, "grid_id").select("grid_id", "y", F.explode("xs").alias("x"))


def in_region(grid: Grid, df: DataFrame, name: str, boxes: Sequence[tuple] = rules.REGION_BOXES) -> DataFrame:
    """Adds ``in_region`` to rows that carry y and x."""
    box = next((b for b in boxes if b[0] == name and b[1] is not None), None)
    if box is None:
        return df.withColumn("in_region", F.lit(True))
    placed = grid.with_coords(df)
    inside = F.col("lon").between(box[1], box[2]) & F.col("lat").between(box[3], box[4])
    return placed.withColumn("in_region", inside).drop("lat", "lon")


def prepare(
    grid: Grid,
    var: str,
    region: str | None = None,
    mask: DataFrame | None = None,
    boxes: Sequence[tuple] = rules.REGION_BOXES,
) -> Grid:
    """One variable with values outside the valid region and the box set to NULL; no cell is dropped."""
    one = grid.one(var)
    cells = one.cells
    keep = F.lit(True)
    if mask is not None:
        valid = mask.select("grid_id", "y", "x", "valid_region")
        cells = cells.join(valid, ["grid_id", "y", "x"], "left")
        keep = keep & F.coalesce(F.col("valid_region"), F.lit(True))
    cells = in_region(one, cells, region, boxes) if region is not None else cells.withColumn("in_region", F.lit(True))
    keep = keep & F.col("in_region")
    return one.with_cells(cells.withColumns({"v": F.when(keep, F.col("v")), "in_region": keep}).drop("valid_region"))


#: Largest and smallest size, as a power of two, of a band of intervals.
BAND_LEVELS = (-30, 30)


def banded(intervals: DataFrame, low: Column, high: Column) -> tuple[DataFrame, list[int]]:
    """Intervals with ``level`` and ``band``, a row for each of the two or three bands of size 2**level that cover one, and the levels there are.

    The level follows from the length of the interval, so long and short ones make equally few rows. A point lies in
    one band of each level: ``in_bands`` gives them, and an equal band is all a join has to look at.
    """
    least, most = BAND_LEVELS
    length = high - low
    level = F.when(length > 0, F.least(F.greatest(F.ceil(F.log2(length)), F.lit(least)), F.lit(most))).otherwise(F.lit(least)).cast("int")
    sized = intervals.withColumn("level", level)
    unit = F.pow(F.lit(2.0), F.col("level"))
    placed = sized.withColumn("band", F.explode(F.sequence(F.floor(low / unit), F.floor(high / unit))))
    return placed, sorted(r[0] for r in sized.select("level").distinct().collect())


def in_bands(points: DataFrame, at: Column, levels: Sequence[int]) -> DataFrame:
    """Points with ``level`` and ``band``, a row for each of the levels."""
    chosen = F.array(*[F.lit(n) for n in levels]).cast("array<int>")
    return points.withColumn("level", F.explode(chosen)).withColumn("band", F.floor(at / F.pow(F.lit(2.0), F.col("level"))))


def polygon_mask(grid: Grid, rings: DataFrame, band: float | None = None) -> DataFrame:
    """(grid_id, y, x, inside): cells inside a set of rings by the even-odd rule.

    ``rings`` holds one row per edge: lon1, lat1, lon2, lat2. Edges meet rows of the latitude axis through
    latitude bands (an equi-join), and each meeting gives one crossing longitude. Bands have sizes of powers of two, chosen edge by edge, or the
    one size ``band``. A cell is inside if the crossings to its east are odd in number; crossings are accumulated along the row, so the work is
    crossings + cells, not crossings x cells.
    """
    lat, lon = grid.lat_axis(), grid.lon_axis()
    low, high = F.least("lat1", "lat2"), F.greatest("lat1", "lat2")
    leaning = rings.where(F.col("lat1") != F.col("lat2"))
    if band is None:
        edges, levels = banded(leaning, low, high)
        rows = in_bands(lat, F.col("lat"), levels)
    else:
        edges = leaning.select("*", F.lit(0).alias("level"), F.explode(F.sequence(F.floor(low / band), F.floor(high / band))).alias("band"))
        rows = lat.withColumns({"level": F.lit(0), "band": F.floor(F.col("lat") / band)})
    crosses = (F.col("lat1") > F.col("lat")) != (F.col("lat2") > F.col("lat"))
    at = F.col("lon1") + (F.col("lat") - F.col("lat1")) * (F.col("lon2") - F.col("lon1")) / (F.col("lat2") - F.col("lat1"))
    crossings = (
        rows.join(edges, ["level", "band"]).where(crosses)
        .select("grid_id", "y", F.lit(None).cast("int").alias("x"), at.alias("lon"), F.lit(1).alias("crossing"))
    )
    columns = lon.groupBy("grid_id").agg(F.collect_list("x").alias("xs"))
    return lat.select("grid_id", "y").join(columns, "grid_id").select("grid_id", "y", F.explode("xs").alias("x"))


def in_region(grid: Grid, df: DataFrame, name: str, boxes: Sequence[tuple] = rules.REGION_BOXES) -> DataFrame:
    """Adds ``in_region`` to rows that carry y and x."""
    box = next((b for b in boxes if b[0] == name and b[1] is not None), None)
    if box is None:
        return df.withColumn("in_region", F.lit(True))
    placed = grid.with_coords(df)
    inside = F.col("lon").between(box[1], box[2]) & F.col("lat").between(box[3], box[4])
    return placed.withColumn("in_region", inside).drop("lat", "lon")


def prepare(
    grid: Grid,
    var: str,
    region: str | None = None,
    mask: DataFrame | None = None,
    boxes: Sequence[tuple] = rules.REGION_BOXES,
) -> Grid:
    """One variable with values outside the valid region and the box set to NULL; no cell is dropped."""
    one = grid.one(var)
    cells = one.cells
    keep = F.lit(True)
    if mask is not None:
        valid = mask.select("grid_id", "y", "x", "valid_region")
        cells = cells.join(valid, ["grid_id", "y", "x"], "left")
        keep = keep & F.coalesce(F.col("valid_region"), F.lit(True))
    cells = in_region(one, cells, region, boxes) if region is not None else cells.withColumn("in_region", F.lit(True))
    keep = keep & F.col("in_region")
    return one.with_cells(cells.withColumns({"v": F.when(keep, F.col("v")), "in_region": keep}).drop("valid_region"))


def polygon_mask(grid: Grid, rings: DataFrame, band: float = 1.0) -> DataFrame:
    """(grid_id, y, x, inside): cells inside a set of rings by the even-odd rule.

    ``rings`` holds one row per edge: lon1, lat1, lon2, lat2. Edges meet rows of the latitude axis through
    latitude bands (an equi-join), and each meeting gives one crossing longitude. A cell is inside if the
    crossings to its east are odd in number; crossings are accumulated along the row, so the work is
    crossings + cells, not crossings x cells.
    """
    lat, lon = grid.lat_axis(), grid.lon_axis()
    low, high = F.least("lat1", "lat2"), F.greatest("lat1", "lat2")
    bands = F.sequence(F.floor(low / band), F.floor(high / band))
    edges = rings.where(F.col("lat1") != F.col("lat2")).select("*", F.explode(bands).alias("band"))
    crosses = (F.col("lat1") > F.col("lat")) != (F.col("lat2") > F.col("lat"))
    at = F.col("lon1") + (F.col("lat") - F.col("lat1")) * (F.col("lon2") - F.col("lon1")) / (F.col("lat2") - F.col("lat1"))
    crossings = (
        lat.withColumn("band", F.floor(F.col("lat") / band)).join(edges, "band").where(crosses)
        .select("grid_id", "y", F.lit(None).cast("int").alias("x"), at.alias("lon"), F.lit(1).alias("crossing"))
    )
    columns = lon.groupBy("grid_id").agg(F.collect_list(F.struct("x", "lon")).alias("cols"))
    places = (
        lat.select("grid_id", "y").join(columns, "grid_id")
        .select("grid_id", "y", F.explode("cols").alias("c"))
        .select("grid_id", "y", "c.x", "c.lon", F.lit(0).alias("crossing"))
    )
    row = Window.partitionBy("grid_id", "y").orderBy(F.col("lon").desc())
    up_to_here = F.sum("crossing").over(row.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    right_here = F.sum("crossing").over(row.rangeBetween(Window.currentRow, Window.currentRow))
    return (
        places.unionByName(crossings)
        .withColumn("n", up_to_here - right_here)
        .where(F.col("x").isNotNull())
        .select("grid_id", "y", "x", (F.col("n") % 2 == 1).alias("inside"))
    )


# --- slices and thinning ------------------------------------------------------------------------

def text_date(text: Column) -> Column:
    """The first date written in a text, as yyyy-mm-dd; NULL if none."""
    def parts(pattern: str) -> Column:
        y, m, d = (F.regexp_extract(text, pattern, i) for i in (1, 2, 3))
        return F.when(text.rlike(pattern), F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")))

    return F.coalesce(parts(rules.DATE_PATTERN), parts(rules.PLAIN_DATE_PATTERN))


def select_slice(axis_t: DataFrame, requests: DataFrame, text: str = "text") -> DataFrame:
    """For each request (request_id, grid_id, text) the step whose label is the date in the text, else the last."""
    wanted = requests.select(
        "request_id", "grid_id", F.coalesce(text_date(F.col(text)), strip(F.col(text))).alias("label")
    )
    last = axis_t.groupBy("grid_id").agg(F.max("t").alias("last_t"), F.max_by("label", "t").alias("last_label"))
    hits = axis_t.where(F.col("label").isNotNull()).select("grid_id", "label", F.col("t").alias("hit_t"))
    chosen = wanted.join(hits, ["grid_id", "label"], "left").join(last, "grid_id")
    return chosen.select(
        "request_id", "grid_id",
        F.coalesce("hit_t", "last_t").alias("t"),
        F.when(F.col("hit_t").isNotNull(), F.col("label")).otherwise(F.col("last_label")).alias("label"),
    )


def slice_at(grid: Grid, t: int | None = None) -> DataFrame:
    """The map (grid_id, var, y, x, v) of one step, the last one by default."""
    if t is None and grid.dims is not None:
        cells = grid.with_dims(grid.cells).where(F.col("t") == F.col("n_t") - 1)
    else:
        cells = grid.cells.where(F.col("t") == (grid.shape[0] - 1 if t is None else t))
    return cells.select("grid_id", "var", "y", "x", "v")


def downsample(grid: Grid, map_df: DataFrame, limit: int = rules.MAX_MAP_POINTS) -> DataFrame:
    """Every k-th row and column so that at most ``limit`` remain on each axis; rounded for display."""
    placed = grid.with_dims(map_df)
    for axis, size in (("y", "n_y"), ("x", "n_x")):
        step = F.greatest(F.lit(1), F.ceil(F.col(size) / limit).cast("int"))
        placed = placed.where(F.col(axis) % step == 0)
    return placed.withColumn("v", finite("v", 5)).drop("n_t", "n_y", "n_x")


def thin(grid: Grid, pairs: DataFrame, limit: int = rules.MAX_SCATTER_POINTS) -> DataFrame:
    """Every k-th row in raster order, k = rows div limit, where there are more than ``limit`` rows.

    Positions come from counts per (grid, step, row) accumulated over a small table plus a number inside
    one row, so no window spans a grid.
    """
    raster_rows = pairs.groupBy("grid_id", "t", "y").agg(F.count(F.lit(1)).alias("n"))
    steps = raster_rows.groupBy("grid_id", "t").agg(F.sum("n").alias("n_step"))
    before_t = Window.partitionBy("grid_id").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    before_y = Window.partitionBy("grid_id", "t").orderBy("y").rowsBetween(Window.unboundedPreceding, -1)
    step_offsets = steps.select("grid_id", "t", F.coalesce(F.sum("n_step").over(before_t), F.lit(0)).alias("t_offset"))
    totals = steps.groupBy("grid_id").agg(F.sum("n_step").alias("total"))
    offsets = (
        raster_rows.withColumn("y_offset", F.coalesce(F.sum("n").over(before_y), F.lit(0)))
        .join(step_offsets, ["grid_id", "t"])
        .join(totals, "grid_id")
        .select("grid_id", "t", "y", (F.col("t_offset") + F.col("y_offset")).alias("offset"), "total")
    )
    inner = F.row_number().over(Window.partitionBy("grid_id", "t", "y").orderBy("x")) - 1
    every = F.when(F.col("total") > limit, F.greatest(F.lit(1), F.floor(F.col("total") / limit))).otherwise(F.lit(1))
    return (
        pairs.withColumn("inner", inner)
        .join(offsets, ["grid_id", "t", "y"])
        .where((F.col("offset") + F.col("inner")) % every == 0)
        .drop("inner", "offset", "total")
    )
