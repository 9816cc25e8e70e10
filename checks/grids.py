"""Grids derived from the given tables, and the same grids as SQL.

Prices, discounts and taxes are taken in hundredths so that sums are exact in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridframe.model import Grid
from gridframe.sources.tabular import from_points

L_SHAPE = (28, 50, 40)
E_SHAPE = (30, 8, 16)
L3_VARS = ("price", "discount", "tax")
E_VARS = ("click", "error", "purchase", "signup", "view")
BOXES = (("core", 5.0, 30.0, 10.0, 40.0), ("corner", 0.0, 9.0, 0.0, 9.0), ("none", None, None, None, None))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_id(spark: SparkSession, grid_id: str) -> DataFrame:
    return spark.range(1).select(F.lit(grid_id).alias("grid_id"))


def line_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = lambda c: F.round(F.col(c) * 100)
    return table(spark, sf_dir, "lineitem").select(
        F.lit("L").alias("grid_id"),
        ((F.year("l_shipdate") - 1995) * 4 + F.quarter("l_shipdate") - 1).alias("t"),
        (F.col("l_quantity").cast("int") - 1).alias("y"), (F.col("l_suppkey") % 40).cast("int").alias("x"),
        cents("l_extendedprice").alias("price"), cents("l_discount").alias("discount"), cents("l_tax").alias("tax"),
    )


def quarter_axis(spark: SparkSession, grid_id: str) -> DataFrame:
    ts = F.add_months(F.lit("1995-01-01").cast("date"), (F.col("id") * 3).cast("int"))
    return spark.range(L_SHAPE[0]).select(
        F.lit(grid_id).alias("grid_id"), F.col("id").cast("int").alias("t"), ts.cast("timestamp").alias("ts"),
        F.date_format(ts, "yyyy-MM-dd").alias("label"),
    )


def day_axis(spark: SparkSession, grid_id: str) -> DataFrame:
    ts = F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int"))
    return spark.range(E_SHAPE[0]).select(
        F.lit(grid_id).alias("grid_id"), F.col("id").cast("int").alias("t"), ts.cast("timestamp").alias("ts"),
        F.date_format(ts, "yyyy-MM-dd").alias("label"),
    )


def grid_l(spark: SparkSession, sf_dir: str) -> Grid:
    points = line_points(spark, sf_dir)
    return from_points(points, ["price"], L_SHAPE, one_id(spark, "L"), axis_t=quarter_axis(spark, "L"), n_grids=1, units={"price": "cent"})


def grid_y(spark: SparkSession, sf_dir: str) -> Grid:
    """Prices by year: as grid L with seven steps and few gaps."""
    points = line_points(spark, sf_dir).withColumns({"grid_id": F.lit("Y"), "t": F.floor(F.col("t") / 4).cast("int")})
    return from_points(points, ["price"], (7, 50, 40), one_id(spark, "Y"), n_grids=1, units={"price": "cent"})


def grid_ly(spark: SparkSession, sf_dir: str) -> Grid:
    """Grids L and Y in one: 28 and 7 steps."""
    quarters, years = grid_l(spark, sf_dir), grid_y(spark, sf_dir)
    dims = spark.createDataFrame([("L", *L_SHAPE), ("Y", 7, 50, 40)], "grid_id string, n_t int, n_y int, n_x int")
    return Grid(quarters.cells.unionByName(years.cells), ("price",), L_SHAPE, dims=dims, n_grids=2)


def grid_l3(spark: SparkSession, sf_dir: str) -> Grid:
    points = line_points(spark, sf_dir)
    return from_points(points, L3_VARS, L_SHAPE, one_id(spark, "L"), axis_t=quarter_axis(spark, "L"), n_grids=1, units={"price": "cent"})


def grid_f(spark: SparkSession, sf_dir: str) -> Grid:
    """Grid L where a fifth of the cells falls silent after the fourth quarter."""
    seen = ((F.col("y") * 7 + F.col("x") * 13) % 5 != 0) | (F.col("t") < 4)
    points = line_points(spark, sf_dir).withColumn("price", F.when(seen, F.col("price")))
    return from_points(points, ["price"], L_SHAPE, one_id(spark, "L"), axis_t=quarter_axis(spark, "L"), n_grids=1)


def grid_e(spark: SparkSession, sf_dir: str) -> Grid:
    points = table(spark, sf_dir, "events").select(
        F.lit("E").alias("grid_id"), F.datediff("ts", F.lit("2024-01-01")).alias("t"), "event_type",
        F.floor(F.hour("ts") / 3).cast("int").alias("y"), (F.col("user_id") % 16).cast("int").alias("x"),
        F.round(F.col("value") * 100).alias("value"),
    )
    wide = points.select("grid_id", "t", "y", "x", *[F.when(F.col("event_type") == v, F.col("value")).alias(v) for v in E_VARS])
    return from_points(wide, E_VARS, E_SHAPE, one_id(spark, "E"), axis_t=day_axis(spark, "E"), n_grids=1)


def grid_i(spark: SparkSession, sf_dir: str) -> Grid:
    """One 8 by 8 grid per embedding."""
    pixels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("grid_id"), F.posexplode("embedding").alias("i", "e"))
    cells = pixels.select(
        "grid_id", F.lit(0).alias("t"), F.lit("intensity").alias("var"), F.floor(F.col("i") / 8).cast("int").alias("y"),
        (F.col("i") % 8).cast("int").alias("x"), F.round(F.col("e").cast("double") * 255, 3).alias("v"),
    )
    return Grid(cells, ("intensity",), (1, 8, 8), grid_type="image", coordinate_system="pixel", crs="pixel_coordinates")


def grid_rgb(spark: SparkSession, sf_dir: str) -> Grid:
    """Embeddings in threes as colour grids, values shifted to 0..255 and rounded."""
    channel = F.get(F.array(F.lit("red"), F.lit("green"), F.lit("blue")), (F.col("vec_id") % 3).cast("int"))
    pixels = table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 3).cast("string").alias("grid_id"), channel.alias("var"), F.posexplode("embedding").alias("i", "e")
    )
    level = F.least(F.greatest(F.round(127.5 + F.col("e").cast("double") * 212.5), F.lit(0.0)), F.lit(255.0))
    cells = pixels.select(
        "grid_id", F.lit(0).alias("t"), "var", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).cast("int").alias("x"), level.alias("v")
    )
    return Grid(cells, ("red", "green", "blue"), (1, 8, 8), grid_type="image", coordinate_system="pixel", crs="pixel_coordinates")


# --- the same grids in SQL ----------------------------------------------------------------------------------------

_POINTS = """
pts AS (
  SELECT CAST((year(l_shipdate) - 1995) * 4 + quarter(l_shipdate) - 1 AS INT) AS t, CAST(l_quantity AS INT) - 1 AS y,
         CAST(l_suppkey % 40 AS INT) AS x, round(l_extendedprice * 100) AS price, round(l_discount * 100) AS discount,
         round(l_tax * 100) AS tax
  FROM lineitem),
addr AS (
  SELECT CAST(t.range AS INT) AS t, CAST(y.range AS INT) AS y, CAST(x.range AS INT) AS x
  FROM range(28) t, range(50) y, range(40) x)"""

SQL_L = _POINTS + """,
cells AS (
  SELECT 'L' AS grid_id, a.t, 'price' AS var, a.y, a.x, p.v
  FROM addr a LEFT JOIN (SELECT t, y, x, avg(price) AS v FROM pts GROUP BY t, y, x) p USING (t, y, x))"""

SQL_Y = _POINTS + """,
cells AS (
  SELECT 'Y' AS grid_id, a.t, 'price' AS var, a.y, a.x, p.v
  FROM (SELECT * FROM addr WHERE t < 7) a LEFT JOIN (SELECT t // 4 AS t, y, x, avg(price) AS v FROM pts GROUP BY t // 4, y, x) p USING (t, y, x))"""

SQL_LY = _POINTS + """,
cells AS (
  SELECT 'L' AS grid_id, a.t, 'price' AS var, a.y, a.x, p.v
  FROM addr a LEFT JOIN (SELECT t, y, x, avg(price) AS v FROM pts GROUP BY t, y, x) p USING (t, y, x)
  UNION ALL SELECT 'Y' AS grid_id, a.t, 'price' AS var, a.y, a.x, p.v
  FROM (SELECT * FROM addr WHERE t < 7) a LEFT JOIN (SELECT t // 4 AS t, y, x, avg(price) AS v FROM pts GROUP BY t // 4, y, x) p USING (t, y, x))"""

SQL_F = _POINTS + """,
cells AS (
  SELECT 'L' AS grid_id, a.t, 'price' AS var, a.y, a.x, p.v
  FROM addr a LEFT JOIN (
    SELECT t, y, x, avg(CASE WHEN (y * 7 + x * 13) % 5 <> 0 OR t < 4 THEN price END) AS v FROM pts GROUP BY t, y, x) p USING (t, y, x))"""

SQL_L3 = _POINTS + """,
agg3 AS (SELECT t, y, x, avg(price) AS price, avg(discount) AS discount, avg(tax) AS tax FROM pts GROUP BY t, y, x),
wide AS (SELECT a.t, a.y, a.x, price, discount, tax FROM addr a LEFT JOIN agg3 USING (t, y, x)),
cells AS (
  SELECT 'L' AS grid_id, t, 'price' AS var, y, x, price AS v FROM wide
  UNION ALL SELECT 'L', t, 'discount', y, x, discount FROM wide
  UNION ALL SELECT 'L', t, 'tax', y, x, tax FROM wide)"""

SQL_E = """
pts AS (
  SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS t, event_type AS var,
         CAST(hour(ts) // 3 AS INT) AS y, CAST(user_id % 16 AS INT) AS x, round(value * 100) AS v
  FROM events),
names AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS var, unnest([0, 1, 2, 3, 4]) AS pos),
addr AS (
  SELECT CAST(t.range AS INT) AS t, var, CAST(y.range AS INT) AS y, CAST(x.range AS INT) AS x
  FROM range(30) t, names, range(8) y, range(16) x),
cells AS (
  SELECT 'E' AS grid_id, a.t, a.var, a.y, a.x, p.v
  FROM addr a LEFT JOIN (SELECT t, var, y, x, avg(v) AS v FROM pts GROUP BY t, var, y, x) p USING (t, var, y, x))"""

SQL_I = """
cells AS (
  SELECT CAST(vec_id AS VARCHAR) AS grid_id, 0 AS t, 'intensity' AS var, CAST(i // 8 AS INT) AS y, CAST(i % 8 AS INT) AS x,
         round(CAST(embedding[i + 1] AS DOUBLE) * 255, 3) AS v
  FROM embeddings, (SELECT CAST(range AS INT) AS i FROM range(64)))"""

SQL_RGB = """
cells AS (
  SELECT CAST(vec_id // 3 AS VARCHAR) AS grid_id, 0 AS t, ['red', 'green', 'blue'][vec_id % 3 + 1] AS var, CAST(i // 8 AS INT) AS y,
         CAST(i % 8 AS INT) AS x, least(greatest(round(127.5 + CAST(embedding[i + 1] AS DOUBLE) * 212.5), 0.0), 255.0) AS v
  FROM embeddings, (SELECT CAST(range AS INT) AS i FROM range(64)))"""


def rd(expr: str, digits: int = 3, name: str | None = None) -> str:
    """Rounded SQL value: nudged off exact halves, which engines round differently, and without negative zero."""
    return f"(round({expr} + 1e-{digits + 3}, {digits}) + 0.0) AS {name or expr}"


def rounded(df: DataFrame, digits: int = 3, **special: int) -> DataFrame:
    """All double columns rounded the same way as ``rd``."""
    def one(name: str):
        d = special.get(name, digits)
        return (F.round(F.col(name) + F.lit(10.0 ** -(d + 3)), d) + F.lit(0.0)).alias(name)

    return df.select(*[one(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes])
