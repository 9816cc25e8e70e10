"""Files written and read again, many variables, grids of different lengths, embeddings up to rotation."""

from __future__ import annotations

import io
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from checks.grids import E_VARS, SQL_E, SQL_I, SQL_L, SQL_L3, SQL_LY, grid_e, grid_i, grid_l, grid_l3, grid_ly, rd, rounded, table
from checks.q_basics import BLOCK_ROWS, TIME_ROWS
from checks.q_vision import _PAIR_FEATURES, _POS, SHAPE
from checks.registry import SERIES, corr_sql, query
from gridframe.model import Grid
from gridframe.operators import aggregates as agg, embed as emb, temporal as tem
from gridframe.session import shared_folder
from gridframe.sources import arrays, sinks, tabular as tab


def new_folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def of_folder(key: str):
    """Names a file that Spark has written below a folder named key=..."""
    return F.regexp_extract("_metadata.file_path", f"{key}=([^/]+)/", 1)


# --- files --------------------------------------------------------------------------------------------------


@query("cells_written_and_read", f"WITH {SQL_L3} SELECT grid_id, t, var, y, x, {rd('v')} FROM cells WHERE var <> 'discount' AND t >= 5")
def cells_written_and_read(spark, sf):
    folder = new_folder(spark, "cells")
    sinks.write_cells(grid_l3(spark, sf), folder)
    return rounded(tab.read_cells(spark, folder).where("var <> 'discount' AND t >= 5").select("grid_id", "t", "var", "y", "x", "v"))


def _text_lines(spark, sf) -> DataFrame:
    cells = grid_l(spark, sf).cells
    text = F.coalesce(F.format_string("%d", F.floor("v")), F.lit("null"))
    return cells.groupBy(F.concat(F.lit("L"), F.col("t")).alias("grid_id"), "t", "y").agg(F.array_join(F.array_sort(F.collect_list(F.struct("x", text.alias("s"))))["s"], ",").alias("value"))


@query("matrix_csv_files", f"""
WITH {SQL_L} SELECT 'L' || t AS grid_id, 0 AS t, 'value' AS var, y, x, {rd('floor(v)', 3, 'v')} FROM cells""")
def matrix_csv_files(spark, sf):
    """Each slice written as a text file, every third one with a header, and read by lines."""
    lines = _text_lines(spark, sf)
    heads = lines.where("y = 0 AND t % 3 = 0").select("grid_id", "t", F.lit(-1).alias("y"), F.regexp_replace("value", "[^,]+", "name").alias("value"))
    folder = new_folder(spark, "matrices")
    lines.unionByName(heads).repartition("grid_id").sortWithinPartitions("grid_id", "y").select("grid_id", "value").write.partitionBy("grid_id").text(folder)
    return rounded(tab.read_matrix_csv(spark, folder, "*", of_folder("grid_id")).cells)


def _json_folder(spark, sf) -> str:
    """Each slice as a JSON file, bare or under one of the accepted names; every fifth one is cut off in the middle."""
    bodies = _text_lines(spark, sf).groupBy("grid_id", "t").agg(F.array_join(F.array_sort(F.collect_list(F.struct("y", "value")))["value"], "],[").alias("b"))
    bare = F.concat(F.lit("[["), F.col("b"), F.lit("]]"))
    name = F.get(F.array(F.lit("data"), F.lit("grid"), F.lit("values")), F.col("t") % 4)
    value = F.when(name.isNull(), bare).otherwise(F.concat(F.lit('{"'), name, F.lit('": '), bare, F.lit("}")))
    folder = new_folder(spark, "json")
    whole = F.when(F.col("t") % 5 == 4, F.substring(value, F.lit(1), F.floor(F.length(value) / 2).cast("int"))).otherwise(value)
    bodies.select("grid_id", whole.alias("value")).repartition("grid_id").write.partitionBy("grid_id").text(folder)
    return folder


@query("matrix_json_files", f"""
WITH {SQL_L} SELECT 'L' || t AS grid_id, 0 AS t, 'value' AS var, y, x, {rd('floor(v)', 3, 'v')} FROM cells WHERE t % 5 <> 4""")
def matrix_json_files(spark, sf):
    return rounded(tab.read_matrix_json(spark, _json_folder(spark, sf), "*", True, of_folder("grid_id")).cells)


@query("matrix_json_errors", f"WITH {SQL_L} SELECT DISTINCT 'L' || t AS grid_id FROM cells WHERE t % 5 = 4")
def matrix_json_errors(spark, sf):
    return tab.read_json_errors(spark, _json_folder(spark, sf), "*", of_folder("grid_id")).select("grid_id")


def _orders(batches):
    """Array files of 4 x 4 x 4 values with their coordinates, steps first or last."""
    for batch in batches:
        content = []
        for vec_id, values in zip(batch["vec_id"], batch["embedding"], strict=True):
            buffer = io.BytesIO()
            cube = np.asarray(values, dtype=float)[:48].reshape(3, 4, 4)
            axes = {"time": np.arange(3).astype(str)} if vec_id % 2 else {}
            np.savez(buffer, lat=np.arange(4.0), lon=np.arange(4.0) * 2, v=np.moveaxis(cube, 0, 2) if vec_id % 3 == 0 else cube, **axes)
            content.append(buffer.getvalue())
        yield pd.DataFrame({"path": "/x/" + batch["vec_id"].astype(str) + ".npz", "content": content})


@query("array_axis_order", """
SELECT CAST(vec_id AS VARCHAR) AS grid_id, CAST(i // 16 AS INT) AS t, 'v' AS var, CAST(i % 16 // 4 AS INT) AS y, CAST(i % 4 AS INT) AS x, round(CAST(embedding[i + 1] AS DOUBLE), 6) + 0.0 AS v
FROM embeddings, (SELECT CAST(range AS INT) AS i FROM range(48))""")
def array_axis_order(spark, sf):
    files = table(spark, sf, "embeddings").select("vec_id", "embedding").mapInPandas(_orders, "path string, content binary")
    return arrays.array_cells(files).withColumn("v", F.round("v", 6) + F.lit(0.0))


@query("series_of_files", f"""
WITH {SQL_L3}, d AS (SELECT t, y, x, price, tax FROM wide)
SELECT strftime(DATE '1995-01-01' + to_months(3 * t), '%Y-%m-%d') AS label, var, y + 10.0 AS lat, x * 0.5 AS lon, {rd('v')} FROM
  (SELECT t, 'price' AS var, y, x, price AS v FROM d UNION ALL SELECT t, 'tax', y, x, tax FROM d)""")
def series_of_files(spark, sf):
    """Points of each quarter as Parquet files of their own, named by day, read as one grid."""
    wide = agg.pivot(grid_l3(spark, sf), ["price", "tax"])
    day = F.date_format(F.add_months(F.lit("1995-01-01").cast("date"), F.col("t") * 3), "yyyyMMdd")
    folder = new_folder(spark, "series")
    wide.select(F.concat(F.lit("L_"), day).alias("day"), (F.col("y") + 10.0).alias("latitude"), (F.col("x") * 0.5).alias("lon"), "price", "tax").write.partitionBy("day").parquet(folder)
    g = tab.read_series(spark, folder, "latitude double, lon double, price double, tax double", name=of_folder("day"))
    return rounded(g.with_time(g.with_coords(g.cells)).select("label", "var", "lat", "lon", "v"))


@query("series_of_arrays", f"""
WITH {SQL_E} SELECT strftime(DATE '2024-01-01' + to_days(t), '%Y-%m-%d') AS label, var, y, x, {rd('v')} FROM cells WHERE var IN ('click', 'view') AND t BETWEEN 3 AND 25""")
def series_of_arrays(spark, sf):
    """Every day of all variables as an array file; some days and variables are read."""
    folder = new_folder(spark, "arrays")
    sinks.write_arrays(grid_e(spark, sf), folder)
    g = tab.read_series(spark, folder, format="arrays", grid_id="E")
    some = g.cells.where("var IN ('click', 'view') AND t >= 3 AND t <= 25")
    return rounded(g.with_time(some).select("label", "var", "y", "x", "v"))


@query("points_snapped", f"""
WITH p AS (SELECT floor((event_id % 997) * 0.013::DOUBLE / 0.5::DOUBLE + 0.5::DOUBLE) * 0.5::DOUBLE AS lat, floor((user_id % 501) * 0.1::DOUBLE / 2.5::DOUBLE + 0.5::DOUBLE) * 2.5::DOUBLE AS lon, event_id % 100 AS v FROM events),
m AS (SELECT lat, lon, avg(v) AS v FROM p GROUP BY lat, lon)
SELECT a.lat, o.lon, {rd('v', 6)} FROM (SELECT DISTINCT lat FROM m) a CROSS JOIN (SELECT DISTINCT lon FROM m) o LEFT JOIN m ON m.lat = a.lat AND m.lon = o.lon""")
def points_snapped(spark, sf):
    """Scattered points on cells of half a degree by two and a half."""
    points = table(spark, sf, "events").select(((F.col("event_id") % 997) * 0.013).alias("lat"), ((F.col("user_id") % 501) * 0.1).alias("lon"), (F.col("event_id") % 100).alias("v"))
    g = tab.rasterize(points, ["v"], step=(0.5, 2.5))
    return rounded(g.with_coords(g.cells).select("lat", "lon", "v"), 6)


# --- many variables ---------------------------------------------------------------------------------------------

MANY = 60
_MANY = f"""m AS (SELECT vec_id, i, CASE WHEN (vec_id + i) % 7 <> 0 THEN round(CAST(embedding[i + 1] AS DOUBLE) * 1000) END AS v FROM embeddings, (SELECT CAST(range AS INT) AS i FROM range({MANY}))),
p AS (SELECT a.i AS l, b.i AS r, a.v AS x, b.v AS y FROM m a JOIN m b ON a.vec_id = b.vec_id),
n AS (SELECT CAST(range AS INT) AS i, 'e' || lpad(CAST(range AS VARCHAR), 2, '0') AS name FROM range({MANY}))"""


def grid_many(spark, sf) -> Grid:
    """Components of the embeddings as variables of one grid of places."""
    parts = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e")).where(F.col("i") < MANY)
    cells = parts.select(
        F.lit("M").alias("grid_id"), F.lit(0).alias("t"), F.format_string("e%02d", "i").alias("var"), F.floor(F.col("vec_id") / 20).cast("int").alias("y"), (F.col("vec_id") % 20).cast("int").alias("x"),
        F.when((F.col("vec_id") + F.col("i")) % 7 != 0, F.round(F.col("e").cast("double") * 1000)).alias("v"),
    )
    return Grid(cells, tuple(f"e{i:02d}" for i in range(MANY)), (1, 1000, 20), n_grids=1)


@query("correlation_of_many", f"""
WITH {_MANY} SELECT 'M' AS grid_id, a.name AS "left", b.name AS "right", {rd('r.c', 6, 'r')} FROM (SELECT l, r, {corr_sql('x', 'y')} AS c FROM p GROUP BY l, r) r JOIN n a ON a.i = r.l JOIN n b ON b.i = r.r""")
def correlation_of_many(spark, sf):
    return rounded(agg.correlation(grid_many(spark, sf)), 6)


@query("relations_of_many", f"""
WITH {_MANY} SELECT 'M' AS grid_id, a.name AS "left", b.name AS "right", {rd('f0', 6)}, {rd('f2', 4)}, {rd('f3', 4)}, CAST(f4 AS DOUBLE) AS f4
FROM (SELECT l, r, {corr_sql('x', 'y')} AS f0, avg(abs(x - y)) AS f2, stddev_pop(x - y) AS f3, count(x - y) AS f4 FROM p WHERE l < r GROUP BY l, r) z JOIN n a ON a.i = z.l JOIN n b ON b.i = z.r""")
def relations_of_many(spark, sf):
    return rounded(agg.relation_features(grid_many(spark, sf)).drop("f1"), 4, f0=6)


# --- grids of different lengths --------------------------------------------------------------------------------

_LENGTHS = f"{SQL_LY}, nt AS (SELECT grid_id, max(t) + 1 AS n FROM cells GROUP BY grid_id)"


@query("maps_of_lengths", f"""
WITH {_LENGTHS}, w AS (SELECT c.*, n, t - (n - 1) / 2.0::DOUBLE AS xc FROM cells c JOIN nt USING (grid_id)),
a AS (SELECT grid_id, var, y, x, avg(v) AS mean, stddev_pop(v) AS sd, max(v) FILTER (t = n - 1) AS cur, max(v) FILTER (t = n - 1) - max(v) FILTER (t = 0) AS dif,
  sum(xc * v) - avg(v) * sum(CASE WHEN v IS NOT NULL THEN xc END) AS tr, sum(xc * xc) AS sq FROM w GROUP BY grid_id, var, y, x)
SELECT grid_id, var, y, x, {rd('mean')}, {rd('coalesce(tr / sq, 0)', 3, 'trend')}, {rd('CASE WHEN sd > 1e-9 THEN (cur - mean) / sd ELSE 0 END', 6, 'z')}, {rd('dif', 3, 'change')} FROM a""")
def maps_of_lengths(spark, sf):
    """Maps of change of a grid of 28 and one of 7 steps, each over its own time."""
    g = grid_ly(spark, sf)
    maps = tem.cell_maps(g).select("grid_id", "var", "y", "x", "mean", "trend", "z")
    return rounded(maps.join(tem.difference_map(g).withColumnRenamed("v", "change"), ["grid_id", "var", "y", "x"]), z=6)


@query("cards_of_lengths", f"""
WITH {SQL_LY}, c2 AS (SELECT * FROM cells UNION ALL SELECT 'Z', t, var, y, x, v FROM cells WHERE grid_id = 'Y' AND t < 2),
sm AS (SELECT grid_id, var, t, avg(v) AS v FROM c2 GROUP BY grid_id, var, t)
SELECT grid_id, var, {rd('avg(v)', 4, 'mean')}, {rd('CASE WHEN count(v) = count(*) AND count(*) > 2 THEN regr_slope(v, t) END', 4, 'trend')}, true AS selected FROM sm GROUP BY grid_id, var""")
def cards_of_lengths(spark, sf):
    """Cards of grids of 28, 7 and 2 steps; the last one has no slope."""
    g = grid_ly(spark, sf)
    short = g.cells.where("grid_id = 'Y' AND t < 2").withColumn("grid_id", F.lit("Z"))
    return rounded(agg.variable_cards(agg.daily_matrix(g.with_cells(g.cells.unionByName(short), dims=None)), "price"), 4)


@query("similar_of_lengths", f"""
WITH {_LENGTHS}, q AS (SELECT c.grid_id, var, y, x, v FROM cells c JOIN nt USING (grid_id) WHERE t = n - 1),
s AS (SELECT c.grid_id, c.var, c.t, {corr_sql('q.v', 'c.v')} AS r, sqrt(avg((c.v - q.v) * (c.v - q.v))) AS rmse, count(c.v - q.v) AS cells FROM cells c JOIN nt USING (grid_id)
  JOIN q ON q.grid_id = c.grid_id AND q.var = c.var AND q.y = c.y AND q.x = c.x WHERE c.t <> n - 1 AND c.v IS NOT NULL AND q.v IS NOT NULL GROUP BY c.grid_id, c.var, c.t HAVING count(*) >= 20)
SELECT grid_id, var, t, cells, {rd('round_even(r, 4)', 4, 'similarity')} FROM s WHERE r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY grid_id, var ORDER BY CASE WHEN round_even(r, 4) = 0 THEN -1 ELSE round_even(r, 4) END DESC, t) <= 8""")
def similar_of_lengths(spark, sf):
    return rounded(tem.similar_slices(grid_ly(spark, sf), min_cells=20).select("grid_id", "var", "t", "cells", "similarity"), similarity=4)


# --- embeddings up to rotation -------------------------------------------------------------------------------------


def products_sql(keys: str, dims: int) -> str:
    """Products of all pairs of embeddings in ``dims`` dimensions, from features lf(keys, i, f).

    The projection on the leading directions of Z'Z is found one direction at a time: its matrix is squared and scaled 30 times, which leaves
    the projection on the first one; what lies in it is then taken away.
    """
    left, right = (", ".join(f"{t}.{k} AS {n}{k}" for k in keys.split(", ")) for t, n in (("a", "a_"), ("b", "b_")))
    steps = []
    for d in range(dims):
        steps.append(f"""pw{d} AS (SELECT 0 AS s, m FROM g{d} UNION ALL
  SELECT s + 1, list_transform(m, lambda a: list_transform(m, lambda b: list_dot_product(a, b) / t)) FROM (SELECT s, m, list_sum(list_transform(m, lambda a: list_dot_product(a, a))) AS t FROM pw{d}) WHERE s < 30),
pr{d} AS (SELECT list_transform(m, lambda a: list_transform(a, lambda x: x / t)) AS p FROM (SELECT m, list_sum(list_transform(range(1, len(m) + 1), lambda k: m[k][k])) AS t FROM pw{d} WHERE s = 30)),
g{d + 1} AS (SELECT list_transform(range(1, len(m) + 1), lambda i: list_transform(range(1, len(m) + 1), lambda j: m[i][j] - e * p[i][j])) AS m
  FROM (SELECT m, p, list_sum(list_transform(range(1, len(m) + 1), lambda k: list_dot_product(m[k], p[k]))) AS e FROM g{d}, pr{d}))""")
    total = " + ".join(f"pr{d}.p[i][j]" for d in range(dims))
    return f"""zf AS (SELECT {keys}, (coalesce(f, m) - m) AS d, i FROM lf JOIN (SELECT i, coalesce(avg(f), 0) AS m FROM lf GROUP BY i) USING (i)),
zs AS (SELECT i, sqrt(avg(d * d)) AS s FROM zf GROUP BY i),
z AS (SELECT {keys}, list(CAST(d / CASE WHEN s > 0 THEN s ELSE 1 END AS DOUBLE) ORDER BY i) AS z FROM zf JOIN zs USING (i) GROUP BY {keys}),
g0 AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(c ORDER BY j) AS r FROM (
  SELECT i, j, sum(z[i] * z[j]) AS c FROM z, (SELECT CAST(range + 1 AS INT) AS i FROM range((SELECT max(len(z)) FROM z))), (SELECT CAST(range + 1 AS INT) AS j FROM range((SELECT max(len(z)) FROM z))) GROUP BY i, j) GROUP BY i)),
{", ".join(steps)},
pp AS (SELECT list_transform(range(1, len(pr0.p) + 1), lambda i: list_transform(range(1, len(pr0.p) + 1), lambda j: {total})) AS p FROM {", ".join(f"pr{d}" for d in range(dims))}),
za AS (SELECT z.*, list_transform(p, lambda r: list_dot_product(r, z)) AS zp FROM z, pp)
SELECT {left}, {right}, {rd('list_dot_product(a.zp, b.z)', 5, 'product')} FROM za a, za b"""


def products(vectors: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Products of all pairs of embeddings: what they are up to rotation and sign."""
    side = lambda n: vectors.select("grid_id", *[F.col(k).alias(f"{n}_{k}") for k in keys], F.col("embedding").alias(n))
    dot = F.aggregate(F.zip_with("a", "b", lambda p, q: p * q), F.lit(0.0), lambda t, p: t + p)
    return rounded(side("a").join(side("b"), "grid_id").select(*[f"{n}_{k}" for n in ("a", "b") for k in keys], dot.alias("product")), 5)


@query("block_embedding_products", f"""
{BLOCK_ROWS.replace('WITH', 'WITH RECURSIVE', 1)}, r AS (SELECT * FROM st JOIN gs USING (grid_id, block_y, block_x, var)),
lf AS MATERIALIZED (SELECT block_y, block_x, {_POS} * 6 + unnest(range(6)) AS i, unnest([mean, std, min, max, missing_ratio, gradient]) AS f FROM r
  UNION ALL SELECT block_y, block_x, 30 + unnest(range(4)), unnest([(y0 + y1 - 1) / 14.0::DOUBLE, (x0 + x1 - 1) / 30.0::DOUBLE, (y1 - y0) / 8.0::DOUBLE, (x1 - x0) / 16.0::DOUBLE]) FROM r WHERE var = 'click'),
{products_sql('block_y, block_x', 3)}""")
def block_embedding_products(spark, sf):
    return products(emb.block_embedding(grid_e(spark, sf), SHAPE, 3), ("block_y", "block_x"))


@query("time_slice_embedding_products", f"""
{TIME_ROWS.replace('WITH', 'WITH RECURSIVE', 1)}, r AS (SELECT grid_id, t, var, coalesce(avg(v), 0) AS mean, coalesce(stddev_pop(v), 0) AS std, coalesce(min(v), 0) AS min, coalesce(max(v), 0) AS max, avg(g) AS gradient FROM gr GROUP BY grid_id, t, var),
lf AS MATERIALIZED (SELECT t, {_POS} * 5 + unnest(range(5)) AS i, unnest([mean, std, min, max, gradient]) AS f FROM r),
{products_sql('t', 3)}""")
def time_slice_embedding_products(spark, sf):
    return products(emb.time_slice_embedding(grid_e(spark, sf), 3), ("t",))


@query("relation_embedding_products", f"""
WITH RECURSIVE {SQL_L3}, pf AS ({_PAIR_FEATURES}), lf AS MATERIALIZED (SELECT "left" AS l, "right" AS r, unnest(range(5)) AS i, unnest(f) AS f FROM pf),
{products_sql('l, r', 1)}""")
def relation_embedding_products(spark, sf):
    named = emb.relation_embedding(grid_l3(spark, sf), 1).withColumnsRenamed({"left": "l", "right": "r"})
    return products(named, ("l", "r"))
