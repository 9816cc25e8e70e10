"""Sources, selection, missing data, aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.grids import BOXES, L_SHAPE, SQL_E, SQL_F, SQL_L, SQL_L3, grid_e, grid_f, grid_l, grid_l3, line_points, one_id, rd, rounded, table
from checks.registry import MEAN, SERIES, corr_sql, fill_sql, grad_sql, query
from gridframe.functions.columns import compact_number, coverage_label
from gridframe.model import Grid
from gridframe.operators import aggregates as agg, missing as mis, selection as sel
from gridframe.operators.quantile import _bracketed
from gridframe.sources import tabular as tab

# --- sources ---------------------------------------------------------------------------------------------


@query("rasterize_points", f"""
WITH p AS (
  SELECT l_quantity AS lat, CAST(l_suppkey % 40 AS DOUBLE) AS lon, date_trunc('quarter', l_shipdate) AS ts, round(l_extendedprice * 100) AS price,
         round(l_tax * 100) AS tax FROM lineitem),
m AS (SELECT ts, lat, lon, avg(price) AS price, avg(tax) AS tax FROM p GROUP BY ts, lat, lon),
tt AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS t FROM (SELECT DISTINCT ts FROM m)),
ay AS (SELECT lat, row_number() OVER (ORDER BY lat) - 1 AS y FROM (SELECT DISTINCT lat FROM m)),
ax AS (SELECT lon, row_number() OVER (ORDER BY lon) - 1 AS x FROM (SELECT DISTINCT lon FROM m)),
d AS (SELECT t, y, x, price, tax FROM tt CROSS JOIN ay CROSS JOIN ax LEFT JOIN m USING (ts, lat, lon))
SELECT 'L' AS grid_id, CAST(t AS INT) AS t, 'price' AS var, CAST(y AS INT) AS y, CAST(x AS INT) AS x, {rd('price', 3, 'v')} FROM d
UNION ALL SELECT 'L', CAST(t AS INT), 'tax', CAST(y AS INT), CAST(x AS INT), {rd('tax', 3, 'v')} FROM d""")
def rasterize_points(spark, sf):
    points = table(spark, sf, "lineitem").select(
        F.col("l_quantity").alias("Latitude"), (F.col("l_suppkey") % 40).cast("double").alias("xlon"),
        F.date_trunc("quarter", "l_shipdate").alias("timestamp"),
        F.round(F.col("l_extendedprice") * 100).alias("price"), F.round(F.col("l_tax") * 100).alias("tax"),
    )
    return rounded(tab.rasterize(points, ["price", "tax"], grid_id="L").cells)


@query("cells_by_index", f"WITH {SQL_L3} SELECT grid_id, t, var, y, x, {rd('v')} FROM cells")
def cells_by_index(spark, sf):
    return rounded(grid_l3(spark, sf).cells)


@query("matrix_text", f"""
WITH {SQL_L} SELECT 'L' || t AS grid_id, 0 AS t, 'value' AS var, y, x, {rd('floor(v)', 3, 'v')} FROM cells""")
def matrix_text(spark, sf):
    """Each slice written as a comma-separated matrix and read back."""
    cells = grid_l(spark, sf).cells
    text = F.coalesce(F.format_string("%d", F.floor("v")), F.lit(""))
    lines = cells.groupBy("t", "y").agg(F.array_join(F.array_sort(F.collect_list(F.struct("x", text.alias("s"))))["s"], ",").alias("line"))
    files = lines.groupBy("t").agg(F.array_join(F.array_sort(F.collect_list(F.struct("y", "line")))["line"], "\n").alias("value"))
    return rounded(tab.matrix_cells(files.select(F.concat(F.lit("L"), F.col("t")).alias("grid_id"), "value")))


@query("matrix_json", f"""
WITH {SQL_L} SELECT 'L' || t AS grid_id, 0 AS t, 'value' AS var, y, x, {rd('floor(v)', 3, 'v')} FROM cells""")
def matrix_json(spark, sf):
    """Each slice written as JSON under one of the accepted names, or bare, and read back."""
    cells = grid_l(spark, sf).cells
    text = F.coalesce(F.format_string("%d", F.floor("v")), F.lit("null"))
    lines = cells.groupBy("t", "y").agg(F.array_join(F.array_sort(F.collect_list(F.struct("x", text.alias("s"))))["s"], ",").alias("line"))
    bodies = lines.groupBy("t").agg(F.array_join(F.array_sort(F.collect_list(F.struct("y", "line")))["line"], "],[").alias("b"))
    bare = F.concat(F.lit("[["), F.col("b"), F.lit("]]"))
    name = F.get(F.array(F.lit("data"), F.lit("grid"), F.lit("values")), F.col("t") % 4)
    value = F.when(name.isNull(), bare).otherwise(F.concat(F.lit('{"'), name, F.lit('":'), bare, F.lit("}")))
    return rounded(tab.matrix_json_cells(bodies.select(F.concat(F.lit("L"), F.col("t")).alias("grid_id"), value.alias("value"))))


@query("file_name_time", """
SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS ts FROM orders""")
def file_name_time(spark, sf):
    named = table(spark, sf, "orders").select("o_orderkey", F.when(
        F.col("o_orderkey") % 2 == 0, F.concat(F.lit("daily_v12_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_x"))
    ).otherwise(F.concat(F.lit("d-"), F.date_format("o_orderdate", "yyyy-MM-dd"))).alias("name"))
    return named.select(F.col("o_orderkey").alias("k"), F.date_format(tab.time_of_name(F.col("name")), "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("concatenate_time", f"""
WITH {SQL_L} SELECT grid_id, t, var, y, x, {rd('v')} FROM cells
UNION ALL SELECT grid_id, t + 28, var, y, x, {rd('v * 2', 3, 'v')} FROM cells""")
def concatenate_time(spark, sf):
    g = grid_l(spark, sf)
    doubled = g.with_cells(g.cells.withColumn("v", F.col("v") * 2))
    return rounded(tab.concat_time([g, doubled]).cells)


@query("override_coordinates", f"""
WITH {SQL_L} SELECT grid_id, var, y, x, {rd('avg(v)', 3, 'v')}, y * 0.5::DOUBLE + 10 AS lat, x * 0.25::DOUBLE - 3 AS lon FROM cells GROUP BY grid_id, var, y, x""")
def override_coordinates(spark, sf):
    g = grid_l(spark, sf)
    lat = g.lat_axis().withColumn("lat", F.col("y") * 0.5 + 10)
    lon = g.lon_axis().withColumn("lon", F.col("x") * 0.25 - 3)
    moved = tab.override_coords(g, lat=lat, lon=lon)
    return rounded(moved.with_coords(agg.mean_map(moved)))


# --- selection ---------------------------------------------------------------------------------------------


@query("select_variables", f"WITH {SQL_L3} SELECT grid_id, t, var, y, x, {rd('v')} FROM cells WHERE var IN ('tax', 'price')")
def select_variables(spark, sf):
    return rounded(sel.select_vars(grid_l3(spark, sf), ["tax", "price"]).cells)


@query("missing_variables", "SELECT DISTINCT event_type AS var FROM events WHERE event_type NOT IN ('click', 'view')")
def missing_variables(spark, sf):
    asked = table(spark, sf, "events").select(F.col("event_type").alias("var"))
    return sel.missing_variables(asked, sel.select_vars(grid_e(spark, sf), ["click", "view"]).cells)


@query("flatten_dimensions", f"""
SELECT 'L' AS grid_id, 'price[flag=' || l_returnflag || ',status=' || l_linestatus || ']' AS var, count(*) AS n,
       {rd('sum(round(l_extendedprice * 100))', 0, 'total')} FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def flatten_dimensions(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.lit("L").alias("grid_id"), F.lit("price").alias("var"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
        F.round(F.col("l_extendedprice") * 100).alias("v"),
    )
    flat = sel.flatten_dims(rows, ["flag", "status"])
    return rounded(flat.groupBy("grid_id", "var").agg(F.count("v").alias("n"), F.sum("v").alias("total")))


@query("null_fill_values", """
SELECT event_type AS var, count(*) AS n, count(CASE WHEN event_id % 97 <> 0 AND NOT (event_type = 'view' AND round(value) = 3) THEN 1 END) AS kept
FROM events GROUP BY event_type""")
def null_fill_values(spark, sf):
    v = F.when(F.col("event_id") % 97 == 0, F.when(F.col("event_id") % 2 == 0, 9.9e36).otherwise(float("nan"))).otherwise(F.round("value"))
    cells = table(spark, sf, "events").select(F.col("event_type").alias("var"), v.alias("v"))
    return sel.null_fill(cells, {"view": [3.0]}).groupBy("var").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("kept"))


@query("densify", f"WITH {SQL_L} SELECT grid_id, t, var, y, x, {rd('v')} FROM cells")
def densify(spark, sf):
    points = line_points(spark, sf).groupBy("grid_id", "t", "y", "x").agg(F.avg("price").alias("v")).withColumn("var", F.lit("price"))
    sparse = Grid(points, ("price",), L_SHAPE)
    return rounded(sel.densify(sparse, one_id(spark, "L")).cells.select("grid_id", "t", "var", "y", "x", "v"))


@query("clean_names", "SELECT p_partkey AS k, replace(p_name, ' ', '_') AS var FROM part")
def clean_names(spark, sf):
    named = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("a/b c/"), F.col("p_name")).alias("n"))
    return named.select(F.col("p_partkey").alias("k"), sel.clean_name(F.col("n")).alias("var"))


@query("region_masks", f"""
WITH {SQL_L}, r AS (SELECT * FROM (VALUES ('core', 5, 30, 10, 40), ('corner', 0, 9, 0, 9), ('none', NULL, NULL, NULL, NULL)) v(region, a, b, c, d))
SELECT region, grid_id, y, x, {rd('avg(v)', 3, 'v')} FROM cells, r WHERE a IS NULL OR (x BETWEEN a AND b AND y BETWEEN c AND d)
GROUP BY region, grid_id, y, x""")
def region_masks(spark, sf):
    g = grid_l(spark, sf)
    mean = agg.mean_map(g)
    parts = [
        mean.join(sel.region_mask(g, name, BOXES), ["grid_id", "y", "x"]).select(F.lit(name).alias("region"), "grid_id", "y", "x", "v")
        for name, *_ in BOXES
    ]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query("prepare_subset", f"""
WITH {SQL_F}, ok AS (SELECT y, x, avg(CASE WHEN v IS NULL THEN 1 ELSE 0 END) < 0.8 AS valid FROM cells GROUP BY y, x)
SELECT grid_id, t, var, y, x, {rd('CASE WHEN valid AND x BETWEEN 5 AND 30 AND y BETWEEN 10 AND 40 THEN v END', 3, 'v')}
FROM cells JOIN ok USING (y, x)""")
def prepare_subset(spark, sf):
    g = grid_f(spark, sf)
    done = sel.prepare(g, "price", "core", mis.missing_masks(g), BOXES)
    return rounded(done.cells.select("grid_id", "t", "var", "y", "x", "v"))


@query("select_slices", """
WITH a AS (SELECT CAST(range AS INT) AS t, strftime(DATE '2024-01-01' + CAST(range AS INT), '%Y-%m-%d') AS label FROM range(30)),
r AS (SELECT o_orderkey AS request_id, strftime(o_orderdate + INTERVAL 8 YEAR, '%Y-%m-%d') AS label FROM orders)
SELECT request_id, 'E' AS grid_id, coalesce(a.t, 29) AS t, coalesce(a.label, '2024-01-30') AS label FROM r LEFT JOIN a USING (label)""")
def select_slices(spark, sf):
    day = F.add_months("o_orderdate", 96)
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("map of "), F.date_format(day, "yyyy/M/d"))).when(
        F.col("o_orderkey") % 3 == 1, F.concat(F.lit("field "), F.date_format(day, "yyyyMMdd"), F.lit("."))
    ).otherwise(F.date_format(day, "yyyy年M月d日"))
    requests = table(spark, sf, "orders").select(F.col("o_orderkey").alias("request_id"), F.lit("E").alias("grid_id"), text.alias("text"))
    return sel.select_slice(grid_e(spark, sf).time_axis(), requests)


@query("downsample_map", f"""
WITH {SQL_L}, {MEAN} SELECT grid_id, var, y, x, {rd('v')} FROM mm WHERE y % 3 = 0 AND x % 2 = 0""")
def downsample_map(spark, sf):
    g = grid_l(spark, sf)
    return rounded(sel.downsample(g, agg.mean_map(g), limit=20))


@query("thin_pairs", f"""
WITH {SQL_L3}, p AS (
  SELECT t, y, x, price AS a, tax AS b, row_number() OVER (ORDER BY t, y, x) - 1 AS k, count(*) OVER () AS n FROM wide WHERE price IS NOT NULL AND tax IS NOT NULL)
SELECT 'L' AS grid_id, t, y, x, {rd('a')}, {rd('b')} FROM p WHERE n <= 3000 OR k % (n // 3000) = 0""")
def thin_pairs(spark, sf):
    g = grid_l3(spark, sf)
    return rounded(sel.thin(g, agg.pair_vars(g, "price", "tax")))


@query("polygon_mask", f"""
WITH {SQL_L}, {MEAN}, edge AS (
  SELECT c_custkey AS k, 2.3::DOUBLE + (c_custkey % 5) AS lon1, 3.1::DOUBLE + (c_custkey % 11) * 3.0::DOUBLE AS lat1, 31.7::DOUBLE - (c_custkey % 7) AS lon2, 44.9::DOUBLE - (c_custkey % 13) * 2.0::DOUBLE AS lat2
  FROM customer)
SELECT grid_id, y, x, (SELECT count(*) FROM edge WHERE (lat1 > y) <> (lat2 > y) AND lon1 + (y - lat1) * (lon2 - lon1) / (lat2 - lat1) > x) % 2 = 1 AS inside
FROM mm""")
def polygon_mask(spark, sf):
    k = F.col("c_custkey")
    rings = table(spark, sf, "customer").select(
        (2.3 + k % 5).alias("lon1"), (3.1 + (k % 11) * 3.0).alias("lat1"), (31.7 - k % 7).alias("lon2"), (44.9 - (k % 13) * 2.0).alias("lat2")
    )
    return sel.polygon_mask(grid_l(spark, sf), rings, band=8.0)


@query("polygon_mask_bands", f"""
WITH {SQL_L}, {MEAN}, edge AS (
  SELECT c_custkey % 6 * 7.0::DOUBLE AS lon1, c_custkey % 400 * 0.25::DOUBLE - 30 AS lat1, 31.7::DOUBLE - (c_custkey % 7) AS lon2, c_custkey % 400 * 0.25::DOUBLE - 30 + power(2.0, c_custkey % 13 - 6) * 1.1::DOUBLE AS lat2
  FROM customer)
SELECT grid_id, y, x, (SELECT count(*) FROM edge WHERE (lat1 > y) <> (lat2 > y) AND lon1 + (y - lat1) * (lon2 - lon1) / (lat2 - lat1) > x) % 2 = 1 AS inside
FROM mm""")
def polygon_mask_bands(spark, sf):
    """Edges from hundredths of a degree to seventy degrees."""
    k = F.col("c_custkey")
    lat1 = k % 400 * 0.25 - 30
    rings = table(spark, sf, "customer").select((k % 6 * 7.0).alias("lon1"), lat1.alias("lat1"), (31.7 - k % 7).alias("lon2"), (lat1 + F.pow(F.lit(2.0), k % 13 - 6) * 1.1).alias("lat2"))
    return sel.polygon_mask(grid_l(spark, sf), rings)


# --- missing data -------------------------------------------------------------------------------------------


@query("missing_masks", f"""
WITH {SQL_F} SELECT grid_id, y, x, {rd('avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END)', 6, 'missing_share')},
  avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END) >= 0.8 AS fixed_missing, avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END) < 0.8 AS valid_region
FROM cells GROUP BY grid_id, y, x""")
def missing_masks(spark, sf):
    return rounded(mis.missing_masks(grid_f(spark, sf)), 6)


@query("fill_nearest", f"""
WITH {SQL_L}, {fill_sql('cells', 'filled', ('grid_id', 't', 'var'))}
SELECT grid_id, t, var, y, x, {rd('f', 3, 'v')}, {rd('v', 3, 'v_original')}, v IS NULL AND f IS NOT NULL AS filled FROM filled""")
def fill_nearest(spark, sf):
    return rounded(mis.fill_nearest(grid_l(spark, sf).cells))


@query("fill_mean", f"""
WITH {SQL_E}, {MEAN} SELECT grid_id, var, y, x, {rd('coalesce(v, avg(v) OVER (PARTITION BY grid_id, var), 0)', 3, 'v')} FROM mm""")
def fill_mean(spark, sf):
    return rounded(mis.fill_mean(agg.mean_map(grid_e(spark, sf))))


@query("fill_linear", f"""
WITH {SQL_L},
h AS (SELECT *, CASE WHEN v IS NOT NULL THEN x END AS px FROM cells),
hx AS (SELECT *, max(px) OVER (PARTITION BY t, y ORDER BY x) AS lp, min(px) OVER (PARTITION BY t, y ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rp FROM h),
ax AS (SELECT a.t, a.y, a.x, coalesce(a.v, l.v + CAST(a.x - l.x AS DOUBLE) / (r.x - l.x) * (r.v - l.v)) AS v FROM hx a
  LEFT JOIN cells l ON l.t = a.t AND l.y = a.y AND l.x = a.lp LEFT JOIN cells r ON r.t = a.t AND r.y = a.y AND r.x = a.rp),
hy AS (SELECT *, max(py) OVER (PARTITION BY t, x ORDER BY y) AS lp, min(py) OVER (PARTITION BY t, x ORDER BY y ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rp
  FROM (SELECT *, CASE WHEN v IS NOT NULL THEN y END AS py FROM ax)),
ay AS (SELECT 'L' AS grid_id, a.t, 'price' AS var, a.y, a.x, coalesce(a.v, l.v + CAST(a.y - l.y AS DOUBLE) / (r.y - l.y) * (r.v - l.v)) AS v FROM hy a
  LEFT JOIN ax l ON l.t = a.t AND l.x = a.x AND l.y = a.lp LEFT JOIN ax r ON r.t = a.t AND r.x = a.x AND r.y = a.rp),
{fill_sql('ay', 'filled', ('grid_id', 't', 'var'))}
SELECT f.grid_id, f.t, f.var, f.y, f.x, {rd('f.f', 3, 'v')}, {rd('c.v', 3, 'v_original')}, c.v IS NULL AND f.f IS NOT NULL AS filled
FROM filled f JOIN cells c USING (t, y, x)""")
def fill_linear(spark, sf):
    return rounded(mis.fill_linear(grid_l(spark, sf).cells))


@query("fill_summary", f"""
WITH {SQL_F}, k AS (SELECT y, x, avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END) >= 0.8 AS fixed FROM cells GROUP BY y, x),
s AS (SELECT t, count(v) AS p FROM cells GROUP BY t)
SELECT grid_id, count(*) FILTER (v IS NULL) AS missing_count, count(*) FILTER (v IS NULL AND p > 0) AS filled_count,
  (SELECT count(*) FROM k WHERE fixed) AS fixed_count FROM cells JOIN s USING (t) GROUP BY grid_id""")
def fill_summary(spark, sf):
    g = grid_f(spark, sf)
    return mis.fill_summary(mis.fill(g), mis.missing_masks(g))


@query("missing_summary", f"""
WITH {SQL_F}, k AS (SELECT y, x, avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END) >= 0.8 AS fixed FROM cells GROUP BY y, x),
s AS (SELECT t, count(v) AS p FROM cells GROUP BY t)
SELECT grid_id, {rd('avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END)', 6, 'missing_ratio')}, count(*) FILTER (v IS NULL AND p > 0) AS filled_count,
  {rd('(SELECT avg(CASE WHEN fixed THEN 1.0 ELSE 0.0 END) FROM k)', 6, 'fixed_ratio')} FROM cells JOIN s USING (t) GROUP BY grid_id""")
def missing_summary(spark, sf):
    g = grid_f(spark, sf)
    return rounded(mis.missing_summary(mis.fill(g), mis.missing_masks(g)), 6)


@query("missing_strategy", f"""
WITH {SQL_E}, c AS (SELECT grid_id, var, y, x, avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END) AS r FROM cells GROUP BY grid_id, var, y, x),
p AS (SELECT grid_id, var, avg(r) AS missing_ratio, avg(CASE WHEN r >= 0.8 THEN 1.0 ELSE 0.0 END) AS fixed_ratio FROM c GROUP BY grid_id, var)
SELECT grid_id, var, {rd('missing_ratio', 6)}, {rd('fixed_ratio', 6)},
  CASE WHEN fixed_ratio > 0.05 THEN 'fixed_nearest' WHEN missing_ratio > 0 THEN 'linear' ELSE 'none' END AS strategy FROM p""")
def missing_strategy(spark, sf):
    return rounded(mis.missing_strategy(grid_e(spark, sf)), 6)


@query("fill_recommendations", f"""
WITH {SQL_F}, k AS (SELECT grid_id, y, x, avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END) >= 0.8 AS fixed FROM cells GROUP BY grid_id, y, x)
SELECT grid_id, {rd('avg(CASE WHEN fixed THEN 1.0 ELSE 0.0 END)', 6, 'fixed_ratio')}, 'nearest_for_fixed_gaps,linear_for_sparse_gaps,keep_fixed_mask'
  || CASE WHEN avg(CASE WHEN fixed THEN 1.0 ELSE 0.0 END) > 0.2 THEN ',report_with_and_without_mask' ELSE '' END AS codes FROM k GROUP BY grid_id""")
def fill_recommendations(spark, sf):
    rows = mis.fill_recommendations(mis.missing_masks(grid_f(spark, sf)))
    return rounded(rows.withColumn("codes", F.array_join("codes", ",")), 6)


@query("coverage_labels", f"""
WITH {SQL_E}, s AS (SELECT grid_id, var, t, avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END) AS r FROM cells GROUP BY grid_id, var, t)
SELECT grid_id, var, t, CASE WHEN r = 0 THEN 'complete grid' WHEN r < 0.05 THEN 'nearly complete grid' WHEN r < 0.3 THEN 'moderate missing regions'
  ELSE 'large fixed or invalid regions' END AS label FROM s""")
def coverage_labels(spark, sf):
    shares = grid_e(spark, sf).cells.groupBy("grid_id", "var", "t").agg(F.avg(F.col("v").isNull().cast("int")).alias("r"))
    return shares.select("grid_id", "var", "t", coverage_label(F.col("r")).alias("label"))


# --- aggregates ----------------------------------------------------------------------------------------------


@query("variable_profile", f"""
WITH {SQL_L3}, {fill_sql('cells', 'filled', ('grid_id', 't', 'var'))},
c AS (SELECT grid_id, var, y, x, avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END) AS r FROM cells GROUP BY grid_id, var, y, x),
st AS (SELECT grid_id, var, CASE WHEN avg(CASE WHEN r >= 0.8 THEN 1.0 ELSE 0.0 END) > 0.05 THEN 'fixed_nearest' WHEN avg(r) > 0 THEN 'linear' ELSE 'none' END AS strategy FROM c GROUP BY grid_id, var)
SELECT grid_id, var, strategy, 28 AS n_t, 50 AS n_y, 40 AS n_x, CASE WHEN var = 'price' THEN 'cent' END AS unit,
  CASE var WHEN 'price' THEN 0 WHEN 'discount' THEN 1 ELSE 2 END AS pos, count(*) FILTER (v IS NULL) AS missing_count,
  {rd('avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END)', 6, 'missing_ratio')}, count(*) FILTER (v IS NULL AND f IS NOT NULL) AS filled_count,
  {rd('min(f)', 3, 'min')}, {rd('max(f)', 3, 'max')}, {rd('avg(f)', 3, 'mean')}, {rd('stddev_pop(f)', 3, 'std')}
FROM filled JOIN st USING (grid_id, var) GROUP BY grid_id, var, strategy""")
def variable_profile(spark, sf):
    return rounded(agg.profile(mis.fill(grid_l3(spark, sf))), missing_ratio=6)


@query("global_statistics", f"""
WITH {SQL_L3} SELECT grid_id, var, {rd('min(v)', 3, 'min')}, {rd('max(v)', 3, 'max')}, {rd('avg(v)', 3, 'mean')}, {rd('stddev_pop(v)', 3, 'std')},
  {rd('median(v)', 3, 'median')}, {rd('quantile_cont(v, 0.05)', 3, 'p05')}, {rd('quantile_cont(v, 0.95)', 3, 'p95')},
  {rd('avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END)', 6, 'missing_ratio')}, count(v) AS n, CASE WHEN var = 'price' THEN 'cent' END AS unit,
  CASE var WHEN 'price' THEN 0 WHEN 'discount' THEN 1 ELSE 2 END AS pos FROM cells GROUP BY grid_id, var""")
def global_statistics(spark, sf):
    return rounded(agg.statistics(grid_l3(spark, sf)), missing_ratio=6)


@query("large_group_quantiles", f"""
SELECT l_returnflag AS flag, {rd('quantile_cont(l_extendedprice, 0.05)', 4, 'p05')}, {rd('quantile_cont(l_extendedprice, 0.5)', 4, 'p50')},
  {rd('quantile_cont(l_extendedprice, 0.9)', 4, 'p90')} FROM lineitem GROUP BY l_returnflag""")
def large_group_quantiles(spark, sf):
    """The route for groups too large for one task."""
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice")
    return rounded(_bracketed(rows, ["flag"], "l_extendedprice", {"p05": 0.05, "p50": 0.5, "p90": 0.9}, 1000), 4)


@query("overall_statistics", f"""
WITH {SQL_L3} SELECT grid_id, var, {rd('min(v)', 3, 'min')}, {rd('max(v)', 3, 'max')}, {rd('avg(v)', 3, 'mean')}, {rd('stddev_pop(v)', 3, 'std')}, count(v) AS n
FROM cells GROUP BY ROLLUP (grid_id, var) HAVING grid_id IS NOT NULL""")
def overall_statistics(spark, sf):
    return rounded(agg.overall_statistics(grid_l3(spark, sf)))


_PAIRS = " UNION ALL ".join(
    f"SELECT 'L' AS grid_id, '{a}' AS \"left\", '{b}' AS \"right\", {rd(corr_sql(a, b), 6, 'r')} FROM wide"
    for a in ("price", "discount", "tax") for b in ("price", "discount", "tax")
)


@query("correlation_matrix", f"WITH {SQL_L3} {_PAIRS}")
def correlation_matrix(spark, sf):
    return rounded(agg.correlation(grid_l3(spark, sf)), 6)


@query("strongest_partner", f"""
WITH {SQL_L3}, c AS ({_PAIRS}) SELECT grid_id, 'price' AS variable, "right" AS partner, r FROM c WHERE "left" = 'price' AND "right" <> 'price'
QUALIFY row_number() OVER (ORDER BY abs(r) DESC) = 1""")
def strongest_partner(spark, sf):
    return rounded(agg.strongest_partner(agg.correlation(grid_l3(spark, sf)), "price"), 6)


@query("mean_map", f"WITH {SQL_E}, {MEAN} SELECT grid_id, var, y, x, {rd('v')} FROM mm")
def mean_map(spark, sf):
    return rounded(agg.mean_map(grid_e(spark, sf)))


@query("std_map", f"WITH {SQL_E} SELECT grid_id, var, y, x, {rd('stddev_pop(v)', 3, 'v')} FROM cells GROUP BY grid_id, var, y, x")
def std_map(spark, sf):
    return rounded(agg.std_map(grid_e(spark, sf)))


@query("mean_series", f"""
WITH {SQL_F}, ok AS (SELECT y, x FROM cells GROUP BY y, x HAVING avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END) < 0.8)
SELECT grid_id, var, t, {rd('avg(v)', 3, 'v')} FROM cells JOIN ok USING (y, x) GROUP BY grid_id, var, t""")
def mean_series(spark, sf):
    g = grid_f(spark, sf)
    return rounded(agg.series_mean(g, mis.missing_masks(g)))


@query("series_stats", f"""
WITH {SQL_E} SELECT grid_id, var, t, {rd('avg(v)', 3, 'mean')}, {rd('max(v)', 3, 'max')}, {rd('quantile_cont(v, 0.95)', 3, 'p95')} FROM cells GROUP BY grid_id, var, t""")
def series_stats(spark, sf):
    return rounded(agg.series_stats(grid_e(spark, sf)))


@query("hotspot_share", f"""
WITH {SQL_L}, {MEAN}, th AS (SELECT quantile_cont(v, 0.9) AS h FROM mm)
SELECT grid_id, var, t, {rd('avg(CASE WHEN v >= h THEN 1.0 ELSE 0.0 END)', 6, 'hotspot_share')} FROM cells, th GROUP BY grid_id, var, t""")
def hotspot_share(spark, sf):
    return rounded(agg.hotspot_share(grid_l(spark, sf)), 6)


@query("daily_matrix", f"""
WITH {SQL_L3} SELECT grid_id, var, t, {rd('avg(v)', 3, 'mean')}, {rd('quantile_cont(v, 0.95)', 3, 'p95')} FROM cells GROUP BY grid_id, var, t""")
def daily_matrix(spark, sf):
    return rounded(agg.daily_matrix(grid_l3(spark, sf)))


@query("grid_quality", f"""
WITH {SQL_L}, c AS (SELECT *, x BETWEEN 5 AND 30 AND y BETWEEN 10 AND 40 AS r FROM cells)
SELECT grid_id, {rd('avg(CASE WHEN r AND v IS NOT NULL THEN 1.0 ELSE 0.0 END)', 6, 'finite_ratio')}, count(*) FILTER (r AND t = 0) AS region_cells,
  count(*) FILTER (t = 0) AS total_cells FROM c GROUP BY grid_id""")
def grid_quality(spark, sf):
    return rounded(agg.quality(sel.prepare(grid_l(spark, sf), "price", "core", None, BOXES)), 6)


@query("space_resolution", """
WITH lat AS (SELECT DISTINCT l_quantity AS c FROM lineitem), lon AS (SELECT DISTINCT l_suppkey % 40 AS c FROM lineitem),
a AS (SELECT c - lag(c) OVER (ORDER BY c) AS d FROM lat), o AS (SELECT c - lag(c) OVER (ORDER BY c) AS d FROM lon)
SELECT 'L' AS grid_id, (SELECT median(d) FROM o) AS lon_step, (SELECT median(d) FROM a) AS lat_step""")
def space_resolution(spark, sf):
    points = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("lat"), (F.col("l_suppkey") % 40).cast("double").alias("lon"), F.col("l_tax").alias("tax"))
    return agg.space_resolution(tab.rasterize(points, ["tax"], grid_id="L"))


@query("time_resolution", """
WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS ts FROM events), s AS (SELECT epoch(ts) - lag(epoch(ts)) OVER (ORDER BY ts) AS s FROM d)
SELECT 'E' AS grid_id, median(s) AS seconds, median(s) / 86400 AS days, '1 day' AS label FROM s""")
def time_resolution(spark, sf):
    points = table(spark, sf, "events").select(
        (F.hour("ts") % 3).alias("lat"), (F.col("user_id") % 4).alias("lon"), F.date_trunc("day", "ts").alias("time"), "value"
    )
    return agg.time_resolution(tab.rasterize(points, ["value"], grid_id="E"))


@query("grid_spec", """
SELECT 'L' AS grid_id, count(DISTINCT l_quantity) AS n_lat, min(l_quantity) AS lat_min, max(l_quantity) AS lat_max, count(DISTINCT l_suppkey) AS n_lon,
  CAST(min(l_suppkey) AS DOUBLE) AS lon_min, CAST(max(l_suppkey) AS DOUBLE) AS lon_max, count(DISTINCT date_trunc('quarter', l_shipdate)) AS n_time,
  strftime(min(date_trunc('quarter', l_shipdate)), '%Y-%m-%dT%H:%M:%S') AS time_start, strftime(max(date_trunc('quarter', l_shipdate)), '%Y-%m-%dT%H:%M:%S') AS time_end,
  1 AS n_variables, 'EPSG:4326/inferred' AS crs, 'spatiotemporal_grid' AS grid_type FROM lineitem""")
def grid_spec(spark, sf):
    points = table(spark, sf, "lineitem").select(
        F.col("l_quantity").alias("lat"), F.col("l_suppkey").cast("double").alias("lon"), F.date_trunc("quarter", "l_shipdate").alias("date"), F.col("l_tax").alias("tax")
    )
    return agg.grid_spec(tab.rasterize(points, ["tax"], grid_id="L"))


@query("hottest_cell", f"""
WITH {SQL_E}, {MEAN} SELECT grid_id, var, y, x, CAST(y AS DOUBLE) AS lat, CAST(x AS DOUBLE) AS lon, {rd('v', 3, 'value')} FROM mm WHERE v IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY grid_id, var ORDER BY v DESC, y, x) = 1""")
def hottest_cell(spark, sf):
    return rounded(agg.hottest(grid_e(spark, sf)).select("grid_id", "var", "y", "x", "lat", "lon", "value"))


@query("first_last_change", f"""
WITH {SQL_E}, {SERIES} SELECT grid_id, var, {rd('arg_min(v, t)', 3, 'first_mean')}, {rd('arg_max(v, t)', 3, 'last_mean')}, {rd('arg_max(v, t) - arg_min(v, t)', 3, 'delta')}
FROM sm GROUP BY grid_id, var""")
def first_last_change(spark, sf):
    return rounded(agg.first_last(grid_e(spark, sf)))


BLOCK_ROWS = f"""WITH {SQL_E}, b AS (SELECT *, y // 3 AS block_y, x // 5 AS block_x FROM cells),
st AS (SELECT grid_id, block_y, block_x, var, coalesce(avg(v), 0) AS mean, coalesce(stddev_pop(v), 0) AS std, coalesce(min(v), 0) AS min, coalesce(max(v), 0) AS max,
  avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END) AS missing_ratio FROM b GROUP BY ALL),
bm AS (SELECT grid_id, block_y, block_x, var, y, x, avg(v) AS v FROM b GROUP BY ALL),
{fill_sql('bm', 'fm', ('grid_id', 'block_y', 'block_x', 'var'), '0')}, {grad_sql('fm', 'gr', 'grid_id, var, block_y, block_x', 'f')},
gs AS (SELECT grid_id, block_y, block_x, var, coalesce(avg(g), 0) AS gradient, min(y) AS y0, max(y) + 1 AS y1, min(x) AS x0, max(x) + 1 AS x1 FROM gr GROUP BY ALL)"""


@query("block_feature_rows", f"""
{BLOCK_ROWS}
SELECT grid_id, block_y, block_x, var, y0, y1, x0, x1, {rd('mean')}, {rd('std')}, {rd('min')}, {rd('max')}, {rd('missing_ratio', 6)}, {rd('gradient')},
  {rd('(y0 + y1 - 1) / 2.0 / 7', 6, 'cy')}, {rd('(x0 + x1 - 1) / 2.0 / 15', 6, 'cx')}, {rd('(y1 - y0) / 8.0', 6, 'height')}, {rd('(x1 - x0) / 16.0', 6, 'width')}
FROM st JOIN gs USING (grid_id, block_y, block_x, var)""")
def block_feature_rows(spark, sf):
    return rounded(agg.block_features(grid_e(spark, sf), (3, 5)), missing_ratio=6, cy=6, cx=6, height=6, width=6)


TIME_ROWS = f"""WITH {SQL_E}, {fill_sql('cells', 'fc', ('grid_id', 't', 'var'), '0')}, {grad_sql('fc', 'gr', 'grid_id, var, t', 'f')}"""


@query("time_feature_rows", f"""
{TIME_ROWS}
SELECT grid_id, t, var, {rd('coalesce(avg(v), 0)', 3, 'mean')}, {rd('coalesce(stddev_pop(v), 0)', 3, 'std')}, {rd('coalesce(min(v), 0)', 3, 'min')},
  {rd('coalesce(max(v), 0)', 3, 'max')}, {rd('avg(g)', 3, 'gradient')} FROM gr GROUP BY grid_id, t, var""")
def time_feature_rows(spark, sf):
    return rounded(agg.time_features(grid_e(spark, sf)))


_RELATIONS = " UNION ALL ".join(
    f"SELECT 'L' AS grid_id, '{a}' AS \"left\", '{b}' AS \"right\", {rd(corr_sql(a, b), 4, 'f0')}, {rd(f'avg({a}) FILTER ({b} IS NOT NULL) / avg({b}) FILTER ({a} IS NOT NULL)', 4, 'f1')}, "
    f"{rd(f'avg(abs({a} - {b}))', 4, 'f2')}, {rd(f'stddev_pop({a} - {b})', 4, 'f3')}, CAST(count({a} - {b}) AS DOUBLE) AS f4 FROM wide"
    for a, b in (("price", "discount"), ("price", "tax"), ("discount", "tax"))
)


@query("relation_feature_rows", f"WITH {SQL_L3} {_RELATIONS}")
def relation_feature_rows(spark, sf):
    return rounded(agg.relation_features(grid_l3(spark, sf)), 4)


@query("variable_cards", f"""
WITH {SQL_L3}, {SERIES} SELECT grid_id, var, {rd('avg(v)', 4, 'mean')}, {rd('CASE WHEN count(v) = count(*) THEN regr_slope(v, t) END', 4, 'trend')}, var = 'tax' AS selected
FROM sm GROUP BY grid_id, var""")
def variable_cards(spark, sf):
    return rounded(agg.variable_cards(agg.daily_matrix(grid_l3(spark, sf)), "tax"), 4)


@query("robust_scale", f"""
WITH {SQL_E}, {MEAN}, m AS (SELECT grid_id, var, median(v) AS med, stddev_pop(v) AS sd FROM mm GROUP BY grid_id, var),
d AS (SELECT grid_id, var, median(abs(v - med)) AS mad FROM mm JOIN m USING (grid_id, var) GROUP BY grid_id, var)
SELECT grid_id, var, {rd('med', 3, 'median')}, {rd('mad')}, {rd('greatest(1.4826 * mad, sd, 1e-9)', 3, 'outlier_scale')} FROM m JOIN d USING (grid_id, var)""")
def robust_scale(spark, sf):
    g = grid_e(spark, sf)
    return rounded(agg.robust_scale(agg.mean_map(g), g.map_cells, small=g.per_map))


@query("log_summary", """
WITH n AS (SELECT user_id AS run_id, event_type AS tool, 'e' || event_id AS message, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT run_id, tool, min(k) AS k FROM n GROUP BY run_id, tool)
SELECT run_id, count(*) AS event_count, (SELECT string_agg(tool, ',' ORDER BY k) FROM f WHERE f.run_id = n.run_id) AS tools,
  string_agg(message, ',' ORDER BY k) FILTER (k <= 12) AS messages FROM n GROUP BY run_id""")
def log_summary(spark, sf):
    log = table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), F.col("ts").alias("time"), F.col("event_id").alias("seq"), F.col("event_type").alias("tool"),
        F.concat(F.lit("e"), F.col("event_id")).alias("message"),
    )
    done = agg.log_summary(log, 12)
    return done.withColumns({"tools": F.array_join("tools", ","), "messages": F.array_join("messages", ",")})


@query("compact_numbers", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 = 0 THEN 'NA' ELSE printf('%.2f', round(o_totalprice) % 9 + 1) END AS s FROM orders")
def compact_numbers(spark, sf):
    v = F.when(F.col("o_orderkey") % 10 != 0, F.round("o_totalprice") % 9 + 1)
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), compact_number(v).alias("s"))
