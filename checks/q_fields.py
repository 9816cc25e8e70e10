"""Stencils, regions, change over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.grids import SQL_E, SQL_F, SQL_L, SQL_L3, grid_e, grid_f, grid_l, grid_l3, rd, rounded
from checks.registry import COMPASS, MEAN, SERIES, comp_sql, corr_sql, fill_sql, grad_sql, query
from gridframe.functions.columns import compass
from gridframe.model import MAP
from gridframe.operators import aggregates as agg, missing as mis, regions as reg, stencil as st, temporal as tem

# --- stencils ------------------------------------------------------------------------------------------------


@query("gradient_map", f"""
WITH {SQL_L}, {MEAN}, {fill_sql('mm', 'fm', empty='0')}, {grad_sql('fm', 'gr', value='f')}
SELECT grid_id, var, y, x, {rd('v')}, {rd('gx')}, {rd('gy')}, {rd('g')} FROM gr""")
def gradient_map(spark, sf):
    sloped = st.filled_gradient(agg.mean_map(grid_l(spark, sf)), width=40)
    return rounded(sloped.select(*MAP, "y", "x", "v", "gx", "gy", "g"))


_VALID = "ok AS (SELECT y, x FROM cells GROUP BY y, x HAVING avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END) < 0.8)"
_VMEAN = _VALID + ", mm AS (SELECT grid_id, var, y, x, avg(CASE WHEN (y, x) IN (SELECT (y, x) FROM ok) THEN v END) AS v FROM cells GROUP BY grid_id, var, y, x)"
_STATS = """gs AS (SELECT grid_id, var, avg(g) FILTER (v IS NOT NULL) AS gradient_strength, quantile_cont(g, 0.95) FILTER (v IS NOT NULL) AS gradient_p95,
  quantile_cont(g, 0.9) FILTER (v IS NOT NULL) AS p90, avg(gx * gx) FILTER (v IS NOT NULL) AS ex, avg(gy * gy) FILTER (v IS NOT NULL) AS ey FROM gr GROUP BY grid_id, var)"""
_ANISO = "CASE WHEN ex + ey = 0 THEN 0 ELSE abs(ex - ey) / (ex + ey) END"
_AXIS = "CASE WHEN ex + ey = 0 THEN 'flat' WHEN ex > ey * 1.25 THEN 'east-west' WHEN ey > ex * 1.25 THEN 'north-south' ELSE 'mixed' END"


@query("gradient_statistics", f"""
WITH {SQL_E}, {MEAN}, {fill_sql('mm', 'fm', empty='0')}, {grad_sql('fm', 'gr', value='f')}, {_STATS},
b AS (SELECT grid_id, var, avg(g) AS boundary_change FROM gr JOIN gs USING (grid_id, var) WHERE g >= p90 GROUP BY grid_id, var)
SELECT grid_id, var, {rd('gradient_strength')}, {rd('gradient_p95')}, {rd(_ANISO, 6, 'anisotropy')}, {_AXIS} AS direction, {rd('boundary_change')}
FROM gs JOIN b USING (grid_id, var)""")
def gradient_statistics(spark, sf):
    g = grid_e(spark, sf)
    return rounded(st.map_gradient_stats(g, agg.mean_map(g)), anisotropy=6)


@query("gradient_compass", f"""
WITH {SQL_E}, {fill_sql('cells', 'fm', ('grid_id', 't', 'var'), '0')}, {grad_sql('fm', 'gr', 'grid_id, var, t', 'f')},
m AS (SELECT grid_id, var, t, avg(gx) AS gx, avg(gy) AS gy FROM gr WHERE v IS NOT NULL GROUP BY grid_id, var, t)
SELECT grid_id, var, t, {COMPASS.format(gx='gx', gy='gy')} AS compass FROM m""")
def gradient_compass(spark, sf):
    keys = ["grid_id", "var", "t"]
    sloped = st.filled_gradient(grid_e(spark, sf).cells.select(*keys, "y", "x", "v"), keys, width=16)
    means = sloped.where(F.col("v").isNotNull()).groupBy(*keys).agg(F.avg("gx").alias("gx"), F.avg("gy").alias("gy"))
    return means.select(*keys, compass(F.col("gx"), F.col("gy")).alias("compass"))


_HOT = "th AS (SELECT grid_id, var, quantile_cont(v, 0.9) AS threshold FROM mm GROUP BY grid_id, var)"


@query("mask_boundary", f"""
WITH {SQL_L}, {MEAN}, {_HOT}, m AS (SELECT grid_id, var, y, x, coalesce(v >= threshold, false) AS hot FROM mm JOIN th USING (grid_id, var)),
n AS (SELECT *, coalesce(lag(hot) OVER r, false) AS w, coalesce(lead(hot) OVER r, false) AS e, coalesce(lag(hot) OVER c, false) AS n, coalesce(lead(hot) OVER c, false) AS s
  FROM m WINDOW r AS (PARTITION BY grid_id, var, y ORDER BY x), c AS (PARTITION BY grid_id, var, x ORDER BY y))
SELECT grid_id, var, y, x, hot, (hot OR w OR e OR n OR s) <> (hot AND w AND e AND n AND s) AS boundary FROM n""")
def mask_boundary(spark, sf):
    g = grid_l(spark, sf)
    marked = reg.hotspot_mask(g, agg.mean_map(g)).select(*MAP, "y", "x", "hot")
    return st.mask_boundary(marked, "hot")


def _mirror(k: int, n: int) -> str:
    return f"CASE WHEN {k} < 0 THEN -1 - {k} WHEN {k} >= {n} THEN 2 * {n} - 1 - {k} ELSE {k} END"


def box_sql(src: str, out: str, n: int, ny: int, nx: int, value: str = "v", keys: str = "grid_id, var") -> str:
    """n by n box mean with mirrored edges, by explicit offsets."""
    h = n // 2
    ks = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    return f"""{out} AS (
  SELECT {ks}, a.y, a.x, avg(b.{value}) AS m, avg(b.{value} * b.{value}) AS q FROM {src} a CROSS JOIN range(-{h}, {n - h}) dy CROSS JOIN range(-{h}, {n - h}) dx
  JOIN {src} b ON {on} AND b.y = {_mirror('(a.y + dy.range)', ny)} AND b.x = {_mirror('(a.x + dx.range)', nx)} GROUP BY {ks}, a.y, a.x)"""


@query("box_filter", f"""
WITH {SQL_E}, {MEAN}, fm AS (SELECT grid_id, var, y, x, coalesce(v, avg(v) OVER (PARTITION BY grid_id, var), 0) AS v FROM mm), {box_sql('fm', 'bx', 5, 8, 16)}
SELECT grid_id, var, y, x, {rd('m', 3, 'box')}, {rd('sqrt(greatest(q - m * m, 0))', 3, 'local_std')} FROM bx""")
def box_filter(spark, sf):
    g = grid_e(spark, sf)
    full = g.with_dims(mis.fill_mean(agg.mean_map(g))).withColumn("box", F.col("v"))
    spread = st.local_std(full, "v", 5, MAP)
    boxed = st.box_mean(full, ["box"], 5, MAP).select(*MAP, "y", "x", "box")
    return rounded(spread.select(*MAP, "y", "x", "local_std").join(boxed, [*MAP, "y", "x"]))


@query("local_entropy", f"""
WITH {SQL_E}, {MEAN}, fm AS (SELECT grid_id, var, y, x, coalesce(v, avg(v) OVER (PARTITION BY grid_id, var), 0) AS v FROM mm),
lv AS (SELECT *, least(greatest(floor((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) * 15), 0), 15) AS level FROM fm WINDOW w AS (PARTITION BY grid_id, var)),
pr AS (SELECT a.grid_id, a.var, a.y, a.x, b.level, count(*) / 49.0::DOUBLE AS p FROM lv a CROSS JOIN range(-3, 4) dy CROSS JOIN range(-3, 4) dx
  JOIN lv b ON a.grid_id = b.grid_id AND a.var = b.var AND b.y = {_mirror('(a.y + dy.range)', 8)} AND b.x = {_mirror('(a.x + dx.range)', 16)} GROUP BY a.grid_id, a.var, a.y, a.x, b.level)
SELECT grid_id, var, y, x, {rd('sum(-p * log2(p)) / 4', 6, 'entropy')} FROM pr GROUP BY grid_id, var, y, x""")
def local_entropy(spark, sf):
    g = grid_e(spark, sf)
    full = g.with_dims(mis.fill_mean(agg.mean_map(g)))
    return rounded(st.local_entropy(full, "v", MAP).select(*MAP, "y", "x", "entropy"), 6)


def smooth_sql(src: str, out: str, n: int, sigma: float = 2.0) -> str:
    radius = int(4 * sigma + 0.5)
    return f"""{out} AS (
  SELECT a.grid_id, a.var, a.t, a.v, sum(b.v * w.w) / sum(w.w) AS s FROM {src} a
  CROSS JOIN (SELECT CAST(range AS INT) AS k, exp(-0.5::DOUBLE * range * range / {sigma * sigma}) AS w FROM range(-{radius}, {radius + 1})) w
  JOIN {src} b ON a.grid_id = b.grid_id AND a.var = b.var AND b.t = {_mirror('(a.t + w.k)', n)} GROUP BY a.grid_id, a.var, a.t, a.v)"""


@query("smooth_series", f"""
WITH {SQL_L}, {SERIES}, {smooth_sql('sm', 'ss', 28)} SELECT grid_id, var, t, {rd('v')}, {rd('s', 3, 'smoothed')} FROM ss""")
def smooth_series(spark, sf):
    return rounded(st.smooth_series(agg.series_mean(grid_l(spark, sf))).select(*MAP, "t", "v", "smoothed"))


@query("smooth_map", f"""
WITH {SQL_E}, {MEAN}, fm AS (SELECT grid_id, var, y, x, coalesce(v, avg(v) OVER (PARTITION BY grid_id, var), 0) AS v FROM mm),
w AS (SELECT CAST(range AS INT) AS k, exp(-0.5::DOUBLE * range * range) AS w FROM range(-4, 5)),
s AS (SELECT a.grid_id, a.var, a.y, a.x, sum(b.v * wy.w * wx.w) / sum(wy.w * wx.w) AS s FROM fm a CROSS JOIN w wy CROSS JOIN w wx
  JOIN fm b ON a.grid_id = b.grid_id AND a.var = b.var AND b.y = {_mirror('(a.y + wy.k)', 8)} AND b.x = {_mirror('(a.x + wx.k)', 16)} GROUP BY a.grid_id, a.var, a.y, a.x)
SELECT grid_id, var, y, x, {rd('(s - min(s) OVER p) / (max(s) OVER p - min(s) OVER p)', 6, 'smoothed')} FROM s WINDOW p AS (PARTITION BY grid_id, var)""")
def smooth_map(spark, sf):
    g = grid_e(spark, sf)
    full = g.with_dims(mis.fill_mean(agg.mean_map(g)))
    return rounded(st.min_max(st.smooth_map(full, "v", 1.0, MAP), "smoothed", MAP).select(*MAP, "y", "x", "smoothed"), 6)


@query("series_volatility", f"""
WITH {SQL_L3}, {SERIES}, d AS (SELECT grid_id, var, v - lag(v) OVER (PARTITION BY grid_id, var ORDER BY t) AS d FROM sm WHERE v IS NOT NULL)
SELECT grid_id, var, {rd('stddev_pop(d)', 3, 'volatility')} FROM d GROUP BY grid_id, var""")
def series_volatility(spark, sf):
    return rounded(st.volatility(agg.series_mean(grid_l3(spark, sf))))


@query("moran_index", f"""
WITH {SQL_E}, z AS (SELECT *, v - avg(v) OVER (PARTITION BY grid_id, var, t) AS z FROM cells),
p AS (SELECT a.grid_id, a.var, a.t, sum(a.z * b.z) AS num, count(*) AS n FROM z a JOIN z b ON a.grid_id = b.grid_id AND a.var = b.var AND a.t = b.t AND a.v IS NOT NULL AND b.v IS NOT NULL
  AND ((a.y = b.y AND b.x = a.x + 1) OR (a.x = b.x AND b.y = a.y + 1)) GROUP BY a.grid_id, a.var, a.t),
s AS (SELECT grid_id, var, t, count(v) AS k, sum(z * z) AS den FROM z GROUP BY grid_id, var, t)
SELECT grid_id, var, t, {rd('CASE WHEN k >= 4 AND den > 1e-12 THEN k / (2.0::DOUBLE * n) * 2 * num / den END', 6, 'moran_i')} FROM s LEFT JOIN p USING (grid_id, var, t)""")
def moran_index(spark, sf):
    return rounded(st.moran(grid_e(spark, sf).cells, ["grid_id", "var", "t"]), 6)


@query("neighbour_edges", f"""
WITH {SQL_L}, {MEAN}, {_HOT}, h AS (SELECT grid_id, var, y, x FROM mm JOIN th USING (grid_id, var) WHERE v >= threshold)
SELECT a.grid_id, a.var, a.y, a.x, b.y AS y2, b.x AS x2 FROM h a JOIN h b ON (a.y = b.y AND b.x = a.x + 1) OR (a.x = b.x AND b.y = a.y + 1)""")
def neighbour_edges(spark, sf):
    g = grid_l(spark, sf)
    hot = reg.hotspot_mask(g, agg.mean_map(g)).where("hot").select(*MAP, "y", "x")
    return st.neighbour_edges(hot)


# --- connected regions --------------------------------------------------------------------------------------

_HOTCELLS = f"{_HOT}, hc AS (SELECT grid_id, var, y, x, v FROM mm JOIN th USING (grid_id, var) WHERE v >= threshold)"


@query("hotspot_components", f"""
WITH RECURSIVE {SQL_L}, {MEAN}, {_HOTCELLS}, {comp_sql('hc', 'cc')} SELECT grid_id, var, y, x, {rd('v')}, component FROM cc""")
def hotspot_components(spark, sf):
    g = grid_l(spark, sf)
    return rounded(reg.hotspots(g, agg.mean_map(g)))


@query("hotspot_components_tiled", f"""
WITH RECURSIVE {SQL_L}, {MEAN}, hc AS (SELECT mm.* FROM mm, (SELECT quantile_cont(v, 0.5) AS h FROM mm) WHERE v >= h), {comp_sql('hc', 'cc')}
SELECT grid_id, var, y, x, {rd('v')}, component FROM cc""")
def hotspot_components_tiled(spark, sf):
    """Labels merged across the borders of small tiles."""
    g = grid_l(spark, sf)
    hot = reg.hotspot_mask(g, agg.mean_map(g), 0.5).where("hot").select(*MAP, "y", "x", "v")
    return rounded(reg.components(hot, MAP, g.shape, tile=16))


@query("hotspot_table", f"""
WITH RECURSIVE {SQL_E}, {MEAN}, {_HOTCELLS}, {comp_sql('hc', 'cc', width=16)},
t AS (SELECT grid_id, var, component, count(*) AS cells, avg(y) AS cy, avg(x) AS cx, avg(v) AS mean, max(v) AS peak, arg_max(y, v) AS peak_y, arg_max(x, v) AS peak_x,
  CAST(min(x) AS DOUBLE) AS lon_min, CAST(min(y) AS DOUBLE) AS lat_min, CAST(max(x) AS DOUBLE) AS lon_max, CAST(max(y) AS DOUBLE) AS lat_max FROM cc GROUP BY grid_id, var, component)
SELECT grid_id, var, component, cells, {rd('cy', 4)}, {rd('cx', 4)}, {rd('cy', 4, 'lat')}, {rd('cx', 4, 'lon')}, {rd('mean', 4)}, {rd('peak', 4)}, lon_min, lat_min, lon_max, lat_max,
  peak_y, peak_x, CAST(peak_y AS DOUBLE) AS peak_lat, CAST(peak_x AS DOUBLE) AS peak_lon, CAST(row_number() OVER w AS INT) AS rank
FROM t WINDOW w AS (PARTITION BY grid_id, var ORDER BY cells DESC, round(peak, 6) DESC, component) QUALIFY row_number() OVER w <= 12""")
def hotspot_table(spark, sf):
    g = grid_e(spark, sf)
    return rounded(reg.component_table(g, reg.hotspots(g, agg.mean_map(g)), n=12, by_peak=True), 4)


@query("high_domains", f"""
WITH RECURSIVE {SQL_E}, {MEAN}, hi AS (SELECT mm.* FROM mm JOIN (SELECT grid_id, var, avg(v) + stddev_pop(v) AS b FROM mm GROUP BY grid_id, var) USING (grid_id, var) WHERE v >= b),
{comp_sql('hi', 'cc', width=16)} SELECT grid_id, var, count(DISTINCT component) AS connected_domains FROM cc GROUP BY grid_id, var""")
def high_domains(spark, sf):
    g = grid_e(spark, sf)
    return reg.high_domains(g, agg.mean_map(g))


@query("component_sizes", f"""
WITH RECURSIVE {SQL_L}, {MEAN}, {_HOTCELLS}, {comp_sql('hc', 'cc')}, s AS (SELECT grid_id, var, component, count(*) AS n FROM cc GROUP BY ALL)
SELECT grid_id, var, count(*) AS components, max(n) AS largest FROM s GROUP BY grid_id, var""")
def component_sizes(spark, sf):
    g = grid_l(spark, sf)
    return reg.component_stats(reg.hotspots(g, agg.mean_map(g)), MAP)


_LASTZ = """lz AS (SELECT grid_id, var, y, x, v, CASE WHEN v IS NULL THEN NULL WHEN s = 0 THEN 0 ELSE (v - m) / s END AS z
  FROM cells JOIN (SELECT grid_id, var, avg(v) AS m, stddev_pop(v) AS s FROM cells WHERE t = {t} GROUP BY grid_id, var) USING (grid_id, var) WHERE t = {t})"""


@query("spatial_anomaly_map", f"WITH {SQL_E}, {_LASTZ.format(t=29)} SELECT grid_id, var, y, x, {rd('v')}, {rd('z', 6)}, abs(z) >= 2 AS odd FROM lz")
def spatial_anomaly_map(spark, sf):
    return rounded(reg.spatial_anomaly(grid_e(spark, sf)), z=6)


@query("spatial_anomaly_regions", f"""
WITH RECURSIVE {SQL_E}, {_LASTZ.format(t=29)}, od AS (SELECT grid_id, var, y, x, v FROM lz WHERE abs(z) >= 2), {comp_sql('od', 'cc', width=16)},
t AS (SELECT grid_id, var, component, count(*) AS cells, avg(y) AS cy, avg(x) AS cx, max(v) AS peak, arg_max(y, v) AS peak_y, arg_max(x, v) AS peak_x FROM cc GROUP BY grid_id, var, component)
SELECT grid_id, var, component, cells, {rd('cy', 4)}, {rd('cx', 4)}, {rd('peak', 4)}, peak_y, peak_x
FROM t QUALIFY row_number() OVER (PARTITION BY grid_id, var ORDER BY cells DESC, component) <= 10""")
def spatial_anomaly_regions(spark, sf):
    table = reg.anomaly_components(grid_e(spark, sf))
    return rounded(table.select(*MAP, "component", "cells", "cy", "cx", "peak", "peak_y", "peak_x"), 4)


@query("hotspot_trajectory", f"""
WITH {SQL_L}, th AS (SELECT grid_id, var, t, quantile_cont(v, 0.9) AS threshold FROM cells GROUP BY grid_id, var, t)
SELECT grid_id, var, t, {rd('avg(y)', 4, 'cy')}, {rd('avg(x)', 4, 'cx')}, count(*) AS cells, {rd('max(threshold)', 4, 'threshold')}
FROM cells JOIN th USING (grid_id, var, t) WHERE v >= threshold GROUP BY grid_id, var, t""")
def hotspot_trajectory(spark, sf):
    return rounded(reg.hotspot_trajectory(grid_l(spark, sf)), 4)


SPATIAL_SQL = f"""{fill_sql('mm', 'fm', empty='0')}, {grad_sql('fm', 'gr', value='f')}, {_STATS}, {_HOTCELLS}, {comp_sql('hc', 'cc', width=64)},
hi AS (SELECT mm.* FROM mm JOIN (SELECT grid_id, var, avg(v) + stddev_pop(v) AS b FROM mm GROUP BY grid_id, var) USING (grid_id, var) WHERE v >= b), {comp_sql('hi', 'cd', width=64)},
mk AS (SELECT grid_id, var, y, x, coalesce(v >= threshold, false) AS hot FROM mm JOIN th USING (grid_id, var)),
nb AS (SELECT *, coalesce(lag(hot) OVER r, false) AS w, coalesce(lead(hot) OVER r, false) AS e, coalesce(lag(hot) OVER c, false) AS n, coalesce(lead(hot) OVER c, false) AS s
  FROM mk WINDOW r AS (PARTITION BY grid_id, var, y ORDER BY x), c AS (PARTITION BY grid_id, var, x ORDER BY y)),
bd AS (SELECT grid_id, var, avg(g) AS boundary_change FROM nb JOIN gr USING (grid_id, var, y, x)
  WHERE v IS NOT NULL AND (hot OR w OR e OR n OR s) <> (hot AND w AND e AND n AND s) GROUP BY grid_id, var),
nh AS (SELECT grid_id, var, count(DISTINCT component) AS hotspot_count FROM cc GROUP BY grid_id, var),
nd AS (SELECT grid_id, var, count(DISTINCT component) AS connected_domains FROM cd GROUP BY grid_id, var),
sp AS (SELECT grid_id, var, threshold, hotspot_count, connected_domains, gradient_strength, gradient_p95 AS gradient_strength_p95, {_ANISO} AS anisotropy, {_AXIS} AS direction, boundary_change
  FROM th JOIN nh USING (grid_id, var) JOIN nd USING (grid_id, var) JOIN gs USING (grid_id, var) JOIN bd USING (grid_id, var))"""
_SPATIAL_OUT = (
    f"SELECT grid_id, var, {rd('threshold')}, hotspot_count, connected_domains, {rd('gradient_strength')}, {rd('gradient_strength_p95')}, "
    f"{rd('anisotropy', 6)}, direction, {rd('boundary_change')} FROM sp"
)


@query("spatial_features", f"WITH RECURSIVE {SQL_F}, {_VMEAN}, {SPATIAL_SQL} {_SPATIAL_OUT}")
def spatial_features(spark, sf):
    g = grid_f(spark, sf)
    return rounded(reg.spatial_features(g, mask=mis.missing_masks(g)), anisotropy=6)


@query("spatial_features_many_variables", f"WITH RECURSIVE {SQL_E}, {MEAN}, {SPATIAL_SQL} {_SPATIAL_OUT}")
def spatial_features_many_variables(spark, sf):
    return rounded(reg.spatial_features(grid_e(spark, sf)), anisotropy=6)


# --- change over time ------------------------------------------------------------------------------------------


@query("linear_trend", f"""
WITH {SQL_E}, {SERIES}, f AS (SELECT grid_id, var, count(v) AS n, regr_slope(v, t) AS s, regr_intercept(v, t) AS i, CASE WHEN var_pop(v) = 0 THEN 0 ELSE regr_r2(v, t) END AS r FROM sm GROUP BY grid_id, var)
SELECT grid_id, var, n, {rd('s', 4, 'slope')}, {rd('i', 4, 'intercept')}, {rd('r', 6, 'r2')}, CASE WHEN s > 0 THEN 'increase' WHEN s < 0 THEN 'decrease' ELSE 'stable' END AS trend FROM f""")
def linear_trend(spark, sf):
    return rounded(tem.linear_trend(agg.series_mean(grid_e(spark, sf))), 4, r2=6)


TEMPORAL_SQL = """nv AS (SELECT *, row_number() OVER w - 1 AS i, v - lag(v) OVER w AS d FROM sm WHERE v IS NOT NULL WINDOW w AS (PARTITION BY grid_id, var ORDER BY t)),
sv AS (SELECT grid_id, var, count(v) AS n, avg(v) AS series_mean, max(v) - min(v) AS series_range, arg_min(v, i) AS first_value, arg_max(v, i) AS last_value, regr_slope(v, i) AS slope,
  stddev_pop(d) AS volatility, quantile_cont(abs(d), 0.9) AS p90 FROM nv GROUP BY grid_id, var),
tr AS (SELECT *, CASE WHEN slope * (n - 1) > greatest(series_range * 0.02, abs(series_mean) * 0.001, 1e-12) THEN 'increase'
  WHEN slope * (n - 1) < -greatest(series_range * 0.02, abs(series_mean) * 0.001, 1e-12) THEN 'decrease' ELSE 'stable' END AS trend FROM sv)"""


@query("classified_trend", f"""
WITH {SQL_E}, {SERIES}, {TEMPORAL_SQL} SELECT grid_id, var, n, trend, {rd('slope', 4)}, {rd('volatility', 4)}, {rd('series_mean', 4)}, {rd('series_range', 4)},
  {rd('first_value', 4)}, {rd('last_value', 4)} FROM tr""")
def classified_trend(spark, sf):
    return rounded(tem.classify_trend(agg.series_mean(grid_e(spark, sf))), 4)


_JUMPS = "jp AS (SELECT nv.grid_id, nv.var, t, i, d FROM nv JOIN sv USING (grid_id, var) WHERE n >= 3 AND volatility > 0 AND abs(d) >= greatest(2 * volatility, p90))"


@query("change_points", f"""
WITH {SQL_E}, {SERIES}, {TEMPORAL_SQL}, {_JUMPS} SELECT grid_id, var, t, CAST(i AS INT) AS i, {rd('d', 4, 'delta')} FROM jp QUALIFY row_number() OVER (PARTITION BY grid_id, var ORDER BY i) <= 10""")
def change_points(spark, sf):
    return rounded(tem.change_points(agg.series_mean(grid_e(spark, sf))), 4)


PERIOD_SQL = """ft AS (SELECT grid_id, var, regr_slope(v, i) AS s, regr_intercept(v, i) AS c, count(*) AS n FROM nv GROUP BY grid_id, var),
rs AS (SELECT grid_id, var, i, n, v - (s * i + c) AS e FROM nv JOIN ft USING (grid_id, var)),
ac AS (SELECT a.grid_id, a.var, b.i - a.i AS lag, sum(a.e * b.e) / any_value(p.p) AS r FROM rs a JOIN rs b ON a.grid_id = b.grid_id AND a.var = b.var AND b.i - a.i BETWEEN 2 AND least(a.n // 2, 366)
  JOIN (SELECT grid_id, var, sum(e * e) AS p FROM rs GROUP BY grid_id, var) p ON p.grid_id = a.grid_id AND p.var = a.var GROUP BY a.grid_id, a.var, b.i - a.i),
pk AS (SELECT * FROM (SELECT *, lag(r) OVER w AS l, lead(r) OVER w AS u FROM ac WINDOW w AS (PARTITION BY grid_id, var ORDER BY lag)) WHERE (l IS NULL OR r >= l) AND (u IS NULL OR r >= u)),
bp AS (SELECT * FROM pk QUALIFY row_number() OVER (PARTITION BY grid_id, var ORDER BY r DESC, lag) = 1),
pd AS (SELECT grid_id, var, n, lag, r AS strength, CASE WHEN r < 0.3 THEN 'none_detected' WHEN lag * {step} BETWEEN 6 AND 8 THEN 'weekly' WHEN lag * {step} BETWEEN 27 AND 32 THEN 'monthly'
  WHEN lag * {step} BETWEEN 80 AND 100 THEN 'seasonal' WHEN lag * {step} BETWEEN 350 AND 380 THEN 'annual' ELSE 'lag_' || lag || '_steps' END AS periodicity FROM bp JOIN ft USING (grid_id, var))"""


@query("periodicity", f"""
WITH {SQL_E}, {SERIES}, {TEMPORAL_SQL}, {PERIOD_SQL.format(step=1.0)} SELECT grid_id, var, n, CAST(lag AS INT) AS lag, {rd('strength', 6)}, periodicity FROM pd""")
def periodicity(spark, sf):
    g = grid_e(spark, sf)
    return rounded(tem.periodicity(g, agg.series_mean(g)), 6)


TEMPORAL_ALL = f"{TEMPORAL_SQL}, {_JUMPS}, {PERIOD_SQL.format(step=92.0)}, cpn AS (SELECT grid_id, var, count(*) AS change_points FROM jp GROUP BY grid_id, var)"


@query("temporal_features", f"""
WITH {SQL_L3}, {SERIES}, {TEMPORAL_ALL} SELECT grid_id, var, n, trend, {rd('slope', 4)}, {rd('volatility', 4)}, {rd('series_mean', 4)}, {rd('series_range', 4)}, {rd('first_value', 4)},
  {rd('last_value', 4)}, periodicity, coalesce(change_points, 0) AS change_points, var = 'price' AS is_primary
FROM tr JOIN (SELECT grid_id, var, periodicity FROM pd) USING (grid_id, var) LEFT JOIN cpn USING (grid_id, var)""")
def temporal_features(spark, sf):
    return rounded(tem.temporal_features(grid_l3(spark, sf)), 4)


@query("features_across_variables", f"""
WITH RECURSIVE {SQL_E}, {MEAN}, {SERIES}, {SPATIAL_SQL}, {TEMPORAL_SQL}, tc AS (SELECT grid_id, trend, count(*) AS n FROM tr GROUP BY grid_id, trend)
SELECT grid_id, {rd('avg(hotspot_count)', 4, 'mean_hotspot_count')}, {rd('avg(gradient_strength)', 4, 'mean_gradient_strength')}, {rd('avg(anisotropy)', 6, 'mean_anisotropy')},
  {rd('avg(connected_domains)', 4, 'mean_connected_domains')}, {rd('avg(boundary_change)', 4, 'mean_boundary_change')}, {rd('(SELECT avg(volatility) FROM tr)', 4, 'mean_volatility')},
  (SELECT string_agg(trend || ':' || n, ',' ORDER BY trend) FROM tc) AS trend_counts FROM sp GROUP BY grid_id""")
def features_across_variables(spark, sf):
    g = grid_e(spark, sf)
    return rounded(agg.across_variables(reg.spatial_features(g), tem.classify_trend(agg.series_mean(g))), 4, mean_anisotropy=6)


_TREND = """tm AS (SELECT grid_id, var, y, x, coalesce(sum((t - 13.5::DOUBLE) * (v - m)), 0) / 1827 AS tr FROM (
  SELECT *, avg(v) OVER (PARTITION BY grid_id, var, y, x) AS m FROM cells) GROUP BY grid_id, var, y, x)"""


@query("trend_map", f"WITH {SQL_L}, {_TREND} SELECT grid_id, var, y, x, {rd('tr', 3, 'v')} FROM tm")
def trend_map(spark, sf):
    return rounded(tem.trend_map(grid_l(spark, sf)))


_CELL = """ms AS (SELECT grid_id, var, y, x, avg(v) AS mean, stddev_pop(v) AS sd, max(v) FILTER (t = 20) AS cur, max(v) FILTER (t = 27) - max(v) FILTER (t = 0) AS dif
  FROM cells GROUP BY grid_id, var, y, x)"""


@query("anomaly_z_map", f"WITH {SQL_L}, {_CELL} SELECT grid_id, var, y, x, {rd('CASE WHEN sd > 1e-9 THEN (cur - mean) / sd ELSE 0 END', 6, 'v')} FROM ms")
def anomaly_z_map(spark, sf):
    return rounded(tem.anomaly_z(grid_l(spark, sf), 20), 6)


@query("anomaly_difference_map", f"WITH {SQL_L}, {_CELL} SELECT grid_id, var, y, x, {rd('cur - mean', 3, 'v')} FROM ms")
def anomaly_difference_map(spark, sf):
    return rounded(tem.anomaly_diff(grid_l(spark, sf), 20))


@query("difference_map", f"WITH {SQL_L}, {_CELL} SELECT grid_id, var, y, x, {rd('dif', 3, 'v')} FROM ms")
def difference_map(spark, sf):
    return rounded(tem.difference_map(grid_l(spark, sf)))


@query("anomaly_days", f"""
WITH {SQL_L3}, {SERIES}, {smooth_sql('sm', 'ss', 28)}, r AS (SELECT *, v - s AS residual FROM ss)
SELECT grid_id, var, t, {rd('v', 4, 'mean')}, {rd('residual', 4)}, CAST(row_number() OVER w AS INT) AS rank FROM r
WINDOW w AS (PARTITION BY grid_id, var ORDER BY abs(round(residual, 9)) DESC, t DESC) QUALIFY row_number() OVER w <= 8""")
def anomaly_days(spark, sf):
    return rounded(tem.anomaly_days(agg.series_mean(grid_l3(spark, sf))), 4)


@query("daily_trend", f"""
WITH {SQL_L3}, {SERIES}, f AS (SELECT grid_id, var, CASE WHEN count(v) = count(*) THEN round_even(regr_slope(v, t), 6) END AS slope, arg_min(v, t) AS a, arg_max(v, t) AS b FROM sm GROUP BY grid_id, var)
SELECT grid_id, var, {rd('slope', 4)}, {rd('a', 4, 'first_mean')}, {rd('b', 4, 'last_mean')}, {rd('b - a', 4, 'delta')}, CASE WHEN slope > 0 THEN 'increase' WHEN slope < 0 THEN 'decrease' ELSE 'stable' END AS direction FROM f""")
def daily_trend(spark, sf):
    return rounded(tem.daily_trend(agg.series_mean(grid_l3(spark, sf))), 4)


def similar_sql(t: int, least: int) -> str:
    return f"""sl AS (SELECT a.grid_id, a.var, a.t, count(*) AS cells, round_even({corr_sql('b.v', 'a.v')}, 4) AS similarity, round_even(sqrt(avg((b.v - a.v) * (b.v - a.v))), 4) AS rmse
  FROM cells a JOIN cells b ON a.grid_id = b.grid_id AND a.var = b.var AND a.y = b.y AND a.x = b.x AND b.t = {t} AND a.t <> {t} WHERE a.v IS NOT NULL AND b.v IS NOT NULL
  GROUP BY a.grid_id, a.var, a.t HAVING count(*) >= {least}),
tk AS (SELECT *, row_number() OVER (PARTITION BY grid_id, var ORDER BY CASE WHEN similarity = 0 THEN -1 ELSE similarity END DESC, t) AS rank FROM sl WHERE similarity IS NOT NULL)"""


@query("similar_slices", f"""
WITH {SQL_L}, {similar_sql(27, 200)} SELECT grid_id, var, t, cells, {rd('similarity', 4)}, {rd('rmse', 3)}, CAST(rank AS INT) AS rank FROM tk WHERE rank <= 8""")
def similar_slices(spark, sf):
    return rounded(tem.similar_slices(grid_l(spark, sf)), similarity=4)


@query("driver_correlation", f"""
WITH {SQL_E}, {SERIES}, r AS (SELECT a.grid_id, a.var, round_even({corr_sql('b.v', 'a.v')}, 4) AS correlation FROM sm a JOIN sm b ON a.grid_id = b.grid_id AND a.t = b.t AND b.var = 'view' AND a.var <> 'view'
  GROUP BY a.grid_id, a.var HAVING count(a.v + b.v) >= 3)
SELECT grid_id, var, correlation, CAST(row_number() OVER w AS INT) AS rank FROM r WHERE correlation IS NOT NULL WINDOW w AS (PARTITION BY grid_id ORDER BY abs(correlation) DESC, var) QUALIFY row_number() OVER w <= 12""")
def driver_correlation(spark, sf):
    return tem.driver_correlation(agg.daily_matrix(grid_e(spark, sf)), "view")
