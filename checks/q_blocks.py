"""Block pattern labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.grids import BOXES, SQL_L, SQL_Y, grid_l, grid_y, rd, rounded
from checks.registry import COMPASS, comp_sql, grad_sql, query
from gridframe.functions import rules
from gridframe.model import MAP
from gridframe.operators import blocks as blk, selection as sel
from gridframe.sources import sinks

REGION_CELLS = SQL_L.replace("cells AS (", "cells0 AS (") + """,
cells AS (SELECT grid_id, t, var, y, x, CASE WHEN x BETWEEN 5 AND 30 AND y BETWEEN 10 AND 40 THEN v END AS v, x BETWEEN 5 AND 30 AND y BETWEEN 10 AND 40 AS in_region FROM cells0)"""
ALL_CELLS = SQL_Y.replace("cells AS (", "cells0 AS (") + ", cells AS (SELECT *, true AS in_region FROM cells0)"

EDGES = """ey AS (SELECT i AS row, CAST(floor(i * (50 / 9.0::DOUBLE)) AS INT) AS y0, CASE WHEN i = 8 THEN 50 ELSE CAST(floor((i + 1) * (50 / 9.0::DOUBLE)) AS INT) END AS y1 FROM (SELECT CAST(range AS INT) AS i FROM range(9))),
ex AS (SELECT i AS col, CAST(floor(i * (40 / 14.0::DOUBLE)) AS INT) AS x0, CASE WHEN i = 13 THEN 40 ELSE CAST(floor((i + 1) * (40 / 14.0::DOUBLE)) AS INT) END AS x1 FROM (SELECT CAST(range AS INT) AS i FROM range(14)))"""


def clamp(e: str) -> str:
    return f"greatest(least({e}, 1.0), 0.0)"


def blocks_sql(t: int, variant: str, centre: float = 13.5, squares: float = 1827.0) -> str:
    masked = "in_region" if variant == "region" else "in_region AND mean IS NOT NULL"
    spot = "0.42 * {a} + 0.28 * {b} + 0.20 * {c} + 0.10 * {d}"
    packed = lambda n: clamp(f"1.0::DOUBLE - greatest(0, {n} - 1) / 2.0::DOUBLE")
    share = clamp("largest_component_ratio / 0.35::DOUBLE")
    h = clamp(spot.format(a=clamp("hotspot_ratio / 0.25::DOUBLE"), b=packed("nh"), c=share, d="peak_prominence_norm"))
    low = clamp(spot.format(a=clamp("lowspot_ratio / 0.25::DOUBLE"), b=packed("nl"), c=share, d="low_prominence_norm"))
    g = clamp(f"0.72 * {clamp('gradient_mean_norm / 0.40::DOUBLE')} + 0.28 * {clamp('1.0::DOUBLE - edge_strength_norm / 0.30::DOUBLE')}")
    d = clamp(f"0.72 * ({clamp('greatest(nh, nl) / 4.0::DOUBLE')} * {clamp('1.0::DOUBLE - largest_component_ratio')}) + 0.28 * {clamp('(nh + nl) / 8.0::DOUBLE')}")
    u = clamp("1.0::DOUBLE - greatest(std_norm / 0.10::DOUBLE, gradient_mean_norm / 0.05::DOUBLE)")
    n = f"greatest({clamp('missing_ratio / 0.30::DOUBLE')}, {clamp('outlier_ratio / 0.18::DOUBLE')})"
    return f"""{EDGES},
ms AS (SELECT grid_id, var, y, x, bool_or(in_region) AS in_region, avg(v) AS mean, stddev_pop(v) AS sd, max(v) FILTER (t = {t}) AS v,
  coalesce(sum((t - {centre}::DOUBLE) * v) - avg(v) * sum(t - {centre}::DOUBLE) FILTER (v IS NOT NULL), 0) / {squares} AS trend FROM cells GROUP BY grid_id, var, y, x),
mk AS (SELECT *, {masked} AS masked, CASE WHEN sd > 1e-9 THEN (v - mean) / sd ELSE 0 END AS z FROM ms),
fl AS (SELECT *, coalesce(CASE WHEN masked THEN v END, avg(CASE WHEN masked THEN v END) OVER (), 0) AS f FROM mk),
{grad_sql('fl', 'gr', value='f')},
r1 AS (SELECT min(v) AS lo, max(v) AS hi, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.75) AS p75, median(v) AS med, stddev_pop(v) AS sdv, greatest(quantile_cont(g, 0.95), 1e-9) AS gp FROM gr WHERE masked AND v IS NOT NULL),
rf AS (SELECT *, greatest(hi - lo, 1e-9) AS rng, greatest(1.4826 * (SELECT median(abs(v - med)) FROM gr, r1 WHERE masked AND v IS NOT NULL), sdv, 1e-9) AS osc FROM r1),
bc AS (SELECT gr.*, row, col, masked AND v IS NOT NULL AS ok FROM gr JOIN ey ON y >= y0 AND y < y1 JOIN ex ON x >= x0 AND x < x1),
hl AS (SELECT grid_id, var, row, col, 'h' AS kind, y, x FROM bc, rf WHERE ok AND v >= p75 UNION ALL SELECT grid_id, var, row, col, 'l', y, x FROM bc, rf WHERE ok AND v <= p25),
{comp_sql('hl', 'cc', ('grid_id', 'var', 'row', 'col', 'kind'))},
cs AS (SELECT row, col, kind, component, count(*) AS k FROM cc GROUP BY ALL),
cn AS (SELECT row, col, count(*) FILTER (kind = 'h') AS nh, count(*) FILTER (kind = 'l') AS nl, max(k) AS big FROM cs GROUP BY row, col),
bz AS (SELECT *, v - avg(v) FILTER (ok) OVER (PARTITION BY row, col) AS zc FROM bc),
mp AS (SELECT a.row, a.col, sum(a.zc * b.zc) AS num, count(*) AS np FROM bz a JOIN bz b ON a.ok AND b.ok AND a.row = b.row AND a.col = b.col
  AND ((a.y = b.y AND b.x = a.x + 1) OR (a.x = b.x AND b.y = a.y + 1)) GROUP BY a.row, a.col),
mo AS (SELECT row, col, CASE WHEN count(*) >= 4 AND sum(zc * zc) > 1e-12 THEN count(*) / (2.0::DOUBLE * any_value(np)) * 2 * any_value(num) / sum(zc * zc) END AS moran
  FROM bz JOIN mp USING (row, col) WHERE ok GROUP BY row, col),
st AS (SELECT grid_id, var, row, col, count(*) FILTER (ok) AS valid, count(*) FILTER (masked) AS mask_cells, avg(v) FILTER (ok) AS mean, stddev_pop(v) FILTER (ok) AS std, min(v) FILTER (ok) AS min,
  max(v) FILTER (ok) AS max, quantile_cont(v, 0.25) FILTER (ok) AS q25, quantile_cont(v, 0.5) FILTER (ok) AS q50, quantile_cont(v, 0.75) FILTER (ok) AS q75, avg(g) FILTER (ok) AS gradient_mean,
  stddev_pop(g) FILTER (ok) AS gradient_std, quantile_cont(g, 0.9) FILTER (ok) AS edge_strength, avg(gx) FILTER (ok) AS ax, avg(gy) FILTER (ok) AS ay, count(*) FILTER (ok AND v >= p75) AS kh,
  count(*) FILTER (ok AND v <= p25) AS kl, count(*) FILTER (ok AND abs((v - med) / osc) > 3.5) AS ko, avg(mean) FILTER (ok) AS mom, avg(trend) FILTER (masked) AS trend, avg(abs(z)) FILTER (masked) AS az,
  avg(abs(v - mean)) FILTER (ok) AS ad, min(y) AS y0, max(y) + 1 AS y1, min(x) AS x0, max(x) + 1 AS x1, any_value(rng) AS rng, any_value(gp) AS gp FROM bc, rf GROUP BY grid_id, var, row, col),
ft AS (SELECT * REPLACE (round_even(trend, 6) AS trend), max - min AS value_range, coalesce(nh, 0) AS components_high, coalesce(nl, 0) AS components_low, round_even(moran, 4) AS moran_i, {COMPASS.format(gx='ax', gy='ay')} AS direction,
  round_even(kh / valid, 4) AS hotspot_ratio, round_even(kl / valid, 4) AS lowspot_ratio, round_even(coalesce(big, 0) / valid, 4) AS largest_component_ratio, round_even(ko / valid, 4) AS outlier_ratio,
  round_even(1.0::DOUBLE - valid / mask_cells, 4) AS missing_ratio, round_even(valid / mask_cells, 4) AS finite_ratio, round_even(std / rng, 4) AS std_norm, round_even(gradient_mean / gp, 4) AS gradient_mean_norm,
  round_even(edge_strength / gp, 4) AS edge_strength_norm, round_even(greatest(max - mean, 0) / rng, 4) AS peak_prominence_norm, round_even(greatest(mean - min, 0) / rng, 4) AS low_prominence_norm
  FROM st LEFT JOIN cn USING (row, col) LEFT JOIN mo USING (row, col) WHERE valid > 0),
s0 AS (SELECT * EXCLUDE (nh, nl), components_high AS nh, components_low AS nl FROM ft),
s1 AS (SELECT *, {n} AS rn, {u} AS ru, {h} AS rh, {low} AS rl, {g} AS rg, {clamp('edge_strength_norm / 0.50::DOUBLE')} AS rb, {d} AS rdd FROM s0),
s2 AS (SELECT *, list_reverse_sort([rh, rl, rg, rb, rdd, ru]) AS o FROM s1),
s3 AS (SELECT *, round_even(rn, 4) AS sn, round_even(ru, 4) AS su, round_even(rh, 4) AS sh, round_even(rl, 4) AS sl, round_even(rg, 4) AS sg, round_even(rb, 4) AS sb, round_even(rdd, 4) AS sd,
  round_even({clamp('(1.0::DOUBLE - (o[1] - o[2]) / 0.12::DOUBLE) * 0.55 + o[2] * 0.45')}, 4) AS sm FROM s2),
s4 AS (SELECT row, col, unnest(['H', 'L', 'G', 'B', 'D']) AS l, unnest([sh, sl, sg, sb, sd]) AS s, unnest([1, 2, 3, 4, 5]) AS i FROM s3),
s5 AS (SELECT row, col, l AS top_l, s AS top_s, lead(s) OVER w AS run_s, row_number() OVER w AS k FROM s4 WINDOW w AS (PARTITION BY row, col ORDER BY s DESC, i)),
lb AS (SELECT s3.*, top_s, run_s, CASE WHEN missing_ratio > 0.30 OR sn >= 0.92 THEN 'N' WHEN std_norm < 0.10 AND gradient_mean_norm < 0.05 THEN 'U' WHEN top_s < 0.42 OR top_s - run_s < 0.12::DOUBLE THEN 'M' ELSE top_l END AS primary_label
  FROM s3 JOIN s5 ON s3.row = s5.row AND s3.col = s5.col AND k = 1),
lc AS (SELECT *, round_even(CASE WHEN primary_label = 'N' THEN sn WHEN primary_label = 'U' THEN greatest(su, 0.72) WHEN primary_label = 'M' THEN greatest(sm, least(0.86, 0.58 + run_s * 0.25)) ELSE top_s END, 4) AS confidence,
  greatest(sh, sl, sg, sb, sd) AS saliency, printf('B_%03d_%03d', row, col) AS block_id, CASE WHEN trend > 1e-5 THEN 'rising' WHEN trend < -1e-5 THEN 'falling' ELSE 'stable' END AS trend_label,
  CASE WHEN primary_label = 'N' THEN 'high' WHEN sn > 0.45 THEN 'medium' ELSE 'low' END AS uncertainty FROM lb)"""


PLAIN = blocks_sql(6, "finite", 3.0, 28.0)


def region_grid(spark, sf):
    return sel.prepare(grid_l(spark, sf), "price", "core", None, BOXES)


_FEATURES = ["mean", "std", "min", "max", "q25", "q50", "q75", "value_range", "gradient_mean", "gradient_std", "edge_strength"]
_NORMS = [
    "hotspot_ratio", "lowspot_ratio", "largest_component_ratio", "moran_i", "missing_ratio", "outlier_ratio", "std_norm", "gradient_mean_norm",
    "edge_strength_norm", "peak_prominence_norm", "low_prominence_norm",
]


@query("assigned_blocks", f"WITH {SQL_L}, {EDGES} SELECT row, col, count(*) AS n, min(y) AS y0, max(x) AS x1 FROM cells JOIN ey ON y >= y0 AND y < y1 JOIN ex ON x >= x0 AND x < x1 GROUP BY row, col")
def assigned_blocks(spark, sf):
    g = grid_l(spark, sf)
    placed = blk.assign_blocks(g, g.cells)
    return placed.groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("y0"), F.max("x").alias("x1"))


@query("assigned_fixed_blocks", f"WITH {SQL_L} SELECT y // 16 AS row, x // 12 AS col, count(*) AS n FROM cells GROUP BY ALL")
def assigned_fixed_blocks(spark, sf):
    g = grid_l(spark, sf)
    return blk.assign_blocks(g, g.cells, shape=(16, 12)).groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"))


@query("block_reference", f"""
WITH RECURSIVE {REGION_CELLS}, {blocks_sql(27, 'region')} SELECT 'L' AS grid_id, 'price' AS var, {rd('lo', 3, 'ref_min')}, {rd('hi', 3, 'ref_max')}, {rd('rng', 3, 'value_range_all')}, {rd('p25', 3, 'low_threshold')},
  {rd('p75', 3, 'high_threshold')}, {rd('med', 3, 'median')}, {rd('osc', 3, 'outlier_scale')}, {rd('gp', 3, 'gradient_p95')} FROM rf""")
def block_reference(spark, sf):
    g = region_grid(spark, sf)
    return rounded(blk.block_reference(g, blk.block_maps(g)))


@query("block_features", f"""
WITH RECURSIVE {REGION_CELLS}, {blocks_sql(27, 'region')}
SELECT grid_id, var, row, col, valid, mask_cells, components_high, components_low, direction, {", ".join(rd(c) for c in _FEATURES)}, {", ".join(rd(c, 4) for c in _NORMS)} FROM ft""")
def block_features(spark, sf):
    g = region_grid(spark, sf)
    rows = blk.block_features_semantic(g, blk.block_maps(g))
    return rounded(
        rows.select("grid_id", "var", "row", "col", "valid", "mask_cells", "components_high", "components_low", "direction", *_FEATURES, *_NORMS),
        **{c: 4 for c in _NORMS},
    )


@query("block_scores", f"""
WITH RECURSIVE {ALL_CELLS}, {PLAIN}
SELECT grid_id, var, row, col, {rd('sn', 4, 'N')}, {rd('su', 4, 'U')}, {rd('sh', 4, 'H')}, {rd('sl', 4, 'L')}, {rd('sg', 4, 'G')}, {rd('sb', 4, 'B')}, {rd('sd', 4, 'D')}, {rd('sm', 4, 'M')} FROM s3""")
def block_scores(spark, sf):
    g = grid_y(spark, sf)
    scored = blk.label_scores(blk.block_features_semantic(g, blk.block_maps(g, variant="finite")))
    return rounded(scored.select("grid_id", "var", "row", "col", "scores.*"), 4)


_SECOND = """sc AS (SELECT row, col, primary_label, unnest(['U', 'H', 'L', 'G', 'B', 'D']) AS l, unnest([su, sh, sl, sg, sb, sd]) AS s, unnest([0, 1, 2, 3, 4, 5]) AS i FROM lc),
sk AS (SELECT row, col, l, row_number() OVER (PARTITION BY row, col ORDER BY s DESC, i) AS k FROM sc WHERE l <> primary_label AND s >= 0.45),
se AS (SELECT row, col, string_agg(l, ',' ORDER BY k) AS secondary FROM sk WHERE k <= 2 GROUP BY row, col)"""


def _num(e: str, digits: int, scale: float = 1.0) -> str:
    """A rounded number as the text both engines give."""
    return f"CAST(round_even({e} * {scale}::DOUBLE, {digits}) AS VARCHAR)"


_HS = f"'high_share=' || {_num('hotspot_ratio', 1, 100)}"
_LS = f"'low_share=' || {_num('lowspot_ratio', 1, 100)}"
_BIG = f"'largest_region_share=' || {_num('largest_component_ratio', 1, 100)}"
_EVIDENCE = f"""CASE primary_label WHEN 'H' THEN {_HS} || ';high_regions=' || components_high || ';peak_above_mean=;' || {_BIG}
  WHEN 'L' THEN {_LS} || ';low_regions=' || components_low || ';minimum_below_mean=;' || {_BIG}
  WHEN 'G' THEN 'gradient_norm=' || {_num('gradient_mean_norm', 3)} || ';direction=' || coalesce(direction, 'flat') || ';continuous_change='
  WHEN 'D' THEN 'high_regions=' || components_high || ';low_regions=' || components_low || ';' || {_BIG} || ';fragmented='
  WHEN 'U' THEN 'std_norm=' || {_num('std_norm', 3)} || ';gradient_norm=' || {_num('gradient_mean_norm', 3)} || ';no_extremes='
  WHEN 'N' THEN 'missing_share=' || {_num('missing_ratio', 1, 100)} || ';outlier_share=' || {_num('outlier_ratio', 1, 100)} || ';low_reliability='
  WHEN 'M' THEN 'scores_close=;' || {_HS} || ';' || {_LS} || ';edge_norm=' || {_num('edge_strength_norm', 3)}
  ELSE 'edge_norm=' || {_num('edge_strength_norm', 3)} || ';local_break=' END"""


@query("block_labels", f"""
WITH RECURSIVE {ALL_CELLS}, {PLAIN}, {_SECOND}
SELECT grid_id, var, row, col, primary_label, {rd('confidence', 4)}, coalesce(secondary, '') AS secondary, {_EVIDENCE} || CASE WHEN missing_ratio <= 0.05 THEN ';low_missing=' ELSE '' END AS evidence
FROM lc LEFT JOIN se USING (row, col)""")
def block_labels(spark, sf):
    g = grid_y(spark, sf)
    scored = blk.label_scores(blk.block_features_semantic(g, blk.block_maps(g, variant="finite")))
    done = blk.evidence(blk.choose_label(scored))
    kept = F.filter("evidence", lambda e: (F.col("primary_label") != "B") | (e["code"] != "value_range"))
    text = F.array_join(F.transform(kept, lambda e: F.concat(e["code"], F.lit("="), e["value"])), ";")
    return rounded(done.select(
        "grid_id", "var", "row", "col", "primary_label", "confidence", F.array_join("secondary_labels", ",").alias("secondary"), text.alias("evidence"),
    ), 4)


_VOL = """bs AS (SELECT row, col, t, round_even(avg(v), 6) AS m FROM cells JOIN ey ON y >= y0 AND y < y1 JOIN ex ON x >= x0 AND x < x1 GROUP BY row, col, t),
vo AS (SELECT row, col, stddev_pop(m) AS volatility FROM bs GROUP BY row, col)"""
_RECORD = ["mean_map", "latest", "trend", "anomaly", "volatility"]


def _record_sql(away: str) -> str:
    return (
        f"grid_id, var, row, col, block_id, primary_label, {rd('confidence', 4)}, {rd('saliency', 4)}, {rd('finite_ratio', 4)}, trend_label, uncertainty, "
        f"{rd('round_even(mom, 6)', 3, 'mean_map')}, {rd('round_even(mean, 6)', 3, 'latest')}, {rd('trend', 3)}, {rd(f'round_even({away}, 6)', 3, 'anomaly')}, {rd('round_even(volatility, 6)', 3, 'volatility')}, "
        "lc.y0::DOUBLE AS lat_min, lc.y1 - 1.0::DOUBLE AS lat_max, lc.x0::DOUBLE AS lon_min, lc.x1 - 1.0::DOUBLE AS lon_max, (lc.y0 + lc.y1 - 1) / 2 AS lat, (lc.x0 + lc.x1 - 1) / 2 AS lon"
    )


def _record(blocks):
    return rounded(blocks.select(
        "grid_id", "var", "row", "col", "block_id", "primary_label", "confidence", "saliency", "finite_ratio", "trend_label", "uncertainty", *_RECORD,
        "lat_min", "lat_max", "lon_min", "lon_max", "lat", "lon",
    ), confidence=4, saliency=4, finite_ratio=4)


@query("block_table_region", f"WITH RECURSIVE {REGION_CELLS}, {blocks_sql(20, 'region')}, {_VOL} SELECT {_record_sql('az')} FROM lc JOIN vo USING (row, col)")
def block_table_region(spark, sf):
    return _record(blk.block_table(region_grid(spark, sf), t=20))


@query("block_table_plain", f"WITH RECURSIVE {ALL_CELLS}, {PLAIN}, {_VOL} SELECT {_record_sql('ad')} FROM lc JOIN vo USING (row, col)")
def block_table_plain(spark, sf):
    return _record(blk.generate_blocks(grid_y(spark, sf)))


def _plain(spark, sf):
    return blk.generate_blocks(grid_y(spark, sf))


_BASE = f"WITH RECURSIVE {ALL_CELLS}, {PLAIN}"
_DIST = f"ld AS (SELECT p.l AS label, p.i, count(lc.row) AS n FROM (SELECT unnest({list(rules.PATTERNS)}) AS l, unnest([5, 5, 5, 5, 5, 5, 5, 5]) AS i) p LEFT JOIN lc ON primary_label = p.l GROUP BY p.l, p.i)"


@query("top_blocks", f"""{_BASE} SELECT grid_id, var, row, col, {rd('saliency', 4)}, CAST(row_number() OVER w AS INT) AS rank FROM lc WINDOW w AS (PARTITION BY grid_id, var ORDER BY saliency DESC, row, col)
QUALIFY row_number() OVER w <= 12""")
def top_blocks(spark, sf):
    return rounded(blk.top_blocks(_plain(spark, sf)).select("grid_id", "var", "row", "col", "saliency", "rank"), 4)


@query("label_distribution", f"{_BASE}, {_DIST} SELECT 'Y' AS grid_id, label, n FROM ld")
def label_distribution(spark, sf):
    return blk.block_labels(_plain(spark, sf))


@query("pattern_distribution", f"{_BASE} SELECT grid_id, primary_label, count(*) AS n FROM lc GROUP BY grid_id, primary_label ORDER BY n DESC, primary_label")
def pattern_distribution(spark, sf):
    return blk.pattern_distribution(_plain(spark, sf))


@query("uncertainty_distribution", f"{_BASE} SELECT grid_id, uncertainty, count(*) AS n FROM lc GROUP BY grid_id, uncertainty ORDER BY uncertainty")
def uncertainty_distribution(spark, sf):
    return blk.uncertainty_distribution(_plain(spark, sf))


@query("view_recommendations", f"""{_BASE}, {_DIST}, rt AS (SELECT label, n, n / (SELECT count(*) FROM lc) AS r, list_position({list(rules.RECOMMEND_ORDER)}, label) AS rule FROM ld)
SELECT 'Y' AS grid_id, label, n, {rd('round_even(r, 4)', 4, 'ratio')}, CAST(row_number() OVER w AS INT) AS rank FROM rt WHERE r >= 0.12 OR (label IN ('H', 'G', 'B', 'D', 'N') AND r >= 0.08)
WINDOW w AS (ORDER BY round_even(r, 4) DESC, rule) QUALIFY row_number() OVER w <= 6""")
def view_recommendations(spark, sf):
    done = blk.recommend(blk.block_labels(_plain(spark, sf)))
    return rounded(done.select("grid_id", "label", "n", "ratio", "rank"), 4)


@query("block_rollup", f"""{_BASE}, g AS (SELECT *, row // 3 AS big_row, col // 3 AS big_col, row * 100 + col AS pos FROM lc),
c AS (SELECT big_row, big_col, primary_label, count(*) AS n, min(pos) AS pos FROM g GROUP BY ALL),
m AS (SELECT big_row, big_col, primary_label AS label FROM c QUALIFY row_number() OVER (PARTITION BY big_row, big_col ORDER BY n DESC, pos) = 1),
b AS (SELECT grid_id, var, big_row, big_col, block_id FROM g QUALIFY row_number() OVER (PARTITION BY big_row, big_col ORDER BY confidence DESC, pos) = 1)
SELECT grid_id, var, big_row, big_col, label, block_id FROM m JOIN b USING (big_row, big_col)""")
def block_rollup(spark, sf):
    return blk.rollup_blocks(_plain(spark, sf), 3)


@query("anomaly_block_share", f"""{_BASE} SELECT grid_id, var, count(*) AS blocks, CASE WHEN count(*) FILTER (saliency > 0.72) > 0 THEN count(*) FILTER (saliency > 0.72) ELSE CAST(round(count(*) * 0.17) AS BIGINT) END AS anomaly_blocks
FROM lc GROUP BY grid_id, var""")
def anomaly_block_share(spark, sf):
    return blk.anomaly_block_share(_plain(spark, sf))


@query("evidence_quality", f"""{_BASE} SELECT row, col, CASE WHEN missing_ratio >= 0.5 THEN 'weak' WHEN primary_label = 'N' THEN 'uncertain' ELSE 'sufficient' END AS evidence_quality FROM lc""")
def evidence_quality(spark, sf):
    return blk.evidence_quality(_plain(spark, sf)).select("row", "col", "evidence_quality")


@query("block_matrix", f"""{_BASE}, fr AS (SELECT r.range AS row, c.range AS col FROM range(9) r, range(14) c)
SELECT 'Y' AS grid_id, 'price' AS var, CAST(row AS INT) AS row, string_agg(coalesce(primary_label, '-'), ' ' ORDER BY col) AS line FROM fr LEFT JOIN lc USING (row, col) GROUP BY row""")
def block_matrix(spark, sf):
    matrix = sinks.to_matrix(_plain(spark, sf), "primary_label", 9, 14)
    line = F.array_join(F.transform("line", lambda v: F.coalesce(v, F.lit("-"))), " ")
    return matrix.select(*MAP, F.posexplode("matrix").alias("row", "line")).select(*MAP, "row", line.alias("line"))
