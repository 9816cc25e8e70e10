"""Request tagging, plans, evidence, images and arrays as sources, composed analyses.

Requests are the texts of ``conversations``, each followed by one of a list of phrases chosen by its keys.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from checks.grids import BOXES, E_VARS, SQL_E, SQL_I, SQL_L, SQL_L3, SQL_RGB, grid_e, grid_i, grid_l, grid_l3, grid_rgb, rd, rounded, table
from checks.q_blocks import REGION_CELLS, blocks_sql
from checks.q_fields import _JUMPS, SPATIAL_SQL, TEMPORAL_SQL, similar_sql
from checks.q_vision import flat_image, image_sql
from checks.registry import MEAN, SERIES, comp_sql, corr_sql, fill_sql, query
from gridframe.functions import rules
from gridframe.functions.columns import unite
from gridframe.model import MAP
from gridframe.operators import aggregates as agg, blocks as blk, missing as mis, requests as req, regions as reg, selection as sel, temporal as tem
from gridframe.plans import analyze as plans
from gridframe.sources import arrays, catalog, images, sinks

PHRASES = (
    "今天和昨天的PM2.5对比", "近7天温度变化趋势", "过去 30 天污染扩散轨迹", "湿度异常在哪里", "华北地区的风速分布", "京津冀污染来源溯源", "杭州市降水与气压的关系",
    "image edge strength", "图片纹理和边缘", "对西南地区做聚类分区", "2024年3月的气温", "2024-03-05 wind field", "最近一周长三角降雨", "热点区的高值", "temperature and humidity",
    "show the click hotspot", "极端事件", "短波辐射 snow", "trend of error 2024/01/07", "view purchase correlation", "地图展示 全国 signup", "比湿与高程", "近三天亮度", "",
)
_TEXT_SQL = (
    "rq AS (SELECT conv_id * 1000 + turn AS id, text || ' ' || " + str(list(PHRASES)) + f"[(conv_id * 7 + turn * 5) % {len(PHRASES)} + 1] AS q FROM conversations)"
)


def requests(spark, sf):
    pick = F.get(F.array(*[F.lit(p) for p in PHRASES]), ((F.col("conv_id") * 7 + F.col("turn") * 5) % len(PHRASES)).cast("int"))
    return table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat_ws(" ", "text", pick).alias("q"))


def _hits(words, text: str = "q") -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


_TASK = f"""CASE WHEN {_hits(rules.COMPARE_WORDS)} THEN 'comparison' WHEN {_hits(rules.CHANGE_WORDS)} AND {_hits(rules.CHANGE_SOURCE_WORDS)} THEN 'source_tracing' WHEN {_hits(rules.CHANGE_WORDS)} THEN 'trend_analysis'
  WHEN {_hits(rules.SOURCE_WORDS)} THEN 'source_tracing' WHEN {_hits(rules.CLUSTER_WORDS)} THEN 'clustering' WHEN {_hits(rules.ANOMALY_WORDS)} THEN 'anomaly_detection' WHEN {_hits(rules.IMAGE_WORDS)} THEN 'distribution'
  WHEN {_hits(rules.CAUSE_WORDS)} THEN 'attribution' WHEN {_hits(rules.SHOW_WORDS)} THEN 'distribution' ELSE 'summary' END"""
_BROAD = "CASE " + " ".join(f"WHEN {_hits(w, 'lower(q)')} THEN '{t}'" for t, w in rules.BROAD_TASK_RULES) + f" ELSE '{rules.BROAD_TASK_DEFAULT}' END"


@query("request_tasks", f"WITH {_TEXT_SQL} SELECT id, {_TASK} AS task_type, {_BROAD} AS broad_task FROM rq")
def request_tasks(spark, sf):
    return requests(spark, sf).select("id", req.tag_task(F.col("q")).alias("task_type"), req.tag_broad_task(F.col("q")).alias("broad_task"))


def _matched(name: str) -> str:
    for v in E_VARS:
        if v.lower() == name.lower():
            return v
    return next((v for v in E_VARS if name.lower() in v.lower() or v.lower() in name.lower()), name)


_MENTIONS = "list_distinct_ordered"
_NAMES_SQL = ", ".join(f"CASE WHEN contains(lower(q), '{a}') THEN '{_matched(n)}' END" for a, n in rules.MENTION_ALIASES)
_NAMES_SQL += "".join(f", CASE WHEN contains(lower(q), '{v}') THEN '{v}' END" for v in E_VARS)


@query("request_variables", f"""
WITH {_TEXT_SQL}, h AS (SELECT id, [{_NAMES_SQL}] AS l FROM rq), u AS (SELECT id, unnest(l) AS v, unnest(range(len(l))) AS i FROM h), d AS (SELECT id, v, min(i) AS i FROM u WHERE v IS NOT NULL GROUP BY id, v)
SELECT rq.id, coalesce((SELECT string_agg(v, ',' ORDER BY i) FROM d WHERE d.id = rq.id), 'click') AS variables FROM rq""")
def request_variables(spark, sf):
    return requests(spark, sf).select("id", F.array_join(req.tag_variables(F.col("q"), E_VARS, "click"), ",").alias("variables"))


_REGION = "CASE " + " ".join(f"WHEN contains(q, '{a}') THEN '{n}'" for a, n in rules.REGION_MENTIONS) + f" WHEN regexp_matches(q, '{rules.PLACE_PATTERN}') AND regexp_extract(q, '{rules.PLACE_PATTERN}') NOT IN {rules.NOT_PLACES} THEN regexp_extract(q, '{rules.PLACE_PATTERN}') ELSE '{rules.DEFAULT_REGION}' END"
_TIME = "CASE " + " ".join(
    f"WHEN regexp_matches(q, '{p}') THEN " + ("'" + f.replace("{}", f"' || regexp_extract(q, '{p}', 1) || '") + "'" if "{}" in f else f"'{f}'") for p, f in rules.TIME_PATTERNS
) + " ELSE '2024-01-01 至 2024-01-30' END"


@query("request_region_and_time", f"WITH {_TEXT_SQL} SELECT id, {_REGION} AS region, {_TIME} AS time_range FROM rq")
def request_region_and_time(spark, sf):
    time = req.tag_time(F.col("q"), F.lit("2024-01-01"), F.lit("2024-01-30"))
    return requests(spark, sf).select("id", req.tag_region(F.col("q")).alias("region"), time.alias("time_range"))


_PAGE_VAR = "CASE " + " ".join(f"WHEN {_hits(w, 'lower(q)')} THEN '{v if v in ('temp', 'wind', 'rain') else 'PM2.5'}'" for w, v in req.PAGE_VARIABLES) + " ELSE 'temp' END"
_PAGE_REGION = "CASE " + " ".join(f"WHEN contains(q, '{w}') THEN '{c}'" for w, c in req.PAGE_REGIONS) + " ELSE 'china' END"


@query("request_page_tags", f"WITH {_TEXT_SQL} SELECT id, {_PAGE_VAR} AS variable, {_PAGE_REGION} AS region FROM rq")
def request_page_tags(spark, sf):
    return requests(spark, sf).select("id", req.page_variable(F.col("q"), ("temp", "wind", "rain")).alias("variable"), req.page_region(F.col("q")).alias("region"))


_STEPS = "CASE " + " ".join(f"WHEN task = '{t}' THEN '{'|'.join(s).replace('{}', 'click')}'" for t, s in rules.TASK_STEPS.items()) + " END"
_PRODUCTS = "CASE WHEN image THEN '" + "|".join(rules.IMAGE_PRODUCTS) + "' " + " ".join(f"WHEN task = '{t}' THEN '{'|'.join(p)}'" for t, p in rules.TASK_PRODUCTS.items()) + " END"
_PATCH_STEPS = f"CASE WHEN patches THEN '{'|'.join(rules.PATCH_STEPS)}' || CASE WHEN image THEN '|{'|'.join(rules.PATCH_IMAGE_STEPS)}' ELSE '' END || CASE WHEN task IN {rules.PATCH_REGION_TASKS} THEN '|{'|'.join(rules.PATCH_REGION_STEPS)}' ELSE '' END ELSE '' END"
_TABLES = "CASE " + " ".join(f"WHEN task = '{t}' THEN '|{'|'.join(f)}'" for t, f in rules.TASK_FEATURES.items()) + " ELSE '' END"


@query("request_products", f"""
WITH {_TEXT_SQL}, k AS (SELECT id, {_TASK} AS task, id % 4 = 0 AS image, id % 3 = 0 AS patches, id % 2 AS hotspots FROM rq)
SELECT id, '{'|'.join(rules.BASE_FEATURES)}' || CASE WHEN image THEN '|image_features' ELSE '' END || CASE WHEN patches THEN '|transformer_features' ELSE '' END || {_TABLES} AS required_features, {_PRODUCTS} AS derived_products,
  {_STEPS} AS steps, {_PATCH_STEPS} AS patch_steps, CASE WHEN task IN ('anomaly_detection', 'source_tracing') THEN 'high' WHEN hotspots > 0 THEN 'medium' ELSE 'low' END AS priority FROM k""")
def request_products(spark, sf):
    tags = req.tag_products(req.tag_task(F.col("q")), F.col("id") % 4 == 0, F.col("id") % 3 == 0, F.col("id") % 2, F.lit("click"))
    joined = {k: F.array_join(v, "|") if k != "priority" else v for k, v in tags.items()}
    return requests(spark, sf).select("id", *[v.alias(k) for k, v in joined.items()])


@query("risk_flags", f"""
WITH {SQL_E}, m AS (SELECT grid_id, var, t, avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END) AS r, t % 3 AS k FROM cells GROUP BY grid_id, var, t),
f AS (SELECT grid_id, var, t, list_filter([CASE WHEN r > 0.3 THEN 'high_missing' END, CASE WHEN k = 1 AND t % 2 = 0 THEN 'pixel_coordinates' END, CASE WHEN k = 1 AND t % 2 = 0 THEN 'single_frame' END,
  CASE WHEN k = 1 AND t % 2 <> 0 THEN 'single_time_step' END, CASE WHEN t % 5 = 0 THEN 'no_anomaly_found' END], lambda s: s IS NOT NULL) AS l FROM m)
SELECT grid_id, var, t, CASE WHEN len(l) = 0 THEN 'stay_within_coverage' ELSE array_to_string(l, ',') END AS risks FROM f""")
def risk_flags(spark, sf):
    shares = grid_e(spark, sf).cells.groupBy("grid_id", "var", "t").agg(F.avg(F.col("v").isNull().cast("int")).alias("r"))
    image = (F.col("t") % 3 == 1) & (F.col("t") % 2 == 0)
    return shares.select("grid_id", "var", "t", F.array_join(req.risk_flags(F.col("r"), F.col("t") % 3, image, F.col("t") % 5), ",").alias("risks"))


def _reply_texts(spark, sf):
    """Replies in the forms models give them: plain, fenced, wrapped in prose, broken, or not an object."""
    body = F.to_json(F.struct(
        F.struct(
            F.when(F.col("turn") % 2 == 0, "clustering").otherwise("something else").alias("task_type"), F.when(F.col("turn") % 3 == 0, "").otherwise("华南地区").alias("region"),
            F.when(F.col("turn") % 2 == 1, F.array(F.lit("temp"), F.lit("wind"))).alias("variables"),
        ).alias("task_graph"),
        F.struct(F.when(F.col("turn") % 2 == 0, "two colours").alias("color_encoding"), F.col("role").alias("focus_region")).alias("visualization_strategy"),
        F.array(F.lit("why"), F.col("role"), F.lit("why")).alias("follow_up_questions"),
        F.array(F.lit("r1"), F.lit("base risk"), F.concat(F.lit("r"), F.col("conv_id").cast("string"))).alias("uncertainty_risks"),
    ))
    form = (F.col("conv_id") + F.col("turn")) % 5
    text = (
        F.when(form == 0, body).when(form == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(form == 2, F.concat(F.lit("Here it is: "), body, F.lit(" done.")))
        .when(form == 3, F.concat(F.lit("{broken "), F.substring("text", 1, 5), F.lit("}"))).otherwise(F.lit("[1, 2]"))
    )
    return table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "turn", text.alias("reply_text"))


_REPLY = """rp AS (SELECT conv_id * 1000 + turn AS id, conv_id, turn, role, (conv_id + turn) % 5 IN (0, 1, 2) AS ok FROM conversations)"""


@query("parsed_replies", f"""
WITH {_REPLY} SELECT id, ok AS parsed, CASE WHEN ok THEN CASE WHEN turn % 2 = 0 THEN 'clustering' ELSE 'something else' END END AS task_type, CASE WHEN ok THEN 'r1,base risk,r' || conv_id END AS risks FROM rp""")
def parsed_replies(spark, sf):
    done = req.parse_replies(_reply_texts(spark, sf), "reply_text")
    return done.select("id", F.col("reply").isNotNull().alias("parsed"), F.col("reply.task_graph.task_type").alias("task_type"), F.array_join("reply.uncertainty_risks", ",").alias("risks"))


@query("merged_plans", f"""
WITH {_REPLY} SELECT id, CASE WHEN ok AND turn % 2 = 0 THEN 'clustering' ELSE 'summary' END AS task_type, CASE WHEN ok AND turn % 3 <> 0 THEN '华南地区' ELSE '数据覆盖区域' END AS region,
  CASE WHEN ok AND turn % 2 = 1 THEN 'temp,wind' ELSE 'PM2.5' END AS variables, 'heatmap + contour overlay' AS chart_type, 'base risk' || CASE WHEN ok THEN ',r1' || CASE WHEN conv_id = 1 THEN '' ELSE ',r' || conv_id END ELSE '' END AS risks,
  CASE WHEN ok AND turn % 2 = 0 THEN 'two colours' ELSE 'sequential color scale' END AS color_encoding, CASE WHEN ok THEN role ELSE '数据覆盖区域' END AS focus_region, CASE WHEN ok THEN 'why,' || role ELSE '' END AS follow_up FROM rp""")
def merged_plans(spark, sf):
    none = F.lit(None).cast("string")
    plan = req.parse_replies(_reply_texts(spark, sf), "reply_text").withColumns({
        "task_type": F.lit("summary"), "region": none, "variables": F.array(F.lit("PM2.5")), "time_range": none, "chart_type": none, "layout": none, "color_encoding": none,
        "focus_region": none, "uncertainty_risks": F.array(F.lit("base risk")),
    })
    done = req.merge_plans(req.with_defaults(plan))
    return done.select("id", "task_type", "region", F.array_join("variables", ",").alias("variables"), "chart_type", F.array_join("uncertainty_risks", ",").alias("risks"), "color_encoding", "focus_region", F.array_join("follow_up_questions", ",").alias("follow_up"))


@query("merged_analysis_plans", """
WITH c AS (SELECT conv_id * 1000 + turn AS id, conv_id, turn, role, text FROM conversations)
SELECT id, 'base' AS kept, CASE WHEN turn % 3 = 0 THEN 'base' ELSE role END AS priority, CASE WHEN turn % 2 = 0 THEN '["' || role || '",' || conv_id || ']' ELSE '["a"]' END AS products,
  CASE WHEN turn % 4 = 1 THEN '{"depth":' || turn || '}' END AS extra, CASE WHEN turn % 5 = 0 THEN NULL ELSE conv_id::DOUBLE / 2 END AS threshold, md5(coalesce(nullif(text, ''), 'none')) AS answer,
  CASE WHEN turn % 2 = 1 THEN 'goal ' || conv_id END AS goal FROM c""")
def merged_analysis_plans(spark, sf):
    """Fields of replies that no column has, over those of the plan; the texts of the conversations come back as answers."""
    k, t = F.col("conv_id"), F.col("turn")
    priority = F.when(t % 3 == 0, F.lit("")).otherwise(F.col("role"))
    # Lists of a text and a number have no column type, so the text of the reply is put together.
    products = F.when(t % 2 == 0, F.format_string('["%s", %d]', "role", "conv_id")).otherwise("[]")
    extra = F.when(t % 4 == 1, F.format_string('{"depth": %d}', "turn")).otherwise("{}")
    threshold = F.when(t % 5 == 0, F.lit("null")).otherwise((k / 2).cast("string"))
    goal = F.when(t % 2 == 1, F.format_string('{"analysis_goals": "goal %d", "task_type": ""}', "conv_id")).otherwise('"none"')
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("s"))), r'(?s)^\{"s":(.*)\}$', 1)
    body = F.concat(
        F.lit('{"analysis_plan": {"priority": '), quoted(priority), F.lit(', "products": '), products, F.lit(', "extra": '), extra, F.lit(', "threshold": '), threshold,
        F.lit('}, "task_graph": '), goal, F.lit(', "semantic_response": '), quoted(F.coalesce("text", F.lit(""))), F.lit("}"),
    )
    rows = table(spark, sf, "conversations").select((k * 1000 + t).alias("id"), "conv_id", "turn", "role", "text").withColumn("r", body)
    none = F.lit(None).cast("string")
    base = F.from_json(F.lit('{"priority": "base", "kept": "base", "products": ["a"]}'), "map<string,variant>")
    plans_ = req.with_defaults(req.parse_replies(rows, "r").withColumns({
        **{c: none for c in ("task_type", "region", "time_range", "chart_type", "layout", "color_encoding", "focus_region")}, "variables": F.array(F.lit("v")), "uncertainty_risks": F.array().cast("array<string>"),
    })).withColumns({"analysis_plan": base, "semantic_response": F.lit("none")})
    done = req.merge_plans(plans_)
    at = lambda m, name, kind: F.try_variant_get(F.try_element_at(F.col(m), F.lit(name)), "$", kind)
    return done.select(
        "id", at("analysis_plan", "kept", "string").alias("kept"), at("analysis_plan", "priority", "string").alias("priority"), F.to_json(F.try_element_at("analysis_plan", F.lit("products"))).alias("products"),
        F.to_json(F.try_element_at("analysis_plan", F.lit("extra"))).alias("extra"), at("analysis_plan", "threshold", "double").alias("threshold"), F.md5("semantic_response").alias("answer"),
        at("more_task_graph", "analysis_goals", "string").alias("goal"),
    )


@query("united_lists", """
WITH u AS (SELECT c_custkey AS k, unnest(['BUILDING', 'A', c_mktsegment, '', 'Z', c_mktsegment]) AS s, unnest([1, 2, 3, 4, 5, 6]) AS i FROM customer), d AS (SELECT k, s, min(i) AS i FROM u WHERE s <> '' GROUP BY k, s)
SELECT k, string_agg(s, ',' ORDER BY i) AS s FROM d GROUP BY k""")
def united_lists(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("k"), F.array_join(unite(F.array(F.lit("BUILDING"), F.lit("A"), F.col("c_mktsegment")), F.array(F.lit(""), F.lit("Z"), F.col("c_mktsegment"))), ",").alias("s"))


_RESOLVE_VARS = ("PM2.5", "temp", "rhum", "wind")
_ALIAS = [(a, v) for a, v in rules.SELECT_ALIASES if v in _RESOLVE_VARS]


@query("resolved_variables", f"""
WITH {_TEXT_SQL}, n AS (SELECT id, CASE id % 4 WHEN 0 THEN ' temp ' WHEN 1 THEN 'HUMIDITY' WHEN 2 THEN q ELSE 'win' END AS name FROM rq)
SELECT id, CASE WHEN trim(name) IN {_RESOLVE_VARS} THEN trim(name) {" ".join(f"WHEN lower(trim(name)) = '{a}' THEN '{v}'" for a, v in _ALIAS)} {" ".join(f"WHEN contains(lower(trim(name)), '{a}') THEN '{v}'" for a, v in _ALIAS)}
  {" ".join(f"WHEN contains('{v.lower()}', lower(trim(name))) THEN '{v}'" for v in _RESOLVE_VARS)} ELSE 'PM2.5' END AS resolved FROM n""")
def resolved_variables(spark, sf):
    k = F.col("id") % 4
    named = requests(spark, sf).select("id", F.when(k == 0, " temp ").when(k == 1, "HUMIDITY").when(k == 2, F.col("q")).otherwise("win").alias("name"))
    return sel.resolve_variable(named, _RESOLVE_VARS).select("id", "resolved")


# --- evidence ------------------------------------------------------------------------------------------------------


_SPREAD = "CASE WHEN anisotropy > 0.35 THEN 'directional' ELSE 'diffuse' END || ' hotspot region(s), ' || CASE WHEN gradient_strength > 1 THEN 'sharp-gradient' ELSE 'smooth-gradient' END"


@query("semantic_labels", f"""
WITH RECURSIVE {SQL_E}, {MEAN}, {SERIES}, {SPATIAL_SQL}, {TEMPORAL_SQL}
SELECT grid_id, var, hotspot_count || ' ' || {_SPREAD} AS spatial_pattern, trend || ', ' || CASE WHEN volatility > 1 THEN 'volatile' ELSE 'low volatility' END AS temporal_pattern FROM sp JOIN tr USING (grid_id, var)""")
def semantic_labels(spark, sf):
    g = grid_e(spark, sf)
    rows = reg.spatial_features(g).join(tem.classify_trend(agg.series_mean(g)), MAP)
    return req.semantic_labels(rows).select(*MAP, "spatial_pattern", "temporal_pattern")


@query("evidence_table", f"""
WITH RECURSIVE {SQL_E}, {MEAN}, {SERIES}, {SPATIAL_SQL}, {TEMPORAL_SQL},
s AS (SELECT grid_id, var, min(v) AS mn, max(v) AS mx, avg(v) AS mean, stddev_pop(v) AS std, quantile_cont(v, 0.95) AS p95, avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END) AS miss FROM cells GROUP BY grid_id, var),
k AS (SELECT grid_id, var, component, count(*) AS n FROM cc GROUP BY ALL), t AS (SELECT grid_id, var, n, row_number() OVER (PARTITION BY grid_id, var ORDER BY n DESC, component) AS r FROM k)
SELECT grid_id, var, {rd('mn', 3, 'min')}, {rd('mx', 3, 'max')}, {rd('mean')}, {rd('std')}, {rd('p95')}, {rd('miss', 6, 'missing_ratio')}, hotspot_count, connected_domains, {rd('gradient_strength')}, {rd('anisotropy', 6)}, {rd('boundary_change')},
  trend, {rd('slope')}, {rd('volatility')}, {rd('series_range')}, (SELECT string_agg(n, ',' ORDER BY r) FROM t WHERE t.grid_id = s.grid_id AND t.var = s.var AND r <= 5) AS top_hotspots
FROM s JOIN sp USING (grid_id, var) JOIN tr USING (grid_id, var)""")
def evidence_table(spark, sf):
    g = grid_e(spark, sf)
    mean = agg.mean_map(g)
    spots = reg.component_table(g, reg.hotspots(g, mean), n=None)
    rows = req.evidence_table(agg.statistics(g), reg.spatial_features(g), tem.classify_trend(agg.series_mean(g)), spots)
    flat = rows.withColumn("top_hotspots", F.array_join(F.transform("top_hotspots", lambda h: h["cells"].cast("string")), ","))
    return rounded(flat.drop("mean_text", "spatial_pattern", "temporal_pattern"), missing_ratio=6, anisotropy=6)


@query("narrative_facts", f"""
WITH RECURSIVE {SQL_L3.replace("cells AS (", "cells3 AS (")}, cells AS (SELECT *, true AS in_region FROM cells3 WHERE var = 'price'), {blocks_sql(27, 'region')},
sm AS (SELECT grid_id, var, t, avg(v) AS v FROM cells3 GROUP BY grid_id, var, t), f AS (SELECT grid_id, var, CASE WHEN count(v) = count(*) THEN regr_slope(v, t) END AS s, arg_max(v, t) - arg_min(v, t) AS d FROM sm GROUP BY grid_id, var),
r AS (SELECT a.var, round_even({corr_sql('b.v', 'a.v')}, 4) AS c FROM sm a JOIN sm b ON a.t = b.t AND b.var = 'price' AND a.var <> 'price' GROUP BY a.var)
SELECT grid_id, var, CASE WHEN s IS NULL OR abs(s) < 1e-5 THEN 'stable' WHEN s > 0 AND d >= 0 THEN 'rising' WHEN s < 0 AND d <= 0 THEN 'falling' ELSE 'fluctuating' END AS direction,
  (SELECT string_agg(var || '(' || CASE WHEN c < 0 THEN '' ELSE '+' END || printf('%.2f', c) || ')', ', ' ORDER BY abs(c) DESC) FROM r) AS top_correlations,
  CASE WHEN var = 'price' THEN (SELECT string_agg(block_id || '[' || primary_label || '/' || trend_label || ']', ', ' ORDER BY k) FROM (SELECT *, row_number() OVER (ORDER BY saliency DESC, row, col) AS k FROM lc) WHERE k <= 3) END AS top_blocks FROM f""")
def narrative_facts(spark, sf):
    g = grid_l3(spark, sf)
    trend = tem.daily_trend(agg.series_mean(g))
    drivers = tem.driver_correlation(agg.daily_matrix(g), "price")
    return req.narrative_facts(trend, drivers, blk.block_table(g.one("price")))


@query("exported_rows", f"""
SELECT CAST(vec_id AS VARCHAR) AS id, 64 AS dim, 4 AS shown, {", ".join(f"round(CAST(embedding[{i + 1}] AS DOUBLE), 4) + 0.0 AS e{i}" for i in range(4))} FROM embeddings""")
def exported_rows(spark, sf):
    """Vectors shortened to a preview in the JSON export."""
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    read = sinks.json_rows(rows, 4).select(F.from_json("value", "vec_id bigint, embedding_dim int, embedding_preview array<double>").alias("j"))
    first = [(F.round(F.col("j.embedding_preview")[i], 4) + F.lit(0.0)).alias(f"e{i}") for i in range(4)]
    return read.select(F.col("j.vec_id").cast("string").alias("id"), F.col("j.embedding_dim").alias("dim"), F.size("j.embedding_preview").alias("shown"), *first)


@query("exported_vectors", """
SELECT CAST(vec_id AS VARCHAR) AS id, i, round(CAST(embedding[i + 1] AS DOUBLE), 4) + 0.0 AS v FROM embeddings, (SELECT CAST(range AS INT) AS i FROM range(64))""")
def exported_vectors(spark, sf):
    """Whole vectors in the JSON export."""
    rows = sinks.json_rows(table(spark, sf, "embeddings").select("vec_id", "embedding"), None)
    read = rows.select(F.from_json("value", "vec_id bigint, embedding array<double>").alias("j"))
    return read.select(F.col("j.vec_id").cast("string").alias("id"), F.posexplode("j.embedding").alias("i", "v")).withColumn("v", F.round("v", 4) + F.lit(0.0))


@query("map_summaries", f"WITH {SQL_E}, {MEAN} SELECT grid_id, var, 8 AS n_y, 16 AS n_x, {rd('min(v)', 3, 'min')}, {rd('max(v)', 3, 'max')} FROM mm GROUP BY grid_id, var")
def map_summaries(spark, sf):
    return rounded(sinks.map_summaries(agg.mean_map(grid_e(spark, sf))))


# --- images and arrays as sources --------------------------------------------------------------------------------------


@query("image_pixels", f"""
WITH {SQL_RGB}, w AS (SELECT grid_id, y, x, max(v) FILTER (var = 'red') AS r, max(v) FILTER (var = 'green') AS g, max(v) FILTER (var = 'blue') AS b FROM cells GROUP BY ALL HAVING count(v) = 3)
SELECT grid_id, 0 AS t, 'red' AS var, y, x, r AS v FROM w UNION ALL SELECT grid_id, 0, 'green', y, x, g FROM w UNION ALL SELECT grid_id, 0, 'blue', y, x, b FROM w
UNION ALL SELECT grid_id, 0, 'intensity', y, x, round(0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b + 1e-7, 4) FROM w""")
def image_pixels(spark, sf):
    """Colour grids packed as image bytes and unpacked again."""
    wide = grid_rgb(spark, sf).cells.groupBy("grid_id", "y", "x").pivot("var", ["red", "green", "blue"]).agg(F.first("v")).dropna()
    pixel = F.concat(*[F.lpad(F.hex(F.col(c).cast("int")), 2, "0") for c in ("blue", "green", "red")])
    packed = wide.groupBy("grid_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("y", "x", pixel.alias("p"))))["p"], "").alias("h"))
    rows = packed.select("grid_id", F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(3).alias("nChannels"), F.unhex("h").alias("data"))
    return images.image_cells(rows).withColumn("v", F.round(F.col("v") + F.lit(1e-7), 4))


def _save(batches):
    for batch in batches:
        content = []
        for values in batch["embedding"]:
            buffer = io.BytesIO()
            np.save(buffer, np.asarray(values, dtype=float).reshape(8, 8))
            content.append(buffer.getvalue())
        yield pd.DataFrame({"path": "/x/" + batch["vec_id"].astype(str) + ".npy", "content": content})


@query("array_files", """
SELECT CAST(vec_id AS VARCHAR) AS grid_id, 0 AS t, 'value' AS var, CAST(i // 8 AS INT) AS y, CAST(i % 8 AS INT) AS x, round(CAST(embedding[i + 1] AS DOUBLE), 6) + 0.0 AS v
FROM embeddings, (SELECT CAST(range AS INT) AS i FROM range(64))""")
def array_files(spark, sf):
    files = table(spark, sf, "embeddings").select("vec_id", "embedding").mapInPandas(_save, "path string, content binary")
    return arrays.array_cells(files).withColumn("v", F.round("v", 6) + F.lit(0.0))


def _save_placed(batches):
    """Each vector as an .npz file with its own latitudes, longitudes and day."""
    for batch in batches:
        content = []
        for i, values in zip(batch["vec_id"], batch["embedding"], strict=True):
            buffer = io.BytesIO()
            day = np.array(["2024-01-01"], "datetime64[D]") + i % 28
            np.savez(buffer, lat=i % 50 + np.arange(8) / 2, lon=100.0 + np.arange(8), time=day, level=np.asarray(values, dtype=float).reshape(1, 8, 8))
            content.append(buffer.getvalue())
        yield pd.DataFrame({"path": "/x/" + batch["vec_id"].astype(str) + ".npz", "content": content})


def placed_arrays(spark, sf):
    return arrays.arrays_grid(table(spark, sf, "embeddings").select("vec_id", "embedding").mapInPandas(_save_placed, "path string, content binary"))


@query("array_coordinates", """
SELECT CAST(vec_id AS VARCHAR) AS grid_id, 'level' AS var, vec_id % 50 + (i // 8) / 2 AS lat, CAST(100 + i % 8 AS DOUBLE) AS lon, strftime(DATE '2024-01-01' + CAST(vec_id % 28 AS INT), '%Y-%m-%d') AS label,
  round(CAST(embedding[i + 1] AS DOUBLE), 6) + 0.0 AS v
FROM embeddings, (SELECT CAST(range AS INT) AS i FROM range(64))""")
def array_coordinates(spark, sf):
    g = placed_arrays(spark, sf)
    return g.with_time(g.with_coords(g.cells)).select("grid_id", "var", "lat", "lon", "label", (F.round("v", 6) + F.lit(0.0)).alias("v"))


@query("catalog", f"""
SELECT CAST(vec_id AS VARCHAR) AS grid_id, 8 AS n_lat, CAST(vec_id % 50 AS DOUBLE) AS lat_min, vec_id % 50 + 3.5::DOUBLE AS lat_max, 8 AS n_lon, 100.0::DOUBLE AS lon_min, 107.0::DOUBLE AS lon_max, 1 AS n_time,
  strftime(DATE '2024-01-01' + CAST(vec_id % 28 AS INT), '%Y-%m-%d') AS time_start, strftime(DATE '2024-01-01' + CAST(vec_id % 28 AS INT), '%Y-%m-%d') AS time_end, 1 AS n_variables,
  'EPSG:4326/inferred' AS crs, 'spatiotemporal_grid' AS grid_type, 'level' AS variables, {len(rules.REGION_NAMES)} AS regions FROM embeddings""")
def catalog_rows(spark, sf):
    """Axes of the array files made of the vectors."""
    done = catalog.catalog(placed_arrays(spark, sf))
    return done.withColumns({"variables": F.array_join("variables.name", ","), "regions": F.size("regions")})


# --- composed analyses ---------------------------------------------------------------------------------------------------


_STAT = f"{rd('round_even(min(v), 6)', 3, 'min')}, {rd('round_even(max(v), 6)', 3, 'max')}, {rd('round_even(avg(v), 6)', 3, 'mean')}, {rd('round_even(stddev_pop(v), 6)', 3, 'std')}, " + ", ".join(
    rd(f"round_even(quantile_cont(v, {q}), 6)", 3, n) for n, q in (("p05", 0.05), ("p50", 0.5), ("p95", 0.95))
)


@query("analysis_statistics", f"""
WITH {REGION_CELLS}, {MEAN} SELECT 'overall' AS part, grid_id, var, {_STAT} FROM cells GROUP BY grid_id, var UNION ALL SELECT 'slice', grid_id, var, {_STAT} FROM cells WHERE t = 20 GROUP BY grid_id, var
UNION ALL SELECT 'mean_map', grid_id, var, {_STAT} FROM mm GROUP BY grid_id, var""")
def analysis_statistics(spark, sf):
    done = plans.analyze(grid_l(spark, sf), "price", "core", 20, boxes=BOXES)
    parts = [done[f"statistics_{p}"].withColumn("part", F.lit(p)) for p in ("overall", "slice", "mean_map")]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query("analysis_blocks", f"WITH RECURSIVE {REGION_CELLS}, {blocks_sql(20, 'region')} SELECT grid_id, var, block_id, primary_label, {rd('confidence', 4)}, trend_label, uncertainty FROM lc")
def analysis_blocks(spark, sf):
    done = plans.analyze(grid_l(spark, sf), "price", "core", 20, boxes=BOXES)
    return rounded(done["blocks"].select(*MAP, "block_id", "primary_label", "confidence", "trend_label", "uncertainty"), 4)


@query("analysis_similar_slices", f"WITH {REGION_CELLS}, {similar_sql(20, 200)} SELECT grid_id, var, t, cells, {rd('similarity', 4)}, {rd('rmse', 3)}, CAST(rank AS INT) AS rank FROM tk WHERE rank <= 8")
def analysis_similar_slices(spark, sf):
    done = plans.analyze(grid_l(spark, sf), "price", "core", 20, boxes=BOXES)
    return rounded(done["similar_slices"], similarity=4)


@query("task_difference_map", f"WITH {REGION_CELLS} SELECT grid_id, var, y, x, {rd('max(v) FILTER (t = 27) - max(v) FILTER (t = 0)', 3, 'v')} FROM cells GROUP BY grid_id, var, y, x")
def task_difference_map(spark, sf):
    return rounded(plans.analyze(grid_l(spark, sf), "price", "core", task="comparison", boxes=BOXES)["difference_map"])


@query("task_mean_map_of_valid_cells", f"""
WITH {SQL_L}, ok AS (SELECT y, x, avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END) < 0.4 AND x BETWEEN 5 AND 30 AND y BETWEEN 10 AND 40 AS valid FROM cells GROUP BY y, x)
SELECT grid_id, var, y, x, {rd('avg(CASE WHEN valid THEN v END)', 3, 'v')} FROM cells JOIN ok USING (y, x) GROUP BY grid_id, var, y, x""")
def task_mean_map_of_valid_cells(spark, sf):
    grid = grid_l(spark, sf)
    return rounded(plans.analyze(grid, "price", "core", task="clustering", boxes=BOXES, mask=mis.missing_masks(grid, 0.4))["mean_map"])


@query("task_pairs", f"""
WITH {SQL_L3}, p AS (SELECT t, y, x, price AS a, discount AS b, row_number() OVER (ORDER BY t, y, x) - 1 AS k, count(*) OVER () AS n FROM wide WHERE price IS NOT NULL AND discount IS NOT NULL AND x BETWEEN 5 AND 30 AND y BETWEEN 10 AND 40)
SELECT 'L' AS grid_id, t, y, x, {rd('a')}, {rd('b')} FROM p WHERE n <= 3000 OR k % (n // 3000) = 0""")
def task_pairs(spark, sf):
    return rounded(plans.analyze(grid_l3(spark, sf), "price", "core", task="attribution", boxes=BOXES, pair_rows=rules.MAX_SCATTER_POINTS)["pairs"])


_FILLED_E = f"""{SQL_E.replace("cells AS (", "cells0 AS (")}, {fill_sql('cells0', 'filled', ('grid_id', 't', 'var'))}"""
_VALID_E = f"""{_FILLED_E}, ok AS (SELECT y, x, avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END) < 0.8 AS valid FROM cells0 GROUP BY y, x),
cells AS (SELECT grid_id, t, var, f.y, f.x, CASE WHEN valid THEN f END AS v FROM filled f JOIN ok ON ok.y = f.y AND ok.x = f.x)"""


@query("feature_bundle_labels", f"""
WITH RECURSIVE {_VALID_E}, {MEAN}, {SERIES}, {SPATIAL_SQL}, {TEMPORAL_SQL}
SELECT grid_id, var, hotspot_count || ' ' || {_SPREAD} AS spatial_pattern, trend || ', ' || CASE WHEN volatility > 1 THEN 'volatile' ELSE 'low volatility' END AS temporal_pattern FROM sp JOIN tr USING (grid_id, var)""")
def feature_bundle_labels(spark, sf):
    done = plans.extract_features(grid_e(spark, sf), block=(3, 5))
    return done["labels"].select(*MAP, "spatial_pattern", "temporal_pattern")


@query("feature_bundle_image", f"WITH {SQL_I}, {MEAN}, {image_sql(False)}")
def feature_bundle_image(spark, sf):
    return flat_image(plans.extract_features(grid_i(spark, sf), block=(8, 8), patches=False)["image"])


@query("grid_description", f"""
WITH {_FILLED_E}, c AS (SELECT grid_id, var, y, x, avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END) AS r FROM cells0 GROUP BY grid_id, var, y, x),
st AS (SELECT grid_id, var, CASE WHEN avg(CASE WHEN r >= 0.8 THEN 1.0 ELSE 0.0 END) > 0.05 THEN 'fixed_nearest' WHEN avg(r) > 0 THEN 'linear' ELSE 'none' END AS strategy FROM c GROUP BY grid_id, var)
SELECT grid_id, var, strategy, 30 AS n_t, 8 AS n_y, 16 AS n_x, CAST(NULL AS VARCHAR) AS unit, list_position({list(E_VARS)}, var) - 1 AS pos, count(*) FILTER (v IS NULL) AS missing_count,
  {rd('avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END)', 3, 'missing_ratio')}, count(*) FILTER (v IS NULL AND f IS NOT NULL) AS filled_count, {rd('min(f)', 3, 'min')}, {rd('max(f)', 3, 'max')}, {rd('avg(f)', 3, 'mean')}, {rd('stddev_pop(f)', 3, 'std')}
FROM filled JOIN st USING (grid_id, var) GROUP BY grid_id, var, strategy""")
def grid_description(spark, sf):
    return rounded(plans.describe(grid_e(spark, sf))["profiles"])


# --- the bundle's tables -----------------------------------------------------------------------------------------------

_BUNDLE_MEAN = "ok AS (SELECT grid_id, y, x FROM cells GROUP BY grid_id, y, x HAVING avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END) < 0.8), cv AS (SELECT c.grid_id, t, var, c.y, c.x, CASE WHEN ok.y IS NOT NULL THEN v END AS v FROM cells c LEFT JOIN ok ON c.grid_id = ok.grid_id AND c.y = ok.y AND c.x = ok.x)"
_BUNDLE_MM = "mm AS (SELECT grid_id, var, y, x, avg(v) AS v FROM cv GROUP BY grid_id, var, y, x)"
_BUNDLE_SM = "sm AS (SELECT grid_id, var, t, avg(v) AS v FROM cv GROUP BY grid_id, var, t)"


@query("bundle_hotspots", f"""
WITH RECURSIVE {SQL_E}, {_BUNDLE_MEAN}, {_BUNDLE_MM}, hq AS (SELECT grid_id, var, quantile_cont(v, 0.9) AS q FROM mm GROUP BY grid_id, var),
hc AS (SELECT mm.* FROM mm JOIN hq USING (grid_id, var) WHERE v >= q), {comp_sql('hc', 'cc', width=16)}
SELECT grid_id, var, component, count(*) AS cells, {rd('max(v)', 4, 'peak')} FROM cc GROUP BY grid_id, var, component""")
def bundle_hotspots(spark, sf):
    """Every region of every variable, without a limit."""
    done = plans.extract_features(grid_e(spark, sf), block=(3, 5), fill=None, patches=False)
    return rounded(done["hotspots"].select(*MAP, "component", "cells", "peak"), 4)


@query("bundle_change_points", f"""
WITH {SQL_E}, {_BUNDLE_MEAN}, {_BUNDLE_SM}, {TEMPORAL_SQL}, {_JUMPS}
SELECT grid_id, var, t, strftime(DATE '2024-01-01' + to_days(t), '%Y-%m-%d') AS label, {rd('d', 4, 'delta')} FROM jp""")
def bundle_change_points(spark, sf):
    done = plans.extract_features(grid_e(spark, sf), block=(3, 5), fill=None, patches=False)
    return rounded(done["change_points"].select(*MAP, "t", "label", "delta"), 4)


@query("bundle_coverage", f"""
WITH {SQL_L3}, m AS (SELECT grid_id, var, avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END) AS r FROM cells GROUP BY grid_id, var)
SELECT grid_id, var, {rd('r', 6, 'missing_ratio')}, CASE WHEN r = 0 THEN 'complete grid' WHEN r < 0.05 THEN 'nearly complete grid' WHEN r < 0.3 THEN 'moderate missing regions' ELSE 'large fixed or invalid regions' END AS coverage FROM m""")
def bundle_coverage(spark, sf):
    return rounded(plans.extract_features(grid_l3(spark, sf), patches=False)["coverage"], 6)
