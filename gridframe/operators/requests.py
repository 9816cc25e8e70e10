"""Tagging of request texts by keyword rules, merging of structured replies, evidence rows.

Requests are a table; every rule is a column expression built from the fixed word lists, so a table of any size is tagged
in one narrow pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridframe.functions import rules
from gridframe.functions.columns import compact_number, first_match, strip, unite
from gridframe.model import MAP
from gridframe.operators.aggregates import top_rows
from gridframe.operators.selection import match_available


def _any(text: Column, words: Sequence[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | text.contains(w)
    return hit


def _list(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


# --- what a request asks for ----------------------------------------------------------------------------------

def tag_task(text: Column) -> Column:
    """One of nine task types; the first rule that holds wins."""
    changing = _any(text, rules.CHANGE_WORDS)
    return first_match(
        [
            (_any(text, rules.COMPARE_WORDS), "comparison"),
            (changing & _any(text, rules.CHANGE_SOURCE_WORDS), "source_tracing"),
            (changing, "trend_analysis"),
            (_any(text, rules.SOURCE_WORDS), "source_tracing"),
            (_any(text, rules.CLUSTER_WORDS), "clustering"),
            (_any(text, rules.ANOMALY_WORDS), "anomaly_detection"),
            (_any(text, rules.IMAGE_WORDS), "distribution"),
            (_any(text, rules.CAUSE_WORDS), "attribution"),
            (_any(text, rules.SHOW_WORDS), "distribution"),
        ],
        "summary",
    )


def tag_broad_task(text: Column) -> Column:
    """One of five broad task types, by the second rule set."""
    lowered = F.lower(text)
    return first_match([(_any(lowered, words), task) for task, words in rules.BROAD_TASK_RULES], rules.BROAD_TASK_DEFAULT)


def tag_variables(text: Column, available: Sequence[str] = (), primary: str | None = None) -> Column:
    """Variables named in a text, by alias and by name; the primary variable if none is named."""
    lowered = F.lower(text)
    hits = []
    for alias, name in rules.MENTION_ALIASES:
        matched = F.coalesce(match_available(F.lit(name), available), F.lit(name)) if available else F.lit(name)
        hits.append(F.when(lowered.contains(alias), matched))
    hits += [F.when(lowered.contains(v.lower()), F.lit(v)) for v in available]
    found = F.array_distinct(F.array_compact(F.array(*hits)))
    return F.when(F.size(found) > 0, found).otherwise(_list([primary or rules.DEFAULT_VARIABLE]))


def tag_region(text: Column) -> Column:
    """Region by alias, else a place name ending in a unit of administration, else everything."""
    named = [(text.contains(alias), name) for alias, name in rules.REGION_MENTIONS]
    place = F.regexp_extract(text, rules.PLACE_PATTERN, 0)
    named.append((text.rlike(rules.PLACE_PATTERN) & ~place.isin(list(rules.NOT_PLACES)), place))
    return first_match(named, rules.DEFAULT_REGION)


def tag_time(text: Column, start: Column | None = None, end: Column | None = None) -> Column:
    """Time range by the first pattern that matches, else the coverage of the data."""
    found = []
    for pattern, form in rules.TIME_PATTERNS:
        if "{}" in form:
            before, after = form.split("{}")
            found.append((text.rlike(pattern), F.concat(F.lit(before), F.regexp_extract(text, pattern, 1), F.lit(after))))
        else:
            found.append((text.rlike(pattern), F.lit(form)))
    default = F.lit(rules.DEFAULT_TIME_RANGE)
    if start is not None:
        known = start.isNotNull() & end.isNotNull()
        default = F.when(known & (start == end), start).when(known, F.concat_ws(" 至 ", start, end)).otherwise(default)
    return first_match(found, default)


def tag_products(task: Column, is_image: Column, has_patches: Column, hotspots: Column, primary: Column) -> dict[str, Column]:
    """Feature tables, products, steps, steps of the patch encoder and priority that a task needs."""
    none = F.array().cast("array<string>")

    def by_task(table: dict[str, Sequence[str]], default: Column) -> Column:
        return first_match([(task == k, _list(v)) for k, v in table.items()], default)

    features = F.concat(
        _list(rules.BASE_FEATURES), F.when(is_image, _list(["image_features"])).otherwise(none),
        F.when(has_patches, _list(["transformer_features"])).otherwise(none), by_task(rules.TASK_FEATURES, none),
    )
    products = F.when(is_image, _list(rules.IMAGE_PRODUCTS)).otherwise(by_task(rules.TASK_PRODUCTS, _list(rules.TASK_PRODUCTS["summary"])))
    steps = by_task(rules.TASK_STEPS, _list(rules.TASK_STEPS["summary"]))
    named = F.transform(steps, lambda s: F.replace(s, F.lit("{}"), primary))
    channel = primary.isin("intensity", "red", "green", "blue", "alpha")
    return {
        "required_features": F.array_distinct(features),
        "derived_products": products,
        "steps": F.when(channel, _list(rules.IMAGE_STEPS)).otherwise(named),
        "patch_steps": F.when(has_patches, F.concat(
            _list(rules.PATCH_STEPS), F.when(is_image, _list(rules.PATCH_IMAGE_STEPS)).otherwise(none),
            F.when(task.isin(list(rules.PATCH_REGION_TASKS)), _list(rules.PATCH_REGION_STEPS)).otherwise(none),
        )).otherwise(none),
        "priority": F.when(task.isin(list(rules.URGENT_TASKS)), "high").when(F.coalesce(hotspots, F.lit(0)) > 0, "medium").otherwise("low"),
    }


def risk_flags(missing_ratio: Column, steps: Column, is_image: Column, anomalies: Column) -> Column:
    """Codes of the cautions an analysis calls for."""
    single = steps == 1
    flags = F.array(
        F.when(missing_ratio > 0.3, "high_missing"), F.when(is_image, "pixel_coordinates"),
        F.when(single & is_image, "single_frame"), F.when(single & ~is_image, "single_time_step"), F.when(anomalies == 0, "no_anomaly_found"),
    )
    kept = F.array_compact(flags)
    return F.when(F.size(kept) > 0, kept).otherwise(_list(["stay_within_coverage"]))


# --- first forms of the same tags, by the front page's own rules ----------------------------------------------------

PAGE_VARIABLES = (
    (("温度",), "temp"), (("湿度",), "rhum"), (("风",), "wind"), (("降水", "precipitation"), "prec"), (("降雨", "rain"), "rain"),
    (("降雪", "snow"), "snow"), (("气压", "pressure"), "pres"), (("高程", "地形", "elevation"), "elevation"), (("长波", "longwave"), "lrad"),
    (("短波", "shortwave", "辐射"), "srad"), (("比湿", "specific humidity"), "shum"),
)
PAGE_REGIONS = (
    ("京津冀", "jingjinji"), ("华北", "north_china"), ("东北", "northeast"), ("长三角", "yangtze_delta"), ("华东", "east_china"),
    ("珠三角", "pearl_delta"), ("华南", "south_china"), ("西南", "southwest"), ("西北", "northwest"),
)


def page_variable(text: Column, available: Sequence[str]) -> Column:
    """Single variable of a request; PM2.5 where the named one is absent."""
    lowered = F.lower(text)
    chosen = [(_any(lowered, words), v if v in available else rules.DEFAULT_VARIABLE) for words, v in PAGE_VARIABLES]
    default = rules.DEFAULT_VARIABLE if rules.DEFAULT_VARIABLE in available or not available else available[0]
    return first_match(chosen, default)


def page_region(text: Column) -> Column:
    return first_match([(text.contains(word), code) for word, code in PAGE_REGIONS], "china")


# --- plans --------------------------------------------------------------------------------------------------------------

PLAN = (
    "struct<task_graph:struct<task_type:string,region:string,variables:array<string>,time_range:string>,"
    "visualization_strategy:struct<chart_type:string,layout:string,color_encoding:string,focus_region:string>,"
    "uncertainty_risks:array<string>,follow_up_questions:array<string>>"
)


def with_defaults(plans: DataFrame) -> DataFrame:
    """Missing fields of flat plans filled: task_type, region, variables, time_range, chart_type, layout,
    color_encoding, focus_region, uncertainty_risks, follow_up_questions."""
    asked = F.col("follow_up_questions") if "follow_up_questions" in plans.columns else F.lit(None)
    region = F.coalesce("region", F.lit(rules.DEFAULT_REGION))
    none = F.array().cast("array<string>")
    return plans.withColumns({
        "task_type": F.coalesce("task_type", F.lit(rules.DEFAULT_TASK)), "region": region, "variables": F.coalesce("variables", none),
        "time_range": F.coalesce("time_range", F.lit(rules.DEFAULT_TIME_RANGE)), "chart_type": F.coalesce("chart_type", F.lit("heatmap + contour overlay")),
        "layout": F.coalesce("layout", F.lit("single map with summary cards")), "color_encoding": F.coalesce("color_encoding", F.lit("sequential color scale")),
        "focus_region": F.coalesce("focus_region", region), "uncertainty_risks": F.coalesce("uncertainty_risks", none),
        "follow_up_questions": F.coalesce(asked, none),
    })


#: Parts of a reply that are merged field by field, whatever the fields are.
SECTIONS = ("task_graph", "visualization_strategy", "analysis_plan")


def parse_replies(df: DataFrame, text: str, out: str = "reply") -> DataFrame:
    """Structured replies from free text: without code fences, whole text if it is JSON, else its outermost braces.

    Adds the known fields as a struct, and all fields as a map of variants, ``<out>_fields``. NULL where neither parses, or where the JSON is not an object.
    """
    bare = strip(F.col(text))
    fenced = bare.startswith("```")
    opened = strip(F.regexp_replace(bare, r"^```(?:json)?", ""))
    body = F.when(fenced, strip(F.regexp_replace(opened, r"```$", ""))).otherwise(bare)
    staged = df.withColumn("_body", body)
    whole = F.try_parse_json("_body").isNotNull()
    inner = F.regexp_extract("_body", r"(?s)\{.*\}", 0)
    chosen = F.when(whole, F.col("_body")).when(F.try_parse_json(inner).isNotNull(), inner)
    is_object = F.ltrim("_json").startswith("{")
    read = lambda form: F.when(is_object, F.from_json("_json", form))
    return staged.withColumn("_json", chosen).withColumns({out: read(PLAN), f"{out}_fields": read("map<string,variant>")}).drop("_body", "_json")


def section(fields: Column, name: str) -> Column:
    """One part of a map of variants as a map of its own; empty where it is no object."""
    text = F.to_json(F.try_element_at(fields, F.lit(name)))
    return F.coalesce(F.when(text.startswith("{"), F.from_json(text, "map<string,variant>")), F.from_json(F.lit("{}"), "map<string,variant>"))


def merge_fields(base: Column, reply: Column) -> Column:
    """Fields of a reply that say something over those of a base: null, empty texts, lists and objects leave the base as it is."""
    said = F.map_filter(reply, lambda _, v: ~F.coalesce(F.to_json(v), F.lit("null")).isin("null", '""', "[]", "{}"))
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(said, k))
    return F.map_concat(kept, said)


def _unknown(known: Sequence[str]):
    return lambda k, _: ~k.isin(*known)


def merge_plans(plans: DataFrame, reply: str = "reply") -> DataFrame:
    """Non-empty fields of a reply over those of the rule-based plan; lists are united; an unknown task type falls back.

    Fields without a column of their own survive in maps of variants: ``analysis_plan`` (over that of the plan, if it has one), ``more_task_graph`` and
    ``more_visualization_strategy``. ``semantic_response`` is the reply's text, else the plan's.
    """
    r = lambda path: F.col(f"{reply}.{path}")
    text = lambda path, name: F.coalesce(F.nullif(r(path), F.lit("")), F.col(name))
    task = text("task_graph.task_type", "task_type")
    asked = r("task_graph.variables")
    fields = F.col(f"{reply}_fields")
    empty = F.from_json(F.lit("{}"), "map<string,variant>")
    said = {name: section(fields, name) for name in SECTIONS}
    base = F.coalesce("analysis_plan", empty) if "analysis_plan" in plans.columns else empty
    own = {"task_graph": ("task_type", "region", "variables", "time_range"), "visualization_strategy": ("chart_type", "layout", "color_encoding", "focus_region")}
    more = {f"more_{name}": merge_fields(empty, F.map_filter(said[name], _unknown(known))) for name, known in own.items()}
    answer = F.nullif(F.variant_get(F.try_element_at(fields, F.lit("semantic_response")), "$", "string"), F.lit(""))
    fallback = F.col("semantic_response") if "semantic_response" in plans.columns else F.lit(None).cast("string")
    return plans.withColumns({
        "analysis_plan": merge_fields(base, said["analysis_plan"]), **more, "semantic_response": F.coalesce(answer, fallback),
        "task_type": F.when(task.isin(list(rules.TASK_TYPES)), task).otherwise(F.col("task_type")),
        "region": text("task_graph.region", "region"),
        "variables": F.when(F.size(F.coalesce(asked, F.array().cast("array<string>"))) > 0, asked).otherwise(F.col("variables")),
        "time_range": text("task_graph.time_range", "time_range"),
        "chart_type": text("visualization_strategy.chart_type", "chart_type"),
        "layout": text("visualization_strategy.layout", "layout"),
        "color_encoding": text("visualization_strategy.color_encoding", "color_encoding"),
        "focus_region": text("visualization_strategy.focus_region", "focus_region"),
        "uncertainty_risks": unite(F.col("uncertainty_risks"), r("uncertainty_risks")),
        "follow_up_questions": unite(F.col("follow_up_questions"), r("follow_up_questions")),
    })


# --- evidence ------------------------------------------------------------------------------------------------------------

def semantic_labels(features: DataFrame) -> DataFrame:
    """Adds spatial_pattern and temporal_pattern in words."""
    count, steep, directed = F.col("hotspot_count"), F.col("gradient_strength"), F.col("anisotropy")
    spread = F.when(directed > 0.35, "directional").otherwise("diffuse")
    slope = F.when(steep > 1, "sharp-gradient").otherwise("smooth-gradient")
    spatial = first_match(
        [(count.isNull(), "unknown spatial pattern"), (count == 0, "no clear hotspots")],
        F.format_string("%d %s hotspot region(s), %s", count, spread, slope),
    )
    wobble = F.when(F.col("volatility") > 1, "volatile").otherwise("low volatility")
    trend = F.col("trend")
    temporal = first_match(
        [(trend.isNull() | (trend == "no_data"), "unknown temporal pattern"), (trend == "single_time_step", "single time slice")],
        F.concat_ws(", ", trend, wobble),
    )
    return features.withColumns({"spatial_pattern": spatial, "temporal_pattern": temporal})


def change_direction(slope: Column, delta: Column) -> Column:
    """Direction of a series; stable below 1e-5 per step, fluctuating where slope and net change disagree."""
    s, d = F.coalesce(slope, F.lit(0.0)), F.coalesce(delta, F.lit(0.0))
    return first_match(
        [(F.abs(s) < 1e-5, "stable"), ((s > 0) & (d >= 0), "rising"), ((s < 0) & (d <= 0), "falling")], "fluctuating"
    )


def _joined(df: DataFrame, keys: Sequence[str], order: Column, item: Column, out: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(F.struct(order.alias("o"), item.alias("s"))))["s"], ", ").alias(out))


def narrative_facts(trend: DataFrame, correlations: DataFrame, blocks: DataFrame, n: int = 3) -> DataFrame:
    """Per variable: direction of change, strongest correlations of the grid, most salient blocks."""
    directed = trend.select(*MAP, change_direction(F.col("slope"), F.col("delta")).alias("direction"))
    best = top_rows(correlations.drop("rank"), ["grid_id"], [F.abs("correlation").desc(), F.col("var")], n)
    linked = _joined(best, ["grid_id"], F.col("rank"), F.format_string("%s(%+.2f)", "var", "correlation"), "top_correlations")
    salient = top_rows(blocks, MAP, [F.col("saliency").desc(), F.col("row"), F.col("col")], n)
    marked = _joined(salient, MAP, F.col("rank"), F.format_string("%s[%s/%s]", "block_id", "primary_label", "trend_label"), "top_blocks")
    return directed.join(linked, "grid_id", "left").join(marked, MAP, "left")


def evidence_table(statistics: DataFrame, spatial: DataFrame, temporal: DataFrame, hotspots: DataFrame, n: int = 5) -> DataFrame:
    """One row per variable: statistics, spatial and temporal features, the first ``n`` hotspots, as numbers and as text."""
    order = [F.col("cells").desc(), F.col("component")]
    first = top_rows(hotspots.drop("rank"), MAP, order, n)
    listed = first.groupBy(*MAP).agg(F.array_sort(F.collect_list(F.struct("rank", "component", "cells", "peak"))).alias("top_hotspots"))
    numbers = statistics.select(*MAP, "min", "max", "mean", "std", "p95", "missing_ratio")
    where = spatial.select(*MAP, "hotspot_count", "connected_domains", "gradient_strength", "anisotropy", "boundary_change")
    when = temporal.select(*MAP, "trend", "slope", "volatility", "series_range")
    rows = numbers.join(where, MAP, "left").join(when, MAP, "left").join(listed, MAP, "left")
    return semantic_labels(rows).withColumn("mean_text", compact_number(F.col("mean")))
