"""Exact linearly interpolated quantiles per group.

Two routes, chosen by the largest possible group, which the driver knows from the axis sizes:

* small groups: Spark's exact ``percentile``, which gathers a group's distinct values in one buffer;
* large groups: a mergeable sketch brackets each wanted rank, one pass counts the values below the
  bracket, and only values inside the brackets (about 6/accuracy of the group) are sorted. No task
  ever holds a whole group, and the result is the same exact quantile.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridframe.model import bounded
from gridframe.operators.numbering import running_totals
from gridframe.session import cut_lineage

SMALL_GROUP = 200_000
ACCURACY = 20_000


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    max_group: int,
    small_group: int = SMALL_GROUP,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """One row per group with one column per name in ``probs``; NULL for groups without values."""
    if max_group <= small_group:
        wanted = [float(p) for p in probs.values()]
        packed = df.groupBy(*keys).agg(F.percentile(F.col(value), wanted).alias("_q"))
        return packed.select(*keys, *[F.col("_q")[i].alias(name) for i, name in enumerate(probs)])
    return _bracketed(df, list(keys), value, probs, accuracy)


def agg_with_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    aggs: Sequence[Column],
    quantiles: Mapping[str, Mapping[str, float]],
    max_group: int,
) -> DataFrame:
    """Aggregates per group with quantiles of some columns, given as {column: {name: probability}}.

    One pass for small groups; large groups take each column's quantiles by their own route and join them.
    """
    if max_group <= SMALL_GROUP:
        packs = [F.percentile(F.col(c), [float(p) for p in probs.values()]).alias(f"_q{i}") for i, (c, probs) in enumerate(quantiles.items())]
        packed = df.groupBy(*keys).agg(*aggs, *packs)
        kept = [c for c in packed.columns if c not in keys and not c.startswith("_q")]
        opened = [F.col(f"_q{i}")[j].alias(name) for i, probs in enumerate(quantiles.values()) for j, name in enumerate(probs)]
        return packed.select(*keys, *kept, *opened)
    rows = df.groupBy(*keys).agg(*aggs)
    for column, probs in quantiles.items():
        rows = rows.join(group_quantiles(df, keys, column, probs, max_group), [*keys], "left")
    return rows


def _bracketed(df: DataFrame, keys: list[str], value: str, probs: Mapping[str, float], accuracy: int) -> DataFrame:
    names = list(probs)
    margin = 3.0 / accuracy
    lower = [max(0.0, probs[n] - margin) for n in names]
    upper = [min(1.0, probs[n] + margin) for n in names]
    present = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    sketch = present.groupBy(*keys).agg(
        F.count("_v").alias("_n"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.percentile_approx("_v", lower + upper, accuracy).alias("_at"),
    )
    # A group the sketch holds whole is its own bracket.
    tiny = F.col("_n") <= accuracy
    brackets = sketch.select(
        *keys,
        "_n",
        *[F.when(tiny, F.col("_min")).otherwise(F.col("_at")[i]).alias(f"_lo{i}") for i in range(len(names))],
        *[F.when(tiny, F.col("_max")).otherwise(F.col("_at")[len(names) + i]).alias(f"_hi{i}") for i in range(len(names))],
    )
    brackets = cut_lineage(brackets)
    groups = brackets.count()
    marked = present.join(bounded(brackets, groups), [*keys])
    below = marked.groupBy(*keys).agg(
        F.first("_n").alias("_n"),
        *[F.sum(F.when(F.col("_v") < F.col(f"_lo{i}"), 1).otherwise(0)).alias(f"_below{i}") for i in range(len(names))],
    )
    inside = [F.col("_v").between(F.col(f"_lo{i}"), F.col(f"_hi{i}")) for i in range(len(names))]
    hits = F.filter(F.array(*[F.when(c, F.lit(i)) for i, c in enumerate(inside)]), lambda i: i.isNotNull())
    candidates = (
        marked.select(*keys, "_v", F.explode(hits).alias("_p")).groupBy(*keys, "_p", "_v").agg(F.count(F.lit(1)).alias("_c"))
    )
    # Values inside a bracket are ranked over range partitions, so that a bracket need not fit one task.
    summed = running_totals(candidates, [*keys, "_p", "_v"], "_c", "_all")
    starts = cut_lineage(summed.groupBy(*keys, "_p").agg(F.min(F.col("_all") - F.col("_c")).alias("_start")))
    ranked = summed.join(bounded(starts, groups * len(names)), [*keys, "_p"]).withColumn("_upto", F.col("_all") - F.col("_start")).drop("_all", "_start")
    offsets = below.select(
        *keys, "_n", F.posexplode(F.array(*[F.col(f"_below{i}") for i in range(len(names))])).alias("_p", "_below")
    )
    prob = F.get(F.array(*[F.lit(float(probs[n])) for n in names]), F.col("_p"))
    rank = prob * (F.col("_n") - 1)
    placed = (
        ranked.join(bounded(offsets, groups * len(names)), [*keys, "_p"])
        .withColumn("_rank", rank)
        .withColumn("_last", F.col("_below") + F.col("_upto") - 1)
        .withColumn("_first", F.col("_last") - F.col("_c") + 1)
    )
    at = lambda r: F.max(F.when((F.col("_first") <= r) & (r <= F.col("_last")), F.col("_v")))
    low, high = at(F.floor("_rank")), at(F.ceil("_rank"))
    per_prob = placed.groupBy(*keys, "_p").agg(
        (low + (high - low) * F.max(F.col("_rank") - F.floor("_rank"))).alias("_q")
    )
    wide = per_prob.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_p") == i, F.col("_q"))).alias(name) for i, name in enumerate(names)]
    )
    return df.select(*keys).distinct().join(wide, [*keys], "left")
