"""Embeddings of blocks, slices and patches, attention over patches, saliency, text alignment.

On request, patches of a grid are kept to a number by enlarging them. Attention works on pairs of blocks of patches, so it
doesn't depend on that number. Many small grids are dealt out once and each is encoded by one task. Feature rows
(blocks, slices) are embedded through triangular factors merged over partitions: only feature-by-feature matrices are grouped.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from gridframe.functions import rules
from gridframe.functions.columns import bin_index, cosine, ratio, share, strip
from gridframe.model import Grid
from gridframe.operators.aggregates import block_features, relation_features, time_features, top_rows
from gridframe.operators.missing import NARROW, fill_nearest
from gridframe.operators.quantile import agg_with_quantiles
from gridframe.operators.stencil import gradient, min_max, smooth_map
from gridframe.session import cut_lineage

PATCH = ["grid_id", "py", "px"]
FEATURES = ["mean", "std", "min", "max", "p05", "p95", "missing_ratio", "gradient"]


# --- feature tables ----------------------------------------------------------------------------------------

def standardize(features: DataFrame, vector: str = "features", least: float = 0.0) -> DataFrame:
    """Missing entries take the mean of their column (0 if it has none), then z-scores; a column without spread
    is divided by 1. Works on vectors per grid."""
    long = features.select("grid_id", F.posexplode(vector).alias("i", "f"))
    stats = long.groupBy("grid_id", "i").agg(F.coalesce(F.avg("f"), F.lit(0.0)).alias("m"), F.count("f").alias("k"), F.count(F.lit(1)).alias("n"), F.var_pop("f").alias("s2"))
    # Imputed entries add nothing to the squares.
    spread = F.sqrt(F.coalesce(F.col("s2") * F.col("k") / F.col("n"), F.lit(0.0)))
    sized = stats.select("grid_id", "i", "m", F.when(spread > least, spread).otherwise(1.0).alias("s"))
    packed = sized.groupBy("grid_id").agg(F.array_sort(F.collect_list(F.struct("i", "m", "s"))).alias("_st"))
    scaled = F.zip_with(F.col(vector), F.col("_st"), lambda f, st: (F.coalesce(f, st["m"]) - st["m"]) / st["s"])
    return features.join(packed, "grid_id").withColumn(vector, scaled).drop("_st")


def svd_embed(features: DataFrame, dim: int, vector: str = "features") -> DataFrame:
    """Projection of standardised vectors on the leading right singular vectors, padded with zeros to ``dim``.

    The vectors of a grid are a tall matrix. Each task reduces its rows to a triangular factor (QR), factors are stacked and reduced again
    over two rounds of groups, and the singular vectors of the last one are those of the whole. Products of features are never summed, so small
    singular values keep their digits. The largest loading of each direction is made positive.
    """
    scaled = standardize(cut_lineage(features), vector)
    parts = scaled.select("grid_id", vector).mapInArrow(_factors, FACTORS)
    merged = parts.groupBy("grid_id", F.pmod(F.xxhash64("r"), F.lit(BRANCHES)).alias("branch")).applyInArrow(_stacked, FACTORS)
    axes = merged.groupBy("grid_id").applyInArrow(_leading(dim), "grid_id string, axes array<array<double>>")
    dot = lambda a: F.aggregate(F.zip_with(F.col(vector), a, lambda p, q: p * q), F.lit(0.0), lambda t, p: t + p)
    return scaled.join(axes, "grid_id").withColumn("embedding", F.transform("axes", dot)).drop("axes", vector)


#: A triangular factor, row by row, with its number of columns and the number of vectors it stands for.
FACTORS = "grid_id string, k int, n long, r array<double>"
#: Groups in which the factors of a grid are first merged, and grids whose factors a task holds at a time.
BRANCHES, HELD = 16, 256


def _factor(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r") if len(rows) > rows.shape[1] else rows


def _factor_rows(held: dict[str, tuple[int, np.ndarray]]) -> pa.RecordBatch:
    fields = [pa.array(held.keys(), pa.string()), pa.array([r.shape[1] for _, r in held.values()], pa.int32()), pa.array([n for n, _ in held.values()], pa.int64())]
    return pa.RecordBatch.from_arrays([*fields, pa.array([r.ravel() for _, r in held.values()], pa.list_(pa.float64()))], ["grid_id", "k", "n", "r"])


def _factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One factor per grid of the vectors of a task."""
    held: dict[str, tuple[int, np.ndarray]] = {}
    for batch in batches:
        ids = batch.column(0).dictionary_encode()
        code = ids.indices.to_numpy()
        for c, grid_id in enumerate(ids.dictionary.to_pylist()):
            rows = batch.column(1).take(pa.array(np.flatnonzero(code == c)))
            x = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
            n, r = held.get(grid_id, (0, x[:0]))
            held[grid_id] = n + len(x), _factor(np.concatenate([r, x]))
        if len(held) > HELD:
            yield _factor_rows(held)
            held = {}
    if held:
        yield _factor_rows(held)


def _merged_factor(table: pa.Table) -> tuple[int, np.ndarray]:
    width = table.column("k")[0].as_py()
    r = np.zeros((0, width))
    for part in table.column("r"):
        r = _factor(np.concatenate([r, part.values.to_numpy().reshape(-1, width)]))
    return sum(table.column("n").to_pylist()), r


def _stacked(table: pa.Table) -> pa.Table:
    return pa.Table.from_batches([_factor_rows({table.column("grid_id")[0].as_py(): _merged_factor(table)})])


def _leading(dim: int):
    def leading(table: pa.Table) -> pa.Table:
        n, r = _merged_factor(table)
        axes = np.linalg.svd(r, full_matrices=False)[2][: min(dim, r.shape[1], n)]
        flip = np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])
        padded = np.zeros((dim, r.shape[1]))
        padded[: len(axes)] = axes * flip[:, None]
        return pa.table({"grid_id": [table.column("grid_id")[0].as_py()], "axes": pa.array([padded.tolist()], pa.list_(pa.list_(pa.float64())))})

    return leading


def _ordered(rows: DataFrame, grid: Grid, keys: Sequence[str], names: Sequence[str], extra: Sequence[Column] = ()) -> DataFrame:
    """Feature columns of all variables of one key as one vector, in the order of the variables."""
    packed = rows.withColumn("_p", F.struct(grid.position().alias("pos"), F.array(*names).alias("f"))).groupBy(*keys).agg(
        F.flatten(F.array_sort(F.collect_list("_p"))["f"]).alias("features"), *extra
    )
    return packed


def block_embedding(grid: Grid, block: tuple[int, int] = (32, 32), dim: int = 8, missing: str = "v") -> DataFrame:
    """Embedding of every fixed-size block from the features of all variables and its place."""
    rows = block_features(grid, block, missing)
    place = [F.first(c).alias(c) for c in ("cy", "cx", "height", "width")]
    blocks = _ordered(rows, grid, ["grid_id", "block_y", "block_x"], ["mean", "std", "min", "max", "missing_ratio", "gradient"], place)
    vectors = F.concat("features", F.array("cy", "cx", "height", "width")).alias("features")
    return svd_embed(blocks.select("grid_id", "block_y", "block_x", vectors), dim)


def time_slice_embedding(grid: Grid, dim: int = 8, mask: DataFrame | None = None) -> DataFrame:
    """Embedding of every time slice from the features of all variables."""
    return svd_embed(_ordered(time_features(grid, mask), grid, ["grid_id", "t"], ["mean", "std", "min", "max", "gradient"]), dim)


def relation_embedding(grid: Grid, dim: int = 8) -> DataFrame:
    """Embedding of every pair of variables."""
    pairs = relation_features(grid).select("grid_id", "left", "right", F.array("f0", "f1", "f2", "f3", "f4").alias("features"))
    return svd_embed(pairs, dim)


# --- patches -------------------------------------------------------------------------------------------------

def patch_shape(n_y: int, n_x: int, shape: tuple[int, int], cap: int | None = None) -> tuple[int, int]:
    """Patch size; with ``cap``, enlarged so that at most about that many patches cover the map."""
    h, w = max(1, shape[0]), max(1, shape[1])
    count = math.ceil(n_y / h) * math.ceil(n_x / w)
    grow = math.sqrt(count / cap) if cap is not None and count > cap else 1.0
    return max(1, math.ceil(h * grow)), max(1, math.ceil(w * grow))


def with_patches(grid: Grid, df: DataFrame, shape: tuple[int, int], cap: int | None = None) -> DataFrame:
    """Adds n_y, n_x, the patch size ph, pw (as ``patch_shape`` has it, for the size of each grid) and the patch index py, px."""
    h, w = max(1, shape[0]), max(1, shape[1])
    sized = grid.with_dims(df)
    count = F.ceil(F.col("n_y") / h) * F.ceil(F.col("n_x") / w)
    grow = F.when(count > cap, F.sqrt(count / cap)).otherwise(1.0) if cap is not None else F.lit(1.0)
    sized = sized.withColumns({"ph": F.ceil(h * grow).cast("int"), "pw": F.ceil(w * grow).cast("int")})
    return sized.withColumns({"py": F.floor(F.col("y") / F.col("ph")).cast("int"), "px": F.floor(F.col("x") / F.col("pw")).cast("int")})


def _masked_cells(grid: Grid, mask: DataFrame | None) -> DataFrame:
    cells = grid.cells.select("grid_id", "t", "var", "y", "x", "v")
    if mask is None:
        return cells
    valid = mask.select("grid_id", "y", "x", "valid_region")
    return cells.join(valid, ["grid_id", "y", "x"]).withColumn("v", F.when(F.col("valid_region"), F.col("v"))).drop("valid_region")


def patch_maps(grid: Grid, shape: tuple[int, int], mask: DataFrame | None = None, max_tokens: int | None = None) -> DataFrame:
    """Mean maps cut into patches, gaps filled inside each patch, with the gradient of the patch."""
    means = _masked_cells(grid, mask).groupBy("grid_id", "var", "y", "x").agg(F.avg("v").alias("v"))
    keys = [*PATCH, "var"]
    placed = with_patches(grid, means, shape, max_tokens).select(*keys, "y", "x", "v")
    width = patch_shape(grid.shape[1], grid.shape[2], shape, max_tokens)[1]
    return cut_lineage(gradient(fill_nearest(placed, tuple(keys), all_missing=0.0, width=width), keys).select(*keys, "y", "x", F.col("v_original").alias("v"), "g"))


#: Cells of a grid, over all steps and variables, up to which a task takes it whole.
WHOLE = 1 << 16
#: Cells of such grids to a task, few enough to be sorted in memory: sizes after the shuffle would join many more, which then spill.
SORTED = 1 << 17


def _fits_task(grid: Grid, shape: tuple[int, int], max_tokens: int | None) -> bool:
    """Whether one task takes a grid whole: of bounded size and patches, no wider than Spark fills by itself. Colours are joined from several variables."""
    n_t, n_y, n_x = grid.shape
    patches = math.ceil(n_y / max(1, shape[0])) * math.ceil(n_x / max(1, shape[1]))
    small = grid.stack_cells * len(grid.variables) <= WHOLE and patches <= BLOCK and len(grid.variables) < 4
    return small and patch_shape(n_y, n_x, shape, max_tokens)[1] <= NARROW


def _whole_tokens(grid: Grid, shape: tuple[int, int], mask: DataFrame | None, max_tokens: int | None, bins: int = 32) -> DataFrame:
    """Features, bounds and summary of every patch, the same as ``patch_features`` and ``patch_summary`` give.

    Cells are dealt out by grid, and only once: all windows and groups after that lie within a grid. Each cell of the mean map carries
    its values over time, so nothing is read again or joined.
    """
    keys = [*PATCH, "var"]
    known = F.col("grid_id").isNotNull() & F.col("var").isNotNull() & F.col("y").isNotNull() & F.col("x").isNotNull()
    cells = _masked_cells(grid, mask).where(known).select("grid_id", "var", "y", "x", "v")
    total = cells.count() if grid.n_grids is None else grid.n_grids * grid.stack_cells * len(grid.variables)
    parts = min(10_000, max(total // SORTED + 1, grid.spark.sparkContext.defaultParallelism))
    cells = cells.repartition(parts, "grid_id")
    means = cells.groupBy("grid_id", "var", "y", "x").agg(F.avg("v").alias("v"), F.collect_list(F.struct("v"))["v"].alias("_all"))
    placed = with_patches(grid, means, shape, max_tokens).select(*keys, "y", "x", "v", "_all")
    width = patch_shape(grid.shape[1], grid.shape[2], shape, max_tokens)[1]
    maps = gradient(fill_nearest(placed, tuple(keys), all_missing=0.0, width=width, keep=("_all",)), keys).withColumn("v", F.col("v_original"))
    whole, zero = Window.partitionBy(*keys), lambda c: F.coalesce(c, F.lit(0.0))
    lo, hi = F.min("v").over(whole), F.max("v").over(whole)
    level = F.when(F.col("v").isNotNull(), F.coalesce(bin_index(F.col("v"), F.col("_lo"), F.col("_hi"), bins), F.lit(0)))
    maps = maps.withColumns({"_lo": lo, "_hi": hi}).withColumn("_level", level)
    maps = maps.withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy(*keys, "_level")))
    rows = maps.select(*keys, "y", "x", "v", "g", "_lo", "_hi", "_k", F.posexplode("_all").alias("_t", "_r"))
    # What belongs to a cell of the mean map is counted with its first value.
    v, r, n = F.when(F.col("_t") == 0, F.col("v")), F.col("_r"), F.count(F.when(F.col("_t") == 0, F.col("v")))
    slope = zero(F.avg(F.when(v.isNotNull(), F.col("g"))))
    entropy = (F.log2(n) - F.sum(F.when(v.isNotNull(), F.log2("_k"))) / n) / math.log2(bins)
    stats = rows.groupBy(*keys).agg(
        zero(F.avg(r)).alias("mean"), zero(F.stddev_pop(r)).alias("std"), zero(F.min(r)).alias("min"), zero(F.max(r)).alias("max"), F.percentile(r, [0.05, 0.95]).alias("_q"),
        F.when(F.count(r) > 0, share(r.isNull())).otherwise(0.0).alias("missing_ratio"), slope.alias("gradient"),
        F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"), F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"),
        F.avg(v).alias("_mean"), F.stddev_pop(v).alias("_std"), (F.max("_hi") - F.min("_lo")).alias("_range"), F.when(n > 0, entropy).otherwise(0.0).alias("_entropy"),
    ).withColumns({"p05": zero(F.col("_q")[0]), "p95": zero(F.col("_q")[1])})
    shown = {"y0": "y0", "y1": "y1", "x0": "x0", "x1": "x1", "mean": "_mean", "std": "_std", "dynamic_range": "_range", "gradient_strength": "gradient", "entropy": "_entropy"}
    first = [F.max(F.when(F.col("var") == grid.primary, F.col(c))).alias(name) for name, c in shown.items()]
    packed = _ordered(stats, grid, PATCH, FEATURES, first).where(F.col("y0").isNotNull())
    return packed.withColumn("colorfulness", F.lit(0.0))


def _patch_slopes(maps: DataFrame, keys: Sequence[str]) -> DataFrame:
    strength = F.coalesce(F.avg(F.when(F.col("v").isNotNull(), F.col("g"))), F.lit(0.0))
    return maps.groupBy(*keys).agg(strength.alias("gradient"))


def patch_features(
    grid: Grid, shape: tuple[int, int] = (32, 32), mask: DataFrame | None = None, maps: DataFrame | None = None, max_tokens: int | None = None
) -> DataFrame:
    """Per patch and variable: mean, std, min, max, p05, p95, missing share, gradient of the mean map."""
    maps = patch_maps(grid, shape, mask, max_tokens) if maps is None else maps
    keys = [*PATCH, "var"]
    h, w = patch_shape(grid.shape[1], grid.shape[2], shape, max_tokens)
    v = F.col("v")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    stats = agg_with_quantiles(
        with_patches(grid, _masked_cells(grid, mask), shape, max_tokens), keys,
        [zero(F.avg(v)).alias("mean"), zero(F.stddev_pop(v)).alias("std"), zero(F.min(v)).alias("min"), zero(F.max(v)).alias("max"), share(v.isNull()).alias("missing_ratio"), F.count("v").alias("n")],
        {"v": {"p05": 0.05, "p95": 0.95}}, grid.shape[0] * h * w,
    )
    # A patch without any value is all zeros.
    filled = stats.withColumns({
        "p05": zero(F.col("p05")), "p95": zero(F.col("p95")), "missing_ratio": F.when(F.col("n") > 0, F.col("missing_ratio")).otherwise(0.0),
    })
    return filled.join(_patch_slopes(maps, keys), keys).drop("n")


def patch_summary(grid: Grid, shape: tuple[int, int] = (32, 32), mask: DataFrame | None = None, maps: DataFrame | None = None, bins: int = 32, max_tokens: int | None = None) -> DataFrame:
    """Per patch, of the first variable's mean map: mean, std, range, gradient, histogram entropy; colourfulness of
    variables two to four where there are four."""
    maps = patch_maps(grid, shape, mask, max_tokens) if maps is None else maps
    first = maps.where(F.col("var") == grid.primary)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    stats = first.groupBy(*PATCH).agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), (F.max("v") - F.min("v")).alias("dynamic_range"),
        zero(F.avg(F.when(F.col("v").isNotNull(), F.col("g")))).alias("gradient_strength"), F.min("v").alias("_lo"), F.max("v").alias("_hi"),
    )
    placed = first.where(F.col("v").isNotNull()).join(stats.select(*PATCH, "_lo", "_hi"), PATCH)
    level = F.coalesce(bin_index(F.col("v"), F.col("_lo"), F.col("_hi"), bins), F.lit(0))
    counts = placed.groupBy(*PATCH, level.alias("level")).agg(F.count(F.lit(1)).alias("k"))
    totals = counts.groupBy(*PATCH).agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.log2("k")).alias("kl"))
    entropy = totals.select(*PATCH, ((F.log2("n") - F.col("kl") / F.col("n")) / math.log2(bins)).alias("entropy"))
    out = stats.join(entropy, PATCH, "left").withColumn("entropy", zero(F.col("entropy"))).drop("_lo", "_hi")
    if len(grid.variables) < 4:
        return out.withColumn("colorfulness", F.lit(0.0))
    red, green, blue = (F.max(F.when(F.col("var") == v, F.col("v"))) for v in grid.variables[1:4])
    wide = maps.groupBy(*PATCH, "y", "x").agg(red.alias("red"), green.alias("green"), blue.alias("blue"))
    color = wide.groupBy(*PATCH).agg(zero(colorfulness(F.col("red"), F.col("green"), F.col("blue"))).alias("colorfulness"))
    return out.join(color, PATCH)


def colorfulness(red: Column, green: Column, blue: Column) -> Column:
    """Aggregate: spread and offset of the red-green and yellow-blue differences."""
    rg, yb = red - green, 0.5 * (red + green) - blue
    yb = F.when(rg.isNotNull(), yb)
    rg = F.when(yb.isNotNull(), rg)
    spread = F.sqrt(F.var_pop(rg) + F.var_pop(yb))
    return spread + 0.3 * F.sqrt(F.avg(rg) * F.avg(rg) + F.avg(yb) * F.avg(yb))


# --- attention ---------------------------------------------------------------------------------------------------

#: Patches whose scores one task holds at a time: a block of queries against a block of keys.
BLOCK = 512


@lru_cache(maxsize=64)
def fixed_weights(rows: int, cols: int, name: str) -> np.ndarray:
    """Standard normal matrix seeded by a name, the same on every machine."""
    seed = int.from_bytes(sha256(name.encode()).digest()[:8], "big") % 2**32
    return np.random.default_rng(seed).normal(0.0, 1.0, size=(rows, cols))


def _scaled_rows(x: np.ndarray) -> np.ndarray:
    """Every row with mean 0 and, unless it is constant, standard deviation 1."""
    x = x - x.mean(axis=1)[:, None]
    return x / np.sqrt((x * x).mean(axis=1)).clip(1e-6)[:, None]


def _waves(y: np.ndarray, x: np.ndarray, dim: int) -> np.ndarray:
    """Place of a patch centre as waves: the first half of the dimensions for y, the second for x.

    Dimension k of a half is the sine (k even) or cosine (k odd) of 2 pi c / 10000 ** (2 floor(k / 2) / half). A dimension
    left over by an odd number is 0.
    """
    half = max(1, dim // 2)
    axis, k = np.divmod(np.arange(dim), half)
    centre = np.stack([y, x, np.zeros(len(y))])[axis.clip(max=2)].T
    turns = 2 * np.pi * centre / 10000.0 ** ((k - k % 2) / half)
    return np.where(axis > 1, 0.0, np.where(k % 2 == 0, np.sin(turns), np.cos(turns)))


def _projected(f: np.ndarray, y: np.ndarray, x: np.ndarray, dim: int, heads: int) -> tuple[np.ndarray, ...]:
    """Tokens of standardised features and places, then their queries, keys and values."""
    used = dim // heads * heads
    seen = f @ fixed_weights(f.shape[1], dim, "feature_projection") / math.sqrt(f.shape[1])
    token = _scaled_rows(seen + _waves(y, x, dim))
    return token, *(token[:, :used] @ fixed_weights(used, used, "w" + c) for c in "qkv")


def _project(dim: int, heads: int):
    """Tokens and their queries, keys and values."""

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if rows.empty:
                continue
            f = np.stack(rows.pop("features").to_list()).astype(float)
            token, *sides = _projected(f, rows.pop("center_y").to_numpy(float), rows.pop("center_x").to_numpy(float), dim, heads)
            yield rows.assign(token=list(token), **{c: list(side) for c, side in zip("qkv", sides, strict=True)})

    return project


def _packed(tokens: DataFrame, side: str, columns: Sequence[str]) -> DataFrame:
    """One row per block of patches: their numbers and vectors, one behind the other."""
    rows = F.array_sort(F.collect_list(F.struct("token_id", *columns)))
    blocks = tokens.groupBy("grid_id", F.floor(F.col("token_id") / BLOCK).alias(f"{side}_block")).agg(F.max("n_tokens").alias("n_tokens"), rows.alias("r"))
    return blocks.select("grid_id", f"{side}_block", "n_tokens", F.col("r.token_id").alias(f"{side}_id"), *[F.flatten(f"r.{c}").alias(c) for c in columns])


def _block_pairs(tokens: DataFrame, of_query: Sequence[str], of_key: Sequence[str]) -> DataFrame:
    """Every block of queries beside every block of keys of its grid; pairs are dealt out by grid and key block."""
    queries = _packed(tokens, "query", of_query)
    queries = queries.withColumn("key_block", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / BLOCK))))
    return queries.join(_packed(tokens, "key", of_key).drop("n_tokens"), ["grid_id", "key_block"])


def _scores(pair, heads: int) -> np.ndarray:
    """Scaled products of a pair's queries and keys: [head, query, key]."""
    q, k = (np.asarray(side).reshape(len(ids), heads, -1) for side, ids in ((pair.q, pair.query_id), (pair.k, pair.key_id)))
    return np.einsum("ihw,jhw->hij", q, k) / math.sqrt(q.shape[2])


def _weights(pair) -> np.ndarray:
    """Attention from each query to each key, averaged over heads, given the logarithm of each query's total."""
    total = np.asarray(pair.total).reshape(len(pair.query_id), -1).T
    return np.exp(_scores(pair, len(total)) - total[:, :, None]).mean(axis=0)


def _mixtures(heads: int):
    """Per query and key block: the logarithm of the summed weights of each head, then the weighted mean of the values."""

    def mixtures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pair in batch.itertuples():
                scores = _scores(pair, heads)
                total = np.logaddexp.reduce(scores, axis=2)
                values = np.asarray(pair.v).reshape(len(pair.key_id), heads, -1)
                mixed = np.einsum("hij,jhw->ihw", np.exp(scores - total[:, :, None]), values)
                yield pd.DataFrame({"grid_id": pair.grid_id, "token_id": pair.query_id, "part": list(np.concatenate([total.T, mixed.reshape(len(mixed), -1)], axis=1))})

    return mixtures


def _encoded(dim: int, heads: int):
    """Joins a token's mixtures over all key blocks and adds them to the token."""
    used = dim // heads * heads

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = fixed_weights(used, used, "wo") / math.sqrt(used)
        for rows in batches:
            if rows.empty:
                continue
            totals, mixed = [], []
            for parts in rows.pop("parts"):
                parts = np.asarray(parts).reshape(-1, heads + used)
                total = np.logaddexp.reduce(parts[:, :heads], axis=0)
                share_of = np.exp(parts[:, :heads] - total)
                mixed.append(np.einsum("ph,phw->hw", share_of, parts[:, heads:].reshape(len(parts), heads, -1)).reshape(-1))
                totals.append(total)
            token = np.stack(rows.pop("token").to_list())
            # Dimensions that no head uses pass through attention unchanged.
            change = np.concatenate([np.stack(mixed) @ out, token[:, used:]], axis=1)
            yield rows.assign(vector=list(_scaled_rows(token + change)), total=totals)

    return encoded


def _incoming(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for pair in batch.itertuples():
            yield pd.DataFrame({"grid_id": pair.grid_id, "token_id": pair.key_id, "incoming": _weights(pair).sum(axis=0) / pair.n_tokens})


def attend(tokens: DataFrame, dim: int = 32, heads: int = 4) -> DataFrame:
    """Projection, positions and one round of self-attention over the patches of each grid.

    Adds the encoded vector, the mean incoming attention, and what edges are computed from (q, k and the logarithm of each
    head's total). A task holds one block of queries and one of keys; the parts of a query are joined by their totals, so a
    grid may have any number of patches.
    """
    heads = max(1, min(heads, dim))
    sizes = tokens.groupBy("grid_id").agg((F.max("px") + 1).alias("_across"), F.count(F.lit(1)).alias("n_tokens"))
    rows = standardize(tokens.select(*PATCH, "features", "center_y", "center_x"), least=1e-12).join(sizes, "grid_id")
    rows = rows.withColumn("token_id", (F.col("py") * F.col("_across") + F.col("px")).cast("int"))
    known = "grid_id string, py int, px int, token_id int, n_tokens bigint"
    sides = "q array<double>, k array<double>"
    rows = rows.select(*PATCH, "token_id", "n_tokens", "features", "center_y", "center_x")
    placed = cut_lineage(rows.mapInPandas(_project(dim, heads), f"{known}, token array<double>, {sides}, v array<double>"))
    parts = _block_pairs(placed, ["q"], ["k", "v"]).mapInPandas(_mixtures(heads), "grid_id string, token_id int, part array<double>")
    joined = parts.groupBy("grid_id", "token_id").agg(F.flatten(F.collect_list("part")).alias("parts"))
    inputs = placed.join(joined, ["grid_id", "token_id"]).select(*PATCH, "token_id", "n_tokens", "token", "q", "k", "parts")
    done = cut_lineage(inputs.mapInPandas(_encoded(dim, heads), f"{known}, {sides}, vector array<double>, total array<double>"))
    arrived = _block_pairs(done, ["q", "total"], ["k"]).mapInPandas(_incoming, "grid_id string, token_id int, incoming double")
    return done.join(arrived.groupBy("grid_id", "token_id").agg(F.sum("incoming").alias("incoming")), ["grid_id", "token_id"])


def _standard(f: np.ndarray, least: float = 1e-12) -> np.ndarray:
    """``standardize`` for features of grids that are held whole: [grid, patch, feature]."""
    gone = np.isnan(f)
    here = (~gone).sum(axis=1)
    off = np.where(gone, 0.0, f - (np.where(gone, 0.0, f).sum(axis=1) / here.clip(1))[:, None])
    spread = np.sqrt((off * off).mean(axis=1))
    return off / np.where(spread > least, spread, 1.0)[:, None]


def _attended(f: np.ndarray, y: np.ndarray, x: np.ndarray, dim: int, heads: int) -> np.ndarray:
    """Query, key, encoded vector, logarithm of each head's total and incoming attention of every patch: [grid, patch, value]."""
    grids, n, width = f.shape
    used = dim // heads * heads
    token, *sides = _projected(_standard(f).reshape(-1, width), y.ravel(), x.ravel(), dim, heads)
    q, k, v = (side.reshape(grids, n, heads, -1) for side in sides)
    scores = np.einsum("gihw,gjhw->ghij", q, k) / math.sqrt(q.shape[3])
    total = np.logaddexp.reduce(scores, axis=3)
    weights = np.exp(scores - total[..., None])
    mixed = np.einsum("ghij,gjhw->gihw", weights, v).reshape(-1, used)
    change = np.concatenate([mixed @ fixed_weights(used, used, "wo") / math.sqrt(used), token[:, used:]], axis=1)
    parts = [*sides[:2], _scaled_rows(token + change), total.transpose(0, 2, 1), weights.mean(axis=1).sum(axis=1) / n]
    return np.concatenate([part.reshape(grids, n, -1) for part in parts], axis=2)


def _attend_whole(dim: int, heads: int):
    @F.pandas_udf("array<array<double>>")
    def attended(features: pd.Series, y: pd.Series, x: pd.Series) -> pd.Series:
        out: list = [None] * len(y)
        sizes = y.map(len).to_numpy()
        for n in np.unique(sizes):
            same, step = np.flatnonzero(sizes == n), max(1, BLOCK * BLOCK // (n * n))
            for at in (same[i : i + step] for i in range(0, len(same), step)):
                f = np.stack(features.iloc[at].to_list()).astype(float).reshape(len(at), n, -1)
                done = _attended(f, np.stack(y.iloc[at].to_list()), np.stack(x.iloc[at].to_list()), dim, heads)
                for i, rows in zip(at, done, strict=True):
                    out[i] = list(rows)
        return pd.Series(out)

    return attended


def attend_whole(tokens: DataFrame, dim: int = 32, heads: int = 4) -> DataFrame:
    """``attend`` for grids of at most BLOCK patches: each is one row, so no vector is shuffled or stored. Keeps all columns of the tokens."""
    heads = max(1, min(heads, dim))
    used = dim // heads * heads
    rest = [c for c in tokens.columns if c not in PATCH]
    packed = tokens.groupBy("grid_id").agg(F.array_sort(F.collect_list(F.struct("py", "px", *rest))).alias("_p"))
    done = packed.withColumn("_a", _attend_whole(dim, heads)(F.flatten("_p.features"), F.col("_p.center_y"), F.col("_p.center_x")))
    opened = done.select("grid_id", F.size("_p").cast("bigint").alias("n_tokens"), (F.array_max("_p.px") + 1).alias("_across"), F.explode(F.arrays_zip("_p", "_a")).alias("_e"))
    sizes, at = {"q": used, "k": used, "vector": dim, "total": heads}, 1
    sides = []
    for name, size in sizes.items():
        sides.append(F.slice("_e._a", at, size).alias(name))
        at += size
    own = [F.col(f"_e._p.{c}").alias(c) for c in ("py", "px", *rest)]
    token_id = (F.col("_e._p.py") * F.col("_across") + F.col("_e._p.px")).cast("int").alias("token_id")
    return opened.select("grid_id", *own, token_id, "n_tokens", *sides, F.get("_e._a", F.lit(at - 1)).alias("incoming"))


def patch_tokens(grid: Grid, shape: tuple[int, int] = (32, 32), mask: DataFrame | None = None, max_tokens: int | None = None) -> DataFrame:
    """One row per patch: feature vector, bounds, normalised centre and summary. With ``max_tokens``, patches are enlarged so that about as many cover a map."""
    if _fits_task(grid, shape, max_tokens):
        rows = grid.with_dims(_whole_tokens(grid, shape, mask, max_tokens))
    else:
        maps = patch_maps(grid, shape, mask, max_tokens)
        vectors = _ordered(patch_features(grid, shape, mask, maps, max_tokens), grid, PATCH, FEATURES)
        summary = patch_summary(grid, shape, mask, maps, max_tokens=max_tokens)
        bounds = maps.where(F.col("var") == grid.primary).groupBy(*PATCH).agg(
            F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"), F.min("x").alias("x0"), (F.max("x") + 1).alias("x1")
        )
        rows = grid.with_dims(vectors.join(bounds, PATCH).join(summary, PATCH))
    centre = lambda a, b, n: (F.col(a) + F.col(b) - 1) / 2 / F.greatest(F.lit(1), F.col(n) - 1)
    return rows.withColumns({
        "center_y": centre("y0", "y1", "n_y"), "center_x": centre("x0", "x1", "n_x"),
        "cell_count": (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0")),
    }).drop("n_t")


def _units(df: DataFrame, columns: dict[str, Column], whole: bool = False) -> DataFrame:
    """Adds columns scaled to 0..1 over the patches of a grid, 0 without spread: a grouped minimum and maximum, joined back; over grids
    that fit a task (``whole``) windows."""
    raw = df.withColumns({f"_raw_{name}": c for name, c in columns.items()})
    spans = {f"_{side}_{name}": f(f"_raw_{name}") for name in columns for side, f in (("lo", F.min), ("hi", F.max))}
    if whole:
        raw = raw.withColumns({name: c.over(Window.partitionBy("grid_id")) for name, c in spans.items()})
    else:
        raw = raw.join(raw.groupBy("grid_id").agg(*[c.alias(name) for name, c in spans.items()]), "grid_id")
    part = lambda name: F.try_divide(F.col(f"_raw_{name}") - F.col(f"_lo_{name}"), F.col(f"_hi_{name}") - F.col(f"_lo_{name}"))
    scaled = raw.withColumns({name: F.coalesce(part(name), F.lit(0.0)) for name in columns})
    return scaled.drop(*[f"_{side}_{name}" for name in columns for side in ("raw", "lo", "hi")])


def saliency_parts(tokens: DataFrame, whole: bool = False) -> DataFrame:
    """Adds the visual and energy parts of saliency, each scaled to 0..1 within a grid."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    scaled = _units(tokens, {f"_{c}": zero(c) for c in rules.VISUAL_WEIGHTS}, whole)
    visual = sum((w * F.col(f"_{c}") for c, w in rules.VISUAL_WEIGHTS.items()), F.lit(0.0))
    energy = F.abs(zero("mean")) + zero("std") + zero("dynamic_range") + zero("gradient_strength")
    return _units(scaled, {"visual": visual, "energy": energy}, whole).drop(*[f"_{c}" for c in rules.VISUAL_WEIGHTS])


def saliency(tokens: DataFrame) -> DataFrame:
    """Adds attention centrality and the fused saliency of encoded patches."""
    return _fused(saliency_parts(tokens))


def _fused(parts: DataFrame, whole: bool = False) -> DataFrame:
    a, b, c = rules.SALIENCY_WEIGHTS
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    central = _units(parts, {"centrality": F.col("incoming") * length}, whole)
    return _units(central, {"saliency": a * F.col("visual") + b * F.col("centrality") + c * F.col("energy")}, whole)


def encode(grid: Grid, shape: tuple[int, int] = (32, 32), dim: int = 32, heads: int = 4, mask: DataFrame | None = None, max_tokens: int | None = None) -> DataFrame:
    """The full patch encoder: tokens with features, vectors, saliency and its sources.

    Grids that fit a task are encoded in one plan without a table in between: cells are shuffled once, then the parts of saliency.
    """
    tokens = patch_tokens(grid, shape, mask, max_tokens)
    if _fits_task(grid, shape, max_tokens):
        return _fused(attend_whole(saliency_parts(tokens, True), dim, heads), True)
    tokens = cut_lineage(tokens)
    return cut_lineage(saliency(tokens.join(attend(tokens, dim, heads), PATCH)))


def grid_token(encoded: DataFrame) -> DataFrame:
    """Layer-normalised mean of the encoded patches."""
    means = encoded.select("grid_id", F.posexplode("vector").alias("i", "x")).groupBy("grid_id", "i").agg(F.avg("x").alias("x"))
    packed = means.groupBy("grid_id").agg(F.array_sort(F.collect_list(F.struct("i", "x")))["x"].alias("m"), F.avg("x").alias("c"), F.stddev_pop("x").alias("s"))
    return packed.select("grid_id", F.transform("m", lambda x: (x - F.col("c")) / F.greatest(F.col("s"), F.lit(1e-6))).alias("grid_token"))


def _edges(n: int | None):
    """Edges of a pair of blocks, the ``n`` strongest."""

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pair in batch.itertuples():
                weights = _weights(pair)
                i, j = np.nonzero((weights > 0) & (np.asarray(pair.query_id)[:, None] != np.asarray(pair.key_id)))
                found = pd.DataFrame({"grid_id": pair.grid_id, "source": np.asarray(pair.query_id)[i], "target": np.asarray(pair.key_id)[j], "attention": weights[i, j]})
                yield found if n is None else found.sort_values(["attention", "source", "target"], ascending=False).head(n)

    return edges


def attention_edges(encoded: DataFrame, n: int | None = 20) -> DataFrame:
    """The ``n`` strongest edges between different patches of a grid; all of them if None."""
    sides = cut_lineage(encoded.select("grid_id", "token_id", "n_tokens", "q", "k", "total"))
    kept = _block_pairs(sides, ["q", "total"], ["k"]).mapInPandas(_edges(n), "grid_id string, source int, target int, attention double")
    return kept if n is None else top_rows(kept, ["grid_id"], [F.col("attention").desc(), F.col("source").desc(), F.col("target").desc()], n)


def top_patches(encoded: DataFrame, n: int = 10) -> DataFrame:
    return top_rows(encoded, ["grid_id"], [F.col("saliency").desc(), F.col("token_id")], n)


def saliency_summary(encoded: DataFrame) -> DataFrame:
    return encoded.groupBy("grid_id").agg(
        F.min("saliency").alias("min"), F.max("saliency").alias("max"), F.avg("saliency").alias("mean"),
        F.percentile("saliency", F.lit(0.95)).alias("p95"), F.count(F.lit(1)).alias("tokens"),
    )


def saliency_map(grid: Grid, encoded: DataFrame, shape: tuple[int, int] = (32, 32), max_tokens: int | None = None) -> DataFrame:
    """Saliency per cell, smoothed with sigma = max(1, median patch side / 7), scaled to 0..1."""
    sides = encoded.select("grid_id", F.explode(F.array(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0"))).alias("side"))
    sigma = sides.groupBy("grid_id").agg(F.greatest(F.lit(1.0), F.percentile("side", F.lit(0.5)) / 7.0).alias("sigma"))
    area = F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)).alias("y")
    rows = encoded.join(grid.per_map(sigma), "grid_id").select("grid_id", "n_y", "n_x", "sigma", "saliency", "x0", "x1", area)
    cells = rows.select("grid_id", "n_y", "n_x", "sigma", "saliency", "y", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1)).alias("x"))
    widest = max(1.0, max(patch_shape(grid.shape[1], grid.shape[2], shape, max_tokens)) / 7.0)
    smoothed = smooth_map(cells, "saliency", F.col("sigma"), ["grid_id"], max_sigma=widest)
    return min_max(smoothed.select("grid_id", "y", "x", F.col("smoothed").alias("v")), "v", ["grid_id"], small=grid.per_map)


# --- text ------------------------------------------------------------------------------------------------------------

def hash_embed(df: DataFrame, text: str, dim: int, key: str = "id") -> DataFrame:
    """Adds nothing to texts but a vector: signed counts of hashed character pairs, scaled to length 1.

    Every row is handled where it lies, without a shuffle. Null and blank texts get zeros; rows with one key keep a vector each.
    """
    return df.select(key, _pair_vectors(dim)(strip(F.lower(F.col(text)))).alias("vector"))


def _pair_vectors(dim: int):
    @F.pandas_udf("array<double>")
    def vectors(texts: pd.Series) -> pd.Series:
        @lru_cache(maxsize=100_000)
        def place(pair: str) -> tuple[int, float]:
            digest = sha256(pair.encode("utf-8", "surrogatepass")).digest()
            return int.from_bytes(digest[:4], "big") % dim, -1.0 if digest[4] % 2 else 1.0

        def one(text: str | None) -> np.ndarray:
            out = np.zeros(dim)
            text = text or ""
            pairs = Counter(map("".join, zip(text, text[1:]))) if len(text) > 1 else Counter(text)
            for pair, n in pairs.items():
                i, sign = place(pair)
                out[i] += sign * n
            length = np.sqrt((out * out).sum())
            return out / length if length else out

        return texts.map(one)

    return vectors


def align(texts: DataFrame, encoded: DataFrame, n: int = 10, key: str = "id") -> DataFrame:
    """Patches of a grid closest in cosine to each text about that grid; ``texts`` has key, grid_id, vector.

    The patches of a grid travel as one array of bounded length to its texts, so no text-patch pair becomes a row.
    """
    packed = encoded.groupBy("grid_id").agg(F.collect_list(F.struct("token_id", "vector")).alias("_tokens"))
    asked = texts.select(key, "grid_id", F.col("vector").alias("_q")).join(packed, "grid_id")
    scored = F.transform("_tokens", lambda t: F.struct((-cosine(F.col("_q"), t["vector"])).alias("neg"), t["token_id"].alias("token_id")))
    best = F.slice(F.array_sort(scored), 1, n)
    return asked.select(key, "grid_id", F.posexplode(best).alias("k", "b")).select(
        key, "grid_id", F.col("b.token_id").alias("token_id"), (-F.col("b.neg")).alias("score"), (F.col("k") + 1).alias("rank")
    )
