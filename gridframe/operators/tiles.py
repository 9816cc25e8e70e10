"""Neighbourhood operations on maps, cut into tiles with a halo.

A cell goes to its own tile and to those whose halo it lies in. One shuffle brings each tile together; a task lays
the tiles of a batch out as arrays, many small maps at once, and hands back the cells that a tile owns. Edges of a map are
mirrored (d c b a | a b c d | d c b a) inside the tile, so no copies of border cells are made for that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Rows and columns of a tile without its halo.
TILE = 256
#: Cells, with halos, that are worked on as one array; a single tile may be larger.
CELLS = 1 << 20

Blocks = Mapping[str, np.ndarray]


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that hold whole groups, with the place where each group begins, of batches sorted by ``keys``.

    Holds one batch, and the group that it breaks off in, at a time.
    """
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        table = table.combine_chunks()
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for key in keys:
            column = table.column(key)
            new[1:] |= pa.compute.not_equal(column[1:], column[:-1]).to_numpy()
        starts = np.flatnonzero(new)
        if len(starts) > 1:
            yield table.slice(0, starts[-1]), starts[:-1]
        rest = table.slice(starts[-1])
    if rest is not None:
        yield rest, np.zeros(1, np.int64)


def on_tiles(
    df: DataFrame, keys: Sequence[str], values: Sequence[str], before: int, after: int, outs: Sequence[str],
    compute: Callable[[Blocks, Blocks], Blocks], per_map: Sequence[str] = (), one_tile: bool = False, tile: int = TILE,
) -> DataFrame:
    """Adds (or replaces) the double columns ``outs``, which ``compute`` makes from the columns ``values``.

    ``df`` has n_y, n_x, and one row per (keys, y, x). ``compute`` gets arrays [tile, row, column], NaN where there is no value, that reach
    ``before`` cells above and left of the tile's own cells and ``after`` below and right of them, and for each tile the value of the
    columns ``per_map``, which are equal throughout a map. It returns arrays of the tile's own cells. With ``one_tile`` every map is known to fit one tile.
    """
    kept = [c for c in df.columns if c not in outs]
    if one_tile:
        placed = df.withColumns({"_ty": F.lit(0), "_tx": F.lit(0), "_own": F.lit(True)})
    else:
        def reach(axis: str, size: str):
            first = F.floor(F.greatest(F.col(axis) - after, F.lit(0)) / tile)
            last = F.floor(F.least(F.col(axis) + before, F.col(size) - 1) / tile)
            return F.explode(F.sequence(first, last).cast("array<int>"))

        placed = df.withColumn("_ty", reach("y", "n_y")).withColumn("_tx", reach("x", "n_x"))
        placed = placed.withColumn("_own", (F.floor(F.col("y") / tile) == F.col("_ty")) & (F.floor(F.col("x") / tile) == F.col("_tx")))
    group = [*keys, "_ty", "_tx"]
    together = placed.repartition(*group).sortWithinPartitions(*group)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in sorted_groups(batches, group):
            made = _tile_values(table, starts, values, before, after, outs, compute, per_map, tile)
            own = table.column("_own")
            out = table.select(kept)
            for name in outs:
                out = out.append_column(name, pa.array(made[name], from_pandas=True))
            yield from out.filter(own).combine_chunks().to_batches()

    return together.mapInArrow(run, ", ".join([*fields, *[f"`{o}` double" for o in outs]])).select(*[*df.columns, *[o for o in outs if o not in df.columns]])


def _tile_values(table, starts, values, before, after, outs, compute, per_map, tile) -> dict[str, np.ndarray]:
    """Columns ``outs`` for the rows of a table of whole tiles; NaN for rows that their tile doesn't own."""
    column = lambda name: table.column(name).to_numpy()
    y, x = column("y"), column("x")
    ends = np.append(starts[1:], len(y))
    first = {c: column(c)[starts] for c in ("_ty", "_tx", "n_y", "n_x", *per_map)}
    spans = []
    for place, size in ((first["_ty"].astype(np.int64), first["n_y"]), (first["_tx"].astype(np.int64), first["n_x"])):
        own_from, own_to = place * tile, np.minimum(place * tile + tile, size)
        lo, hi = np.maximum(own_from - before, 0), np.minimum(own_to + after, size)
        spans.append((own_from, own_to, lo, hi))
    (y0, y1, top, bottom), (x0, x1, left, right) = spans
    # Tiles of one shape and one place relative to the edges are laid out together.
    shape = np.stack([y0 - top, y1 - y0, bottom - y1, x0 - left, x1 - x0, right - x1], axis=1)
    shapes, kind = np.unique(shape, axis=0, return_inverse=True)
    kind = kind.ravel()
    made = {name: np.full(len(y), np.nan) for name in outs}
    data = {v: column(v).astype(np.float64) for v in values}
    for k, (up, height, down, west, width, east) in enumerate(shapes):
        tiles = np.flatnonzero(kind == k)
        rows, columns = up + height + down, west + width + east
        step = max(1, CELLS // max(1, int(rows * columns)))
        for at in range(0, len(tiles), step):
            some = tiles[at : at + step]
            sizes = ends[some] - starts[some]
            owner = np.repeat(np.arange(len(some)), sizes)
            row = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts[some], sizes)
            yy, xx = y[row] - top[some][owner], x[row] - left[some][owner]
            blocks = {}
            for name, v in data.items():
                block = np.full((len(some), rows, columns), np.nan)
                block[owner, yy, xx] = v[row]
                blocks[name] = np.pad(block, ((0, 0), (before - up, after - down), (before - west, after - east)), "symmetric")
            result = compute(blocks, {c: first[c][some] for c in per_map})
            inside = (yy >= up) & (yy < up + height) & (xx >= west) & (xx < west + width)
            for name in outs:
                made[name][row[inside]] = result[name][owner[inside], yy[inside] - up, xx[inside] - west]
    return made


def box_sums(block: np.ndarray, n: int) -> np.ndarray:
    """Sums over n by n boxes that lie inside the array, by cumulative sums along both axes; exact for whole numbers."""
    for axis in (1, 2):
        total = np.cumsum(block, axis=axis, dtype=block.dtype)
        total = np.concatenate([np.zeros_like(np.take(total, [0], axis)), total], axis=axis)
        size = total.shape[axis]
        block = np.take(total, np.arange(n, size), axis) - np.take(total, np.arange(0, size - n), axis)
    return block


def box_means(block: np.ndarray, n: int) -> np.ndarray:
    """Means of the values present in n by n boxes, along rows and then along columns.

    Sums run over the n shifted arrays: differences of cumulative sums would lose digits where the spread is small.
    """
    for axis in (1, 2):
        size = block.shape[axis] - n + 1
        parts = [np.take(block, np.arange(k, k + size), axis) for k in range(n)]
        there = sum(~np.isnan(p) for p in parts)
        block = np.where(there > 0, sum(np.where(np.isnan(p), 0.0, p) for p in parts) / np.maximum(there, 1), np.nan)
    return block


def box_std(block: np.ndarray, n: int) -> np.ndarray:
    """sqrt(max(E[v^2] - E[v]^2, 0)) over n by n boxes; values are taken relative to the middle of the tile, which changes nothing but the digits."""
    centre = np.nan_to_num(block[:, block.shape[1] // 2, block.shape[2] // 2])[:, None, None]
    moved = block - centre
    return np.sqrt(np.maximum(box_means(moved * moved, n) - box_means(moved, n) ** 2, 0.0))


def box_entropy(block: np.ndarray, low: np.ndarray, high: np.ndarray, n: int, bins: int) -> np.ndarray:
    """Entropy, scaled to 0..1, of the levels in n by n boxes: one sliding count per level. 0 where low equals high."""
    span = (high - low)[:, None, None]
    with np.errstate(invalid="ignore", divide="ignore"):
        level = np.clip(np.floor((block - low[:, None, None]) / span * (bins - 1)), 0, bins - 1)
    share = np.arange(n * n + 1) / (n * n)
    part = np.zeros(n * n + 1)
    part[1:] = -share[1:] * np.log2(share[1:]) / np.log2(bins)
    total = 0.0
    for k in range(bins):
        total = total + part[box_sums((level == k).astype(np.int32), n)]
    return np.where(span == 0, 0.0, total)
