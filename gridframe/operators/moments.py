"""Joint moments of all pairs of variables, with gaps, by mergeable Gram matrices.

Cells are brought together in chunks of places, all variables of a place in one chunk. A task lays a chunk out as a matrix of places by
variables and multiplies blocks of its columns: values with values, values with presence, presence with presence. Results of chunks are
merged in the task, and once more over the tasks, by the update rule for means and central moments (Chan, Golub and
LeVeque, 1983), so neither many cells nor values far from zero cost digits. The plan does not grow with the number of variables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridframe.model import Grid
from gridframe.operators.tiles import sorted_groups

#: Values of a chunk, places times variables, and the places of a chunk at least.
CHUNK, PLACES = 1 << 20, 64
#: Variables whose products are made at a time.
BLOCK = 128

MOMENTS = "n double, mean_left double, mean_right double, left2 double, right2 double, both double, away double"

#: The moments of a pair from those of its parts, one after the other.
MERGE = """aggregate(parts, named_struct('n', 0D, 'mean_left', 0D, 'mean_right', 0D, 'left2', 0D, 'right2', 0D, 'both', 0D, 'away', 0D),
  (s, p) -> named_struct('n', s.n + p.n,
    'mean_left', IF(s.n = 0, p.mean_left, s.mean_left + (p.mean_left - s.mean_left) * p.n / (s.n + p.n)),
    'mean_right', IF(s.n = 0, p.mean_right, s.mean_right + (p.mean_right - s.mean_right) * p.n / (s.n + p.n)),
    'left2', s.left2 + p.left2 + IF(s.n = 0, 0D, (p.mean_left - s.mean_left) * (p.mean_left - s.mean_left) * s.n * p.n / (s.n + p.n)),
    'right2', s.right2 + p.right2 + IF(s.n = 0, 0D, (p.mean_right - s.mean_right) * (p.mean_right - s.mean_right) * s.n * p.n / (s.n + p.n)),
    'both', s.both + p.both + IF(s.n = 0, 0D, (p.mean_left - s.mean_left) * (p.mean_right - s.mean_right) * s.n * p.n / (s.n + p.n)),
    'away', s.away + p.away))"""


def _block_moments(a: np.ndarray, b: np.ndarray, away: bool) -> np.ndarray:
    """Moments [7, left, right] of the columns of a with those of b, over rows where both are present (not NaN)."""
    def parts(m: np.ndarray) -> tuple[np.ndarray, ...]:
        there = ~np.isnan(m)
        shift = np.where(there.any(axis=0), m[there.argmax(axis=0), np.arange(m.shape[1])], 0.0)
        moved = np.where(there, m - shift, 0.0)
        return there.astype(np.float64), shift, moved

    (p, s, x), (q, t, y) = parts(a), parts(b)
    n = p.T @ q
    safe = np.maximum(n, 1)
    sum_x, sum_y = x.T @ q, p.T @ y
    out = np.zeros((7, *n.shape))
    out[0], out[1], out[2] = n, s[:, None] + sum_x / safe, t[None, :] + sum_y / safe
    out[3] = np.maximum((x * x).T @ q - sum_x * sum_x / safe, 0.0)
    out[4] = np.maximum(p.T @ (y * y) - sum_y * sum_y / safe, 0.0)
    out[5] = x.T @ y - sum_x * sum_y / safe
    if away:
        for i in range(a.shape[1]):
            out[6, i] = np.nansum(np.abs(a[:, i : i + 1] - b), axis=0)
    return out


def _merged(s: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Moments of two disjoint sets of rows together."""
    n = s[0] + p[0]
    share = np.divide(p[0], n, out=np.zeros_like(n), where=n > 0)
    left, right = np.where((s[0] > 0) & (p[0] > 0), p[1:3] - s[1:3], 0.0)
    out = s + p
    out[1], out[2] = (np.where(s[0] > 0, s[k] + d * share, p[k]) for k, d in ((1, left), (2, right)))
    weight = s[0] * share
    out[3] += left * left * weight
    out[4] += right * right * weight
    out[5] += left * right * weight
    return out


def pair_moments(grid: Grid, away: bool = False) -> DataFrame:
    """(grid_id, left_pos, right_pos, n, mean_left, mean_right, left2, right2, both[, away]) for all pairs of variables, left_pos <= right_pos.

    Over cells where both are present: number, means, sums of squares and products of deviations, and, with ``away``, the sum of absolute
    differences. Variables are named by position. One shuffle of cells, and one of a row per pair, grid and task.
    """
    names = grid.variables
    width = len(names)
    places = max(PLACES, CHUNK // width)
    n_y, n_x = grid.shape[1:]
    place = (F.col("t").cast("long") * n_y + F.col("y")) * n_x + F.col("x")
    cells = grid.cells.select("grid_id", F.floor(place / places).alias("chunk"), (place % places).cast("int").alias("place"), grid.position().cast("int").alias("pos"), "v")
    cells = cells.where("pos >= 0").repartition("grid_id", "chunk").sortWithinPartitions("grid_id", "chunk")
    blocks = [(i, j) for i in range(0, width, BLOCK) for j in range(i, width, BLOCK)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, grid_id = {}, None

        def rows() -> Iterator[pa.RecordBatch]:
            for (i, j), m in held.items():
                left, right = np.nonzero(np.arange(m.shape[1])[:, None] + i <= np.arange(m.shape[2])[None, :] + j)
                columns = [pa.array([grid_id] * len(left), pa.string()), pa.array((left + i).astype(np.int32)), pa.array((right + j).astype(np.int32)), *[pa.array(x[left, right]) for x in m]]
                yield pa.RecordBatch.from_arrays(columns, ["grid_id", "left_pos", "right_pos", *[f.split()[0] for f in MOMENTS.split(", ")]])

        for table, starts in sorted_groups(batches, ["grid_id", "chunk"]):
            place, pos, v = (table.column(c).to_numpy() for c in ("place", "pos", "v"))
            for start, stop in zip(starts, [*starts[1:], len(v)], strict=True):
                this = table.column("grid_id")[int(start)].as_py()
                if this != grid_id:
                    yield from rows()
                    held, grid_id = {}, this
                there, row = np.unique(place[start:stop], return_inverse=True)
                x = np.full((len(there), width), np.nan)
                x[row, pos[start:stop]] = v[start:stop]
                for i, j in blocks:
                    m = _block_moments(x[:, i : i + BLOCK], x[:, j : j + BLOCK], away)
                    held[i, j] = _merged(held[i, j], m) if (i, j) in held else m
        yield from rows()

    parts = cells.mapInArrow(run, f"grid_id string, left_pos int, right_pos int, {MOMENTS}")
    fields = [f.split()[0] for f in MOMENTS.split(", ")]
    listed = parts.groupBy("grid_id", "left_pos", "right_pos").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("parts"))
    return listed.select("grid_id", "left_pos", "right_pos", F.expr(MERGE).alias("m")).select("grid_id", "left_pos", "right_pos", *[f"m.{f}" for f in fields])
