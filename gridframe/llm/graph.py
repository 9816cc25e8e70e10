"""Connected components of a table of links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.session import cut_lineage

#: Rounds after which something must be wrong: every round at least halves the depth.
MAX_ROUNDS = 60


class Roots:
    """Union-find over positions 0..n-1 whose root is the smallest position of a set."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)

    def stars(self) -> tuple[list[int], list[int]]:
        """Each position that is not a root, and its root."""
        who = [i for i in range(len(self.up)) if self.up[i] != i]
        return who, [self.find(i) for i in who]


def _within(batches):
    """Links of a batch by links to the smallest member: at most one row per node and batch."""
    for batch in batches:
        ends = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
        ids, at = np.unique(ends, return_inverse=True)
        roots = Roots(len(ids))
        for i, j in zip(*at.reshape(2, -1).tolist(), strict=True):
            roots.join(i, j)
        who, root = roots.stars()
        yield pa.RecordBatch.from_arrays([pa.array(ids[who], pa.int64()), pa.array(ids[root], pa.int64())], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each node that has a link. ``edges`` has two long columns.

    Links are first merged within batches, then large-star and small-star rounds follow (Kiveris et al., 2014),
    each written to the checkpoint folder. Least neighbours are grouped with partial sums and written before they
    are joined back, so a node with very many links is a skewed join side that Spark splits. Rows with a null end
    and links of a node to itself are left out; without links the result is empty.
    """
    a, b = edges.columns
    pairs = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a != b")
    pairs = cut_lineage(pairs.mapInArrow(_within, "a long, b long").distinct())

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        if large:
            both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = cut_lineage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        moved = both.join(least, "a").where(F.col("b") > F.col("a") if large else F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            moved = moved.unionByName(least.select("a", F.col("m").alias("b")))
        return cut_lineage(moved.where("a != b").distinct())

    def mark(pairs: DataFrame):
        return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    seen = mark(pairs)
    for _ in range(MAX_ROUNDS if seen[0] else 0):
        pairs = star(star(pairs, True), False)
        now = mark(pairs)
        if now == seen:
            break
        seen = now
    else:
        if seen[0]:
            raise RuntimeError("component merging did not settle")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
