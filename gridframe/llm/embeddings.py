"""Near-duplicate vectors by iterative quantisation, multi-index Hamming tables and exact cosines."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.llm.common import send, small, whole_groups
from gridframe.llm.graph import components
from gridframe.session import cut_lineage

#: Vectors that the rotations are learned on, at most: those with the smallest hashes.
FIT_ROWS = 5000
#: Independent rotations, and the bits of a key, at least. A code has as many bits as the vectors have dimensions.
ROTATIONS = 5
KEY_BITS = 12
#: Rows that should share a key of random codes, about; the share of equal bits in codes of vectors with a cosine of 0.9; the recall to be reached.
PER_KEY, AGREE, RECALL = 64, 0.856, 0.98
#: Rows of a bucket that one task compares; larger buckets are dealt out as pairs of blocks.
BLOCK = 1024


def learn_rotations(sample: np.ndarray, rotations: int = ROTATIONS, rounds: int = 30, seed: int = 5) -> np.ndarray:
    """Mean, then matrices that take a centred unit vector to the numbers whose signs are its code: [rotations, dim, bits].

    Principal directions, then alternating steps: signs for a fixed rotation, and the rotation nearest to the signs (Gong and Lazebnik,
    2011). The starts are drawn from a fixed seed.
    """
    draw = np.random.default_rng(seed)
    dim = sample.shape[1]
    if not len(sample):
        return np.array([np.linalg.qr(draw.normal(size=(dim, dim)))[0] for _ in range(rotations)])
    _, _, axes = np.linalg.svd(sample, full_matrices=True) if len(sample) < dim else (None, None, np.linalg.eigh(sample.T @ sample)[1].T[::-1])
    flat = sample @ axes.T
    out = []
    for _ in range(rotations):
        turn = np.linalg.qr(draw.normal(size=(dim, dim)))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(flat @ turn >= 0, 1.0, -1.0).T @ flat)
            turn = (u @ v).T
        out.append(axes.T @ turn)
    return np.array(out)


def table_sizes(rows: int, dim: int, key_bits: int | None = None, rotations: int | None = None) -> tuple[int, int]:
    """Bits of a key and number of rotations: keys grow with the logarithm of the rows, and tables so that the recall stays."""
    bits = key_bits or max(KEY_BITS, math.ceil(math.log2(max(rows, 1) / PER_KEY)))
    tables = math.log(1 - RECALL) / math.log(1 - AGREE ** min(bits, dim))
    return bits, rotations or max(ROTATIONS, math.ceil(tables / max(1, dim // bits)))


def _units(vectors: list) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that large and small numbers don't overflow."""
    v = np.array(vectors, np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _compare(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Links of whole buckets (key, table, id, n, block, keys, unit): for each vector, how many vectors it is linked to that it
    meets here first of all tables, and a smaller member of its connected part."""
    for whole in whole_groups(batches):
        key = whole.column(0).to_numpy()
        cut = np.flatnonzero(np.diff(key)) + 1
        starts, ends = np.append(0, cut), np.append(cut, len(key))
        busy = np.flatnonzero(ends - starts > 1)
        if not len(busy):
            continue
        tables, ids, n, blocks = (whole.column(i).to_numpy() for i in (1, 2, 3, 4))
        all_keys, all_units = whole.column(5).combine_chunks(), whole.column(6).combine_chunks()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for s, e in zip(starts[busy].tolist(), ends[busy].tolist(), strict=True):
            # A bucket has vectors of one length.
            keys, units = (x.slice(s, e - s).flatten().to_numpy().reshape(e - s, -1) for x in (all_keys, all_units))
            near = units @ units.T >= least
            np.fill_diagonal(near, False)
            if blocks[s] >= 0:  # of two blocks, only pairs across
                near &= blocks[s:e][:, None] != blocks[s:e][None, :]
            seen = near.any(axis=1)
            if not seen.any():
                continue
            m = e - s
            root = np.arange(m)
            while True:
                low = np.minimum(root, np.where(near, root[None, :], m).min(axis=1))
                if (low == root).all():
                    break
                root = low[low]
            for earlier in range(tables[s]):
                own = keys[:, earlier]
                near &= own[:, None] != own[None, :]
            out.append((ids[s:e][seen], (near @ n[s:e])[seen], ids[s:e][root][seen]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["id", "links", "other"])


def near_duplicates(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", least: float = 0.9, key_bits: int | None = None, rotations: int | None = None, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(id, n_links, component_id, kept) for each row; a pair is linked if it is found and its cosine is ``least`` or more.

    Equal vectors are one class. Rotations are learned on a bounded sample; every class is then coded and entered
    in a table for each ``key_bits`` bits of each code. Vectors that agree in a key of any table are compared by their
    cosines in double precision, in buckets of bounded blocks, each pair in the first table in which it meets. A
    bucket returns counts and one link per vector, not pairs. Where not given, ``key_bits`` grows with the logarithm of the rows and ``rotations`` so that
    the recall stays. Vectors of one length are compared with each other, each length in tables of its own; a length that the sample lacks has rotations drawn at random.
    n_links counts rows, so copies of a vector are linked with each other. Vectors that are null, empty, zero or hold null or
    non-finite numbers link with nothing. A null id is its own row and never names a component with other members. A repeated id is one
    node: each of its rows gets the same result, and its vectors count one by one. An empty table gives an empty one.
    """
    numbers = F.transform(F.col(vector), lambda x: x.cast("double"))
    fine = F.coalesce(F.size(vector) > 0, F.lit(False)) & F.coalesce(F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists(numbers, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.when(fine, numbers).alias("v"))
    classes = cut_lineage(rows.where("v IS NOT NULL AND id IS NOT NULL").groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))
    sizes = {r[0]: r[1] for r in classes.groupBy(F.size("v")).count().collect()}
    sample = [r[0] for r in classes.select("v", F.xxhash64("v").alias("h")).orderBy("h", "v").limit(fit_rows).select("v").collect()]
    plans = {dim: table_sizes(n, dim, key_bits, rotations) for dim, n in sizes.items()}
    learned = {dim: (bits, learn_rotations(_units(some), turns)) for dim, (bits, turns) in plans.items() if (some := [v for v in sample if len(v) == dim])}
    turns = send(vectors, (plans, learned))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans, learned = turns()
        for batch in batches:
            lengths = pa.compute.list_value_length(batch.column(2)).to_numpy()
            for dim in np.unique(lengths).tolist():
                own = batch.filter(pa.array(lengths == dim))
                units = _units(own.column(2).to_pylist())
                bits, count = plans[dim]
                _, matrices = learned.get(dim) or (bits, learn_rotations(np.zeros((0, dim)), count, rounds=0))
                keys = []
                for matrix in matrices:
                    code = (units @ matrix >= 0).astype(np.int64)
                    for at in range(0, max(1, dim - bits + 1), bits):
                        part = code[:, at : at + bits]
                        keys.append(part @ (1 << np.arange(part.shape[1])))
                keys = np.stack(keys, axis=1)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1))) for x in (keys, units)]
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), *lists], ["id", "n", "keys", "unit"])

    codes = cut_lineage(classes.select("id", "n", "v").mapInArrow(coded, "id long, n long, keys array<long>, unit array<double>"))
    entry = F.posexplode("keys").alias("t", "part")
    # One length alone has keys of bits; several are told apart by a hash.
    key = F.shiftleft(F.col("t").cast("long"), 32) + F.col("part")
    if len(sizes) > 1 or any(bits > 32 for bits, _ in plans.values()):
        key = F.xxhash64("t", "part", F.size("unit"))
    key = key.alias("key")
    heavy, _ = small(codes.select("unit", entry).select(key).groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")).where("blocks > 1"))
    entries = codes.select("id", "n", "keys", "unit", entry).select(key, "t", "id", "n", "keys", "unit").join(heavy, "key", "left")
    entries = entries.withColumn("block", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("id"), F.col("blocks"))).otherwise(-1))
    entries = entries.withColumn("pair", F.explode(F.expr("CASE WHEN block < 0 THEN array(0L) ELSE transform(sequence(0L, blocks - 1), o -> least(o, block) * blocks + greatest(o, block)) END")))
    entries = entries.select(F.when(F.col("block") < 0, F.col("key")).otherwise(F.xxhash64("key", "pair")).alias("key"), "t", "id", "n", F.expr("CASE WHEN pair = block * blocks + block THEN -1L ELSE block END").cast("long").alias("block"), "keys", "unit")
    met = cut_lineage(entries.repartition("key").sortWithinPartitions("key").mapInArrow(lambda batches: _compare(batches, least), "id long, links long, other long"))

    found = components(met.select("id", "other"))
    counts = met.groupBy("id").agg(F.sum("links").alias("links"))
    named = classes.join(counts, "id", "left").join(found.withColumnRenamed("node", "id"), "id", "left")
    named = cut_lineage(named.select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")))
    # A row without a usable vector or id stands for itself.
    sound = rows.where("v IS NOT NULL AND id IS NOT NULL").join(named, "v").select("id", "n_links", "component_id")
    rest = rows.where("v IS NULL OR id IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return sound.unionByName(rest).select(F.col("id").alias(id), F.col("n_links").cast("long"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
