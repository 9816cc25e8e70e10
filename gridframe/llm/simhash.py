"""Near-duplicate documents by SimHash fingerprints and deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.llm.common import LOWER, pieces, small, whole_groups
from gridframe.llm.graph import Roots, components
from gridframe.session import cut_lineage

#: Fingerprints of a bucket that one task compares; larger buckets are dealt out as pairs of blocks.
BLOCK = 4096
#: Buckets up to this size are compared by shifted arrays, all buckets of a batch at once.
FEW = 16


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """64-bit SimHash: a bit is set where over half of the shingles' hashes have it; zero without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    ends = ends[shingle - 1 :].tolist() if len(words) >= shingle else [len(joined)]
    hashes = np.fromiter((xxh64_intdigest(joined[s:e], seed) for s, e in zip(starts, ends, strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        ones += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(documents: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp): the fingerprint as a signed long. A null text has no words and the fingerprint zero."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    return documents.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(hashed, "id long, fp long")


def segments(bits: int) -> list[tuple[int, int]]:
    """(offset, width) of the fewest segments of 64 bits so that, of two fingerprints that differ in ``bits`` bits, one
    segment differs in one bit at most: with s segments and two or more differences in each there are 2s."""
    count = bits // 2 + 1
    cuts = [64 * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _pairs(fp: np.ndarray, other: np.ndarray, bits: int, count: int, key: np.ndarray) -> np.ndarray:
    """Which pairs differ in ``bits`` bits at most and meet in this bucket first, of all buckets that they share."""
    x = fp ^ other
    ok = np.bitwise_count(x) <= bits
    first = np.full(len(x), -1, np.int64)
    for s, (at, width) in enumerate(segments(bits)):
        part = (x >> np.uint64(at)) & np.uint64((1 << width) - 1)
        hole = np.where(part > 0, np.bitwise_count(part - np.uint64(1) * (part > 0)).astype(np.int64), 0)
        first = np.where((first < 0) & (np.bitwise_count(part) <= 1), s * 64 + hole, first)
    return ok & (first == key)


def _links(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Links among fingerprints of whole buckets: (bucket, block pair, id, fp, place) sorted by bucket."""
    count = len(segments(bits))
    for table in whole_groups(batches):
        key = table.column(0).to_numpy()
        node, fp = table.column(1).to_numpy(), table.column(2).to_numpy().view(np.uint64)
        place = table.column(3).to_numpy()
        edge = np.flatnonzero(np.diff(key)) + 1
        starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(key)]])
        sizes = ends - starts
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []
        large = np.repeat(sizes > FEW, sizes)
        for shift in range(1, min(FEW, int(sizes.max()))):
            i = np.flatnonzero((key[shift:] == key[:-shift]) & ~large[shift:])
            i = i[_pairs(fp[i], fp[i + shift], bits, count, place[i])]
            a.append(node[i])
            b.append(node[i + shift])
        for s, e in zip(starts[sizes > FEW].tolist(), ends[sizes > FEW].tolist(), strict=True):
            roots = Roots(e - s)
            for i in range(s, e - 1):
                for j in np.flatnonzero(np.bitwise_count(fp[i + 1 : e] ^ fp[i]) <= bits).tolist():
                    roots.join(i - s, i + 1 + j - s)
            who, root = roots.stars()
            a.append(node[s:e][who])
            b.append(node[s:e][root])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def links(nodes: DataFrame, bits: int = 4) -> DataFrame:
    """Links (a, b) that connect all fingerprints (``id``, ``fp``, each fp once) at ``bits`` or fewer differing bits.

    Each segment of a fingerprint is indexed with each of its bits left out in turn, so that segments which differ in at most one bit
    share a key, and rows with equal keys are compared on the whole fingerprint. In buckets of up to FEW rows each
    link appears once; larger buckets give links to the smallest member of each connected part instead, so the result
    grows with the rows. Buckets above BLOCK are dealt out as pairs of blocks.
    """
    parts = segments(bits)
    cut = nodes.select("id", "fp", F.posexplode(F.array(*[F.shiftrightunsigned("fp", at).bitwiseAND((1 << w) - 1) for at, w in parts])).alias("s", "part"))
    holes = F.expr("CASE s " + " ".join(f"WHEN {s} THEN sequence(0, {w - 1})" for s, (_, w) in enumerate(parts)) + " END")

    def variants(df: DataFrame) -> DataFrame:
        """One key per hole: segment and hole above the bits that are left."""
        df = df.withColumn("hole", F.explode(holes)).withColumn("place", (F.col("s") * 64 + F.col("hole")).cast("long"))
        left = F.col("part").bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, hole)")))
        return df.withColumn("key", F.expr("shiftleft(place, 52)").bitwiseOR(left) if max(w for _, w in parts) <= 52 else F.xxhash64("place", left))

    # A bucket holds two values of a segment, so it can only be large if one of the two is frequent.
    heavy = variants(cut.groupBy("s", "part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK // 2)).groupBy("key").agg(F.ceil(F.sum("n") / BLOCK).alias("blocks")).where("blocks > 1")
    heavy, _ = small(heavy)
    dealt = variants(cut).join(heavy, "key", "left").withColumn("mine", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("id"), F.col("blocks"))))
    dealt = dealt.withColumn("pair", F.explode(F.expr("CASE WHEN mine IS NULL THEN array(0L) ELSE transform(sequence(0L, blocks - 1), o -> least(o, mine) * blocks + greatest(o, mine)) END")))
    dealt = dealt.select(F.when(F.col("mine").isNull(), F.col("key")).otherwise(F.xxhash64("key", "pair")).alias("key"), "id", "fp", "place")
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(lambda batches: _links(batches, bits), "a long, b long")


def grouped(documents: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 4, bits: int = 4) -> tuple[DataFrame, DataFrame]:
    """Fingerprints (id, fp) of all rows, and (fp, root) for each fingerprint: the least one reachable over links."""
    rows = cut_lineage(fingerprints(documents, id, text, shingle))
    nodes = cut_lineage(rows.select("fp").distinct())
    found = components(links(nodes.select(F.col("fp").alias("id"), "fp"), bits))
    roots = nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("root"))
    return rows, cut_lineage(roots)


def near_duplicates(documents: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 4, bits: int = 4) -> DataFrame:
    """(id, fingerprint, component_id) for each row: the fingerprint as 16 hex digits and the smallest id reachable over links.

    Rows with one fingerprint are one node, so exact copies make no pairs; a component is named by its smallest id when it is
    whole. Null or empty texts have the zero fingerprint and link like others. Repeated rows come back as often as they went
    in. Rows without an id link like others but are no candidate for the smallest id; component_id is null if all rows of a
    component lack an id. Other columns of the input are not read. An empty table gives an empty one.
    """
    rows, roots = grouped(documents, id, text, shingle, bits)
    least = rows.groupBy("fp").agg(F.min("id").alias("id")).join(roots, "fp")
    names = least.groupBy("root").agg(F.min("id").alias("component_id"))
    named = cut_lineage(roots.join(names, "root").select("fp", "component_id"))
    return rows.join(named, "fp").select(F.col("id").alias(id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
