"""Hard negatives by exact integer scores: matrix products in a residue number system, then selection in windows of the score.

Vectors are quantised to whole numbers. Their matrix product is taken modulo several primes, each in float32, where sums of products of
residues stay below 2**24 and are therefore exact. Chinese remaindering in mixed radix gives the signed score back; there are as many
primes as the largest possible score asks for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridframe.llm.common import send
from gridframe.session import cut_lineage

#: Components multiplied before the sums are reduced again, and the largest prime: PART * (LARGEST / 2)**2 < 2**24.
PART, LARGEST = 64, 1021
#: Bytes of quantised anchors that are sent to every task at a time. All rows are read once for each such share of the anchors.
ANCHOR_BYTES = 16 << 20
#: Anchors and rows whose scores a task holds at a time.
ANCHORS, ROWS = 1024, 2048
LOWEST = np.iinfo(np.int64).min


def primes_for(bound: int) -> list[int]:
    """The largest primes whose product is over twice ``bound``, so that every score between -bound and bound has residues of its own."""
    found, product, p = [], 1, LARGEST
    while product <= 2 * bound + 1:
        if all(p % d for d in range(3, int(p**0.5) + 1, 2)):
            found.append(p)
            product *= p
        p -= 2
    return found


def residues(a: np.ndarray, p: int) -> np.ndarray:
    """Whole numbers modulo p, centred on zero, in float32."""
    r = np.remainder(a, p)
    return (r - p * (r > p // 2)).astype(np.float32)


def scores(a: list[np.ndarray], b: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact a @ b.T from the residues of a and b modulo each prime.

    Digits in mixed radix are centred on zero, so their sum is the signed score; it is right modulo 2**64, and fits.
    """
    digits: list[np.ndarray] = []
    total, unit = np.zeros((len(a[0]), len(b[0])), np.int64), 1
    for left, right, p in zip(a, b, primes, strict=True):
        s = np.zeros(total.shape, np.int32)
        for at in range(0, left.shape[1], PART):
            s += (left[:, at : at + PART] @ right[:, at : at + PART].T).astype(np.int32)
            s %= p
        for digit, q in zip(digits, primes, strict=False):
            s = (s - digit) % p * pow(q, -1, p) % p
        s -= p * (s > p // 2)
        digits.append(s)
        total += s * np.array([unit % (1 << 64)], np.uint64).view(np.int64)
        unit *= p
    return total


class Best:
    """The first k rows of each slot, by score and then by smaller id. Slots that lack rows hold the lowest score."""

    def __init__(self, slots: int, k: int):
        self.score = np.full((slots, k), LOWEST)
        self.id = np.zeros((slots, k), np.int64)

    def add(self, slot: np.ndarray, score: np.ndarray, id: np.ndarray) -> None:
        last, tie = self.score[slot, -1], self.id[slot, -1]
        new = (score > last) | (score == last) & (id < tie) if len(slot) else np.zeros(0, bool)
        slot, score, id = slot[new], score[new], id[new]
        if not len(slot):
            return
        k = self.score.shape[1]
        touched = np.unique(slot)
        slot = np.concatenate([np.repeat(touched, k), slot])
        score = np.concatenate([self.score[touched].ravel(), score])
        id = np.concatenate([self.id[touched].ravel(), id])
        at = np.lexsort((id, ~score, slot))  # ~x falls as x grows, and has no overflow
        slot, score, id = slot[at], score[at], id[at]
        first = np.searchsorted(slot, touched)
        place = np.arange(len(slot)) - np.repeat(first, np.diff(np.append(first, len(slot))))
        kept = place < k
        self.score[touched], self.id[touched] = score[kept].reshape(-1, k), id[kept].reshape(-1, k)


def _vectors(batch: pa.RecordBatch, at: int, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Quantised vectors of a batch by length: places of the rows, and their whole numbers."""
    column = batch.column(at)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        yield rows, np.floor(scale * flat).astype(np.int64).reshape(len(rows), length)


def _search(rows: DataFrame, anchors: DataFrame, k: int, slots: int, same: bool, primes: list[int], scale: int) -> DataFrame:
    """(anchor, slot, id, score): for each anchor and slot the first k rows of the same, or of another, label with low <= score <= high.

    ``rows`` has (id, label, vector); ``anchors`` has (share, anchor, id, label, vector, low, high), the last two with one value per slot. Every task keeps the best of its
    rows and hands them on once; what is handed on is merged by a window over each slot.
    """

    def best_of(anchors_of, batches):
        table = anchors_of().sort_by("label").combine_chunks()
        blocks = []
        for batch in table.to_batches(max_chunksize=ANCHORS):
            number, own, label = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "id", "label"))
            low, high = (np.array(batch.column(c).to_pylist(), np.int64).reshape(-1, slots) for c in ("low", "high"))
            for at, vectors in _vectors(batch, batch.schema.get_field_index("vector"), scale):
                blocks.append((number[at], own[at], label[at], low[at], high[at], [residues(vectors, p) for p in primes], vectors.shape[1], Best(len(at) * slots, k)))
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                id, label = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                for at, vectors in _vectors(part, 2, scale):
                    by_label = np.argsort(label[at])
                    ids, labels = id[at[by_label]], label[at[by_label]]
                    b = [residues(vectors[by_label], p) for p in primes]
                    for block in blocks:
                        if block[6] == vectors.shape[1]:
                            _meet(block, ids, labels, b, same)
        for number, *_, best in blocks:
            slot, place = np.nonzero(best.score > LOWEST)
            columns = [number[slot // slots], (slot % slots).astype(np.int32), best.id[slot, place], best.score[slot, place]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "slot", "id", "score"])

    def _meet(block, ids, labels, b, same):
        _, own, label, low, high, a, _, best = block
        spans = [(slice(None), slice(None))]
        if same:  # both sides are sorted by label, so equal labels are rectangles
            spans = [
                (slice(*np.searchsorted(label, [x, x + 1])), slice(*np.searchsorted(labels, [x, x + 1])))
                for x in np.intersect1d(label, labels)
            ]
        for left, right in spans:
            s = scores([m[left] for m in a], [m[right] for m in b], primes)
            able = own[left, None] != ids[None, right]
            if not same:
                able &= label[left, None] != labels[None, right]
            first = np.arange(len(label))[left]
            for j in range(slots):
                line, at = np.nonzero(able & (s >= np.maximum(low[left, j], best.score[first * slots + j, -1])[:, None]) & (s <= high[left, j, None]))
                best.add(first[line] * slots + j, s[line, at], ids[right][at])

    found = None
    for share in range(1 + (anchors.agg(F.max("share")).first()[0] or 0)):
        sent = send(rows, anchors.where(F.col("share") == share).drop("share").toArrow())
        part = rows.mapInArrow(lambda batches, sent=sent: best_of(sent, batches), "anchor long, slot int, id long, score long")
        part = cut_lineage(part)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    embeddings: DataFrame, anchor: Column, id: str = "vec_id", vector: str = "embedding", label: str | Column = "label",
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, anchor_bytes: int = ANCHOR_BYTES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where ``anchor`` holds.

    Components are quantised to floor(scale x). The score of two rows is the inner product of their whole numbers, exact. An anchor's positives are the ``positives``
    other rows of its label with the highest scores; for each of them, the ``negatives`` rows of other labels with the highest scores between ``low`` and
    ``high`` hundredths of the positive's score are returned. Ties go to smaller ids.

    Anchors are a query set against all rows: they are dealt by hash into shares of about ``anchor_bytes``, and each share meets every row where that
    row lies, without a shuffle of vectors. A task holds one block of scores, and the best rows of each anchor so far.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part. Only vectors of equal length have a score. Another row is one with another id. Rows repeated under one id count
    as often as they occur; an anchor that repeats in all three columns counts once, one that repeats by its id alone
    has results for each of its vectors. Equal vectors, however many, are ties. An empty table, or one without anchors, gives an empty one. Other columns are not read.
    Vectors so large that a score could pass 63 bits are an error.
    """
    label = F.col(label) if isinstance(label, str) else label
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.col(id).isNotNull() & label.isNotNull() & F.col(vector).isNotNull() & finite
    rows = embeddings.where(whole).select(F.col(id).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector"), F.coalesce(anchor, F.lit(False)).alias("_anchor"))
    largest = F.array_max(F.transform("vector", F.abs))
    top, width, n = rows.agg(F.max(largest), F.max(F.size("vector")), F.count_if("_anchor")).first()
    bound = int(width or 0) * int(scale * (top or 0.0) + 1) ** 2
    if bound >= 1 << 62:
        raise ValueError(f"scores of vectors of {width} components up to {top} do not fit 63 bits")
    primes = primes_for(bound)
    shares = max(1, -(-(n or 0) * 8 * (width or 1) // anchor_bytes))
    chosen = rows.where("_anchor").select("id", "label", "vector").distinct()
    share = F.pmod(F.xxhash64("id", "label", "vector"), F.lit(shares)).alias("share")
    chosen = cut_lineage(chosen.select(F.monotonically_increasing_id().alias("anchor"), share, "id", "label", "vector"))
    rows = rows.drop("_anchor")
    edge = lambda value, slots: F.array_repeat(F.lit(value).cast("long"), slots)
    near = _search(rows, chosen.withColumns({"low": edge(LOWEST + 1, 1), "high": edge(-LOWEST - 1, 1)}), positives, 1, True, primes, scale)
    near = cut_lineage(near.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    # 50 p <= 100 n <= 95 p in whole numbers; decimals hold the products.
    wide = F.col("positive_score").cast("decimal(38,0)")
    limits = near.select("anchor", "slot", F.ceil(wide * low / 100).cast("long").alias("l"), F.floor(wide * high / 100).cast("long").alias("h"))
    pairs = limits.groupBy("anchor").agg(*[F.map_from_entries(F.collect_list(F.struct("slot", c))).alias(c) for c in ("l", "h")])
    # A slot without a positive has an empty window, from 1 to 0.
    slots = F.sequence(F.lit(0), F.lit(positives - 1))

    def edges(found: str, none: int) -> Column:
        return F.transform(slots, lambda j: F.coalesce(F.try_element_at(F.col(found), j), F.lit(none).cast("long")))

    window = pairs.select("anchor", edges("l", 1).alias("low"), edges("h", 0).alias("high"))
    far = _search(rows, chosen.join(window, "anchor"), negatives, positives, False, primes, scale)
    far = far.select("anchor", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = chosen.select("anchor", F.col("id").alias("anchor_id"))
    return near.join(far, ["anchor", "slot"]).join(named, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
