"""Documents drawn so that they resemble a target: importance resampling on hashed word runs, hashed by prefix CRCs.

Each document is normalised to words, each with one space before it, and scanned once; the running CRC-32 after each word is kept. The
CRC of any run of words follows from two of them: crc(ab) = shift(crc(a), |b|) ^ crc(b), where shift multiplies by
x^(8|b|) modulo the CRC polynomial over GF(2). So runs of every length cost the same and no run is ever put together.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridframe.llm.common import pieces, send
from gridframe.operators.numbering import numbered
from gridframe.session import cut_lineage

#: Bytes of text that a task works on at a time, and bytes of one text that are cut into words at a time.
SLICE, PART = 2 << 20, 1 << 20
#: Bytes of a text to bytes of its normalised form: A-Z to a-z, everything in ASCII but letters and digits to a space.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def _times(rows: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map of 32-bit values, given by the images of its bits, on an array of values."""
    bits = (crc[:, None] >> np.arange(32, dtype=np.uint32)) & np.uint32(1)
    return np.bitwise_xor.reduce(np.where(bits == 1, rows[None], np.uint32(0)), axis=1)


@cache
def _tables(power: int) -> np.ndarray:
    """The shift by 2**power zero bytes, as four tables of 256 values, one for each byte of a CRC."""
    if power == 0:
        step = np.array([zlib.crc32(b"\0", 1 << i) ^ zlib.crc32(b"\0") for i in range(32)], np.uint32)
    else:
        half = _tables(power - 1)
        bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
        step = _apply(half, _apply(half, bits))
    values = np.arange(256, dtype=np.uint32)
    return np.stack([_times(step, values << np.uint32(8 * k)) for k in range(4)])


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    low = np.uint32(0xFF)
    return tables[0][crc & low] ^ tables[1][crc >> np.uint32(8) & low] ^ tables[2][crc >> np.uint32(16) & low] ^ tables[3][crc >> np.uint32(24)]


def shift(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The share of a CRC in that of a text which goes on for ``length`` more bytes."""
    out = crc.copy()
    for power in range(int(length.max(initial=0)).bit_length()):
        at = np.flatnonzero(length >> power & 1)
        out[at] = _apply(_tables(power), out[at])
    return out


def scan(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Running CRCs and lengths after each word of one text."""
    crcs, ends, crc, end, at = [], [], 0, 0, 0
    normal = text.translate(NORMAL)
    while at < len(normal):
        stop = normal.find(b" ", at + PART)
        stop = len(normal) if stop < 0 else stop
        words = [b" " + w for w in normal[at:stop].split()]
        at = stop
        if words:
            crcs.append(np.fromiter(accumulate(words, lambda c, w: zlib.crc32(w, c), initial=crc), np.uint32, len(words) + 1)[1:])
            ends.append(end + np.cumsum(np.fromiter(map(len, words), np.int64, len(words))))
            crc, end = int(crcs[-1][-1]), int(ends[-1][-1])
    return (np.concatenate(crcs), np.concatenate(ends)) if crcs else (np.zeros(0, np.uint32), np.zeros(0, np.int64))


def runs(texts: list[bytes | None], shortest: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each run length: the CRC of every run of that many words, and the number of the text it lies in."""
    scans = [scan(t or b"") for t in texts]
    sizes = np.fromiter((len(c) for c, _ in scans), np.int64, len(scans))
    owner = np.repeat(np.arange(len(scans)), sizes)
    if not len(owner):
        return
    crc, end = np.concatenate([c for c, _ in scans]), np.concatenate([e for _, e in scans])
    first = np.concatenate([[True], owner[1:] != owner[:-1]])
    begin = np.where(first, 0, np.roll(end, 1)) + 1
    before = np.where(first, np.uint32(0), np.roll(crc, 1))
    before = shift(before, np.ones(len(before), np.int64)) ^ np.uint32(zlib.crc32(b" "))
    for n in range(shortest, longest + 1):
        whole = np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1 :])
        yield crc[whole + n - 1] ^ shift(before[whole], end[whole + n - 1] - begin[whole]), owner[whole]


def bucket_counts(documents: DataFrame, text: str = "text", shortest: int = 1, longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """(bucket, n): how many word runs of all texts fall into each bucket; summed up within a task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in pieces(batches, 0, SLICE):
            for crc, _ in runs(batch.column(0).to_pylist(), shortest, longest):
                total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array(total[hit])], ["bucket", "n"])

    return documents.select(F.col(text).cast("binary").alias("text")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) for each bucket, from counts s and t with sums S and T."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for counts, df in ((s, source), (t, target)):
        found = df.toArrow()
        counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weights(documents: DataFrame, gain: np.ndarray, id: str = "doc_id", text: str = "text", shortest: int = 1, longest: int = 1) -> DataFrame:
    """(id, n_words, n_features, weight) for each row: the floored mean of the gains of a text's word runs, 0 without any."""
    sent = send(documents, gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent()
        for batch in pieces(batches, 1, SLICE):
            texts = batch.column(1).to_pylist()
            n, total, words = (np.zeros(len(texts), np.int64) for _ in range(3))
            for length, (crc, owner) in enumerate(runs(texts, 1, longest), 1):
                found = np.bincount(owner, minlength=len(texts))
                words = found if length == 1 else words
                if length >= shortest:
                    n += found
                    # Sums of up to 2**53 / 10**5 gains are exact in doubles.
                    total += np.bincount(owner, gain[crc % np.uint32(len(gain))], len(texts)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(n), pa.array(total // np.maximum(n, 1))], ["id", "n_words", "n_features", "weight"])

    kind = dict(documents.dtypes)[id]
    rows = documents.select(F.col(id).alias("id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(weigh, f"id {kind}, n_words long, n_features long, weight long").withColumnRenamed("id", id)


def noise(id: Column, seed: str) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of the SHA-256 of ``seed:id``."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(
    documents: DataFrame, target: DataFrame, id: str = "doc_id", text: str = "text", target_text: str = "text",
    shortest: int = 1, longest: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: str = "2024",
) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) for each row of ``documents``; drawn rows have a rank, the others none.

    Features are runs of ``shortest`` to ``longest`` words, hashed into ``buckets``. A row's weight is the floored mean of its features' gains, its score the
    weight plus Gumbel noise that depends on the id alone. Of the N rows with ``least_words`` words or more, the floor(percent N / 100) highest scores are drawn, ties to
    smaller ids. Counts are of all rows of both tables. What goes to the driver and to every task is one number per bucket. Ranks come from a range sort of
    ids and scores; no task sees them all.

    A null or empty text, or one without words, has no features and the weight 0. Repeated rows count as often as they occur; those with
    equal scores and ids are ranked in any order among them. A null id counts as the empty text for noise and comes last in ties. Other columns are not
    read. An empty ``documents`` gives an empty table; an empty ``target`` gives all buckets their share of T = 0.
    """
    sizes = {"shortest": shortest, "longest": longest, "buckets": buckets}
    gain = gains(bucket_counts(documents, text, **sizes), bucket_counts(target, target_text, **sizes), buckets)
    scored = weights(documents, gain, id, text, shortest, longest).withColumn("score", F.col("weight") + noise(F.col(id), seed))
    scored = cut_lineage(scored)
    able = F.col("n_words") >= least_words
    drawn = scored.where(able).count() * percent // 100
    spread = F.monotonically_increasing_id()  # splits large groups of rows that are alike; only their order among them is free
    placed = numbered(scored.where(able).withColumn("_spread", spread), [F.col("score").desc(), F.col(id).asc_nulls_last(), "_spread"]).drop("_spread")
    ranked = placed.withColumn("rank", F.when(F.col("position") < drawn, F.col("position") + 1)).drop("position")
    return ranked.unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")))
