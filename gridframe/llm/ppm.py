"""Log probability of texts by prediction by partial matching over bytes, and by words.

The byte model is a trie of contexts of up to ORDER bytes with the counts of the bytes that follow. Prediction starts at the longest
context that occurs. A byte not seen there escapes to the next shorter context with the chance of a new byte (method C: the
number of different bytes seen, as if they had been seen once more), where bytes already ruled out are excluded.
Below the empty context all bytes not ruled out are equally likely. The model is trained once, so a byte's chance only depends on
the bytes before it, and each document is scored by itself.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridframe.llm.common import LOWER, pieces
from gridframe.session import cut_lineage

#: Bytes of the longest context.
ORDER = 5
#: Contexts with their byte whose chances go to every task, at most: the most frequent ones. Those of all others are joined.
NODES = 2_000_000
#: Words whose counts go to every task, at most: the most frequent ones. Counts of all others are joined.
COMMON = 200_000
#: Bytes of text that a task works on at a time, and grams or words that it counts before it hands them on.
SLICE, HELD = 512 << 10, 250_000
#: Ends a text, and stands before it as context. No word has this byte.
END = b"\n"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LOWER).split()


def codes(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte of some texts (words joined by one space, then the end): its context and itself as one number; which
    places hold such bytes; and where each text begins."""
    parts = [END * ORDER + b" ".join(words) + END for words in texts]
    a = np.frombuffer(b"".join(parts), np.uint8)
    first = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))])
    out = np.zeros(len(a), np.uint64)
    for back in range(ORDER, -1, -1):
        out <<= np.uint64(8)
        out[back:] |= a[: len(a) - back]
    real = np.ones(len(a), bool)
    for i in range(ORDER):
        real[first[:-1] + i] = False
    return out, real, first


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts in the texts to learn from of contexts with the next byte (``gram``) and of words (``word``, empty: the end), summed up within a task.
    Grams of the other texts come with the count 0."""
    keys, counts, words = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], Counter()

    def merged() -> tuple[np.ndarray, np.ndarray]:
        at, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        return at, np.bincount(inverse, weights=np.concatenate(counts)).astype(np.int64)

    def rows() -> Iterator[pa.RecordBatch]:
        at, n = merged()
        yield pa.RecordBatch.from_arrays([pa.array(at.view(np.int64)), pa.nulls(len(at), pa.binary()), pa.array(n)], ["gram", "word", "n"])
        yield pa.RecordBatch.from_arrays([pa.nulls(len(words), pa.int64()), pa.array(words.keys(), pa.binary()), pa.array(words.values(), pa.int64())], ["gram", "word", "n"])

    for batch in pieces(batches, 0, SLICE):
        parts: tuple[list, list] = [], []
        for t, learn in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parts[learn].append(words_of(t))
        for learn, texts in enumerate(parts):
            if not texts:
                continue
            code, real, _ = codes(texts)
            at, n = np.unique(code[real], return_counts=True)
            keys.append(at)
            counts.append(n * learn)
            if learn:
                words.update(chain.from_iterable(texts))
                words[b""] += len(texts)
        if sum(map(len, keys)) > HELD or len(words) > HELD:
            keys[:], counts[:] = zip(merged(), strict=True)
            if len(keys[0]) > HELD // 2 or len(words) > HELD:
                yield from rows()
                keys[:], counts[:] = [keys[0][:0]], [counts[0][:0]]
                words.clear()
    yield from rows()


#: The chance of a gram by its contexts from the longest on, those that don't occur having no total. A context with
#: ``kinds`` bytes leaves ``rest`` of the next shorter one, once its own bytes are excluded, of which ``fresh`` new bytes' share.
FOLD = """aggregate(sort_array(collect_list(struct(length, n, total, kinds, rest, fresh)), false),
  named_struct('log', 0D, 'rest', -1D, 'fresh', 0D, 'done', false),
  (s, x) -> CASE WHEN s.done OR x.total IS NULL THEN s
    WHEN x.n IS NOT NULL THEN named_struct('log', s.log + ln(x.n) - ln(IF(s.rest < 0, x.total + x.kinds, s.rest)), 'rest', s.rest, 'fresh', s.fresh, 'done', true)
    ELSE named_struct('log', s.log + CASE WHEN s.rest < 0 THEN ln(x.kinds) - ln(x.total + x.kinds) WHEN s.fresh > 0 THEN ln(s.fresh) - ln(s.rest) ELSE 0D END,
      'rest', greatest(x.rest, 1D), 'fresh', x.fresh, 'done', false) END)"""


def chances(grams: DataFrame) -> DataFrame:
    """(gram, n, log): natural log of the chance of each gram's byte after its context, by the whole trie of the grams with n > 0.

    All of the trie stays a table: entries per context length, grouped to contexts. A gram that was learned needs its longest
    context only; the others are few, and meet their contexts of every length. Contexts of up to one byte, 257 at most, are sent.
    """
    lengths = F.explode(F.array(*[F.struct(F.lit(k).alias("length"), F.lit((1 << 8 * (k + 1)) - 1).cast("long").alias("mask")) for k in range(ORDER + 1)])).alias("m")
    entries = grams.where("n > 0").select("gram", "n", lengths).groupBy("m.length", F.col("gram").bitwiseAND(F.col("m.mask")).alias("key")).agg(F.sum("n").alias("n"))
    entries = cut_lineage(entries)
    shorter = entries.select((F.col("length") + 1).alias("length"), F.col("key").alias("up"), F.col("n").alias("same"))
    own = entries.withColumn("up", F.expr("key & (shiftleft(1L, 8 * length) - 1)")).join(shorter, ["length", "up"], "left")
    own = own.groupBy("length", F.shiftright("key", 8).alias("context")).agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"), F.sum("same").alias("same"), F.map_from_entries(F.collect_list(F.struct(F.expr("key & 255L"), "n"))).alias("next")
    )
    own = cut_lineage(own)
    above = own.select((F.col("length") + 1).alias("length"), F.col("context").alias("up"), F.col("total").alias("up_total"), F.col("kinds").alias("up_kinds"))
    contexts = own.withColumn("up", F.expr("IF(length = 0, 0L, context & (shiftleft(1L, 8 * (length - 1)) - 1))")).join(above, ["length", "up"], "left")
    fresh = F.col("up_kinds") - F.col("kinds")
    contexts = contexts.select(
        "length", "context", "next", F.col("total").cast("double"), F.col("kinds").cast("double"),
        F.coalesce(F.col("up_total") - F.col("same") + fresh, F.lit(0)).cast("double").alias("rest"), F.coalesce(fresh, F.lit(0)).cast("double").alias("fresh"),
    )
    longest = own.where(F.col("length") == ORDER).select("context", F.ln(F.col("total") + F.col("kinds")).alias("whole"))
    learned = grams.where("n > 0").withColumn("context", F.shiftright("gram", 8)).join(longest, "context").select("gram", "n", (F.ln("n") - F.col("whole")).alias("log"))
    seen = own.where("length = 0").select("kinds").first()
    steps = grams.where("n = 0").select("gram", lengths).select("gram", "m.length", F.col("gram").bitwiseAND(F.col("m.mask")).alias("key"))
    steps = steps.select("gram", "length", F.shiftright("key", 8).alias("context"), F.expr("key & 255L").alias("byte"))
    near = steps.where("length < 2").join(F.broadcast(contexts.where("length < 2")), ["length", "context"], "left")
    far = steps.where("length >= 2").join(contexts.where("length >= 2"), ["length", "context"], "left")
    met = near.unionByName(far).withColumn("n", F.expr("try_element_at(next, byte)").cast("double"))
    new = float(np.log(max(256 - (seen[0] if seen else 0), 1)))
    other = met.groupBy("gram").agg(F.expr(FOLD).alias("s")).select("gram", F.lit(0).cast("long").alias("n"), F.when(F.col("s.done"), F.col("s.log")).otherwise(F.col("s.log") - new).alias("log"))
    return cut_lineage(learned.unionByName(other))


def _level(n: Column) -> Column:
    """Counts by eighths of powers of two: a few hundred levels whatever the table."""
    return F.floor(F.log2(n) * 8).cast("int")


def _floor(levels: list[tuple[int, int]], most: int) -> int:
    """The lowest level so that at most ``most`` rows lie at or above it."""
    kept, floor = 0, 1 << 20
    for level, n in sorted(levels, reverse=True):
        kept += n
        if kept > most:
            break
        floor = level
    return floor


def score(documents: DataFrame, learn: Column, id: str = "doc_id", text: str = "text", order: int = ORDER, nodes: int = NODES, common: int = COMMON) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) for each row; learned from the rows where ``learn`` holds.

    Texts are lower-cased (A-Z) and cut into words; each text ends with one more token. ``base_score`` adds log10((c + 1) / (N + V + 1)) over
    the tokens, with counts c, N and V of all training tokens; ``score`` is the byte model's log10 probability of the words joined by one space and
    the end. All training texts are counted. Chances of the ``nodes`` most frequent contexts with their byte and counts of the ``common`` most
    frequent words are sent to the tasks, all others are joined, so both scores are exact.
    A null text is empty: its only token is the end. Without training rows every byte has the chance 1/256, N and V are 0. Repeated rows come
    back as often as they went in, with equal scores. Rows are told apart by id and text; a null id is allowed. An empty
    table gives an empty one. Other columns are not read.
    """
    if order != ORDER:
        raise ValueError(f"contexts have {ORDER} bytes")
    counted = documents.select(text, F.coalesce(learn, F.lit(False)).alias("learn")).mapInArrow(_grams, "gram long, word binary, n long")
    counted = cut_lineage(counted.groupBy("gram", "word").agg(F.sum("n").alias("n")))
    words = counted.where("word IS NOT NULL").select("word", "n")
    distinct, total = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    unit = np.log10(total + distinct + 1)
    floor = _floor([tuple(r) for r in words.groupBy(_level(F.col("n"))).count().collect()], common)
    most = words.where(_level(F.col("n")) >= floor).toArrow()
    frequent = dict(zip(most.column(0).to_pylist(), most.column(1).to_pylist(), strict=True))
    del most

    grams = chances(counted.where("gram IS NOT NULL").select("gram", "n"))
    levels = grams.groupBy(_level(F.col("n") + 1)).count().collect()
    floor = _floor([tuple(r) for r in levels], nodes)
    kept = grams.where(_level(F.col("n") + 1) >= floor).select("gram", "log").toArrow()
    key, log = (kept.column(i).to_numpy() for i in range(2))
    at = np.argsort(key)
    missing = len(key) < sum(r[1] for r in levels)
    sent = documents.sparkSession.sparkContext.broadcast((key[at].view(np.uint64), log[at], list(frequent), np.array(list(frequent.values()), float)))
    del kept, key, log, at

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, log, frequent, table = sent.value
        table = np.log10(table + 1) - unit if frequent else np.zeros(1)
        get = {w: i for i, w in enumerate(frequent)}.get
        for batch in pieces(batches, 2, SLICE):
            texts = [words_of(t) for t in batch.column(2).to_pylist()]
            code, real, first = codes(texts)
            grams, at = np.unique(code, return_inverse=True)
            place = np.minimum(np.searchsorted(key, grams), max(len(key) - 1, 0))
            met = key[place] == grams if len(key) else np.zeros(len(grams), bool)
            logs = np.where(real & met[at], (log[place] if len(key) else np.zeros(len(grams)))[at], 0.0)
            totals = np.add.reduceat(logs, first[:-1]) / np.log(10) if len(texts) else logs
            unmet: list[dict[bytes, int]] = [{} for _ in texts]
            where = np.flatnonzero(real & ~met[at])
            for i, g in zip((np.searchsorted(first, where, "right") - 1).tolist(), grams[at[where]].tolist(), strict=True):
                gram = END + g.to_bytes(ORDER + 1, "big")
                unmet[i][gram] = unmet[i].get(gram, 0) + 1
            known, base, others, sizes = [], [], [], []
            for words, more in zip(texts, unmet, strict=True):
                words = [*words, b""]
                found = list(map(get, words))
                seen = [i for i in found if i is not None]
                known.append(len(seen))
                base.append(float(table[seen].sum()) if seen else 0.0)
                rare = Counter(w for w, i in zip(words, found, strict=True) if i is None) if len(seen) < len(words) else {}
                others.append({**rare, **more})
                sizes.append(len(others[-1]))
            yield _tall(batch, known, base, [len(w) + 1 for w in texts], totals, others, sizes)

    rows = documents.select(F.col(id).alias("id"), F.xxhash64(id, text).alias("r"), F.col(text)).mapInArrow(scored, "id long, r long, word binary, n long, n_tokens long, n_known long, base double, score double")
    lookup = words.select("word", F.col("n").alias("c"), F.lit(None).cast("double").alias("log")) if len(frequent) < distinct else None
    if missing:  # grams go by their bytes behind an end, which no word has
        rare = grams.where(_level(F.col("n") + 1) < floor)
        rare = rare.select(F.concat(F.lit(END), F.unhex(F.lpad(F.hex("gram"), 2 * ORDER + 2, "0"))).alias("word"), F.lit(None).cast("long").alias("c"), "log")
        lookup = rare if lookup is None else lookup.unionByName(rare)
    rows = rows.join(lookup, "word", "left") if lookup is not None else rows.select("*", F.lit(None).cast("long").alias("c"), F.lit(None).cast("double").alias("log"))
    own = F.col("n_tokens").isNull() & F.col("log").isNull()
    sums = rows.groupBy("id", "r").agg(
        F.count("n_tokens").alias("times"), F.max("n_tokens").alias("n_tokens"), F.max("score").alias("score"),
        F.sum(F.coalesce(F.col("n") * F.col("log") / float(np.log(10)), F.lit(0.0))).alias("joined"),
        F.sum(F.coalesce("n_known", F.when(F.col("c").isNotNull(), F.col("n")), F.lit(0))).alias("n_known"),
        F.sum(F.coalesce("base", F.when(own, F.col("n") * (F.log10(F.coalesce("c", F.lit(0)) + 1) - F.lit(float(unit)))), F.lit(0.0))).alias("base"),
    )
    sums = sums.withColumn("copy", F.explode(F.expr("array_repeat(0, CAST(times AS INT))")))
    return sums.select(
        F.col("id").alias(id), "n_tokens", (F.col("n_known") / F.col("times")).cast("long").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("times")).alias("base_score"), (F.col("score") + F.col("joined") / F.col("times")).alias("score"),
    )


def _tall(batch: pa.RecordBatch, known: list, base: list, n_tokens: list, totals: np.ndarray, others: list, sizes: list) -> pa.RecordBatch:
    """One row per document with what is known of it, under a word of its own that no text has; one for each of its rarer words and grams."""
    n, rare = batch.num_rows, sum(sizes)
    at = pa.array(np.concatenate([np.arange(n), np.repeat(np.arange(n), sizes)]))
    own = [b" %d" % r for r in batch.column(1).to_pylist()]
    tail = lambda values, kind: pa.concat_arrays([pa.array(values, kind), pa.nulls(rare, kind)])
    return pa.RecordBatch.from_arrays(
        [
            batch.column(0).take(at), batch.column(1).take(at), pa.array([*own, *chain.from_iterable(others)], pa.binary()),
            pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(list(chain.from_iterable(x.values() for x in others)), pa.int64())]),
            tail(n_tokens, pa.int64()), tail(known, pa.int64()), tail(base, pa.float64()), tail(totals, pa.float64()),
        ],
        ["id", "r", "word", "n", "n_tokens", "n_known", "base", "score"],
    )
