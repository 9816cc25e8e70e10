"""Removal of long word sequences that already stand in an earlier document, found by recompression.

A document is a sequence of words, each named by a hash. Rounds of recompression replace runs and pairs of symbols by new symbols
(Jez, 2016). A symbol's name is a hash of what it replaces, so equal pairs get one name everywhere without a table of names.
Which neighbours pair up depends on their names alone, so two equal passages are cut alike except for a few words at
their ends. Spark groups the symbols that stand out in their surroundings by name: a passage whose symbols
are not shared cannot repeat. Only windows all of whose symbols are shared are compared as whole word sequences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridframe.llm.common import pieces

#: Longest symbols that may still pair up, round by round. Two symbols pair up only if both are within it.
ROUNDS = (1, 1, 2, 2)
#: Words at either end of a passage where the cut may depend on what lies outside: 2 for runs, then one symbol a round.
EDGE = 2 + sum(ROUNDS)
#: Words of the longest symbol.
LONGEST = 2 * max(ROUNDS)
ODD = 0x9E3779B97F4A7C15
#: Bytes of text that a task works on at a time.
SLICE = 3 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def words_of(texts: list[str | None]) -> tuple[list[bytes], np.ndarray]:
    """All words of some texts, and how many each has."""
    words: list[bytes] = []
    counts = []
    for text in texts:
        own = text.encode().split() if text else []
        counts.append(len(own))
        words += own
    return words, np.array(counts, np.int64)


def name_words(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def recompress(names: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, start, length in words) of the symbols after all rounds; symbols stay within a document.

    Two equal words in a row become one symbol. In longer runs every word gets the run's name and pairs up no more, so that
    a run of any length is found by any other. Equal symbols fall on one side of the pairing, so later rounds meet no new runs.
    """
    n = len(names)
    start, length = np.arange(n), np.ones(n, np.int64)
    if not n:
        return names, start, length
    new = np.ones(n, bool)
    new[1:] = (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    size = np.repeat(np.diff(np.append(first, n)), np.diff(np.append(first, n)))
    names = np.where(size == 1, names, mix(names + np.uint64(ODD) * np.minimum(size, 3).astype(np.uint64)))
    length[size == 2] = 2
    fixed = size > 2
    keep = new | (size != 2)
    names, start, length, fixed, doc = names[keep], start[keep], length[keep], fixed[keep], doc[keep]
    for k, most in enumerate(ROUNDS):
        free = ~fixed & (length <= most)
        left = (mix(names + np.uint64(k + 1)) & np.uint64(1)).astype(bool)
        pair = np.flatnonzero(free[:-1] & free[1:] & left[:-1] & ~left[1:] & (doc[1:] == doc[:-1]))
        names, length = names.copy(), length.copy()
        names[pair] = mix(mix(names[pair]) * np.uint64(3) + names[pair + 1])
        length[pair] += length[pair + 1]
        keep = np.ones(len(names), bool)
        keep[pair + 1] = False
        names, start, length, fixed, doc = names[keep], start[keep], length[keep], fixed[keep], doc[keep]
    return names, start, length


class Cut:
    """The words of some documents, their symbols, and the outstanding symbol of each group of neighbours."""

    def __init__(self, texts: list[str | None], window: int):
        inner = window - 2 * EDGE
        self.group = (inner - 2 * (LONGEST - 1)) // LONGEST
        if self.group < 1:
            raise ValueError(f"a window has at least {2 * EDGE + 3 * LONGEST - 2} words")
        self.window = window
        words, self.counts = words_of(texts)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        self.words = name_words(words)
        self.name, self.start, self.length = recompress(self.words, self.doc)
        owner, g = self.doc[self.start], self.group
        n = len(owner) - g + 1
        if n < 1:
            self.begin = self.end = self.best = np.zeros(0, np.int64)
            return
        # The longest symbol of each group, then the one with the largest name.
        weight = (self.length.astype(np.uint64) << np.uint64(58)) | (self.name >> np.uint64(6))
        best = np.lib.stride_tricks.sliding_window_view(weight, g).argmax(axis=1) + np.arange(n)
        whole = (owner[:n] == owner[g - 1 :]) & (self.counts[owner[:n]] >= window)
        self.begin = self.start[:n][whole]
        self.end = (self.start + self.length)[g - 1 :][whole]
        self.best = best[whole]

    def candidates(self, shared: np.ndarray) -> np.ndarray:
        """Starts of windows in whose inner part each group's outstanding symbol is shared. shared: by word position."""
        starts = np.flatnonzero(self.first[1:][self.doc] - np.arange(len(self.doc)) >= self.window)
        unshared = np.concatenate([[0], np.cumsum(~shared[self.start[self.best]])])
        low = np.searchsorted(self.begin, starts + EDGE)
        high = np.searchsorted(self.end, starts + self.window - EDGE, "right")
        return starts[(high > low) & (unshared[high] == unshared[np.minimum(low, high)])]

    def sequences(self, starts: np.ndarray, ends: np.ndarray, kind: int) -> np.ndarray:
        """A hash of the words from each start to its end; two kinds are independent."""
        base = (ODD, 0xC2B2AE3D27D4EB4F)[kind]
        words, n = mix(self.words + np.uint64(kind)), len(self.words)
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base, np.uint64)]), dtype=np.uint64)
        back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, pow(base, -1, 1 << 64), np.uint64)]), dtype=np.uint64)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(words * powers[:n], dtype=np.uint64)])
        return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64)).view(np.int64)

    def stretches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Outstanding symbols in order: index, first word, and the last window start up to the next one in the document.

        The words from the first to the end of that last window are the symbol's stretch; it is empty if the last start lies
        before the first word.
        """
        at = np.unique(self.best)
        place = self.start[at]
        doc = self.doc[place]
        last = self.first[doc + 1] - self.window
        following = np.append(place[1:], np.iinfo(np.int64).max)
        following[:-1][doc[1:] != doc[:-1]] = np.iinfo(np.int64).max
        return at, place, np.minimum(following, last)


def _ranges(places: np.ndarray, cut: Cut) -> tuple[np.ndarray, pa.ListArray]:
    """Documents of sorted places, and for each a list: first place in the document, how many follow each other, and so on."""
    docs = cut.doc[places]
    new = np.ones(len(places), bool)
    new[1:] = (np.diff(places) != 1) | (docs[1:] != docs[:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(places)))
    flat = np.stack([places[at] - cut.first[docs[at]], size], axis=1).reshape(-1)
    return _lists(np.repeat(docs[at], 2), flat)


def _lists(owner: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """values by owner (sorted): the owners, and a list for each."""
    cut = np.flatnonzero(np.diff(owner)) + 1
    first = np.concatenate([[0], cut, [len(owner)]]) if len(owner) else np.zeros(1, np.int64)
    return owner[first[:-1]] if len(owner) else owner, pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, pa.int32()))


#: Rows that go on by key have a place; settled rows have a list and stay with their document.
KEYED = "settled boolean, k1 long, k2 long, d long, r long, place int, list array<int>"


def _going(k1: np.ndarray, k2: np.ndarray, d: np.ndarray, r: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    n = len(k1)
    return pa.RecordBatch.from_arrays([pa.array(np.zeros(n, bool)), pa.array(k1), pa.array(k2), pa.array(d), pa.array(r), pa.array(place.astype(np.int32)), pa.nulls(n, pa.list_(pa.int32()))], NAMES)


def _settled(d: np.ndarray, r: np.ndarray, lists: pa.ListArray) -> pa.RecordBatch:
    n = len(d)
    return pa.RecordBatch.from_arrays([pa.array(np.ones(n, bool)), pa.array(mix(d.view(np.uint64) ^ mix(r.view(np.uint64))).view(np.int64)), pa.array(r), pa.array(d), pa.array(r), pa.nulls(n, pa.int32()), lists], NAMES)


NAMES = [part.split()[0] for part in KEYED.split(", ")]


def _least(groups: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The first value of each group, at every member. groups: where one begins."""
    return values[np.maximum.accumulate(np.where(groups, np.arange(len(values)), 0))]


def _symbols(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Outstanding symbols: k1 is the name, k2 the hash of the stretch (0 without one), place is 4 * word + 2 if the name is known to be shared.

    Of equal stretches in a slice the one of the smallest document goes on by name, for the documents elsewhere; the others are settled.
    So a stretch has about one row per slice, however frequent it is. Entries of settled lists are like places, with 1 added if the
    windows of the stretch are covered.
    """
    for batch in pieces(batches, 2, SLICE):
        r, d = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cut = Cut(batch.column(2).to_pylist(), window)
        at, place, last = cut.stretches()
        if not len(at):
            continue
        has = last >= place
        name = (cut.name[at] >> np.uint64(8)).view(np.int64)
        stretch = np.zeros(len(at), np.int64)
        stretch[has] = cut.sequences(place[has], last[has] + window, 0) | 1
        doc = cut.doc[place]
        order = np.lexsort((d[doc], stretch, name))
        name, stretch, place, doc = name[order], stretch[order], place[order], doc[order]
        named = np.append(True, name[1:] != name[:-1])
        first = np.flatnonzero(named)
        several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
        known = np.repeat(several, np.diff(np.append(first, len(name))))
        later = d[doc] > _least(named | np.append(True, stretch[1:] != stretch[:-1]), d[doc])
        word = (place - cut.first[doc]) * 4
        go = np.flatnonzero(~later)
        yield _going(name[go], stretch[go], d[doc[go]], r[doc[go]], word[go] + 2 * known[go])
        back = np.flatnonzero(later)
        back = back[np.argsort(place[back])]
        docs, lists = _lists(doc[back], word[back] + 2 + (stretch[back] != 0))
        yield _settled(d[docs], r[docs], lists)


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Candidate windows: those of a smaller document in the slice and those of covered stretches are settled, the smallest one's go on."""
    for batch in pieces(batches, 2, SLICE):
        batch = batch.filter(pa.compute.greater(pa.compute.list_value_length(batch.column(3)).fill_null(0), 0))
        if not batch.num_rows:
            continue
        r, d = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cut = Cut(batch.column(2).to_pylist(), window)
        marks = batch.column(3)
        owner = np.repeat(np.arange(len(marks)), pa.compute.list_value_length(marks).to_numpy())
        code = marks.flatten().to_numpy()
        places = cut.first[owner] + code // 4
        shared = np.zeros(len(cut.words) + 1, bool)
        shared[places] = True
        whole = np.zeros(len(cut.words) + 1, bool)
        whole[places[code % 2 == 1]] = True
        _, place, last = cut.stretches()
        steps = np.zeros(len(cut.words) + 2, np.int64)
        np.add.at(steps, place[whole[place]], 1)
        np.add.at(steps, last[whole[place]] + 1, -1)
        done = np.cumsum(steps)[: len(cut.words)] > 0
        starts = cut.candidates(shared)
        starts = starts[~done[starts]]
        k1, k2 = cut.sequences(starts, starts + window, 0), cut.sequences(starts, starts + window, 1) & 0xFFFF
        docs = cut.doc[starts]
        order = np.lexsort((d[docs], k2, k1))
        k1, k2, starts, docs = k1[order], k2[order], starts[order], docs[order]
        new = np.ones(len(k1), bool)
        new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        later = d[docs] > _least(new, d[docs]) if len(k1) else new
        go = np.flatnonzero(~later)
        yield _going(k1[go], k2[go], d[docs[go]], r[docs[go]], (starts - cut.first[docs])[go])
        done[starts[later]] = True
        docs, lists = _ranges(np.flatnonzero(done), cut)
        yield _settled(d[docs], r[docs], lists)


def _remove(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 2, SLICE):
        kept, n_words, n_removed = [], [], []
        for text, starts in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
            words = text.encode().split() if text else []
            gone = 0
            if starts.is_valid and len(starts.values):
                first, many = starts.values.to_numpy().reshape(-1, 2).T
                steps = np.zeros(len(words) + 1, np.int64)
                np.add.at(steps, first, 1)
                np.add.at(steps, first + many - 1 + window, -1)
                stays = np.cumsum(steps[:-1]) == 0
                gone = len(words) - int(stays.sum())
                kept.append(b" ".join([w for w, s in zip(words, stays.tolist(), strict=True) if s]))
            else:
                kept.append(b" ".join(words))
            n_words.append(len(words))
            n_removed.append(gone)
        yield pa.RecordBatch.from_arrays([*batch.columns[4:], batch.column(2), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], [*batch.schema.names[4:], "__text", "kept", "n_words", "n_removed"])


def remove_repeats(documents: DataFrame, id: str = "doc_id", text: str = "text", window: int = 50) -> DataFrame:
    """The input's columns with ``kept`` (kept words joined by one space), ``n_words`` and ``n_removed`` behind them.

    A word goes if it is covered by ``window`` consecutive words of its document which also start in a document with a smaller
    id. Windows are judged on the input. A null text has no words. A null id counts as larger than all others. Rows with the
    same id don't remove from each other, and repeated rows get equal results. Passages repeated within one document
    alone stay. Columns of the input that have one of the three names are replaced. An empty table gives an empty one.
    Window sequences are compared by 80 bits of hashes; rows that share an id, or have none, are told apart by 64 bits of a hash of id and text.
    """
    rest = [c for c in documents.columns if c not in ("kept", "n_words", "n_removed", text)]
    row = F.xxhash64(id, text).alias("__r")
    rows = documents.select(row, F.coalesce(F.col(id).cast("long"), F.lit((1 << 63) - 1)).alias("__d"), F.col(text).alias("__text"), *rest)

    def by_row(found: DataFrame, entries: Column) -> DataFrame:
        return found.groupBy(F.col("r").alias("__r"), F.col("d").alias("__d")).agg(F.flatten(F.collect_list(F.when(F.col("settled"), F.col("list")).otherwise(entries))).alias("__at"))

    # Both joins have the same left side, which is shuffled once: each takes all columns.
    columns = ["__r", "__d", "__text", "__at", *rest]
    symbols = rows.select("__r", "__d", "__text").mapInArrow(lambda batches: _symbols(batches, window), KEYED)
    name, stretch = Window.partitionBy("settled", "k1"), Window.partitionBy("settled", "k1", "k2")
    symbols = symbols.withColumn("covered", (F.col("k2") != 0) & (F.col("d") > F.min("d").over(stretch)))
    symbols = symbols.withColumn("shared", F.min("d").over(name) < F.max("d").over(name)).where("settled OR shared OR place % 4 = 2")
    marked = rows.join(by_row(symbols, F.array(F.col("place") + F.col("covered").cast("int"))), ["__r", "__d"], "left").select(*columns)
    windows = marked.mapInArrow(lambda batches: _windows(batches, window), KEYED)
    windows = windows.withColumn("least", F.min("d").over(stretch)).where("settled OR d > least")
    covered = rows.join(by_row(windows, F.array("place", F.lit(1))), ["__r", "__d"], "left").select(*columns)
    types = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in rest)
    out = covered.mapInArrow(lambda batches: _remove(batches, window), f"{types}, __text string, kept string, n_words long, n_removed long")
    return out.select(*[F.col("__text").alias(text) if c == text else F.col(f"`{c}`") for c in documents.columns if c in (*rest, text)], "kept", "n_words", "n_removed")
