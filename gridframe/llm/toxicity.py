"""Toxicity of a text, by logistic regression over hashed word n-grams and skip-grams, fitted with FTRL-proximal."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridframe.llm.common import drawn, pieces, send
from gridframe.llm.ftrl import Ftrl
from gridframe.llm.substrings import mix

#: Labelled rows that the weights are fitted on, at most: those with the smallest hashes of their ids.
FIT_ROWS = 12_000
#: Words whose hash a task remembers before it starts afresh.
MEMORY = 500_000


class Features:
    """Sorted distinct features of a text: words, pairs of neighbours, and pairs with one word between them, hashed to 31 bits."""

    def __init__(self):
        import regex
        from xxhash import xxh64_intdigest

        self.find, self.hash = regex.compile(r"\w+").findall, xxh64_intdigest
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = self.find((text or "").lower())
        known = self.known
        for w in {w for w in words if w not in known}:
            known[w] = self.hash(w.encode("utf-8", "surrogatepass"))
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if len(known) > MEMORY:
            known.clear()
        pairs = [h, h[:-1] * np.uint64(3) + h[1:], h[:-2] * np.uint64(5) + h[2:] * np.uint64(7)]
        return np.unique((mix(np.concatenate(pairs)) >> np.uint64(33)).astype(np.int32))


@dataclass
class Model:
    """The features whose weight is not zero, sorted, with their weights; the bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, found: np.ndarray) -> float:
        total = self.bias
        if len(self.features) and len(found):
            # Both are sorted: look the shorter up in the longer.
            a, b = (self.features, found) if len(self.features) < len(found) else (found, self.features)
            at = np.searchsorted(b, a)
            hit = b[np.minimum(at, len(b) - 1)] == a
            total += float(self.weights[np.flatnonzero(hit) if b is found else at[hit]].sum())
        return float(1 / (1 + np.exp(-np.clip(total, -500, 500))))


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features = Features()
    for batch in pieces(batches, 1):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["label", "found"])


def train(documents: DataFrame, labels: DataFrame, learn: Column, id: str = "doc_id", text: str = "text", label: str = "toxic", fit_rows: int = FIT_ROWS, alpha: float = 2.0, l1: float = 10.0, l2: float = 0.1, epochs: int = 6, least: int = 3) -> Model:
    """Model from the labelled documents among those where ``learn``, a condition on the id, holds.

    Labels that are null or lack a document don't count; an id with both labels counts as 1. At most ``fit_rows`` ids, and of their distinct texts as many, are used: those with the smallest hashes. Features that
    occur in fewer than ``least`` of their texts are left out. Without labels every score is one half.
    """
    known = labels.where(learn & F.col(label).isNotNull() & F.col(id).isNotNull()).groupBy(F.col(id).alias("chosen")).agg(F.max(F.col(label).cast("int")).alias("label"))
    chosen = known.orderBy(F.xxhash64("chosen"), "chosen").limit(fit_rows)
    met = documents.join(F.broadcast(chosen), F.col(id) == F.col("chosen")).select("label", F.col(text).alias("text"), F.col(id).alias("id"))
    sample = drawn(met, F.xxhash64("id", "text"), fit_rows).select("label", "text")
    rows = sample.mapInArrow(_gather, "label int, found binary").toArrow()
    if not rows.num_rows:
        return Model(np.zeros(0, np.int32), np.zeros(0), 0.0)
    # The order of the rows must not depend on how tasks ended.
    rows = sorted(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True))
    texts = [np.frombuffer(found, np.int32) for _, found in rows]
    target = np.array([[float(label)] for label, _ in rows])
    names, counts = np.unique(np.concatenate(texts), return_counts=True)
    names = names[counts >= least]
    ones = np.ones(max(map(len, texts)), np.float32)
    vectors = []
    for i, found in enumerate(texts):
        at = np.searchsorted(names, found).astype(np.int32)
        at = at[names[np.minimum(at, len(names) - 1)] == found] if len(names) else at[:0]
        vectors.append((at, ones[: len(at)]))
        texts[i] = rows[i] = None  # the raw features of a row are needed no more
    learner = Ftrl(len(names), 1, alpha, l1, l2)
    learner.fit(vectors, target, epochs)
    weights = learner.weights()[:, 0]
    kept = np.flatnonzero(weights[:-1])
    return Model(names[kept], weights[kept], float(weights[-1]))


def score(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The input's columns with ``score`` behind them: the chance, 0 to 1, that the label is 1.

    Whole texts are read, each row by itself. A null or empty text has no features and gets the score of the bias. Repeated rows
    get equal scores. A column of the input named ``score`` is replaced. An empty table gives an empty one.
    """
    kept = [c for c in documents.columns if c != "score"]
    out = documents.select(*kept)
    at = kept.index(text)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    sent = send(documents, model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, model = Features(), sent()
        for batch in pieces(batches, at):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([model.score(features(t)) for t in batch.column(at).to_pylist()], pa.float64())], [*kept, "score"])

    return out.mapInArrow(predict, f"{types}, score double")
