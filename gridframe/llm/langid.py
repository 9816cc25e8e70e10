"""Language of a text, by sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridframe.llm.common import drawn, pieces, send
from gridframe.llm.ftrl import Ftrl, chances

#: Buckets of hashed n-grams, and their longest length.
BUCKETS = 1 << 15
LONGEST = 3
#: Labelled rows that the weights are fitted on, at most: those with the smallest hashes of their ids.
FIT_ROWS = 6000


def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str | None, is_letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the text's n-grams and their counts. Small letters; everything else becomes one space. None without letters."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kept = np.where(is_letter[codes], codes, 32).astype(np.uint64)
    kept = np.concatenate([[np.uint64(32)], kept, [np.uint64(32)]])
    same = np.ones(len(kept), bool)
    same[1:] = (kept[1:] != 32) | (kept[:-1] != 32)
    kept = kept[same]
    if len(kept) < 2:
        return np.zeros(0, np.int64), np.zeros(0)
    found, code = [], np.zeros(len(kept), np.uint64)
    for n in range(1, LONGEST + 1):
        code = (code[: len(kept) - n + 1] << np.uint64(21)) | kept[n - 1 :]
        found.append((code * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(49))
    counts = np.bincount(np.concatenate(found).astype(np.int64), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at].astype(float)


@dataclass
class Model:
    """Languages in order, weights (bucket or bias by language), inverse document frequencies and the temperature."""

    languages: list[str]
    weights: np.ndarray
    idf: np.ndarray
    temperature: float

    def vector(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = counts / counts.sum() * self.idf[at]
        return x / np.sqrt((x * x).sum())

    def predict(self, text: str | None, is_letter: np.ndarray) -> tuple[str, float]:
        at, counts = grams(text, is_letter)
        if not len(at) or not self.languages:
            return "und", 0.0
        if len(self.languages) == 1:
            return self.languages[0], 1.0
        p = chances((self.vector(at, counts) @ self.weights[at] + self.weights[-1]) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per slice: in how many texts a bucket occurs; bucket -1 counts the texts."""
    is_letter = letters()
    for batch in pieces(batches, 0):
        seen = np.zeros(BUCKETS, np.int64)
        for text in batch.column(0).to_pylist():
            seen[grams(text, is_letter)[0]] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[at], batch.num_rows))], ["bucket", "n"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    is_letter = letters()
    for batch in pieces(batches, 1):
        rows = [grams(t, is_letter) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a.astype(np.int32).tobytes() for a, _ in rows], pa.binary()), pa.array([c.astype(np.float32).tobytes() for _, c in rows], pa.binary())], ["lang", "at", "counts"])


def train(documents: DataFrame, learn: Column, id: str = "doc_id", text: str = "text", lang: str = "lang", fit_rows: int = FIT_ROWS, alpha: float = 0.5, l1: float = 0.02, l2: float = 0.01, epochs: int = 4) -> Model:
    """Model from the rows where ``learn`` holds and ``lang`` is not null.

    Document frequencies are counted over all such rows. The weights are fitted on at most ``fit_rows`` distinct rows, those with the smallest hashes; every fifth of
    these serves to set the temperature at which the predicted probabilities have the least log loss; as one more row of any
    language might come, that loss is smoothed, so a model without errors does not become certain.
    """
    labelled = documents.where(learn & F.col(lang).isNotNull())
    counted = labelled.select(F.col(text)).mapInArrow(_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect()
    seen = np.zeros(BUCKETS + 1)
    for bucket, n in counted:
        seen[bucket] = n
    idf = np.log((1 + seen[-1]) / (1 + seen[:-1])) + 1
    known = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.col(id).alias("id"))
    sample = drawn(known, F.xxhash64("id", "lang", "text"), fit_rows).select("lang", "text")
    rows = sorted(map(tuple, sample.mapInArrow(_features, "lang string, at binary, counts binary").collect()))
    rows = [(name, np.frombuffer(at, np.int32), np.frombuffer(counts, np.float32).astype(float)) for name, at, counts in rows if at]
    languages = sorted({name for name, _, _ in rows})
    model = Model(languages, np.zeros((BUCKETS + 1, len(languages))), idf, 1.0)
    if len(languages) < 2:
        return model
    vectors = [(at, model.vector(at, counts)) for _, at, counts in rows]
    number = {name: i for i, name in enumerate(languages)}
    target = np.array([number[name] for name, _, _ in rows])
    order = np.random.default_rng(3).permutation(len(rows))
    held, fit = order[::5], np.array([i for k, i in enumerate(order) if k % 5])
    learner = Ftrl(BUCKETS, len(languages), alpha, l1, l2)
    learner.fit([vectors[i] for i in fit], np.eye(len(languages))[target[fit]], epochs)
    model.weights = learner.weights()
    logits = np.array([x @ model.weights[at] + model.weights[-1] for at, x in (vectors[i] for i in held)])
    steps = np.exp(np.linspace(np.log(0.05), np.log(5), 93))
    wish = (np.eye(len(languages))[target[held]] * len(held) + 1 / len(languages)) / (len(held) + 1)
    loss = [-(wish * np.log(np.maximum(chances(logits / t), 1e-300))).sum(axis=1).mean() for t in steps]
    model.temperature = float(steps[int(np.argmin(loss))])
    return model


def identify(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The input's columns with ``lang_pred`` and ``score`` (the calibrated probability of that language) behind them.

    Whole texts are read, each row by itself. A null text and one without letters get ``und`` and score 0, and so do all rows if nothing
    could be learned; ties go to the first language in order. Repeated rows get equal results. Columns of the input with
    one of the two names are replaced. An empty table gives an empty one.
    """
    kept = [c for c in documents.columns if c not in ("lang_pred", "score")]
    out = documents.select(*kept)
    at = kept.index(text)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    sent = send(documents, model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_letter, model = letters(), sent()
        for batch in pieces(batches, at):
            found = [model.predict(t, is_letter) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], [*kept, "lang_pred", "score"])

    return out.mapInArrow(predict, f"{types}, lang_pred string, score double")
