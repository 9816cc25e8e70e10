"""Helpers that several operators share."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridframe.session import cut_lineage

#: Rows up to which a table is sent to every task. Such tables are counted first; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Bytes of such a table, written as JSON.
BROADCAST_BYTES = 64 << 20

#: Bytes A-Z to a-z, all others as they are.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def share(column: str, parts: int) -> Column:
    """crc32 of an id written as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % parts


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, all other characters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(batches: Iterable[pa.RecordBatch], text: int = 1, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``most`` bytes of text, so that a task's memory doesn't depend on Spark's batch size."""
    for batch in batches:
        lengths = pa.compute.binary_length(batch.column(text)).fill_null(0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(lengths):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def whole_groups(batches: Iterable[pa.RecordBatch], key: int = 0) -> Iterator[pa.Table]:
    """Tables that hold whole groups, of batches that are sorted by one column. Holds one group and one batch at a time."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        if not table.num_rows:
            continue
        keys = table.column(key).combine_chunks().to_numpy(zero_copy_only=False)
        first = int((keys == keys[-1]).argmax())
        if first:
            yield table.slice(0, first).combine_chunks()
        rest = table.slice(first)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


def drawn(rows: DataFrame, key: Column, most: int) -> DataFrame:
    """At most ``most`` distinct rows, those with the smallest keys, a hash of all that tells rows apart. Repeated rows count once, so neither
    they nor repeated ids make the draw larger; only keys are sorted."""
    hashed = rows.withColumn("__key", key)
    chosen = hashed.select("__key").distinct().orderBy("__key").limit(most)
    return hashed.join(F.broadcast(chosen), "__key", "left_semi").dropDuplicates(["__key"]).drop("__key")


def small(df: DataFrame) -> tuple[DataFrame, bool]:
    """The table, computed once, and whether it is of a size, in rows and in bytes, to send to every task."""
    df = cut_lineage(df)
    fits = df.count() <= BROADCAST_ROWS and (df.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] or 0) <= BROADCAST_BYTES
    return (F.broadcast(df) if fits else df), fits


def send(df: DataFrame, thing: Any) -> Callable[[], Any]:
    """Broadcasts an object with the code of its class; the result, called in a task, gives it back."""
    sent = df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(thing))
    return lambda: pickle.loads(sent.value)
