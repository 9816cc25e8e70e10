"""Benchmark passages in documents, by a prefix-filtered set join on word shingles. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridframe.llm.common import lower_ascii, small
from gridframe.session import cut_lineage

#: A word. Digits, letters a-z and everything beyond ASCII belong to words.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text after A-Z become a-z; none for null."""
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def shingles(names: str, length: int) -> Column:
    """Hash of the ``length`` words that start at each place, given an array column of word hashes; empty if there are fewer."""
    parts = ", ".join(f"{names}[i + {k}]" for k in range(length))
    return F.expr(f"CASE WHEN size({names}) >= {length} THEN transform(sequence(0, size({names}) - {length}), i -> xxhash64({parts})) ELSE CAST(array() AS array<bigint>) END")


def occurrences(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """One row for each place and shingle length: ``length``, ``place`` (from 0) and ``code`` beside the columns of ``rows``, which have ``names``."""
    if len(lengths) == 1:
        return rows.select("*", F.posexplode(shingles("names", lengths[0])).alias("place", "code")).withColumn("length", F.lit(lengths[0]))

    def placed(n: int) -> Column:
        return F.transform(shingles("names", n), lambda code, i: F.struct(F.lit(n).alias("length"), i.alias("place"), code.alias("code")))

    return rows.select("*", F.explode(F.concat(*map(placed, lengths))).alias("o")).select("*", "o.length", "o.place", "o.code").drop("o")


def contaminated(documents: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10, shingle: int = 5) -> DataFrame:
    """(id, n_words, n_hit, items, contaminated) for each document; items are the sorted ids, as strings, whose windows occur.

    A window is ``window`` consecutive words of an item; an item with fewer words, but not none, is one window. A window is a set of
    shingles (of ``shingle`` words, or of the window's own length if that is less), each with its place. It can only lie in a
    document that has all of them, so the window is looked up by its prefix alone: its rarest shingle, by the number of places
    at which documents have it, ties by place. A find has to fit into the document (length and position) and then has to agree
    with the window word by word; for that, the documents with such a find are read again. Tables of shingles and prefixes
    go to every task if they are small, and are joined by a shuffle of hashes otherwise.

    Null texts have no words; an item without words has no window. Repeated items or rows count once each by id, and repeated
    documents come back as often as they went in; rows with one id but different texts are judged apart. Other columns
    are not read. Either table may be empty.
    """
    rows = documents.select(F.col(id).alias("__id"), F.xxhash64(id, text).alias("__r"), words_of(F.col(text)).alias("words"))
    named = rows.withColumn("names", F.transform("words", lambda w: F.xxhash64(w)))
    items = benchmark.select(F.col(item).cast("string").alias("item"), words_of(F.col(item_text)).alias("all")).where("size(all) > 0")
    first = F.posexplode(F.sequence(F.lit(0), F.greatest(F.size("all") - window, F.lit(0)))).alias("n", "at")
    cut = items.select("item", "all", first).select("item", F.slice("all", F.col("at") + 1, window).alias("window"))
    windows, _ = small(cut.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("size", F.size("window")))

    # Where documents have a shingle of any window. Texts are cut into words once for this; all that follows works on these places.
    lengths = sorted(r[0] for r in windows.select(F.least("size", F.lit(shingle))).distinct().collect())
    if not lengths:
        return rows.select(F.col("__id").alias(id), F.size("words").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"), F.lit(False).alias("contaminated"))
    parts = occurrences(windows.withColumn("names", F.transform("window", lambda w: F.xxhash64(w))), lengths).where(F.col("length") == F.least("size", F.lit(shingle)))
    parts, fits = small(parts.select("window", "items", "size", "length", F.col("place").alias("offset"), "code"))
    wanted = parts.select("length", "code").distinct()
    seen = occurrences(named.select("__r", "names", F.size("names").alias("n_words")), lengths).select("__r", "n_words", "length", "code", "place")
    places = cut_lineage(seen.join(F.broadcast(wanted) if fits else wanted, ["length", "code"], "left_semi"))

    # The rarest shingle of a window, over all documents, is its prefix.
    counts = places.groupBy("length", "code").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "code")
    prefixes, fits = small(parts.join(counts, ["length", "code"], "left").groupBy("window", "items", "size", "length").agg(F.min(order).alias("o")).where("o.n > 0").select("window", "items", "size", "length", "o.offset", "o.code"))
    start = F.col("place") - F.col("offset")
    able = places.join(prefixes, ["length", "code"]).withColumn("start", start).where((F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.col("n_words")))
    able = cut_lineage(able.select("__r", "start", "size", "window", "items").distinct())
    # Only documents with such a place are cut into words again. Copies have one key, and one of them is compared.
    keys, _ = small(able.select("__r").distinct())
    texts = documents.select(F.xxhash64(id, text).alias("__r"), F.col(text).alias("__text")).join(keys, "__r", "left_semi").dropDuplicates(["__r"])
    words = texts.select("__r", words_of(F.col("__text")).alias("words"))
    found = able.join(words, "__r").where(F.slice("words", F.col("start") + 1, F.col("size")) == F.col("window"))
    # A place that is hit by several windows counts once: each start goes on with its longest window.
    hits = found.groupBy("__r").agg(F.collect_set(F.struct(F.col("start").alias("s"), F.col("size").alias("n"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("found"))
    covered = F.expr("size(array_distinct(flatten(transform(spans, x -> sequence(x.s, x.s + x.n - 1)))))")
    joined = rows.select("__id", "__r", F.size("words").cast("long").alias("n_words")).join(hits.select("__r", covered.cast("long").alias("n_hit"), "found"), "__r", "left")
    return joined.select(
        F.col("__id").alias(id), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("found", F.array().cast("array<string>")).alias("items"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
