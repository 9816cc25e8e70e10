"""From raw documents to token counts: language, near copies, repeated passages, benchmark passages, tokens.

Each stage takes (session, documents, folder of the tables) and returns a DataFrame; all but the last return the columns of
``documents``. A stage works on what its predecessor kept. ``run`` writes every stage to the folder that the
cluster names in ``spark.checkpoint.dir`` and goes on from there.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridframe.llm import bpe, decontam, langid, simhash, substrings
from gridframe.llm.common import share, small
from gridframe.session import configure, cut_lineage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document stays if its most probable language has at least this calibrated probability.
SURE = 0.35

#: Learned languages and tokens have no form in SQL.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters, and those whose language is not clear. The model learns from the documents themselves."""
    model = langid.train(docs, share("doc_id", 5) != 0)
    return langid.identify(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= SURE)).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: that with the smallest id, one without an id only if none has one.

    Rows are told apart by id and text, so rows without an id, and different texts under one id, are documents of their own; rows that agree in both are
    one.
    """
    row = F.xxhash64("doc_id", "text").alias("row")
    found, roots = simhash.grouped(docs.select(row, "text"), id="row")
    known = docs.select(row, "doc_id").distinct()
    order = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "row")
    first = found.distinct().join(roots, "fp").withColumnRenamed("id", "row").join(known, "row").groupBy("root").agg(F.min(order).alias("first"))
    kept = cut_lineage(first.select("first.row"))
    return docs.withColumn("row", row).dropDuplicates(["row"]).join(kept, "row", "left_semi").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words and more that an earlier document has. A text without such passages stays as it is; one that is
    nothing but such passages goes."""
    cut = substrings.remove_repeats(docs.select(*COLUMNS))
    changed = F.col("n_removed") > 0
    kept = cut.where("n_removed = 0 OR n_removed < n_words")
    text = F.when(changed, F.col("kept")).otherwise(F.col("text"))
    return kept.select("doc_id", text.alias("text"), "lang", "source", F.when(changed, F.length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark, told apart by id and text."""
    row = F.xxhash64("doc_id", "text")
    keyed = docs.select(row.alias("row"), "text")
    found = decontam.contaminated(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id="row")
    hit, _ = small(found.where("contaminated").select("row").distinct())
    return docs.withColumn("row", row).join(hit, "row", "left_anti").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the tokens and of the decoded text."""
    coded = bpe.encode_decode(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return bpe.digests(coded).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def configured(stage):
    """The stage with the session settings that the memory of its tasks depends on."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(configure(spark), docs, sf_dir)

    return run_stage


STAGES = [(stage.__name__, configured(stage)) for stage in (language, near_copies, repeated_passages, benchmark_passages, tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
