"""Rows without an id, ids of several rows, vectors of several lengths: nothing is lost, and nothing is gathered that is not bounded."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from gridframe.llm import common, embeddings, langid, simhash, substrings, toxicity


def test_rows_without_an_id_link_others(spark, monkeypatch):
    from collections.abc import Iterator

    import pyarrow as pa

    codes = {"a": 0x00, "b": 0x0F, "c": 0xFF, "d": 0xFFFF0000}

    def given(documents, id="doc_id", text="text", shingle=4):
        return documents.select(F.col(id).cast("long").alias("id"), F.element_at(F.create_map(*[F.lit(x) for p in codes.items() for x in p]), F.col(text)).cast("long").alias("fp"))

    monkeypatch.setattr(simhash, "fingerprints", given)
    rows = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c"), (None, "d"), (None, "d")], "doc_id long, text string")
    found = sorted(((r.doc_id, r.fingerprint[-8:], r.component_id) for r in simhash.near_duplicates(rows).collect()), key=repr)
    assert found == sorted([(1, "00000000", 1), (None, "0000000f", 1), (3, "000000ff", 1), (None, "ffff0000", None), (None, "ffff0000", None)], key=repr)


def test_many_rows_without_an_id_keep_their_words(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    many = 12_000
    rows = spark.range(2 * many).select(
        F.lit(None).cast("long").alias("doc_id"),
        F.when(F.col("id") < many, F.concat(F.lit(passage + " "), F.col("id").cast("string"))).otherwise(
            F.array_join(F.transform(F.sequence(F.lit(0), F.lit(54)), lambda i: F.concat(F.lit("u"), F.col("id").cast("string"), F.lit("x"), i.cast("string"))), " ")
        ).alias("text"),
    ).unionByName(spark.createDataFrame([(5, passage)], "doc_id long, text string"))
    done = substrings.remove_repeats(rows).select("doc_id", F.substring("text", 1, 1).alias("kind"), "n_removed")
    assert {(r.doc_id, r.kind, r.n_removed): r["count"] for r in done.groupBy("doc_id", "kind", "n_removed").count().collect()} == {(None, "p", 60): many, (None, "u", 0): many, (5, "p", 0): 1}


def test_draws_are_of_distinct_rows(spark):
    rows = spark.createDataFrame([(1, "a")] * 500 + [(i, "b") for i in range(50)], "id long, text string").repartition(4)
    got = common.drawn(rows, F.xxhash64("id", "text"), 20).collect()
    assert len(got) == 20 == len(set(map(tuple, got)))
    assert common.drawn(rows, F.xxhash64("id", "text"), 1000).count() == 51
    assert common.drawn(rows.where("id < 0"), F.xxhash64("id", "text"), 5).count() == 0


def test_small_tables_are_small_in_bytes(spark, monkeypatch):
    rows = spark.range(10).select(F.repeat(F.lit("x"), 1000).alias("s"))
    assert common.small(rows)[1]
    monkeypatch.setattr(common, "BROADCAST_BYTES", 5000)
    assert not common.small(rows)[1]


def test_languages_of_rows_without_an_id(spark):
    draw = random.Random(2)
    say = lambda letters: " ".join("".join(draw.choice(letters) for _ in range(5)) for _ in range(20))
    rows = [(None, say("abcdef"), "aa") for _ in range(30)] + [(None, say("uvwxyz"), "zz") for _ in range(30)] + [(None, "abc", "aa")] * 200
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df, F.lit(True), fit_rows=40)
    assert model.languages == ["aa", "zz"]
    found = langid.identify(df, model).groupBy("lang", "lang_pred").count().collect()
    assert {(r.lang, r.lang_pred) for r in found} == {("aa", "aa"), ("zz", "zz")}


def test_toxic_rows_of_one_id(spark):
    draw = random.Random(3)
    say = lambda words: " ".join(draw.choice(words) for _ in range(30))
    rows = [(i, say(["bad", "worse", "worst"] if i % 2 else ["fine", "good", "well"])) for i in range(100)] + [(1, say(["bad", "worse"])) for _ in range(50)] + [(None, "good")] * 20
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(df, labels, F.lit(True), fit_rows=60)
    scored = toxicity.score(df, model).where("doc_id IS NOT NULL").select("doc_id", "score").collect()
    assert all((r.score > 0.5) == (r.doc_id % 2 == 1) for r in scored)


def linked(rows, least=0.9):
    """Brute force: (links, component) of rows of (id, vector)."""
    def unit(v):
        if v is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        a = np.array(v) / np.abs(v).max()
        return a / np.sqrt(a @ a)

    units = [(i, unit(v)) for i, v in rows]
    near = [[j for j, (_, b) in enumerate(units) if j != k and a is not None and b is not None and len(a) == len(b) and a @ b >= least] for k, (_, a) in enumerate(units)]
    least_of = [i for i, _ in rows]
    for _ in rows:
        least_of = [min([least_of[k], *[least_of[j] for j in near[k]]]) for k in range(len(rows))]
    return sorted((i, len(near[k]), least_of[k], least_of[k] == i) for k, (i, _) in enumerate(rows))


def test_vectors_of_several_lengths(spark):
    draw = np.random.default_rng(4)
    rows = [(i, [float(x) for x in draw.normal(size=4)]) for i in range(9)]
    rows += [(20, [1.0, 0.0, 0.0]), (21, [2.0, 0.0, 0.0]), (22, [1.0, 0.01, 0.0]), (23, [0.0, 1.0, 0.0]), (30, [2.0]), (31, [5.0]), (32, [-5.0]), (40, []), (41, None), (42, [0.0, 0.0])]
    base = draw.normal(size=(6, 40))
    rows += [(100 + 10 * k + j, (base[k] + 0.15 * draw.normal(size=40)).tolist()) for k in range(6) for j in range(8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert sorted(map(tuple, embeddings.near_duplicates(df).collect())) == linked(rows)
    # A length that the sample lacks is found by rotations drawn at random.
    assert sorted(map(tuple, embeddings.near_duplicates(df, fit_rows=3).collect())) == linked(rows)


def test_tables_grow_with_the_rows():
    assert embeddings.table_sizes(50_000, 64) == (12, 5)
    bits, turns = embeddings.table_sizes(10**9, 64)
    assert bits == 24 and turns * (64 // bits) >= math.log(0.02) / math.log(1 - 0.856**24)


def test_the_pipeline_keeps_every_unique_text(spark):
    import corpus_pipeline as p

    draw = random.Random(1)
    text = lambda: " ".join(f"w{draw.randrange(10**6)}" for _ in range(60))
    same, other = text(), text()
    rows = [(None, text()), (None, text()), (None, same), (7, same), (8, same), (9, text()), (9, other), (9, other), (10, other)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(p.STAGES)
    kept = sorted(((r.doc_id, r.text) for r in stages["near_copies"](spark, df, "").collect()), key=repr)
    assert kept == sorted([rows[0], rows[1], (7, same), rows[5], (9, other)], key=repr)


def test_benchmark_stage_tells_rows_apart_by_text(spark, tmp_path):
    import corpus_pipeline as p

    passage = "one two three four five six seven eight nine ten eleven"
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"x {passage} y"), (None, "clean"), (3, passage), (3, "clean too"), (4, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = dict(p.STAGES)["benchmark_passages"](spark, df, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted([(None, "clean"), (3, "clean too"), (4, None)], key=repr)
