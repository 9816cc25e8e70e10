"""Hard negatives, resampling and archives: against brute force, and with nulls, ties, repeated rows, empty tables and clashing names."""

import base64
import gzip
import hashlib
import json
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridframe.llm import negatives, resample, warc
from gridframe.operators.numbering import numbered

VECTORS = "vec_id long, embedding array<double>, label int, score double, anchor string"


# --- hard negatives --------------------------------------------------------------------------------

@pytest.mark.parametrize("largest,width", [(1, 3), (256, 64), (100_000, 130), (2**26, 200)])
def test_scores_are_exact(largest, width):
    draw = np.random.default_rng(largest)
    a, b = (draw.integers(-largest, largest + 1, (9, width)) for _ in range(2))
    a[0], b[0], b[1] = largest, largest, -largest
    primes = negatives.primes_for(width * largest**2)
    assert len(set(primes)) == len(primes) and math.prod(primes) > 2 * width * largest**2
    got = negatives.scores([negatives.residues(a, p) for p in primes], [negatives.residues(b, p) for p in primes], primes)
    assert (got.astype(object) == a.astype(object) @ b.astype(object).T).all()


def mined(rows, positives=5, negatives_=3, low=50, high=95):
    """Brute force: rows of (id, vector, label), anchors where id is divisible by 4."""
    rows = [
        (i, [math.floor(256 * x) for x in v], label) for i, v, label in rows
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for i, v, label in {(i, tuple(v), label) for i, v, label in rows if i % 4 == 0}:
        scored = sorted(((-sum(x * y for x, y in zip(v, w)), j, other) for j, w, other in rows if j != i and len(w) == len(v)))
        for s, j, _ in [x for x in scored if x[2] == label][:positives]:
            inside = [x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s]
            out += [(i, j, rank, k, -s, -n) for rank, (n, k, _) in enumerate(inside[:negatives_], 1)]
    return sorted(out)


def some_vectors(n=160, width=6, seed=4):
    draw = random.Random(seed)
    rows = [(i, [round(draw.uniform(-1, 1), 3) + (i % 3 == 0) * 0.5 for _ in range(width)], draw.randrange(3)) for i in range(n)]
    rows += [(i, [0.5] * width, i % 2) for i in range(n, n + 40)]  # ties
    rows += [(3, rows[3][1], rows[3][2]), (8, [0.1] * width, 0), (300, [0.25, 0.5], 0), (301, [0.25, 0.4], 1), (303, [0.3, 0.4], 0), (304, [0.3, 0.4], 0)]
    rows += [(None, [1.0] * width, 0), (400, None, 0), (404, [1.0] * width, None), (408, [1.0, None] * 3, 0), (412, [math.nan] * width, 1), (416, [math.inf] * width, 1), (420, [], 1), (421, [], 1), (422, [], 2)]
    return rows


@pytest.mark.parametrize("share", [16 << 20, 400])
def test_hard_negatives(spark, share):
    rows = some_vectors()
    df = spark.createDataFrame([(*r, 0.0, "x") for r in rows], VECTORS).repartition(5)
    found = negatives.hard_negatives(df, F.col("vec_id") % 4 == 0, anchor_bytes=share)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, found.collect())) == mined(rows)


def test_hard_negatives_of_large_components_and_empty_tables(spark):
    draw = random.Random(1)
    rows = [(i, [draw.uniform(-1e5, 1e5) for _ in range(70)], i % 2) for i in range(40)]
    df = spark.createDataFrame([(*r, 0.0, "x") for r in rows], VECTORS)
    found = negatives.hard_negatives(df, F.col("vec_id") % 4 == 0)
    assert sorted(map(tuple, found.collect())) == mined(rows)
    assert negatives.hard_negatives(df.where("vec_id < 0"), F.lit(True)).count() == 0
    assert negatives.hard_negatives(df, F.lit(None).cast("boolean")).count() == 0
    with pytest.raises(ValueError, match="63 bits"):
        negatives.hard_negatives(df.withColumn("embedding", F.array(F.lit(1e30))), F.lit(True))


# --- resampling --------------------------------------------------------------------------------------

def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def drawn(documents, target, shortest=1, longest=1, buckets=10_000, percent=10, least=20):
    def features(text):
        w = words_of(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(shortest, longest + 1) for i in range(len(w) - n + 1)]

    s = Counter(f for _, text in documents for f in features(text))
    t = Counter(f for text in target for f in features(text))
    gain = [math.floor(1000 * math.log((t[k] + 1) * (t_s + buckets) / ((s[k] + 1) * (t_t + buckets)))) for t_s, t_t in [(s.total(), t.total())] for k in range(buckets)]
    out = []
    for i, text in documents:
        f = features(text)
        weight = sum(gain[k] for k in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words_of(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[5] = rank
    return sorted(map(tuple, out), key=repr)


DRAW = random.Random(7)
NAMES = ["alpha", "Beta", "GAMMA", "straße", "日本語", "x1", "É", "ǅ", "delta"]
DOCUMENTS = [(i, DRAW.choice([" ", ", ", "\n"]).join(DRAW.choice(NAMES) + DRAW.choice(["", "7", "ing"]) for _ in range(DRAW.randrange(60)))) for i in range(120)]
DOCUMENTS += [(900, None), (901, ""), (902, " .,;- \t"), (903, "word " * 30_000), (None, "alpha beta " * 20), (None, "alpha beta " * 20), (5, "gamma " * 25), (5, "gamma " * 25), (904, "w" * 3_000_000 + " end")]
TARGET = ["alpha ing", "Delta7 beta GAMMA", None, "", "日本語 straße"]


@pytest.mark.parametrize("shortest,longest,buckets", [(1, 1, 10_000), (1, 3, 97), (2, 2, 1000)])
def test_resample(spark, shortest, longest, buckets):
    docs = spark.createDataFrame([(*r, "a", 1.0, 2) for r in DOCUMENTS], "doc_id long, text string, bucket string, score double, rank int").repartition(4)
    target = spark.createDataFrame([(t, "b") for t in TARGET], "text string, bucket string")
    got = resample.resample(docs, target, shortest=shortest, longest=longest, buckets=buckets)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    want = drawn(DOCUMENTS, TARGET, shortest, longest, buckets)
    rows = sorted(map(tuple, got.collect()), key=repr)
    alike = lambda rows: sorted((r[:5] for r in rows), key=repr)
    assert alike(rows) == alike(want)
    assert sorted(r[5] for r in rows if r[5]) == sorted(r[5] for r in want if r[5])
    assert {r[5]: r[4] for r in rows if r[5]} == {r[5]: r[4] for r in want if r[5]}


def test_resample_of_empty_tables(spark):
    docs = spark.createDataFrame(DOCUMENTS[:50], "doc_id long, text string")
    none = docs.where("doc_id < 0")
    assert resample.resample(none, docs).count() == 0
    got = sorted(map(tuple, resample.resample(docs, none).collect()), key=repr)
    assert got == drawn(DOCUMENTS[:50], [])


def test_crc_of_runs_from_prefixes():
    draw = random.Random(3)
    texts = [" ".join("".join(draw.choice("abcé9") for _ in range(draw.randrange(1, 300))) for _ in range(draw.randrange(0, 40))).encode() for _ in range(20)]
    for n, (crc, owner) in enumerate(resample.runs(texts, 1, 5), 1):
        want = [(k, zlib.crc32(b" ".join(w[i : i + n]))) for k, t in enumerate(texts) for w in [t.split()] for i in range(len(w) - n + 1)]
        assert list(zip(owner.tolist(), crc.tolist())) == want


def test_numbers_of_many_equal_rows(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("k"), "id").repartition(7)
    got = numbered(df, [F.col("k").desc(), "id"]).collect()
    assert sorted(r.position for r in got) == list(range(5000))
    assert all(r.position == (0 if r.k else 2500) + r.id // 2 for r in got)
    assert numbered(df.where("id < 0"), ["id"]).count() == 0


# --- archives ------------------------------------------------------------------------------------------

LONG = "<p>" + "long text " * 200
PAGES = [(i, f"http://h{i % 3}/{i}", f"<p>{i}</p>" * (i % 9 * 40)) for i in range(60)]
PAGES += [(100, "http://a/ b\r\nX: y", LONG), (101, None, LONG), (102, "http://é/日", LONG), (102, "http://b", LONG), (103, "u", "short"), (104, "u", "short"), (105, None, None), (106, "u", "")]
PAGES += [(None, "n1", "x" * 2000), (None, "n2", "x" * 2000), (None, "n3", LONG), (107, "u", "é" * 499 + "a"), (108, "u", "é" * 499 + "a"), (109, "u", "é" * 500), (110, "u", "é" * 500)]
PAGES += [(200, "same", "y" * 1500)] * 3


def as_records(pages, least=1000):
    groups = defaultdict(list)
    for i, _, html in pages:
        groups[html or ""].append(i)
    out, met = [], set()
    for i, _, html in sorted(pages, key=lambda p: (p[0] is not None, p[0] or 0, p[1] or "")):
        data = (html or "").encode()
        known = [x for x in groups[html or ""] if x is not None]
        last = max(known) if known else None
        again = len(groups[html or ""]) > 1 and len(data) >= least and (i != last or (i, html) in met)
        met.add((i, html))
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", last if again else None))
    return sorted(out, key=repr)


def table(spark, pages, parts=3):
    return spark.createDataFrame([(*p, "c", b"z", 1) for p in pages], "page_id long, url string, html string, digest string, payload binary, shard int").repartition(parts)


def test_archives_hold_all_records(spark, tmp_path):
    folder = f"file:{tmp_path}/a"
    manifest = warc.write_warc(table(spark, PAGES), folder, shard_bytes=4000, roll_bytes=3000)
    got = warc.read_warc(spark, folder)
    rows = got.collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=repr) == as_records(PAGES)
    assert {r.payload.decode() for r in rows if r.record_type == "response"} == {p[2] or "" for p in PAGES}
    assert sum(r.records for r in manifest.collect()) == len(PAGES) and manifest.count() > 20
    assert not [f for f in os.listdir(tmp_path / "a") if not f.startswith("part-") and f != warc.MANIFEST]
    for r in manifest.collect():
        data = (tmp_path / "a" / r.file).read_bytes()
        assert len(data) == r.bytes and hashlib.sha256(data).hexdigest() == r.sha256
    with pytest.raises(ValueError, match="already"):
        warc.write_warc(table(spark, PAGES), folder)


def test_archives_are_the_same_however_rows_lie(spark, tmp_path):
    found = []
    for parts in (1, 6):
        warc.write_warc(table(spark, PAGES, parts), f"file://{tmp_path}/{parts}", shard_bytes=3000)
        found.append({f: (tmp_path / str(parts) / f).read_bytes() for f in os.listdir(tmp_path / str(parts))})
    assert found[0] == found[1] and len(found[0]) > 5


def test_records_follow_the_format(spark, tmp_path):
    warc.write_warc(table(spark, PAGES), f"file:{tmp_path}/f")
    names = [json.loads(line)["file"] for line in (tmp_path / "f" / warc.MANIFEST).read_text().splitlines()]
    assert names == sorted(names)
    ids, referred = set(), set()
    for name in names:
        data = gzip.decompress((tmp_path / "f" / name).read_bytes())
        while data:
            head, rest = data.split(b"\r\n\r\n", 1)
            first, *lines = head.decode().split("\r\n")
            fields = dict(line.split(": ", 1) for line in lines)
            block, end = rest[: int(fields["Content-Length"])], rest[int(fields["Content-Length"]) :]
            assert first == "WARC/1.1" and end.startswith(b"\r\n\r\n")
            assert fields["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
            assert fields["WARC-Record-ID"] not in ids
            ids.add(fields["WARC-Record-ID"])
            referred |= {fields["WARC-Refers-To"]} if "WARC-Refers-To" in fields else set()
            data = end[4:]
    assert referred and referred <= ids


def test_damaged_and_empty_archives(spark, tmp_path):
    assert warc.write_warc(table(spark, PAGES).where("page_id < 0"), f"file:{tmp_path}/none").count() == 0
    assert warc.read_warc(spark, f"file:{tmp_path}/none").count() == 0
    warc.write_warc(table(spark, PAGES[:5]), f"file:{tmp_path}/bad")
    file = next((tmp_path / "bad").glob("part-*"))
    file.write_bytes(file.read_bytes()[:-40])
    with pytest.raises(Exception, match="ends inside a record"):
        warc.read_warc(spark, f"file:{tmp_path}/bad").collect()


def test_a_task_that_runs_twice_leaves_one_copy(spark, tmp_path, monkeypatch):
    """Files of tasks whose results did not count are not moved, and go with the temporary folder."""
    whole = warc.cut_lineage

    def twice(df):
        if "temporary" in df.columns:
            df.count()
        return whole(df)

    monkeypatch.setattr(warc, "cut_lineage", twice)
    warc.write_warc(table(spark, PAGES), f"file:{tmp_path}/t", shard_bytes=4000)
    assert warc.read_warc(spark, f"file:{tmp_path}/t").count() == len(PAGES)
    assert sorted(os.listdir(tmp_path / "t"))[0] == warc.MANIFEST
