"""Each operator on small tables: against brute force, and with nulls, empty and long texts, ties, repeated rows and clashing names."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridframe.llm import bpe, decontam, embeddings, graph, langid, licenses, ppm, simhash, substrings, toxicity, wrappers

TOKENS = public_tokenizers.path("byte_bpe_50k.json")
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def texts(seed=1, n=40):
    """Random texts with shared passages, copies, runs and periods; nulls and empties."""
    draw = random.Random(seed)
    passage = [draw.choice(WORDS) + str(draw.randrange(99)) for _ in range(90)]
    out = []
    for i in range(n):
        words = [draw.choice(WORDS) + str(draw.randrange(30)) for _ in range(draw.randrange(5, 200))]
        if i % 3 == 0:
            at, s = draw.randrange(len(words)), draw.randrange(30)
            words[at:at] = passage[s : s + draw.randrange(45, 60)]
        out.append(" ".join(words))
    out += [out[3], out[3], out[6] + " more", "a " * 130 + "b", "c " + "a " * 90, "x y " * 60, "q x y " + "x y " * 45, "", "  \n", None, "one two"]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 0, 1.5) for i, t in enumerate(texts())] + [(None, texts()[3], "en", "s", 0, 1.5), (5, "other " * 60, "en", "s", 0, 1.5), (5, "other " * 60, "en", "s", 0, 1.5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double").repartition(3)


def gone(rows, window=50):
    return sorted(gone_rows(rows, window), key=repr)


def gone_rows(rows, window=50):
    """Brute force of substring removal: (id, text) to kept words, in the order of the rows."""
    rows = [(math.inf if i is None else i, (t or "").split()) for i, t in rows]
    least = {}
    for i, w in rows:
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            least[key] = min(least.get(key, math.inf), i)
    out = []
    for i, w in rows:
        hit = set()
        for p in range(len(w) - window + 1):
            if least[tuple(w[p : p + window])] < i:
                hit.update(range(p, p + window))
        out.append((None if i == math.inf else i, len(w), len(hit), " ".join(x for k, x in enumerate(w) if k not in hit)))
    return out


def test_substrings(docs):
    want = gone([(r.doc_id, r.text) for r in docs.collect()])
    got = substrings.remove_repeats(docs.withColumn("kept", F.lit(1)))
    assert got.columns == [*docs.columns, "kept", "n_words", "n_removed"]
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()), key=repr) == want
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


def test_recompression_is_consistent_inside_equal_passages():
    draw = np.random.default_rng(2)
    for _ in range(200):
        common = draw.integers(0, draw.integers(2, 30), 60).astype(np.uint64)
        found = []
        for _ in range(2):
            head, tail = draw.integers(0, 30, draw.integers(0, 20)).astype(np.uint64), draw.integers(0, 30, 15).astype(np.uint64)
            name, start, length = substrings.recompress(np.concatenate([head, common, tail]), np.zeros(len(head) + 75, np.int64))
            start = start - len(head)
            inner = (start >= substrings.EDGE) & (start + length <= 60 - substrings.EDGE)
            found.append(list(zip(name[inner], start[inner], length[inner], strict=True)))
        assert found[0] == found[1] and found[0]
        assert max(length) <= substrings.LONGEST


def test_simhash(docs):
    rows = docs.select("doc_id", "text").collect()
    fp = {t: simhash.fingerprint(t) for _, t in rows}
    near = lambda a, b: bin(fp[a] ^ fp[b]).count("1") <= 4
    group = {i: i for i, _ in rows if i is not None}
    changed = True
    while changed:
        changed = False
        for i, t in rows:
            for j, u in rows:
                if i is not None and j is not None and near(t, u) and group[j] < group[i]:
                    group[i], changed = group[j], True
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert all(r.component_id == group[r.doc_id] for r in got if r.doc_id is not None)
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((i, f"{fp[t]:016x}") for i, t in rows)
    assert fp[None] == fp[""] == 0
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_deletion_variants_find_all_links(spark):
    draw = random.Random(4)
    base = [draw.getrandbits(64) for _ in range(30)]
    known = sorted({b ^ sum(1 << k for k in draw.sample(range(64), draw.randrange(6))) for b in base for _ in range(12)})
    nodes = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(known)], "id long, fp long")
    pairs = [(i, j) for i in range(len(known)) for j in range(i) if bin(known[i] ^ known[j]).count("1") <= 4]
    roots = graph.Roots(len(known))
    for i, j in pairs:
        roots.join(i, j)
    want = {i: roots.find(i) for p in pairs for i in p}
    assert {r.node: r.component for r in graph.components(simhash.links(nodes)).collect()} == want


def test_hot_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    known = sorted({(1 << a) | (1 << b) for a in range(64) for b in range(a)})[:400]
    nodes = spark.createDataFrame(list(enumerate(known)), "id long, fp long")
    assert {r.component for r in graph.components(simhash.links(nodes)).collect()} == {0}


def test_components_of_a_chain_and_no_links(spark):
    chain = spark.range(300).selectExpr("id AS a", "id + 1 AS b")
    assert {r.component for r in graph.components(chain).collect()} == {0}
    assert graph.components(chain.limit(0)).count() == 0


def test_bpe(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENS)
    extra = ["<|endoftext|>a <|endoftext|>", "aaaa" * 9, "é\u0085 \u001c　x\n\n  y", "it's we'll 12 ½ !!", "🙂" * 5, "\u0000 b"]
    table = docs.select("doc_id", "text", F.lit(1).alias("ids")).unionByName(docs.sparkSession.createDataFrame([(900 + i, t, 1) for i, t in enumerate(extra)], "doc_id long, text string, ids int"))
    got = bpe.digests(bpe.encode_decode(table, TOKENS)).collect()
    assert len(got) == docs.count() + len(extra)
    for r in got:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == library.decode(ids, skip_special_tokens=False) == (r.text or "")
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_automaton_on_random_bytes():
    from tokenizers import Tokenizer

    library, coder, draw = Tokenizer.from_file(TOKENS), bpe.Coder(bpe.Automaton.read(TOKENS)), random.Random(5)
    for _ in range(1500):
        text = "".join(draw.choice("aeinorst  .,'-=0é") for _ in range(draw.randrange(40)))
        assert coder.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_automaton_on_long_words_and_few_remembered_ones(monkeypatch):
    from tokenizers import Tokenizer

    library, draw = Tokenizer.from_file(TOKENS), random.Random(6)
    monkeypatch.setattr(bpe, "LONG", 30)
    monkeypatch.setattr(bpe, "MEMORY", 10)
    monkeypatch.setattr(bpe, "CELLS", 100)
    coder = bpe.Coder(bpe.Automaton.read(TOKENS))
    texts = ["".join(draw.choice("aeinorst é") for _ in range(draw.randrange(200))) for _ in range(200)] + ["ab" * 500 + "c" * 2000, "x" * 501, ""]
    for at in range(0, len(texts), 40):
        want = [library.encode(t, add_special_tokens=False).ids for t in texts[at : at + 40]]
        assert coder.encode_all(texts[at : at + 40]) == want


def test_decontamination(spark, docs):
    rows = docs.collect()
    long = rows[0].text or "one two"
    items = [(1, " ".join((rows[1].text or "a b").split()[5:30]).upper()), (2, "one TWO"), (3, ""), (4, None), (5, "never seen words here at all"), (2, "one TWO"), (6, " ".join(long.split()[:10]))]
    got = decontam.contaminated(docs, spark.createDataFrame(items, "item_id long, text string"), window=10).collect()
    assert len(got) == len(rows)
    import re

    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    want = []
    for r in rows:
        words, hit, found = cut(r.text), set(), set()
        for i, t in items:
            w = cut(t)
            for s in range(max(1, len(w) - 9) if w else 0):
                part = w[s : s + 10]
                for p in range(len(words) - len(part) + 1):
                    if words[p : p + len(part)] == part:
                        hit.update(range(p, p + len(part)))
                        found.add(str(i))
        want.append((r.doc_id, len(words), len(hit), sorted(found), bool(hit)))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    for a, b in ((docs, spark.createDataFrame([], "item_id long, text string")), (docs.limit(0), spark.createDataFrame(items, "item_id long, text string"))):
        assert not [r for r in decontam.contaminated(a, b).collect() if r.contaminated]


def test_decontamination_by_shuffle(spark, docs, monkeypatch):
    from gridframe.llm import common

    items = spark.createDataFrame([(1, "alpha1 beta2"), (2, "one two")], "item_id long, text string")
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    want = key(decontam.contaminated(docs, items))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert key(decontam.contaminated(docs, items)) == want


def test_licenses(spark):
    rows = [
        (1, "Intro.\nReleased under the MIT License. More text"), (2, None), (3, ""), (4, "x" * 200_000),
        (5, "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License.\nYou may obtain a copy of the License at"),
        (6, "licensed under CC BY-NC 4.0.\nReleased under the MIT license.\nreleased under the mit license!"), (6, "the license of the mit"),
    ]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.rules, r.licenses) for r in got] == [
        (1, "MIT", "MIT"), (2, "", ""), (3, "", ""), (4, "", ""), (5, "Apache-2.0", "Apache-2.0"), (6, "CC-BY-NC-4.0,MIT,MIT", "CC-BY-NC-4.0,MIT"), (6, "", ""),
    ]
    assert got[4].sentence_ids == "apache2-notice,apache2-obey,apache2-copy"


MIT = """MIT License

Copyright (c) 2020 A

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL = """# This program is free software{0} you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
"""
APACHE = """ * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy"""


def test_licenses_as_they_are_written(spark):
    tag = "// SPDX-License-Identifier: {}\nint x;"
    rows = [
        (MIT, "MIT"), (MIT.replace("\n", "\r\n"), "MIT"), (BSD, "BSD-3-Clause"), (GPL.format(":"), "GPL-3.0"), (GPL.format(";"), "GPL-3.0"), (APACHE, "Apache-2.0"), (MPL, "MPL-2.0"),
        (tag.format("MIT"), "MIT"), (tag.format("Apache-2.0"), "Apache-2.0"), (tag.format("GPL-3.0-or-later"), "GPL-3.0"), (tag.format("GPL-2.0-only"), "GPL-2.0"),
        ("SPDX-License-Identifier:\n\nMIT", ""), ("released under\n \nthe MIT license", ""), ("released under\nthe MIT license", "MIT"),
    ]
    got = licenses.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")).collect()
    assert [r.rules for r in sorted(got)] == [want for _, want in rows]


ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE"""
LGPL = """ * This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means."""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:"""


def test_more_licenses(spark):
    rows = [
        (ISC, "ISC"), (ISC.replace(", provided that the above\ncopyright notice and this permission notice appear in all copies", ""), "0BSD"), (LGPL, "LGPL-2.1"), (UNLICENSE, "Unlicense"), (ZLIB, "Zlib"),
        ("// SPDX-License-Identifier: AGPL-3.0-or-later\n", "AGPL-3.0"), ("SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause"), ("SPDX-License-Identifier: CC-BY-NC-SA-4.0", "CC-BY-NC-SA-4.0"),
        ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0"), ("This project is licensed under the Apache License 2.0.", "Apache-2.0"), ("Released under the GPL v3.", "GPL-3.0"),
        ("This work is licensed under the Creative Commons Attribution 4.0 International License.", "CC-BY-4.0"), ("the ISC license of others", ""),
    ]
    got = licenses.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")).collect()
    assert [r.licenses for r in got] == [name for _, name in rows]
    words = [s for some in licenses.SENTENCES.values() for s in some]
    assert len(words) == len(set(words)) and {name for _, ids in licenses.RULES for name in ids} <= set(licenses.SENTENCES)


def test_language(spark):
    draw = random.Random(1)
    parts = {"xx": "ba be bi bo bu".split(), "yy": "ka ke ki ko ku".split(), "zz": "ñá ñé ñí".split()}
    rows = [(i, " ".join("".join(draw.choices(parts[lang], k=3)) for _ in range(draw.randrange(4, 40))), lang, 0.0) for i, lang in enumerate(draw.choices([*parts], k=300))]
    rows += [(1000, None, "xx", 0.0), (1001, "", None, 0.0), (1002, "12 %% 34", "yy", 0.0), (1003, "ba " * 60_000, None, 0.0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = langid.train(table, F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r for r in langid.identify(table, model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang, _ in rows[:300] if i % 5 == 0)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [(got[i].lang_pred, got[i].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3 and got[1003].lang_pred == "xx"
    none = langid.train(table.where("false"), F.lit(True))
    assert {r.lang_pred for r in langid.identify(table, none).collect()} == {"und"}


def test_toxicity(spark):
    draw = random.Random(3)
    rows, labels = [], []
    for i in range(700):
        words, toxic = draw.choices(WORDS, k=draw.randrange(3, 60)), int(i % 5 == 0)
        if toxic:
            words.insert(draw.randrange(len(words)), draw.choice(["Vile!", "rotten"]))
        rows.append((i, " ".join(words), 9.0))
        labels.append((i, toxic))
    rows += [(2000, None, 0.0), (2001, "", 0.0), (2002, "alpha " * 100_000 + "vile", 0.0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, score double")
    known = spark.createDataFrame([*labels, (3000, 1), (5, None), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(table, toxicity.train(table, known, F.col("doc_id") % 3 != 1)).collect()}
    held = [(got[i], t) for i, t in labels if i % 3 == 1]
    assert min(s for s, t in held if t) > 0.7 > max(s for s, t in held if not t)
    assert got[2000] == got[2001] < 0.5 < got[2002]
    nothing = toxicity.score(table, toxicity.train(table, known.where("false"), F.lit(True)))
    assert {r.score for r in nothing.collect()} == {0.5}


@pytest.mark.parametrize("common", [200_000, 3])
def test_ppm(docs, common):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    cut = lambda t: (t or "").lower().split()
    learn = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 != 2
    c, k = Counter(), ppm.ORDER
    trie = defaultdict(Counter)
    for i, t in rows:
        if learn(i):
            c.update([*cut(t), None])
            s = b"\n" * k + " ".join(cut(t)).encode() + b"\n"
            for p in range(k, len(s)):
                for n in range(k + 1):
                    trie[s[p - n : p]][s[p]] += 1
    total, distinct = sum(c.values()), len(c)

    def log(s, p):
        out, ruled = 0.0, set()
        for n in range(k, -1, -1):
            left = {b: x for b, x in trie.get(s[p - n : p], {}).items() if b not in ruled}
            if left:
                whole = sum(left.values()) + len(left)
                if s[p] in left:
                    return out + math.log10(left[s[p]] / whole)
                out += math.log10(len(left) / whole)
                ruled |= set(left)
        return out - math.log10(256 - len(ruled))

    from gridframe.llm.common import share

    want = []
    for i, t in rows:
        s, w = b"\n" * k + " ".join(cut(t)).encode() + b"\n", [*cut(t), None]
        want.append((i, len(w), sum(c[x] > 0 for x in w), total, round(sum(math.log10((c[x] + 1) / (total + distinct + 1)) for x in w), 6), round(sum(log(s, p) for p in range(k, len(s))), 3)))
    got = ppm.score(docs, share("doc_id", 7) != 2, common=common).collect()
    got = [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 3)) for r in got]
    for a, b in zip(sorted(got, key=repr), sorted(want, key=repr), strict=True):
        assert a[:4] == b[:4] and abs(a[4] - b[4]) < 1e-5 and abs(a[5] - b[5]) < 1e-2


def test_ppm_by_join_is_the_same(docs):
    rows = lambda **sizes: sorted(map(tuple, ppm.score(docs, F.col("doc_id") % 7 != 2, **sizes).collect()), key=repr)
    for a, b in zip(rows(nodes=20, common=3), rows(), strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:])


def test_ppm_without_training_rows(docs):
    got = ppm.score(docs, F.lit(False)).collect()
    assert len(got) == docs.count() and all(r.train_tokens == 0 and r.n_known == 0 for r in got)
    one = next(r for r in got if r.doc_id is not None and r.n_tokens == 1)
    assert one.score == pytest.approx(-math.log10(256))


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 32)
    draw = np.random.default_rng(1)
    centre = draw.normal(size=(40, 64))
    vectors = np.concatenate([draw.normal(size=(100, 64)), *[c + draw.normal(size=(6, 64)) * 0.25 for c in centre], centre[0] + draw.normal(size=(150, 64)) * 0.1])
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(vectors)]
    rows += [(1000, rows[0][1], 0), (1001, rows[0][1], 0), (1002, None, 0), (1003, [0.0] * 64, 0), (1004, [float("nan")] * 64, 0), (1005, [None] * 64, 0), (1006, [], 0), (1007, [x * 1e200 for x in rows[5][1]], 0), (1008, [1.0], 0)]
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int")).collect()}
    ids = [i for i, v, _ in rows if i < 1002 or i == 1007]
    m = np.array([np.array(v) / max(map(abs, v)) for i, v, _ in rows if i in ids])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T >= 0.9
    np.fill_diagonal(near, False)
    counts = near.sum(axis=1)
    assert sum(got[i].n_links for i in ids) >= 0.9 * counts.sum() and all(got[i].n_links <= n for i, n in zip(ids, counts, strict=True))
    assert got[1001].component_id == got[1000].component_id == 0 and got[1007].component_id == 5 and got[1007].n_links >= 1
    assert all(got[i].n_links == 0 and got[i].kept and got[i].component_id == i for i in (1002, 1003, 1004, 1005, 1006, 1008))
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_main_text(spark):
    page = "<html><head><title>T</title></head><body><div class='top-menu'><a>x</a></div><div class=box>Site name</div><div id=body><h2>{0}</h2><p>A &amp; B\n {0}<p>C {0}<br>D<script>if (a<b) x</script></div><div class=box>All rights reserved</div><div class='ad'>buy</div><div class=comments><p>me too</p></div></body>"
    rows = [(i, f"http://h.example/{i}", page.format(f"text {i}")) for i in range(5)]
    rows += [(10, "http://one.example/", "<article><header><h1>H</h1></header><p>a<b>b</b> c</p><footer>f</footer></article><footer>no</footer>"), (11, None, None), (12, "", ""), (13, "x", "plain &lt;text&gt;"), (14, "http://d.example", "<b>" * 5000 + "deep")]
    got = {r.page_id: r for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i].text == f"text {i}\nA & B text {i}\nC text {i} D" for i in range(5))
    assert [got[i].text for i in (10, 11, 12, 13, 14)] == ["H\nab c", "", "", "plain <text>", "deep"]
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_names_of_the_page_and_the_article_drop_nothing():
    page = "<html class=menu><body class='no-sidebar nav-open'><article class='post has-comments comments'><p>A</p><div class='comments'>no</div></article></body>"
    assert wrappers.text_of(page, frozenset()) == "A"
    assert wrappers.text_of("<body class=widget><div id='content' class='with-sidebar no-header'><p>B</p></div><div class='sidebar'>no</div><ol class='comment-list'><li>no</ol>", frozenset()) == "B"


def test_template_inside_articles_and_over_all_pages(spark):
    inside = "<body><article><h1>T{0}</h1><p>Own text {0} of this page</p><p>{1}</p></article></body>"
    rows = [(i, "http://a.example/", inside.format(i, "Read our terms" if i != 4 else "Another end")) for i in range(9)]
    rows += [(100 + 2 * h + k, f"http://two{h}.example/", f"<body><p>Name</p><div><p>page {h} {k}</p></div></body>") for h in range(20) for k in range(2)]
    rows += [(200, "http://t.example/", "<body><div>" + "<p>The long story that no mark is around.</p>" * 3 + "</div><article>teaser</article></body>")]
    got = {r.page_id: r.text for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"T{i}\nOwn text {i} of this page" + "\nAnother end" * (i == 4) for i in range(9))
    assert all(got[100 + 2 * h + k] == f"page {h} {k}" for h in range(20) for k in range(2))
    assert got[200].count("The long story") == 3


def test_tree_matching():
    a = ["r", 0, [["x", 1, []], ["y", 2, []], ["z", 3, []]]]
    b = ["r", 0, [["y", 2, []], ["x", 9, []], ["z", 4, []]]]
    assert len(wrappers.match(a, b)) == 3 and wrappers.match(a, ["s", 0, []]) == []


def largest(a, b):
    """Brute force of the size of the largest alignment."""
    if a[0] != b[0]:
        return 0
    best = [[0] * (len(b[2]) + 1) for _ in range(len(a[2]) + 1)]
    for i, x in enumerate(a[2], 1):
        for j, y in enumerate(b[2], 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + largest(x, y))
    return 1 + best[-1][-1]


def a_tree(draw, depth=0):
    return [draw.choice("abc") if depth else "r", draw.randrange(3), [a_tree(draw, depth + 1) for _ in range(draw.randrange(5 if depth < 3 else 1))]]


def changed(draw, tree):
    kids = [changed(draw, c) if draw.random() < 0.8 else c for c in tree[2] if draw.random() > 0.1]
    if draw.random() < 0.2:
        kids.insert(draw.randrange(len(kids) + 1), a_tree(draw, 2))
    return [tree[0], tree[1] if draw.random() < 0.8 else 9, kids]


def test_tree_matching_finds_the_largest_alignment():
    draw = random.Random(8)
    for _ in range(150):
        a = a_tree(draw)
        b = changed(draw, a) if draw.random() < 0.7 else a_tree(draw)
        pairs = wrappers.match(a, b)
        assert len(pairs) == largest(a, b) == len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs})
        assert all(x[0] == y[0] for x, y in pairs)


def test_long_pages_align_in_time():
    import time

    def page(k, n=20_000):
        return ["r", 0, [["p", 1, []], *[["p", k * 10**7 + i if i % 3 else i + 5, []] for i in range(n)], ["div", 7, [["b", k, []]]], *[[("li", "dt")[i % 2], k + i, []] for i in range(300)], ["p", 2, []]]]

    start = time.process_time()
    pairs = wrappers.match(page(1), page(2))
    assert time.process_time() - start < 2 and len(pairs) == 1 + 1 + 20_000 + 2 + 300 + 1
    start = time.process_time()
    assert len(wrappers.match(page(1, 500), page(2, 20_000))) >= 500 + 300
    assert wrappers.parse("<a href=\"x" * 20_000) and wrappers.parse("<a href='" + "y" * 3_000_000 + "'>z</a>")
    assert time.process_time() - start < 6


def test_byte_model_counts_in_small_slices():
    import tracemalloc

    draw = random.Random(3)
    texts = [" ".join("".join(draw.choices("abcdefghij", k=6)) for _ in range(5000)) for _ in range(60)]
    batch = pa.RecordBatch.from_pydict({"text": texts, "learn": [True] * len(texts)})
    tracemalloc.start()
    n = sum(1 for _ in ppm._grams(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n and peak < 100 << 20, peak


def test_template_of_a_layout_is_what_all_its_pages_share(spark):
    # Four of nine pages share a text, in many hosts: in some of these the pages of the least hashes are among the four.
    page = "<body><div><h1>T{0} {1}</h1><p>Own text {0} of {1}</p>{2}</div></body>"
    rows = [(100 * h + i, f"http://h{h}.example/{i}", page.format(h, i, "<p>Shared by some</p>" * (i < 4))) for h in range(60) for i in range(9)]
    # A layout of its own, small beside the others of its host, whose pages all share a text at a place that all pages have.
    rows += [(10_000 + i, "http://l.example/", f"<body><div><p>Page {i}</p><p>Other {i}</p></div></body>") for i in range(30)]
    rows += [(11_000 + i, "http://l.example/", f"<body><div><p>Page {i} b</p><p>Of this layout</p><h2>Head {i}</h2></div></body>") for i in range(6)]
    got = {r.page_id: r.text for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)).collect()}
    assert all(got[100 * h + i] == f"T{h} {i}\nOwn text {h} of {i}" + "\nShared by some" * (i < 4) for h in range(60) for i in range(9))
    assert all(got[11_000 + i] == f"Page {i} b\nHead {i}" for i in range(6)) and all(got[10_000 + i] == f"Page {i}\nOther {i}" for i in range(30))


def test_gaps_too_large_for_the_table_lose_no_equal_text():
    a, b = (["r", 0, [["div", 0, [["p", 5 if i in at else start + i, []] for i in range(200)]]]] for start, at in ((1000, (10, 11)), (5000, (90, 150))))
    first = wrappers.Signed(a)
    equal = wrappers.same_text(first, wrappers.Signed(b))
    assert equal == {id(a[2][0][2][i]) for i in (10, 11)} and [n for n, _ in wrappers.keys_of(a, equal)] == [12, 13]


def test_large_gaps_are_aligned_by_the_whole_table():
    draw = random.Random(4)

    def tree(n):
        return ["r", 0, [[draw.choice("abcd"), draw.randrange(10**6), [["e", 1, []] for _ in range(draw.randrange(3))]] for _ in range(n)]]

    for n, m in ((130, 110), (400, 3), (250, 260)):
        a, b = tree(n), tree(m)
        pairs = wrappers.match(a, b)
        assert len(pairs) == largest(a, b) == len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs})
        for place, side in enumerate((a, b)):
            at = {id(node): i for i, node in enumerate(side[2])}
            order = [at[id(pair[place])] for pair in pairs if id(pair[place]) in at]
            assert order == sorted(order)


def test_quotes_that_are_not_closed():
    assert wrappers.text_of("<p class=\"a>One</p><p>Two</p>", frozenset()) == "One\nTwo"
    assert wrappers.text_of("<p title='a > b'>One</p><p data-x=\"" + "z" * 100_000 + "\">Two</p>", frozenset()) == "One\nTwo"


def test_pipeline(spark, tmp_path, docs):
    import corpus_pipeline as p

    known = docs.select(p.COLUMNS)
    known.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "never seen anywhere here")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    held = known
    for name, stage in p.STAGES:
        out = stage(spark, held, str(tmp_path))
        if name != "tokens":
            assert out.columns == p.COLUMNS
            out.write.parquet(str(tmp_path / name))
            out = spark.read.parquet(str(tmp_path / name))
            before = [(r.doc_id, r.text) for r in held.collect()]
            after = [(r.doc_id, r.text) for r in out.collect()]
            if name == "near_copies":
                fp = {t: simhash.fingerprint(t) for _, t in before}
                roots = graph.Roots(len(before))
                for i, (_, t) in enumerate(before):
                    for j, (_, u) in enumerate(before[:i]):
                        if bin(fp[t] ^ fp[u]).count("1") <= 4:
                            roots.join(i, j)
                groups = defaultdict(list)
                for i, row in enumerate(before):
                    groups[roots.find(i)].append(row)
                kept = Counter(after)
                for group in groups.values():
                    (stays,) = kept & Counter(group)
                    ids = [i for i, _ in group if i is not None]
                    assert kept[stays] == 1 and stays[0] == (min(ids) if ids else None)
                assert len(after) == len(groups)
            if name == "repeated_passages":
                want = [(i, t if m == 0 else kept) for (i, t), (_, _, m, kept) in zip(before, gone_rows(before), strict=True) if m == 0 or kept]
                assert Counter(after) == Counter(want)
            held = out
    assert Counter(r.doc_id for r in p.run(spark, str(tmp_path)).collect()) == Counter(r.doc_id for r in held.collect())
