"""Licences named or quoted in documents, by sentence recognition and ordered rules. DataFrame operations only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridframe.llm.common import lower_ascii

#: Known licence sentences by identifier, normalised: lower case, words of letters, digits and dots, one space between.
#: The wording of public licences and of usual notices.
SENTENCES: dict[str, tuple[str, ...]] = {
    "apache2-notice": ("licensed under the apache license version 2.0", "licensed under the apache license version 2.0 the license"),
    "apache2-obey": ("you may not use this file except in compliance with the license",),
    "apache2-copy": ("you may obtain a copy of the license at",),
    "apache2-title": ("apache license version 2.0 january 2004", "apache license"),
    "apache2-tag": ("spdx license identifier apache 2.0",),
    "mit-notice": ("released under the mit license", "licensed under the mit license", "this project is licensed under the mit license"),
    "mit-title": ("mit license", "the mit license mit"),
    "mit-tag": ("spdx license identifier mit",),
    "mit-grant": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation "
        "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    ),
    "mit-keep": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "gpl3-notice": ("this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "this program is licensed under the gnu general public license version 3"),
    "gpl2-notice": ("licensed under the gnu general public license version 2", "this work is licensed under the gnu general public license version 2"),
    "gpl-title": ("gnu general public license",),
    "gpl3-tag": ("spdx license identifier gpl 3.0", "spdx license identifier gpl 3.0 only", "spdx license identifier gpl 3.0 or later"),
    "gpl2-tag": ("spdx license identifier gpl 2.0", "spdx license identifier gpl 2.0 only", "spdx license identifier gpl 2.0 or later"),
    "gpl-free": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",),
    "cc-by-nc4-notice": ("licensed under cc by nc 4.0", "this work is licensed under cc by nc 4.0"),
    "cc-by4-notice": ("licensed under cc by 4.0", "this work is licensed under cc by 4.0"),
    "cc-by-sa4-notice": ("licensed under cc by sa 4.0", "this work is licensed under cc by sa 4.0"),
    "cc0-notice": ("licensed under cc0 1.0", "released under cc0 1.0"),
    "bsd-grant": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "bsd-source": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",),
    "bsd-binary": ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",),
    "bsd-names": ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",),
    "bsd-notice": ("licensed under the bsd license", "released under the bsd license"),
    "mpl2-notice": ("this source code form is subject to the terms of the mozilla public license v. 2.0", "licensed under the mozilla public license version 2.0"),
    "as-is": ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",),
    "rights": ("all rights reserved",),
    "gpl2-free": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",),
    "lgpl21-free": ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version",),
    "lgpl3-free": ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",),
    "agpl3-free": ("this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",),
    "isc-grant": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",),
    "isc-as-is": ("the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",),
    "0bsd-grant": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",),
    "zlib-as-is": ("this software is provided as is without any express or implied warranty",),
    "zlib-grant": ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",),
    "zlib-origin": ("the origin of this software must not be misrepresented you must not claim that you wrote the original software",),
    "unlicense-free": ("this is free and unencumbered software released into the public domain",),
    "unlicense-anyone": ("anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",),
    "boost-grant": (
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and "
        "transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    ),
    "epl-notice": ("this program and the accompanying materials are made available under the terms of the eclipse public license 2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at"),
    "wtfpl-do": ("you just do what the fuck you want to",),
}

#: Licences by their identifiers, with the names by which notices call them. Fixed values.
NAMES: dict[str, tuple[str, ...]] = {
    "LGPL-2.1": ("gnu lesser general public license version 2.1", "lgpl v2.1"), "LGPL-3.0": ("gnu lesser general public license version 3", "gnu lesser general public license v3.0", "lgpl v3"),
    "AGPL-3.0": ("gnu affero general public license version 3", "gnu affero general public license v3.0", "agpl v3"), "ISC": ("isc license",), "Zlib": ("zlib license",), "Unlicense": ("unlicense",),
    "BSL-1.0": ("boost software license version 1.0", "boost software license"), "EPL-2.0": ("eclipse public license 2.0", "eclipse public license version 2.0"), "EPL-1.0": ("eclipse public license 1.0", "eclipse public license version 1.0"),
    "CDDL-1.0": ("common development and distribution license version 1.0", "cddl"), "Artistic-2.0": ("artistic license 2.0",), "WTFPL": ("wtfpl", "do what the fuck you want to public license"),
    "PostgreSQL": ("postgresql license",), "NCSA": ("university of illinois ncsa open source license",), "OFL-1.1": ("sil open font license version 1.1", "sil open font license"),
    "MS-PL": ("microsoft public license",), "0BSD": ("zero clause bsd license", "0bsd license"), "BSD-3-Clause": ("bsd 3 clause license", "3 clause bsd license"), "BSD-2-Clause": ("bsd 2 clause license", "2 clause bsd license"),
    "MPL-2.0": ("mozilla public license 2.0",), "CC-BY-ND-4.0": ("cc by nd 4.0",), "CC-BY-NC-SA-4.0": ("cc by nc sa 4.0",), "CC-BY-NC-ND-4.0": ("cc by nc nd 4.0",), "EUPL-1.2": ("european union public licence v. 1.2", "eupl 1.2"),
    "Apache-2.0": ("apache 2.0 license", "apache license 2.0"), "GPL-3.0": ("gpl v3", "gnu gpl v3", "gnu general public license v3.0"), "GPL-2.0": ("gpl v2", "gnu gpl v2", "gnu general public license v2.0"),
    "CC0-1.0": ("creative commons zero v1.0 universal", "cc0 1.0 universal"), "CC-BY-4.0": ("creative commons attribution 4.0 international license",), "CC-BY-SA-4.0": ("creative commons attribution sharealike 4.0 international license",),
}
#: What stands before a name in a notice, and licences whose tags say which versions are meant.
OPENINGS = ("licensed under the", "released under the", "distributed under the", "this project is licensed under the", "this work is licensed under the", "this software is licensed under the")
VERSIONED = ("LGPL-2.1", "LGPL-3.0", "AGPL-3.0")
#: Licences with tags among SENTENCES.
TAGGED = ("Apache-2.0", "MIT", "GPL-3.0", "GPL-2.0")


def _named() -> None:
    """Notices and tags of all licences in NAMES, by rule."""
    for licence, names in NAMES.items():
        key = licence.lower()
        own = {s for some in SENTENCES.values() for s in some}
        SENTENCES[f"{key}:notice"] = tuple(f"{opening} {name}" for opening in OPENINGS for name in names if f"{opening} {name}" not in own)
        if licence not in TAGGED:
            tag = f"spdx license identifier {key.replace('-', ' ')}"
            SENTENCES[f"{key}:tag"] = (tag, f"{tag} only", f"{tag} or later") if licence in VERSIONED else (tag,)


_named()

#: Ordered rules: licence, and the identifiers that follow each other. Where rules start at one place, the first that fits is taken,
#: and matching goes on behind it. Identifiers that no rule uses at their place are passed over.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Apache-2.0", ("apache2-notice", "apache2-obey", "apache2-copy")),
    ("Apache-2.0", ("apache2-title", "apache2-notice")),
    ("Apache-2.0", ("apache2-notice",)),
    ("Apache-2.0", ("apache2-title",)),
    ("Apache-2.0", ("apache2-tag",)),
    ("MIT", ("mit-title", "mit-grant", "mit-keep", "as-is")),
    ("MIT", ("mit-grant", "mit-keep", "as-is")),
    ("MIT", ("mit-grant", "mit-keep")),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-title",)),
    ("MIT", ("mit-tag",)),
    ("GPL-3.0", ("gpl-title", "gpl3-notice")),
    ("GPL-3.0", ("gpl3-notice",)),
    ("GPL-3.0", ("gpl-free",)),
    ("GPL-3.0", ("gpl3-tag",)),
    ("GPL-2.0", ("gpl2-notice",)),
    ("GPL-2.0", ("gpl2-tag",)),
    ("CC-BY-NC-4.0", ("cc-by-nc4-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa4-notice",)),
    ("CC-BY-4.0", ("cc-by4-notice",)),
    ("CC0-1.0", ("cc0-notice",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD", ("bsd-notice",)),
    ("MPL-2.0", ("mpl2-notice",)),
    ("GPL-2.0", ("gpl2-free",)),
    ("LGPL-2.1", ("lgpl21-free",)),
    ("LGPL-3.0", ("lgpl3-free",)),
    ("AGPL-3.0", ("agpl3-free",)),
    ("ISC", ("isc-grant", "isc-as-is")),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("0bsd-grant", "isc-as-is")),
    ("Zlib", ("zlib-as-is", "zlib-grant")),
    ("Zlib", ("zlib-grant",)),
    ("Unlicense", ("unlicense-free",)),
    ("BSL-1.0", ("boost-grant",)),
    ("EPL-2.0", ("epl-notice",)),
    ("WTFPL", ("wtfpl-do",)),
    *((licence, (f"{licence.lower()}:{kind}",)) for licence in NAMES for kind in ("notice", "tag") if f"{licence.lower()}:{kind}" in SENTENCES),
)

#: Sentences end at a line end and at a full stop, semicolon, colon or similar mark that is followed by white space or the end.
BREAK = r"[\n\r]+|[.;:!?]+(?=\s|$)"
#: Stand between sentences, and for a blank line, where sentences are recognised.
EDGE, BLANK = "\x1f", "\x1e"


def by_length() -> list[tuple[str, str]]:
    """Sentences and identifiers."""
    return sorted((s, name) for name, some in SENTENCES.items() for s in some)


def sentences(text: Column) -> Column:
    """Normalised sentences of a text, in order; those without words are left out. A blank line is the sentence BLANK."""
    marked = F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), r"(?:\r\n|\n|\r)(?:[ \t]*(?:\r\n|\n|\r))+", f"\n{BLANK}\n")
    plain = F.transform(F.split(marked, BREAK), lambda s: F.when(s == BLANK, s).otherwise(F.trim(F.regexp_replace(s, r"[^a-z0-9.\x{80}-\x{10FFFF}]+", " "))))
    return F.filter(plain, lambda s: s != "")


def as_split(sentence: str) -> str:
    """A known sentence as it is once it has been split by BREAK and its parts are joined by a space."""
    return " ".join(" ".join(re.split(BREAK, sentence)).split())


def _codes() -> dict[str, str]:
    """A letter for each identifier, so that rules match a sequence as a pattern does."""
    return {name: chr(0x4E00 + i) for i, name in enumerate(SENTENCES)}


def scan(documents: DataFrame, id: str = "doc_id", text: str = "text", others: dict[str, str] | None = None) -> DataFrame:
    """(id, n_sentences, n_known, sentence_ids, rules, licenses) for each row.

    Sentences are normalised and looked up among SENTENCES (and ``others``: normalised sentence to one of its identifiers). A known
    sentence may be one of the text's or several in a row, as line ends and marks such as the colon of a tag split it; blank lines
    are not crossed, and of those that begin at one place the longest is taken. ``n_sentences`` counts the text's as split.
    ``sentence_ids`` are the identifiers found, in order, joined by commas. RULES are then matched from left to right
    on that sequence: ``rules`` are the licences of the rules in order of their match, and ``licenses`` the distinct
    ones, sorted; all joined by commas, empty if none. The row is read by itself, so there is no shuffle and ids, ties and
    repeated rows play no part. A null text has no sentence. Other columns are not read. An empty table gives an empty one.
    """
    codes = _codes()
    words = {as_split(s): codes[name] for s, name in [*by_length(), *sorted((others or {}).items())]}
    known = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    names = F.create_map(*[F.lit(x) for name, code in codes.items() for x in (code, name)])
    rows = documents.select(F.col(id), sentences(F.col(text)).alias("all"))
    # Few sentences are of interest: those that are in the list. The map is only asked for these.
    any_of = "|".join(re.escape(s).replace("\\ ", f"[ {EDGE}]") for s in sorted(words, key=lambda s: (-len(s), s)))
    joined = F.concat(F.lit(EDGE), F.array_join("all", EDGE), F.lit(EDGE))
    rows = rows.withColumn("found", F.regexp_extract_all(joined, F.lit(f"(?<={EDGE})(?:{any_of})(?={EDGE})"), F.lit(0)))
    rows = rows.withColumn("coded", F.transform("found", lambda s: F.element_at(known, F.translate(s, EDGE, " "))))
    sequence = F.array_join("coded", "")
    # An array holds each rule's letters; a match takes the first rule that fits at its place.
    pattern = "|".join("".join(codes[i] for i in ids) for _, ids in RULES)
    licence = F.create_map(*[F.lit(x) for key, name in {"".join(codes[i] for i in ids): name for name, ids in RULES}.items() for x in (key, name)])
    rows = rows.withColumn("matched", F.transform(F.regexp_extract_all(sequence, F.lit(f"({pattern})"), F.lit(1)), lambda m: F.element_at(licence, m)))
    return rows.select(
        F.col(id), F.size(F.filter("all", lambda s: s != BLANK)).cast("long").alias("n_sentences"), F.size("found").cast("long").alias("n_known"),
        F.array_join(F.transform("coded", lambda c: F.element_at(names, c)), ",").alias("sentence_ids"),
        F.array_join("matched", ",").alias("rules"), F.array_join(F.array_sort(F.array_distinct("matched")), ",").alias("licenses"),
    )


def oracle() -> str:
    """The same in DuckDB's SQL, from the fixed tables above."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    codes = _codes()
    known = ", ".join(f"({quote(s)}, {quote(name)}, {quote(codes[name])})" for s, name in by_length())
    rules = ", ".join(f"({quote(''.join(codes[i] for i in ids))}, {quote(name)})" for name, ids in RULES)
    pattern = "|".join("".join(codes[i] for i in ids) for _, ids in RULES)
    return rf"""
WITH known(s, name, code) AS (VALUES {known}), rule(code, licence) AS (VALUES {rules}),
p AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
b AS (SELECT r, doc_id, list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(t, '[.;:!?]+([ \t\n\r\f\v])', chr(10) || '\1', 'g'), '[.;:!?]+$', ''), '[\n\r]+'),
  lambda s: trim(regexp_replace(s, '[^a-z0-9.\x{{80}}-\x{{10FFFF}}]+', ' ', 'g'))), lambda s: s <> '') AS l FROM p),
u AS (SELECT r, unnest(l) AS s, unnest(range(len(l))) AS i FROM b),
k AS (SELECT r, count(*) AS n, string_agg(name, ',' ORDER BY i) AS ids, string_agg(code, '' ORDER BY i) AS seq FROM u JOIN known USING (s) GROUP BY r),
m AS (SELECT r, unnest(regexp_extract_all(seq, '{pattern}')) AS code, unnest(range(len(regexp_extract_all(seq, '{pattern}')))) AS i FROM k),
o AS (SELECT r, string_agg(licence, ',' ORDER BY i) AS rules, array_to_string(list_sort(list_distinct(list(licence))), ',') AS licenses FROM m JOIN (SELECT DISTINCT * FROM rule) USING (code) GROUP BY r)
SELECT b.doc_id, CAST(len(l) AS BIGINT) AS n_sentences, CAST(coalesce(k.n, 0) AS BIGINT) AS n_known, coalesce(ids, '') AS sentence_ids, coalesce(rules, '') AS rules, coalesce(licenses, '') AS licenses
FROM b LEFT JOIN k USING (r) LEFT JOIN o USING (r)"""
