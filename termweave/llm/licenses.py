"""Licence scans by a positional rare-token index, in DataFrame functions only.

TEMPLATES are licence passages and whole licence texts; each has a mandatory key phrase. The index
keeps, for every template, the two words of its key phrase of highest IDF over the templates, with
their places (openers). A file is cut into words once; each of its opener words looks up its
postings, which gives a relative position (place in the file minus place in the template); the
second opener must lie at the same relative position; then the key phrase must be whole there, and at
least MIN_SHARE of the template's words in place. A template is reported only with its whole phrase,
so no place that could be reported lacks its openers: the lookup loses nothing.

All of this happens inside the file's own row, so nothing is joined or shuffled, whatever words or
files are frequent. Base phrases are found in the same words. The SQL aligns all words of all
templates at all places, without openers.

Cases: null text counts as empty; texts without words have n_words 0, null first and last, empty
labels and score 0; repeated rows are scanned each; null ids stay null; an empty table gives no
rows; extra columns are not read; texts of any length are scanned whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
MIN_SHARE = 0.6

#: (label, passage, mandatory key phrase within it), in lower case without signs.
TEMPLATES = [
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", "permission is hereby granted free of charge"),
    ("apache", "licensed under the apache license version 2 0", "apache license version 2"),
    ("apache", "you may obtain a copy of the license at http www apache org licenses license 2 0", "www apache org licenses"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license as published"),
    ("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("bsd", "released under the bsd license", "bsd license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "licensed under cc by nc"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software released into the public domain"),
    # whole texts
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the "
        "software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the "
        "software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission "
        "notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied "
        "including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright "
        "holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the "
        "software or the use or other dealings in the software",
        "permission is hereby granted free of charge to any person obtaining a copy",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of "
        "source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above "
        "copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution 3 neither the "
        "name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior "
        "written permission this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to "
        "the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
        "redistributions of source code must retain the above copyright notice",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and "
        "this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all "
        "implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages "
        "whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with "
        "the use or performance of this software",
        "provided that the above copyright notice and this permission notice appear in all copies",
    ),
    (
        "apache",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as "
        "is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations "
        "under the license",
        "unless required by applicable law or agreed to in writing software distributed under the license",
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software "
        "foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any "
        "warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should "
        "have received a copy of the gnu general public license along with this program if not see http www gnu org licenses",
        "have received a copy of the gnu general public license along with this program",
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in "
        "source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        "anyone is free to copy modify publish use compile sell or distribute this software",
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this "
        "software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject "
        "to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software",
        "permission is granted to anyone to use this software for any purpose including commercial applications",
    ),
    (
        "bsl",
        "boost software license version 1 0 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying "
        "documentation covered by this license the software to use reproduce display distribute execute and transmit the software",
        "boost software license",
    ),
]


def postings() -> list[tuple[str, int, int, float]]:
    """(word, template, place, idf)."""
    cut = [t[1].split() for t in TEMPLATES]
    df: dict[str, int] = {}
    for words in cut:
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    return [(w, t, p, round(math.log(len(cut) / df[w]), 6)) for t, words in enumerate(cut) for p, w in enumerate(words)]


def template_rows() -> list[tuple[int, str, int, int, int]]:
    """(template, label, number of words, the key phrase's first place, its number of words)."""
    out = []
    for t, (label, text, phrase) in enumerate(TEMPLATES):
        words, key = text.split(), phrase.split()
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        out.append((t, label, len(words), at, len(key)))
    return out


def openers() -> list[tuple[int, str, int, str, int]]:
    """(template, opener, its place, second opener, its place): the words of highest IDF in the key phrase, the earlier on ties."""
    idf = {w: x for w, _, _, x in postings()}
    out = []
    for t, _, _, at, n in template_rows():
        words = TEMPLATES[t][1].split()
        best = sorted(range(at, at + n), key=lambda p: (-idf[words[p]], p))
        first, second = best[0], best[1]
        out.append((t, words[first], first, words[second], second))
    return out


def _index() -> Column:
    """The openers with all that is checked after them, as one constant array."""
    lit = F.lit
    rows = []
    for (t, first, p1, second, p2), (_, label, size, key_at, key_n) in zip(openers(), template_rows(), strict=True):
        words = F.array(*(lit(w) for w in TEMPLATES[t][1].split()))
        rows.append(F.struct(lit(first).alias("first"), lit(p1).alias("p1"), lit(second).alias("second"), lit(p2).alias("p2"), lit(label).alias("label"), lit(size).alias("size"), lit(key_at).alias("key_at"), lit(key_n).alias("key_n"), words.alias("words")))
    return F.array(*rows)


def _in_place(words: Column, at: Column, template: Column, first: Column, n: Column) -> Column:
    """How many of n template words from place `first` lie in place in the file."""
    return F.size(F.filter(F.sequence(first, first + n - 1), lambda j: F.coalesce(F.get(words, at + j) == F.get(template, j), F.lit(False))))


def _base_starts(words: Column, hits: Column) -> Column:
    """Structs (start, label) of all places of base phrases; found from their last word, license."""
    ends = F.filter(hits, lambda i: F.get(words, i) == "license")
    is_ = lambda i, back, w: F.coalesce(F.get(words, i - back) == w, F.lit(False))
    place = lambda i, start, label: F.struct((i - start).alias("start"), F.lit(label).alias("label"))
    found = F.transform(
        ends,
        lambda i: F.when(is_(i, 1, "mit"), place(i, 1, "mit")).when(is_(i, 1, "apache"), place(i, 1, "apache")).when(is_(i, 1, "public") & is_(i, 2, "general"), place(i, 2, "gpl")),
    )
    return F.filter(found, lambda x: x.isNotNull())


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row.

    Each step reads the one before more than once, so the optimizer keeps the steps apart. The words
    are marked as not deterministic (though they are), lest a filter on the result be pushed below
    them and cut the text again for every word.
    """
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)
    cut = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.rand(0) < 2, cut).alias("words"))
    opening = F.array(*(F.lit(w) for w in sorted({"license", *(o[1] for o in openers())})))
    places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.array_contains(opening, F.get("words", i)))
    none = F.array().cast("array<int>")
    rows = rows.select("doc_id", "words", F.when(F.arrays_overlap("words", opening), places).otherwise(none).alias("hits"))

    def of(i: Column) -> Column:
        """label and share of the templates whose opener is word i, where phrase and openers are in place."""
        same = lambda t: (t["first"] == F.get("words", i)) & F.coalesce(F.get("words", i - t["p1"] + t["p2"]) == t["second"], F.lit(False))
        whole = lambda t: _in_place(F.col("words"), i - t["p1"], t["words"], t["key_at"], t["key_n"]) == t["key_n"]
        share = lambda t: _in_place(F.col("words"), i - t["p1"], t["words"], F.lit(0), t["size"]) / t["size"]
        return F.transform(F.filter(_index(), lambda t: same(t) & whole(t)), lambda t: F.struct(t["label"].alias("label"), share(t).alias("share")))

    found = F.filter(F.flatten(F.transform("hits", of)), lambda x: x["share"] >= MIN_SHARE)
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), _base_starts(F.col("words"), F.col("hits")).alias("places"), found.alias("found"))
    starts = F.col("places")["start"]
    base = F.array_sort(F.array_distinct(F.col("places")["label"]))
    labels = F.array_sort(F.array_distinct(F.concat(F.col("places")["label"], F.col("found")["label"])))
    score = F.greatest(F.coalesce(F.array_max(F.col("found")["share"]), F.lit(0.0)), F.when(F.size("places") > 0, 0.5).otherwise(0.0))
    return rows.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"),
    )


def oracle() -> str:
    """The scan in DuckDB SQL: every word of every template votes at every place, with no openers and no cap."""
    rows = lambda xs: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in xs)
    return rf"""
    WITH idx(word, template, place, idf) AS (VALUES {rows(postings())}),
    tpl(template, label, size, key_at, key_n) AS (VALUES {rows(template_rows())}),
    d AS (SELECT row_number() OVER () AS r, doc_id,
            regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
    w AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d),
    base AS (
      SELECT a.r, a.pos - 1 AS start, b.word AS label FROM w a JOIN w b ON a.r = b.r AND b.pos = a.pos - 1
        WHERE a.word = 'license' AND b.word IN ('mit', 'apache')
      UNION ALL SELECT a.r, a.pos - 2, 'gpl' FROM w a JOIN w b ON a.r = b.r AND b.pos = a.pos - 1 JOIN w c ON a.r = c.r AND c.pos = a.pos - 2
        WHERE a.word = 'license' AND b.word = 'public' AND c.word = 'general'),
    b AS (SELECT r, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list_sort(list(DISTINCT label)) AS base FROM base GROUP BY r),
    votes AS (SELECT w.r, i.template, w.pos - i.place AS at, count(*) AS n, count(*) FILTER (i.place >= t.key_at AND i.place < t.key_at + t.key_n) AS k
      FROM w JOIN idx i ON w.word = i.word JOIN tpl t ON i.template = t.template GROUP BY ALL),
    found AS (SELECT v.r, list(DISTINCT t.label) AS more, max(n / CAST(t.size AS DOUBLE)) AS best
      FROM votes v JOIN tpl t ON v.template = t.template WHERE k = t.key_n AND n / CAST(t.size AS DOUBLE) >= {MIN_SHARE} GROUP BY v.r)
    SELECT CAST(d.doc_id AS BIGINT) AS doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(b.n_base, 0) AS BIGINT) AS n_base,
      CAST(b.first_word AS BIGINT) AS first_word, CAST(b.last_word AS BIGINT) AS last_word,
      coalesce(array_to_string(b.base, ','), '') AS base_labels,
      coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.base, []), coalesce(f.more, [])))), ','), '') AS labels,
      greatest(coalesce(f.best, 0.0), CASE WHEN b.n_base > 0 THEN 0.5 ELSE 0.0 END) AS score
    FROM d LEFT JOIN b ON d.r = b.r LEFT JOIN found f ON d.r = f.r"""
