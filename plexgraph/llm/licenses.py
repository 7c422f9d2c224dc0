"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

A template of n words is looked for in windows of 2.5 n words that start every n words, so any stretch of up to 1.5 n
words lies whole in a window. A window that holds the required part of a template's shingles has at least a known
similarity to it; from that follows how many bands, of one MinHash row each, collide with probability 1 - MISS at least.
Texts without any of the words of which every match holds one cannot match and are not hashed; windows without any
shingle of a template of their length cannot match and get no signature. A template of fewer than K words is one shingle,
its whole word sequence, and is looked for by a pattern in the text. DataFrame functions only.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plexgraph.llm.common import table
from plexgraph.llm.license_texts import FULL

K = 5
CONTAINED = 0.8
#: The probability at most that a window with a match shares no band with the template.
MISS = 1e-6
#: Words of templates that one pass over the documents looks for: this bounds the plan's literals and what is broadcast.
PASS_WORDS = 20_000
_SPLIT = "[^a-z0-9]+"

TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    'the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the Software.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
    "that the above copyright notice and this permission notice appear in all copies.",
    "bsd-clauses": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with '
    "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or "
    'agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF '
    "ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
    "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is "
    "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS "
    "FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
    "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
    "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, "
    "and by any means.",
    "boost-1.0-line": "Distributed under the Boost Software License, Version 1.0.",
    "all-rights-line": "All rights reserved. No part of this publication may be reproduced",
    **FULL,
}
#: Notices of fewer than K words. They stand apart from TEMPLATES, which the SQL of op9_license_scan lists.
SHORT_TEMPLATES = {"all-rights-reserved": "All rights reserved."}


def window_words(n: int) -> int:
    return (5 * n + 1) // 2


def bands_needed(n: int, kinds: int, contained: float = CONTAINED, miss: float = MISS) -> int:
    """Bands for a template of n words and so many distinct shingles: the least similarity of a window that matches is
    hit / (window + kinds - hit), and each band misses it with one minus that."""
    hit = math.ceil(contained * kinds - 1e-9)
    alike = hit / (window_words(n) - K + 1 + kinds - hit)
    return 1 if alike >= 1 else math.ceil(math.log(miss) / math.log(1 - alike))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _SPLIT), "")


def _each(words: Column, make) -> Column:
    places = F.when(F.size(words) >= K, F.sequence(F.lit(1), F.size(words) - (K - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, make)


def _hashes(words: Column) -> Column:
    return _each(words, lambda i: F.xxhash64(*[F.element_at(words, i + j) for j in range(K)]))


def _strings(words: Column) -> Column:
    return _each(words, lambda i: F.concat_ws(" ", *[F.element_at(words, i + j) for j in range(K)]))


def _signature(hashes: Column, bands: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), bands - 1), lambda p: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, p))))


def _templates(spark: SparkSession, templates: dict[str, str], contained: float) -> DataFrame:
    """name, n (words), _bands, _kinds (distinct shingles as strings) and _hashes. As small as the dictionary given."""
    rows = spark.createDataFrame(sorted(templates.items()), "name string, text string").select("name", words_of(F.col("text")).alias("_w"))
    rows = rows.filter(F.size("_w") >= K).select("name", F.size("_w").alias("n"), F.array_distinct(_strings(F.col("_w"))).alias("_kinds"), F.array_distinct(_hashes(F.col("_w"))).alias("_hashes"))
    got = [(r["name"], r["n"], bands_needed(r["n"], len(r["_kinds"]), contained), r["_kinds"], r["_hashes"]) for r in rows.collect()]
    return spark.createDataFrame(got, "name string, n int, _bands int, _kinds array<string>, _hashes array<long>")


def needles(templates: dict[str, list[str]], contained: float) -> list[str]:
    """Words of which every match holds one. A match lacks at most so many of its template's distinct shingles as the
    share allows; if the shingles that hold a needle are more than that, it cannot lack them all. Long words first, since
    they are rare, and words of other templates' needles before new ones. templates: as words."""
    out: dict[str, None] = {}
    for _, words in sorted(templates.items(), key=lambda x: (len(x[1]), x[0])):
        kinds = {tuple(words[i : i + K]) for i in range(len(words) - K + 1)}
        may_lack = len(kinds) - math.ceil(contained * len(kinds) - 1e-9)
        left = {g for g in kinds if not any(w in out for w in g)}
        for w in sorted(set(words), key=lambda w: (-len(w), w)):
            if len(kinds) - len(left) > may_lack:
                break
            if any(w in g for g in left):
                out[w] = None
                left = {g for g in left if w not in g}
    return list(out)


def _short(docs: DataFrame, templates: dict[str, list[str]], id_col: str, text_col: str) -> DataFrame:
    """scan for templates of fewer than K words, given as lists of words: each is one shingle, and the earliest window
    that holds its first occurrence in a row is the row's earliest."""
    of = {name: "(?<![a-z0-9])" + "[^a-z0-9]+".join(words) + "(?![a-z0-9])" for name, words in templates.items()}
    low = F.lower(F.col(text_col))
    some = docs.select(F.col(id_col).alias("doc_id"), low.alias("_low")).filter(F.col("_low").rlike("|".join(of.values())))

    def found(name: str) -> Column:
        n = len(templates[name])
        before = F.regexp_count(F.split("_low", of[name], 2)[0], F.lit("[a-z0-9]+"))
        first = F.ceil(F.greatest(before + n - window_words(n), F.lit(0)) / n) * n
        return F.when(F.col("_low").rlike(of[name]), F.struct(F.lit(name).alias("license"), first.cast("long").alias("first_word")))

    each = some.select("doc_id", F.explode(F.array_compact(F.array(*[found(name) for name in sorted(of)]))).alias("_f"))
    best = each.groupBy("doc_id", F.col("_f.license").alias("license")).agg(F.min("_f.first_word").alias("first_word"))
    one = F.lit(1).cast("long")
    return best.select("doc_id", "license", one.alias("template_shingles"), one.alias("matched"), "first_word")


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, contained: float = CONTAINED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The templates found in each document: doc_id, license, template_shingles, matched, first_word.

    A template is found if a window holds at least `contained` of its distinct 5-word shingles; matched is the most that
    one window holds and first_word the number (from 0) of the first word of the earliest such window. Words are runs of
    letters and digits a-z, 0-9 after lower-casing. A template of fewer than 5 words is one shingle of all its words.
    Defined results: a null or empty text has no matches; rows that share an id are one document; rows with a null id
    are too; templates without words are left out; an empty table gives no rows. Very many templates are looked for in
    several passes of bounded size.
    """
    spark = docs.sparkSession
    split = {name: re.findall("[a-z0-9]+", text.lower()) for name, text in templates.items()}
    short = {name: w for name, w in split.items() if 0 < len(w) < K}
    if short:
        rest = {name: templates[name] for name, w in split.items() if len(w) >= K}
        part = _short(docs, short, id_col, text_col)
        return scan(docs, rest, contained, id_col, text_col).unionByName(part) if rest else part
    parts, held = [{}], 0
    for name, w in split.items():
        if w:
            if parts[-1] and held + len(w) > PASS_WORDS:
                parts, held = [*parts, {}], 0
            parts[-1][name] = templates[name]
            held += len(w)
    if len(parts) > 1:
        return reduce(DataFrame.unionByName, [scan(docs, part, contained, id_col, text_col) for part in parts])
    known = _templates(spark, templates, contained)
    listed = known.collect()
    every = F.array(*[F.lit(h) for h in sorted({h for r in listed for h in r["_hashes"]})]).cast("array<bigint>")
    bands: dict[int, int] = {}
    for r in listed:
        bands[r["n"]] = max(bands.get(r["n"], 1), r["_bands"])
    # A class is a length of templates. Its windows matter only where they hold a shingle of one of its own templates.
    of = {n: sorted({h for r in listed if r["n"] == n for h in r["_hashes"]}) for n in bands}
    held = lambda n: F.array(*[F.lit(h) for h in of[n]]).cast("array<bigint>")
    classes = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(window_words(n)).alias("w"), F.lit(b).alias("b"), held(n).alias("e")) for n, b in sorted(bands.items())])
    # Words and hashes are bound once by transforms over arrays of one item, and exploding only the arrays of documents
    # that share a shingle with a template is a generator, through which no filter is pushed: a plain filter on the
    # hashes would be moved below them, with the split written again into each step of the loop over words.
    def relevant(w: Column) -> Column:
        pair = F.transform(F.array(_hashes(w)), lambda h: F.struct(w.alias("w"), h.alias("h")))
        return F.filter(pair, lambda p: F.arrays_overlap(p["h"], every))

    # Texts without a needle need no hashes.
    some = F.array(*[F.lit(w) for w in needles({n: w for n, w in split.items() if w}, contained)])
    hits = F.flatten(F.transform(F.filter(F.array(words_of(F.col(text_col))), lambda w: F.arrays_overlap(w, some)), relevant))
    hashed = docs.select(F.col(id_col).alias("doc_id"), F.explode(hits).alias("_hit")).select("doc_id", F.col("_hit.w").alias("_words"), F.col("_hit.h").alias("_h"))
    windows = (
        hashed.select("doc_id", "_words", "_h", F.explode(F.filter(classes, lambda c: F.arrays_overlap(F.col("_h"), c["e"]))).alias("_c"))
        .select("doc_id", "_words", "_h", "_c", F.explode(F.sequence(F.lit(0), F.size("_words") - 1, F.col("_c.n"))).alias("first_word"))
        .withColumn("_own", F.slice("_h", F.col("first_word") + 1, F.col("_c.w") - (K - 1)))
        .filter(F.arrays_overlap("_own", F.col("_c.e")))
        .select("doc_id", "first_word", F.col("_c.n").alias("n"), F.slice("_words", F.col("first_word") + 1, F.col("_c.w")).alias("_part"), F.posexplode(_signature(F.col("_own"), F.col("_c.b"))).alias("_band", "_value"))
    )
    sizes = F.create_map(*[F.lit(v) for item in sorted(bands.items()) for v in item])
    signed = known.select("name", "n", "_kinds", F.posexplode(_signature(F.col("_hashes"), sizes[F.col("n")])).alias("_band", "_value"))
    retrieved = windows.join(F.broadcast(signed), ["n", "_band", "_value"]).select("doc_id", "first_word", "name", "_kinds", "_part")
    hit = F.size(F.array_intersect(_strings(F.col("_part")), "_kinds"))
    verified = retrieved.withColumn("matched", hit.cast("long")).filter(F.col("matched") >= F.lit(contained) * F.size("_kinds") - 1e-9)
    best = verified.groupBy("doc_id", "name", F.size("_kinds").cast("long").alias("template_shingles")).agg(F.min(F.struct((-F.col("matched")).alias("m"), "first_word")).alias("_b"))
    return best.select("doc_id", F.col("name").alias("license"), "template_shingles", (-F.col("_b.m")).alias("matched"), F.col("_b.first_word").cast("long").alias("first_word"))


def op9(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op9_short(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), SHORT_TEMPLATES)


def oracle() -> str:
    """The same by an index of all shingles and their positions, without windows' signatures."""
    rows = ", ".join("('" + name + "', '" + text.replace("'", "''") + "')" for name, text in sorted(TEMPLATES.items()))
    words = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '')"
    grams = "list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i+4], ' '))"
    return f"""
WITH t AS (SELECT name, {words} AS w FROM (VALUES {rows}) v(name, text)),
tg AS (SELECT name, len(w) AS n, unnest(list_distinct({grams})) AS g FROM t WHERE len(w) >= {K}),
tk AS (SELECT name, count(*) AS kinds FROM tg GROUP BY name),
d AS (SELECT doc_id, {words} AS w FROM documents),
dg AS (SELECT doc_id, len(w) AS words, unnest({grams}) AS g, unnest(range(0, greatest(len(w) - 4, 0))) AS pos FROM d),
m AS (SELECT dg.doc_id, dg.words, tg.name, tg.n, dg.g, dg.pos FROM dg JOIN tg ON dg.g = tg.g),
wins AS (SELECT *, unnest(range(greatest(0, pos // n - 2), pos // n + 1)) * n AS first_word FROM m),
held AS (
  SELECT doc_id, name, first_word, count(DISTINCT g) AS matched FROM wins
  WHERE first_word <= pos AND pos + {K} <= first_word + (5 * n + 1) // 2 AND first_word < words
  GROUP BY doc_id, name, first_word
),
good AS (SELECT h.*, kinds FROM held h JOIN tk ON h.name = tk.name WHERE matched >= {CONTAINED} * kinds - 1e-9),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY matched DESC, first_word) AS k FROM good)
SELECT doc_id, name AS license, CAST(kinds AS BIGINT) AS template_shingles, CAST(matched AS BIGINT) AS matched, CAST(first_word AS BIGINT) AS first_word
FROM ranked WHERE k = 1
"""
