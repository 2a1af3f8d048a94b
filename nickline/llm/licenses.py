"""License scans by diagonal voting, in DataFrame operations only.

The hashes of all rolling word k-grams of the texts are joined with those of the templates.  A hit votes for a diagonal (its place in
the text less its place in the template); neighbouring diagonals are merged, and a span counts if enough of its template's
words are covered.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, table

K = 3
#: Diagonals that lie so close are one passage with words put in or left out.
SLACK = 2
#: Least share of a template's words that a span must cover.
COVER = 0.8

#: Base phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Grams of templates that may be broadcast; more meet the texts' grams in a shuffle.
BROADCAST_GRAMS = 200_000
#: Public notices by which the method finds labels of its own.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
        CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
        OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
        obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See
        the License for the specific language governing permissions and limitations under the License."""),
    ("apache", "you may not use this file except in compliance with the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the
        Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that
        it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
        GNU General Public License for more details."""),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2.
        Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its
        contributors may be used to endorse or promote products derived from this software without specific prior written permission."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
        copyright notice and this permission notice appear in all copies."""),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file,
        You can obtain one at https://mozilla.org/MPL/2.0/."""),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text):
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z in lower case, in JVM expressions."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def grams(templates) -> list[tuple[str, str, str, int, int, int, str]]:
    """(three words, template, place in it, its number of words, label)."""
    out = []
    for t, (label, text) in enumerate(templates):
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.translate(str.maketrans(_UPPER, _LOWER)))
        out += [(*w[i : i + K], t, i, len(w), label) for i in range(len(w) - K + 1)]
    return out


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of docs.

    One pass over the texts makes all rolling k-grams and joins their hashes with the templates'; only a text's first gram and grams that
    hit are written.  The templates' side is broadcast up to BROADCAST_GRAMS.  Rows are keyed by id and a hash of the text: repeated rows have equal
    results, rows of one id and other texts their own; null ids join as equals.  Null and empty texts have no words and no labels; texts of any
    length are read whole.  score: the largest covered share of a template, and at least 0.5 where a base phrase stands.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    key = [F.col("doc_id").alias("key_id"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), F.length("text"), "text").alias("h2")]
    words = rows.select(*key, words_of(F.col("text")).alias("w"))
    shifted = lambda n: F.slice("w", n + 1, F.greatest(F.size("w"), F.lit(1)))
    each = F.arrays_zip(F.col("w").alias("a"), shifted(1).alias("b"), shifted(2).alias("c"))
    gram = words.select("key_id", "h1", "h2", F.size("w").cast("bigint").alias("n_words"), F.posexplode_outer(each).alias("pos", "g"))
    gram = gram.select("key_id", "h1", "h2", "n_words", "pos", F.col("g.a").alias("a"), F.col("g.b").alias("b"), F.col("g.c").alias("c"))

    base = F.lit(None).cast("string")
    for phrase, label in PHRASES:
        here = F.lit(True)
        for word, column in zip(phrase.split(), "abc"):
            here = here & F.col(column).eqNullSafe(word)
        base = F.when(here, F.lit(label)).otherwise(base)
    known = grams(templates)
    table_ = spark.createDataFrame(known, "ta string, tb string, tc string, template int, place int, length int, label string")
    table_ = table_.groupBy("ta", "tb", "tc").agg(F.collect_list(F.struct("template", "place", "length", "label")).alias("hits"))
    table_ = F.broadcast(table_) if len(known) <= BROADCAST_GRAMS else table_
    same = (F.xxhash64("a", "b", "c") == F.xxhash64("ta", "tb", "tc")) & (F.col("a") == F.col("ta")) & (F.col("b") == F.col("tb")) & (F.col("c") == F.col("tc"))
    found = gram.withColumn("base", base).join(table_, same, "left").filter("base IS NOT NULL OR hits IS NOT NULL OR pos IS NULL OR pos = 0")
    found = saved(found.select("key_id", "h1", "h2", "n_words", "pos", "base", "hits"), "grams")

    by = ["key_id", "h1", "h2"]
    hits = found.filter("hits is not null").select(*by, "pos", F.explode("hits").alias("hit")).select(*by, "pos", "hit.*")
    diagonals = hits.groupBy(*by, "template", "length", "label", (F.col("pos") - F.col("place")).alias("diagonal")).agg(F.collect_set("place").alias("places"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    along = Window.partitionBy(*by, "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(along)
    merged = diagonals.withColumn("new", F.when(gap <= SLACK, 0).otherwise(1)).withColumn("passage", F.sum("new").over(along))
    passages = merged.groupBy(*by, "template", "length", "label", "passage").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.min("first").alias("first"), (F.max("last") + K).alias("end"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + (K - 1))))))
    cover = covered / F.col("length")
    verified = passages.withColumn("cover", cover).filter((F.col("cover") >= COVER) & (F.col("end") - F.col("first") <= F.greatest(F.col("length") + 2 * SLACK, F.col("length") / COVER)))

    spans = verified.groupBy(*by).agg(F.collect_set("label").alias("own"), F.max("cover").alias("cover"))
    at = F.when(F.col("base").isNotNull(), F.col("pos"))
    copies = F.count(F.when(F.coalesce("pos", F.lit(0)) == 0, 1))  # of the row: each has the same places
    based = found.groupBy(*by).agg(F.max("n_words").alias("n_words"), (F.count("base") / copies).cast("bigint").alias("n_base"), F.min(at).alias("first_word"), F.max(at).alias("last_word"), F.collect_set("base").alias("base_set"))

    def left(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.select(*[F.col(c).alias(f"r_{c}" if c in by else c) for c in b.columns])
        return a.join(b, F.col("key_id").eqNullSafe(F.col("r_key_id")) & (F.col("h1") == F.col("r_h1")) & (F.col("h2") == F.col("r_h2")), "left").drop("r_key_id", "r_h1", "r_h2")

    out = left(rows.select(*key), left(based, spans))
    listed = lambda x: F.concat_ws(",", F.array_sort(x))
    none = F.array().cast("array<string>")
    return out.select(
        F.col("key_id").alias(doc_id), "n_words", F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"), F.col("first_word").cast("bigint"), F.col("last_word").cast("bigint"),
        listed(F.coalesce("base_set", none)).alias("base_labels"), listed(F.array_union(F.coalesce("base_set", none), F.coalesce("own", none))).alias("labels"),
        F.greatest(F.coalesce("cover", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)).cast("double").alias("score"),
    )


def op10_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


_WORDS = f"list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
_GRAMS = ", ".join(f"('{a} {b} {c}', {t}, {i}, {n}, '{label}')" for a, b, c, t, i, n, label in grams(TEMPLATES))
_BASES = " ".join(f"WHEN {' AND '.join(f'w[p + {i}] = {chr(39)}{x}{chr(39)}' for i, x in enumerate(phrase.split()))} THEN '{label}'" for phrase, label in PHRASES)

ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT rid, w, p FROM (SELECT rid, w, unnest(generate_series(1, len(w))) AS p FROM d)),
b AS (SELECT rid, p - 1 AS pos, CASE {_BASES} END AS label FROM p),
bb AS (SELECT rid, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS labels FROM b WHERE label IS NOT NULL GROUP BY rid),
k(gram, template, place, length, label) AS (VALUES {_GRAMS}),
h AS (SELECT rid, template, length, label, pos - place AS diagonal, place, pos FROM (SELECT rid, p - 1 AS pos, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS gram FROM p) JOIN k USING (gram)),
g AS (SELECT rid, template, length, label, diagonal, list(DISTINCT place) AS places, min(pos) AS first, max(pos) AS last FROM h GROUP BY ALL),
n AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY rid, template ORDER BY diagonal) <= {SLACK} THEN 0 ELSE 1 END AS new FROM g),
r AS (SELECT *, sum(new) OVER (PARTITION BY rid, template ORDER BY diagonal) AS passage FROM n),
v AS (SELECT rid, template, length, label, passage, flatten(list(places)) AS places, min(first) AS first, max(last) + {K} AS stop FROM r GROUP BY ALL),
c AS (SELECT *, CAST(len(list_distinct(flatten(list_transform(places, lambda x: generate_series(x, x + {K - 1}))))) AS DOUBLE) / length AS cover FROM v),
o AS (SELECT rid, list(DISTINCT label) AS labels, max(cover) AS cover FROM c WHERE cover >= {COVER}::DOUBLE AND stop - first <= greatest(length + {2 * SLACK}, length / {COVER}::DOUBLE) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(bb.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(bb.labels, []), coalesce(o.labels, [])))), ','), '') AS labels,
       greatest(coalesce(cover, 0.0::DOUBLE), CASE WHEN n_base > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS score
FROM d LEFT JOIN bb USING (rid) LEFT JOIN o USING (rid)
"""
