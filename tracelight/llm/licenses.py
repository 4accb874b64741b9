"""Licence scans by exact set-similarity join, in DataFrame functions only.

A block is any run of words, across line breaks, of a template's length and as many
words more as may be missing. It matches if it holds at least CONTAINMENT of the template's
distinct words, all of its `must` words, and none of its `bars`: names, versions and conditions
that tell a licence from those with nearly the same words (MIT from BSD, Attribution from
NonCommercial, the General from the Lesser and Affero Public Licence), which have templates of
their own.

The search is exact: tokens are put into one global order, rarest in the corpus first. A
text that holds a match must share a token of the template's prefix (prefix filter), hold
enough of its words (length filter), and the places of the first common token in both must leave
room for the overlap (positional filter). Only in texts that pass, and for the templates that
do, runs are looked at: from each word of the template to its reach, or the first barred word.

Beside this, phrases (fixed word runs) are counted and located.

Null and empty texts have no words and no labels. Rows are independent: no row
leaves its partition, so hot sources, copies and long texts or lines move no data. Extra
columns are ignored. With an empty table the global order is alphabetical.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import runtime as R

#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

class Template(NamedTuple):
    """A wording; words that a block must hold, and words that it must not."""

    text: str
    must: str = ""
    bars: str = ""


#: Words that make another licence of the General Public one, or of Attribution.
LESSER = "lesser library affero"
NC, ND, SA = "noncommercial nc", "noderivatives noderivs nd", "sharealike sa"

#: Wordings of public licences, of their notices, and of usual short mentions.
TEMPLATES = {
    "mit": Template("Released under the MIT License", "mit"),
    "mit-grant": Template("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    "mit-text": Template("""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    "isc-text": Template("""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    "bsd": Template("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    "bsd-mention": Template("Released under the BSD License", "bsd"),
    "bsd-2-text": Template("""Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    "bsd-3-clause": Template("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    "apache-2.0": Template("Licensed under the Apache License, Version 2.0", "apache 2 0"),
    "apache-mention": Template("Released under the Apache License", "released apache", "version v2 2"),
    "epl-2.0": Template("Licensed under the Eclipse Public License, Version 2.0", "eclipse 2 0"),
    "apache-2.0-notice": Template("""Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""", "apache 2 0"),
    "gpl-3.0": Template("This work is licensed under the GNU General Public License, version 3", "general public 3", LESSER),
    "gpl-2.0": Template("This work is licensed under the GNU General Public License, version 2", "general public 2", LESSER),
    "gpl-mention": Template("Licensed under the GPL License", "gpl"),
    "lgpl-3.0": Template("This work is licensed under the GNU Lesser General Public License, version 3", "lesser general public 3"),
    "agpl-3.0": Template("This work is licensed under the GNU Affero General Public License, version 3", "affero general public 3"),
    "gpl-notice": Template("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "general public", LESSER),
    "lgpl-notice": Template("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "lesser general public"),
    "agpl-notice": Template("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License", "affero general public"),
    "gpl-2.0-or-later-notice": Template("""This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""", "general public 2", LESSER),
    "mpl-2.0": Template("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla 2 0"),
    "cc-by-4.0": Template("This work is licensed under a Creative Commons Attribution 4.0 International License", "attribution 4 0", f"{NC} {ND} {SA}"),
    "cc-by-sa-4.0": Template("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "sharealike 4 0", f"{NC} {ND}"),
    "cc-by-nc-4.0": Template("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "noncommercial 4 0", f"{SA} {ND}"),
    "cc-by-nd-4.0": Template("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", "noderivatives 4 0", f"{NC} {SA}"),
    "cc-by-nc-sa-4.0": Template("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "noncommercial sharealike 4 0", ND),
    "cc-by-nc-nd-4.0": Template("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "noncommercial noderivatives 4 0", SA),
    "cc0-1.0": Template("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "waived"),
    "unlicense": Template("This is free and unencumbered software released into the public domain", "unencumbered"),
}
CONTAINMENT = (4, 5)
_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())


def needed(size: int) -> int:
    """Least overlap with a template of so many words."""
    a, b = CONTAINMENT
    return -(-size * a // b)


def reach(template: Template) -> int:
    """Words of a run that is a block for this template."""
    words = words_of(template.text)
    return len(words) + len(set(words)) - needed(len(set(words)))


def plain(text: Column) -> Column:
    """Words with one blank before, between and after. lower() changes no ASCII
    sign into a word sign, so the words' borders are those of A-Z lowering."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), _NO_WORD, " ")), F.lit(" "))


def token_order(docs: DataFrame) -> list[str]:
    """The templates' words, rarest first: documents that hold them are counted over
    the whole table. The result has one row per template word at most."""
    vocabulary = sorted({w for t in TEMPLATES.values() for w in words_of(t.text)})
    held = F.array_intersect(F.split(plain(F.coalesce(F.col("text"), F.lit(""))), " "), F.array(*map(F.lit, vocabulary)))
    counts = {r.w: r.n for r in docs.select(F.explode(held).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def _matches(text: Column, order: list[str]) -> Column:
    """array<struct<label, containment>> of the templates that a lowered text holds a
    block of, with the most words of it that one holds."""
    rank = {w: k for k, w in enumerate(order)}
    listed = lambda ws: F.array(*map(F.lit, ws)).cast("array<string>")
    templates, prefix_words = [], set()
    for label, t in TEMPLATES.items():
        words = sorted(set(words_of(t.text)), key=rank.__getitem__)
        need = needed(len(words))
        prefix = words[: len(words) - need + 1]
        prefix_words.update(prefix)
        parts = {"words": listed(words), "prefix": listed(prefix), "must": listed(t.must.split()), "bars": listed(t.bars.split()), "need": F.lit(need), "size": F.lit(len(words)), "reach": F.lit(reach(t))}
        templates.append(F.struct(F.lit(label).alias("label"), *[c.alias(n) for n, c in parts.items()]))
    any_prefix = r"(?<![^\x00-\x2F\x3A-\x60\x7B-\x7F])(?:" + "|".join(sorted(prefix_words)) + r")(?![^\x00-\x2F\x3A-\x60\x7B-\x7F])"

    def passes(t: Column, held: Column) -> Column:
        """held: the text's words that any template has, rarest first."""
        common = F.array_intersect(F.slice(held, 1, F.size(held) - t.need + 1), t.prefix)
        first = F.element_at(common, 1)
        room = 1 + F.least(t.size - F.array_position(t.words, first), F.size(held) - F.array_position(held, first))
        enough = (room >= t.need) & (F.size(F.array_intersect(held, t.words)) >= t.need) & (F.size(F.array_except(t.must, held)) == 0)
        return F.when(F.size(held) < t.need, False).otherwise(F.when(F.size(common) == 0, False).otherwise(enough))

    def most(t: Column, mine: Column) -> Column:
        """mine: places of the template's words and barred ones. The largest overlap of a run
        from one of them that holds all it must."""

        def overlap(x: Column, j: Column) -> Column:
            run = F.filter(F.slice(mine, j + 1, t.reach), lambda y: y.at < x.at + t.reach)
            stop = F.array_min(F.transform(F.filter(run, lambda y: F.array_contains(t.bars, y.w)), lambda y: y.at))
            run = F.when(F.size(t.bars) > 0, F.filter(run, lambda y: y.at < F.coalesce(stop, y.at + 1))).otherwise(run)
            words = F.array_distinct(F.transform(run, lambda y: y.w))
            # too few places within reach need no look
            return F.when(F.get(mine, j + t.need - 1).at < x.at + t.reach, F.when(F.size(F.array_except(t.must, words)) == 0, F.size(words)).otherwise(0)).otherwise(0)

        return F.coalesce(F.array_max(F.transform(mine, overlap)), F.lit(0))

    none = F.from_json(F.lit("[]"), "array<struct<label:string,containment:double>>")

    def counted(words: Column, likely: Column) -> Column:
        wanted = F.array_distinct(F.flatten(F.transform(likely, lambda t: F.concat(t.words, t.bars))))
        placed = F.filter(F.transform(words, lambda w, at: F.struct(at.alias("at"), w.alias("w"))), lambda x: F.array_contains(wanted, x.w))

        def found(all_: Column) -> Column:
            n = lambda t: F.element_at(F.transform(F.array(F.filter(all_, lambda x: F.array_contains(t.words, x.w) | F.array_contains(t.bars, x.w))), lambda mine: most(t, mine)), 1)
            best = F.transform(likely, lambda t: F.struct(t.label.alias("label"), t.need.alias("need"), t.size.alias("size"), n(t).alias("n")))
            return F.transform(F.filter(best, lambda c: c.n >= c.need), lambda c: F.struct(c.label.alias("label"), (c.n / c.size).alias("containment")))

        # arrays of one, so that what is in them is computed once
        return F.flatten(F.transform(F.array(placed), found))

    def of(words: Column) -> Column:
        held = F.array_intersect(listed(order), words)  # in the order of the first
        likely = F.flatten(F.transform(F.array(held), lambda h: F.filter(F.array(*templates), lambda t: passes(t, h))))
        return F.flatten(F.transform(F.array(likely), lambda ts: F.when(F.size(ts) > 0, counted(words, ts)).otherwise(none)))

    words = F.split(F.trim(F.regexp_replace(text, _NO_WORD, " ")), " ")
    return F.when(text.rlike(any_prefix), F.flatten(F.transform(F.array(words), of))).otherwise(none)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, words, phrase counts and places, labels and score of every text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = token_order(rows)
    spaces = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    rows = rows.select("doc_id", plain(F.col("text")).alias("p"), _matches(F.lower("text"), order).alias("found"))
    # every word between two blanks of its own: neighbouring places do not overlap
    held = None
    for phrase in PHRASES:
        has = F.contains(F.col("p"), F.lit(f" {phrase} "))
        held = has if held is None else held | has
    rows = rows.withColumn("n_words", F.when(F.col("p") == "  ", F.lit(0)).otherwise(spaces(F.col("p")) - 1).cast("long"))
    rows = rows.withColumn("q", F.when(held, F.replace(F.col("p"), F.lit(" "), F.lit("  "))))
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in PHRASES.items():
        mark = " " + phrase.replace(" ", "  ") + " "
        has = F.contains(F.col("q"), F.lit(mark))
        n = (F.length("q") - F.length(F.replace(F.col("q"), F.lit(mark), F.lit("")))) / len(mark)
        counts.append(F.when(has, n.cast("long")).otherwise(F.lit(0).cast("long")))
        # every word has two blanks, so blanks halved are words
        before = F.substring_index(F.col("q"), mark, 1)
        after = F.substring_index(F.col("q"), mark, -1)
        firsts.append(F.when(has, F.floor(spaces(before) / 2).cast("long")))
        lasts.append(F.when(has, F.col("n_words") - F.floor(spaces(after) / 2).cast("long") - len(phrase.split())))
        labels.append(F.when(has, F.lit(label)))
    rows = rows.withColumn("base", F.filter(F.array(*labels), lambda x: x.isNotNull())).withColumn("n_base", sum(counts[1:], counts[0]))
    more = F.transform("found", lambda x: x.label)
    return rows.select(
        "doc_id", "n_words", "n_base", F.least(*firsts).alias("first_word"), F.greatest(*lasts).alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", more)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("found", lambda x: x.containment)), F.lit(0.0))).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(R.table(spark, sf_dir, "documents"))


def _oracle() -> str:
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    listed = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]::VARCHAR[]"
    phrases = ", ".join(f"({listed(p.split())}, '{label}')" for p, label in PHRASES.items())
    templates = ", ".join(f"({listed(sorted(set(words_of(t.text))))}, '{label}', {needed(len(set(words_of(t.text))))}, {reach(t)}, {listed(t.must.split())}, {listed(t.bars.split())})" for label, t in TEMPLATES.items())
    return rf"""
WITH w AS (SELECT doc_id, regexp_extract_all({low}, {word}) AS words FROM documents),
ph AS (SELECT * FROM (VALUES {phrases}) v(p, label)),
tp AS (SELECT * FROM (VALUES {templates}) v(t, label, need, reach, must, bars)),
places AS (SELECT doc_id, label, k - 1 AS k FROM (SELECT doc_id, label, p, words, unnest(range(1, len(words) - len(p) + 2)) AS k FROM w, ph) WHERE words[k:k + len(p) - 1] = p),
b AS (SELECT doc_id, count(*) AS n_base, min(k) AS first_word, max(k) AS last_word FROM places GROUP BY doc_id),
likely AS (SELECT doc_id, tp.*, words FROM (SELECT *, list_distinct(words) AS d FROM w) w, tp WHERE len(list_intersect(d, t)) >= need AND len(list_intersect(d, must)) = len(must)),
tok AS (SELECT doc_id, label, need, reach, must, pos, wd, list_contains(bars, wd) AS bar FROM (SELECT *, words[pos] AS wd FROM (SELECT *, unnest(range(1, len(words) + 1)) AS pos FROM likely)) WHERE list_contains(t, wd) OR list_contains(bars, wd)),
runs AS (SELECT a.doc_id, a.label, a.pos, any_value(a.need) AS need, any_value(a.must) AS must, list(b.wd) AS xs FROM tok a JOIN tok b ON a.doc_id IS NOT DISTINCT FROM b.doc_id AND a.label = b.label AND b.pos >= a.pos AND b.pos < a.pos + a.reach
 LEFT JOIN (SELECT doc_id, label, pos AS bar_at FROM tok WHERE bar) z ON z.doc_id IS NOT DISTINCT FROM a.doc_id AND z.label = a.label AND z.bar_at >= a.pos AND z.bar_at <= b.pos WHERE z.bar_at IS NULL GROUP BY a.doc_id, a.label, a.pos),
hits AS (SELECT doc_id, label, len(list_distinct(xs)) / CAST(size AS DOUBLE) AS c FROM runs JOIN (SELECT label, len(t) AS size FROM tp) USING (label) WHERE len(list_distinct(xs)) >= need AND len(list_intersect(list_distinct(xs), must)) = len(must)),
labelled AS (SELECT doc_id, label, TRUE AS base, 1.0::DOUBLE AS c FROM places UNION ALL SELECT doc_id, label, FALSE, c FROM hits),
l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(c) AS score FROM labelled GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id)
"""


ORACLE = _oracle()
