"""License scan: normalised text against licence templates, by the Dice coefficient over word bigrams.

A unit of text (each line, the whole text, and windows of a template's length about bigrams of it) is
normalised to lower-case words. A template is compared only with units whose number of bigrams lets the
coefficient reach the bound: of sizes a and b it is at most 2 min(a, b) / (a + b). By the same bound each match
holds one of a few telling words, so texts without them are done at once. Everything is a column
expression: no shuffle, no Python.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Notices and texts of public licences, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}

_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_HOPE = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details."

#: Whole texts of short public licences, whole file notices of long ones, and the words that long texts begin with.
WHOLE_TEXTS = {
    "MIT": [
        TEMPLATES["MIT"][1] + " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY,
    ],
    "BSD-2-Clause": [_BSD + _BSD_END],
    "BSD-3-Clause": [_BSD + _BSD_3 + _BSD_END],
    "ISC": [
        TEMPLATES["ISC"][0] + " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ],
    "BSL-1.0": [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 " + TEMPLATES["Apache-2.0"][2] + " See the License for the specific language governing permissions and limitations under the License.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions.",
    ],
    "GPL-3.0": [
        TEMPLATES["GPL-3.0"][1] + " " + _HOPE.format("General Public License"),
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    ],
    "GPL-2.0": [
        TEMPLATES["GPL-2.0"][1] + " " + _HOPE.format("General Public License"),
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The licenses for most software are designed to take away your freedom to share and change it.",
    ],
    "LGPL-3.0": [
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
}


@dataclass(frozen=True)
class Template:
    name: str
    words: tuple[str, ...]

    @property
    def bigrams(self) -> tuple[str, ...]:
        return tuple(sorted(set(self.pairs)))

    @property
    def pairs(self) -> list[str]:
        return [f"{a} {b}" for a, b in zip(self.words, self.words[1:], strict=False)]

    def sizes(self, least: float) -> tuple[int, int]:
        """The fewest and the most bigrams with which a text can reach the coefficient ``least``."""
        n = len(self.bigrams)
        fewest = -(-round(n * least * 1e9) // round((2 - least) * 1e9))
        return max(1, fewest), int(n * (2 - least) / least + 1e-9)

    def anchors(self) -> list[tuple[str, int]]:
        """(bigram, place): in each third of the template the longest bigram that stands there only."""
        pairs, out = self.pairs, []
        for k in range(3):
            own = [(len(g), g, i) for i, g in enumerate(pairs) if i * 3 // len(pairs) == k and pairs.count(g) == 1]
            out += [(g, i) for _, g, i in sorted(own)[-1:]]
        return out


#: Words of the templates that much other prose holds as well; others tell more.
COMMON = frozenset("under without following possible provided required version product source particular related subject specific conditions including otherwise program published works general public this you with from that was not but are and the for any all may can has have to of in is an or as at on it if be by so no do we one must such shall only its".split())


def _weight(word: str) -> float:
    """How much a word tells by its looks: single characters and common words least, long words most."""
    return 0.0005 if len(word) == 1 else 0.001 if word in COMMON else max(0.03, len(word) - 4)


def telling_words(known: list[Template], least: float) -> list[str]:
    """Words one of which stands in every text that reaches ``least`` with any template: without them too few of its bigrams are left.

    Chosen one after the other, by how many bigrams of templates not yet done they stand in; long words count for more.
    """
    open_ = [(set(t.bigrams), t.sizes(least)[0]) for t in known]
    out: list[str] = []
    while open_:
        gain: dict[str, float] = {}
        for left, fewest in open_:
            held: dict[str, int] = {}
            for g in left:
                for w in set(g.split()):
                    held[w] = held.get(w, 0) + 1
            for w, n in held.items():
                gain[w] = gain.get(w, 0.0) + min(n, len(left) - fewest + 1)
        out.append(max(gain, key=lambda w: (gain[w] * _weight(w), w)))
        open_ = [({g for g in left if out[-1] not in g.split()}, fewest) for left, fewest in open_]
        open_ = [(left, fewest) for left, fewest in open_ if len(left) >= fewest]
    return sorted(out)


def normal_words(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", _lower(text)) if w]


def _lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def templates(texts: dict[str, list[str]] | None = None) -> list[Template]:
    if texts is None:
        texts = {name: TEMPLATES.get(name, []) + WHOLE_TEXTS.get(name, []) for name in {**TEMPLATES, **WHOLE_TEXTS}}
    out = [Template(name, tuple(normal_words(text))) for name, own in texts.items() for text in own]
    return [t for t in out if t.bigrams]


def _words(unit: Column) -> Column:
    return F.filter(F.split(F.translate(unit, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]+"), lambda w: w != "")


def _pairs(words: Column) -> Column:
    at = F.sequence(F.lit(1), F.size(words) - 1)
    return F.transform(at, lambda k: F.concat_ws(" ", F.element_at(words, k), F.element_at(words, k + 1)))


def _list(items: list[str]) -> Column:
    """An array of strings that the optimiser makes one literal."""
    return F.split(F.lit("|".join(items)), "\\|")


def _dice(pairs: Column, bigrams: Column, n: Column | int) -> Column:
    return 2.0 * F.size(F.array_intersect(pairs, bigrams)) / (F.size(pairs) + n)


def license_scan(docs: DataFrame, least: float = 0.8, texts: dict[str, list[str]] | None = None) -> DataFrame:
    """doc_id, n_units, n_matches, licenses, best_license, best_dice: one row per input row.

    Units are the lines of the text and, where it has more than one, the whole text; n_units counts
    them. Each is compared with all templates. Besides, wherever a template's anchor, one of three
    of its bigrams, stands in the text's words, line breaks or not, the window of the template's number of words
    that puts the anchor in its place is compared with that template, so that wrapped and embedded notices are found.
    A match is 2 |A & B| / (|A| + |B|) >= ``least`` for the sets of word bigrams. licenses are
    the distinct names of all matches, sorted; best is the match with the largest coefficient, ties
    to the smaller name; both are empty or null without a match. A null or empty text has one
    empty unit. Repeated rows and null ids come out as they stand; extra columns are ignored.

    Bigrams are built only for texts that hold a telling word (see telling_words), which any match does.
    """
    known = templates(texts)
    bounds = [t.sizes(least) for t in known]
    fewest, most = min(lo for lo, _ in bounds), max(hi for _, hi in bounds)
    telling = telling_words(known, least)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.split(text, "\n", -1)
    small = F.lower(text)
    # of the telling words as parts of others, the shortest say all: first a look for bytes, then for words
    roots = [w for w in telling if not any(v != w and v in w for v in telling)]
    may = reduce(lambda a, b: a | b, (F.contains(small, F.lit(w)) for w in roots))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.size(lines).alias("n_lines"), F.when(may, text).alias("text"))
    rows = rows.withColumn("words", F.when(F.col("text").isNotNull(), _words(F.col("text"))))
    hit = F.coalesce(F.arrays_overlap("words", _list(telling)), F.lit(False)) & (F.size("words") > fewest)
    found = F.concat(_of_units(F.col("text"), known, bounds, fewest, most, telling, least), _of_windows(F.col("words"), known, least))
    rows = rows.select("doc_id", (F.col("n_lines") + (F.col("n_lines") > 1).cast("int")).cast("long").alias("n_units"), F.when(hit, found).alias("found"))
    best = F.element_at(F.array_sort(F.transform("found", lambda x: F.struct((-x["dice"]).alias("d"), x["name"].alias("name")))), 1)
    best = F.when(F.size("found") > 0, best)
    return rows.select(
        "doc_id",
        "n_units",
        F.coalesce(F.array_size("found"), F.lit(0)).cast("long").alias("n_matches"),
        F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda x: x["name"]))), ","), F.lit("")).alias("licenses"),
        best["name"].alias("best_license"),
        F.round(-best["d"], 6).alias("best_dice"),
    )


def _of_units(text: Column, known: list[Template], bounds: list[tuple[int, int]], fewest: int, most: int, telling: list[str], least: float) -> Column:
    """The matches of the lines and of the whole text."""
    lines = F.split(text, "\n", -1)
    units = F.when(F.size(lines) > 1, F.concat(lines, F.array(text))).otherwise(lines)
    # cheap bounds come first: a unit with fewer words than the smallest template's bound has too few bigrams
    units = F.transform(F.filter(units, lambda u: F.length(u) >= 2 * fewest + 1), _words)
    units = F.filter(units, lambda w: (F.size(w) > fewest) & F.arrays_overlap(w, _list(telling)))
    sets = F.filter(F.transform(units, lambda w: F.array_distinct(_pairs(w))), lambda b: F.size(b).between(fewest, most))

    def scored(b: Column) -> Column:
        found = [
            F.when(F.size(b).between(lo, hi), F.struct(_dice(b, _list(list(t.bigrams)), len(t.bigrams)).alias("dice"), F.lit(t.name).alias("name")))
            for t, (lo, hi) in zip(known, bounds, strict=True)
        ]
        return F.filter(F.array(*found), lambda x: x.isNotNull() & (x["dice"] >= least))

    return F.flatten(F.transform(sets, scored))


def _of_windows(words: Column, known: list[Template], least: float) -> Column:
    """The matches of the windows about anchors, each window against the anchor's template."""
    table = F.array(*(F.struct(F.lit(t.name).alias("name"), F.lit(len(t.words)).alias("words"), F.lit(len(t.bigrams)).alias("n"), _list(list(t.bigrams)).alias("bigrams")) for t in known))
    at: dict[str, list[tuple[int, int]]] = {}
    for number, t in enumerate(known, 1):
        for bigram, place in t.anchors():
            at.setdefault(bigram, []).append((number, place))
    anchors = F.map_from_arrays(_list(list(at)), F.array(*(F.array(*(F.struct(F.lit(n).alias("t"), F.lit(p).alias("p")) for n, p in own)) for own in at.values())))

    def score(w: Column, pairs: Column) -> Column:
        t = F.element_at(table, w["t"])
        first = F.greatest(w["first"], F.lit(1))
        own = F.array_distinct(F.slice(pairs, first, w["first"] + t["words"] - 1 - first))
        return F.struct(_dice(own, t["bigrams"], t["n"]).alias("dice"), t["name"].alias("name"))

    def windows(pairs: Column) -> Column:
        hits = F.transform(pairs, lambda g, k: F.transform(F.try_element_at(anchors, g), lambda a: F.struct(a["t"].alias("t"), (k + 1 - a["p"]).alias("first"))))
        found = F.transform(F.array_distinct(F.flatten(F.filter(hits, lambda x: x.isNotNull()))), lambda w: score(w, pairs))
        return F.when(F.arrays_overlap(pairs, _list(list(at))), F.filter(found, lambda x: x["dice"] >= least)).otherwise(F.array().cast("array<struct<dice:double,name:string>>"))

    # a one-element array binds the pairs, so that they are built once
    return F.flatten(F.transform(F.array(_pairs(words)), windows))


def oracle_sql(least: float = 0.8) -> str:
    """The same scan for DuckDB, without the pruning."""
    quoted = lambda items: ", ".join(map(repr, items))
    known = ", ".join(f"({k}, '{t.name}', {len(t.words)}, [{quoted(t.bigrams)}])" for k, t in enumerate(templates()))
    anchors = ", ".join(f"({k}, {g!r}, {p})" for k, t in enumerate(templates()) for g, p in t.anchors())
    words = "list_filter(string_split_regex(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda x: x <> '')"
    return f"""
WITH t(tid, name, n_words, grams) AS (VALUES {known}),
a(tid, gram, place) AS (VALUES {anchors}),
l AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
u AS (SELECT r, unnest(CASE WHEN len(lines) > 1 THEN list_append(lines, text) ELSE lines END) AS unit FROM l),
w AS (SELECT r, {words.format("unit")} AS words FROM u),
g AS (SELECT r, list_distinct([words[k] || ' ' || words[k + 1] for k in range(1, len(words))]) AS grams FROM w),
m AS (SELECT r, name, 2.0::DOUBLE * len(list_intersect(g.grams, t.grams)) / (len(g.grams) + len(t.grams)) AS dice
      FROM g JOIN t ON len(g.grams) <= len(t.grams) * {(2 - least) / least + 1e-9} AND len(g.grams) > 0),
x AS (SELECT r, {words.format("text")} AS words FROM l),
b AS (SELECT r, [words[k] || ' ' || words[k + 1] for k in range(1, len(words))] AS pairs FROM x WHERE len(words) > 1),
p AS (SELECT r, unnest(pairs) AS gram, unnest(range(1, len(pairs) + 1)) AS k FROM b),
v AS (SELECT DISTINCT r, tid, k - place AS first FROM p JOIN a USING (gram)),
y AS (SELECT r, name, t.grams, list_distinct(list_slice(pairs, greatest(first, 1), least(first + n_words - 2, len(pairs)))) AS own FROM v JOIN t USING (tid) JOIN b USING (r)),
z AS (SELECT r, name, dice FROM m UNION ALL SELECT r, name, 2.0::DOUBLE * len(list_intersect(own, grams)) / (len(own) + len(grams)) FROM y),
h AS (SELECT r, count(*) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses, max(dice) AS dice,
      min(struct_pack(d := -dice, name := name)).name AS name FROM z WHERE dice >= {least} GROUP BY r)
SELECT doc_id, CAST(CASE WHEN len(lines) > 1 THEN len(lines) + 1 ELSE 1 END AS BIGINT) AS n_units, coalesce(n, 0) AS n_matches,
       coalesce(licenses, '') AS licenses, name AS best_license, round(dice, 6) AS best_dice
FROM l LEFT JOIN h USING (r)"""
