r"""License scans: parts of a text against licence templates by Dice coefficient over word bigrams.

A text's parts are the sentences of its lines, the sentences of its paragraphs (lines
joined, so that hard-wrapped notices are whole; comment gutters are signs that
normalising drops, and a line of signs alone ends a paragraph), its paragraphs and
the whole text.  Templates are notices, licence paragraphs and whole licences.  A part
is normalised (lower case, everything but letters, digits and inner dots to single
spaces) and becomes its set of word bigrams.  Dice >= t needs a set between
t / (2 - t) and (2 - t) / t of the template's size, and at least t / (2 - t) of the
template's bigrams: all but ``spare`` of them, so any spare + 1 of them hold one that
the part shares.  Both bounds prune before any set is intersected; a text without
any word of such probes isn't cut at all.  Everything is DataFrame expressions, with no
shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridscope.llm.scratch import fresh

THRESHOLD = 0.8

# Notice sentences of public licences, (identifier, text).
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
)

# Paragraphs of public licences and of the notices that they ask for.
_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS %sBE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_SOURCE = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_BINARY = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAME = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
LICENCES = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        _WARRANTY % "OR COPYRIGHT HOLDERS ",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "BSD-2-Clause": (_BSD_HEAD, _BSD_SOURCE, _BSD_BINARY, _BSD_WARRANTY),
    "BSD-3-Clause": (_BSD_HEAD, _BSD_SOURCE, _BSD_BINARY, _BSD_NAME, _BSD_WARRANTY),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
        _WARRANTY % "",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    ),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
}


def _templates() -> tuple[tuple[str, str], ...]:
    """(identifier, text): the notices, each licence's paragraphs, and each one of several paragraphs as a whole.

    A paragraph of several licences stands once, under the first.
    """
    out = list(NOTICES)
    for name, paragraphs in LICENCES.items():
        whole = [(name, " ".join(paragraphs))] if len(paragraphs) > 1 else []
        out += [(name, p) for p in paragraphs if all(p != q for _, q in out)] + whole
    return tuple(out)


TEMPLATES = _templates()


def _py_words(text: str) -> list[str]:
    return re.sub(r"\.(?![a-z0-9])|[^a-z0-9.]+", " ", text.lower()).split()


def _py_bigrams(text: str) -> list[str]:
    w = _py_words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:])))


def bounds(size: int, threshold: float) -> tuple[int, int, int]:
    """Smallest and largest sentence set for a template set of this size, and how many bigrams may be missing."""
    eps = 1e-9
    low = -int(-(size * threshold / (2 - threshold) - eps) // 1)
    return low, int(size * (2 - threshold) / threshold + eps), size - low


def probes(templates=TEMPLATES, threshold: float = THRESHOLD) -> list[str]:
    """For each template spare + 1 of its bigrams: those with its longest words, as far as no others are probes yet."""
    out: dict[str, None] = {}
    for _, t in templates:
        s = _py_bigrams(t)
        need = bounds(len(s), threshold)[2] + 1 - sum(b in out for b in s)
        for b in sorted((b for b in s if b not in out), key=lambda b: (-max(map(len, b.split())), b))[: max(0, need)]:
            out[b] = None
    return list(out)


def probe_words(probe: list[str]) -> list[str]:
    """Substrings of which every text with a probe has one: each probe's longest word, without those that hold another."""
    words = sorted({max(b.split(), key=lambda w: (len(w), w)) for b in probe}, key=lambda w: (len(w), w))
    return [w for i, w in enumerate(words) if not any(v in w for v in words[:i])]


def parts(text: Column) -> Column:
    """The distinct normalised sentences of lines, sentences of paragraphs, paragraphs and the whole of a lower-case text.

    An end is a run of .!?;: before white space; a paragraph ends at a line without a
    letter or digit.  No expression looks at a character more than a few times.
    """
    ends = F.regexp_replace(text, r"(?<![.!?;:])[.!?;:]++(?=[ \t\n\x0B\f\r]|$)", "\x01")
    ends = F.regexp_replace(F.regexp_replace(ends, r"\r\n?", "\n"), r"[^a-z0-9.\n\x01]+", " ")
    # a line of spaces and ends only: \x02 stands for the paragraph's end
    cut = F.regexp_replace(ends, r"\n[ \x01]*+\n[ \x01\n]*+", "\x02")
    flat = F.replace(cut, F.lit("\n"), F.lit(" "))
    by_line = F.split(F.translate(ends, "\x01", "\n"), "\n")
    by_sentence = F.split(F.translate(flat, "\x02", "\x01"), "\x01")
    by_paragraph = F.split(F.translate(flat, "\x01", " "), "\x02")
    whole = F.array(F.translate(flat, "\x01\x02", "  "))
    return F.array_distinct(F.transform(F.concat(by_line, by_sentence, by_paragraph, whole), lambda s: F.trim(F.regexp_replace(s, " {2,}", " "))))


def bigrams(sentence: Column) -> Column:
    words = F.split(F.trim(F.regexp_replace(sentence, r"\.(?![a-z0-9])", " ")), " +")
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.lit(0), F.size(words) - 1)), F.slice(words, F.lit(2), F.greatest(F.lit(0), F.size(words) - 1)), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(pairs)


def _texts(values: list[str]) -> Column:
    """An array of texts without |, as one literal."""
    return F.split(F.lit("|".join(values)), r"\|") if values else F.array().cast("array<string>")


def scan(docs: DataFrame, text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD, hits: str = "license_hits") -> DataFrame:
    """docs with license_hits: array<struct<license, template, dice, shared, sentence>>, best first.

    One hit per template that some part of the text reaches the threshold with: its best
    part (the first by letters of equal ones).  More shared bigrams are better; ties by
    licence, then template.  Null and empty texts have none; every row stays, repeated
    ones too; a column named like the hits is replaced, others stay.
    """
    sets = [_py_bigrams(t) for _, t in templates]
    limits = [bounds(len(s), threshold) for s in sets]
    probe = probes(templates, threshold)
    low, high = min(a for a, _, _ in limits), max(b for _, b, _ in limits)
    lower, kept_name = fresh(docs, "lower"), fresh(docs, "parts")
    told = F.lit(False)
    for w in probe_words(probe):
        told = told | F.contains(lower, F.lit(w))
    # fewer than low bigrams need at least low + 1 words of a letter
    units = F.filter(parts(F.col(lower)), lambda s: F.length(s) > 2 * low)
    sized = F.transform(units, lambda s: F.struct(s.alias("sentence"), bigrams(s).alias("set")))
    kept = F.filter(sized, lambda u: F.size(u["set"]).between(low, high) & F.arrays_overlap(u["set"], _texts(probe)))
    rows = docs.withColumn(lower, F.lower(F.col(text_col).cast("string"))).withColumn(kept_name, F.when(told, kept)).drop(lower)
    table = F.array(*[
        F.struct(F.lit(name).alias("license"), F.lit(i).alias("template"), F.lit(len(s)).alias("n"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), _texts(s).alias("set"))
        for i, ((name, _), s, (lo, hi, _)) in enumerate(zip(templates, sets, limits))
    ])

    def against(t: Column) -> Column:
        def one(u: Column) -> Column:
            both = F.when(F.size(u["set"]).between(t["lo"], t["hi"]), F.size(F.array_intersect(u["set"], t["set"])))
            dice = F.lit(2.0) * both / (F.size(u["set"]) + t["n"])
            return F.struct((-dice).alias("order"), u["sentence"].alias("sentence"), both.alias("shared"))

        found = F.filter(F.transform(F.col(kept_name), one), lambda h: F.coalesce(-h["order"] >= threshold, F.lit(False)))
        return F.struct(t["license"].alias("license"), t["template"].alias("template"), F.array_min(found).alias("best"))

    got = F.filter(F.transform(table, against), lambda h: h["best"].isNotNull())
    got = F.array_sort(F.transform(got, lambda h: F.struct((-h["best"]["shared"]).alias("order"), h["license"].alias("license"), h["template"].alias("template"), h["best"].alias("best"))))
    shaped = F.transform(got, lambda h: F.struct(h["license"].alias("license"), h["template"].alias("template"), (-h["best"]["order"]).alias("dice"), h["best"]["shared"].alias("shared"), h["best"]["sentence"].alias("sentence")))
    kind = "array<struct<license:string,template:int,dice:double,shared:int,sentence:string>>"
    some = F.when(F.size(kept_name) > 0, shaped)
    return rows.withColumn(hits, F.coalesce(some, F.from_json(F.lit("[]"), kind))).drop(kept_name)


def report(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    best = F.try_element_at("license_hits", F.lit(1))
    return scanned.select(
        F.col(id_col).alias("doc_id"),
        best["license"].alias("license"),
        F.round(best["dice"], 6).alias("dice"),
        F.size("license_hits").cast("long").alias("n_hits"),
    )


def sql(templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same for DuckDB by another way: lines are numbered into paragraphs and words joined to templates, without any pruning."""
    rows = ", ".join(f"({i}, '{n}', '{t.replace(chr(39), chr(39) * 2)}')" for i, (n, t) in enumerate(templates))
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, replace(replace(lower(coalesce(text, '')), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM documents),
line AS (SELECT r, i, regexp_replace(regexp_replace(x, '[.!?;:]+([ \t\x0B\f]|$)', chr(1) || '\1', 'g'), '[^a-z0-9.\x01]+', ' ', 'g') AS x
         FROM (SELECT r, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs)),
numbered AS (SELECT *, sum(CASE WHEN regexp_matches(x, '[a-z0-9.]') THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS p FROM line),
para AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS x FROM numbered GROUP BY r, p),
unit AS (SELECT DISTINCT r, s FROM (
    SELECT r, unnest(string_split(x, chr(1))) AS s FROM line UNION ALL SELECT r, unnest(string_split(x, chr(1))) FROM para
    UNION ALL SELECT r, replace(x, chr(1), ' ') FROM para
    UNION ALL SELECT r, string_agg(replace(x, chr(1), ' '), ' ' ORDER BY i) FROM line GROUP BY r)),
text AS (SELECT s, -1 AS template, row_number() OVER () AS u FROM (SELECT DISTINCT s FROM unit)
         UNION ALL SELECT lower(c), i, -1 - i FROM (VALUES {rows}) v(i, n, c)),
tmpl AS (SELECT i AS template, n AS license FROM (VALUES {rows}) v(i, n, c)),
word AS (SELECT u, template, list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(s || ' ', '[^a-z0-9.]+', ' ', 'g'), '\.+(\.[a-z0-9])', ' \1', 'g'), '\.+ ', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM text),
gram AS (SELECT DISTINCT u, template, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS b FROM word WHERE len(w) > 1),
size AS (SELECT u, template, count(*) AS n FROM gram GROUP BY ALL),
shares AS (SELECT a.u, b.template, count(*) AS n FROM gram a JOIN gram b USING (b) WHERE a.template < 0 AND b.template >= 0 GROUP BY ALL),
dice AS (SELECT shares.u, shares.template, shares.n AS shared, 2.0 * shares.n / (x.n + y.n) AS dice
         FROM shares JOIN size x ON x.u = shares.u JOIN size y ON y.template = shares.template WHERE 2.0 * shares.n / (x.n + y.n) >= {threshold}),
best AS (SELECT r, dice.template AS template, min((-dice, regexp_replace(trim(s), ' +', ' ', 'g'), shared)) AS h FROM unit JOIN text USING (s) JOIN dice USING (u) WHERE text.template < 0 GROUP BY r, dice.template),
top AS (SELECT r, arg_min(struct_pack(license, d := -h[1]), (-h[3], license, template)) AS b, count(*) AS n FROM best JOIN tmpl USING (template) GROUP BY r)
SELECT doc_id, b.license AS license, round(b.d, 6)::DOUBLE AS dice, coalesce(n, 0)::BIGINT AS n_hits FROM docs LEFT JOIN top USING (r)
"""


SQL = sql()
