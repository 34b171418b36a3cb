r"""License scans: parts of a text compared with licence templates by Dice over word bigrams.

The parts are the lines, the paragraphs of two or more lines, the whole text where it has two
or more paragraphs, and the windows: for each template, every run of as many words as it has
(fewer at the text's end) that begins with a bigram of it, so that a notice inside a longer
line and a licence inside a longer text are found. A part is normalised to lower-case runs of
letters and digits; its set of word bigrams A is compared with each template's set B by
2|A∩B| / (|A|+|B|). As |A∩B| is at most the smaller size, a template can only match a part
whose size lies in [|B| t/(2-t), |B| (2-t)/t]; these bounds, and one common bigram at least,
prune the pairs. For windows the same bound asks for |B| t/(2-t) bigrams of B inside, which is
read off the positions of such bigrams before any window is cut out.
Everything stays in the row: no shuffle, no Python.

Defined cases: a null or empty text has no match (license null, dice 0); the best match has
the most bigrams in common, so that a whole licence comes before a notice in it, then the
higher score, then the first name; rows are independent, so repeated rows each get their
result; further columns are ignored.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, table

THRESHOLD = 0.8

#: Public licence notices, by name and family.
TEMPLATES = [
    ("apache-2.0", "permissive", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0/header", "permissive", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("bsd", "permissive", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd-3-clause", "permissive", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("cc-by-4.0", "attribution", "Licensed under CC BY 4.0."),
    ("cc-by-4.0/long", "attribution", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "noncommercial", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0/long", "noncommercial", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nd-4.0", "noderivatives", "Licensed under CC BY-ND 4.0."),
    ("cc-by-sa-4.0", "sharealike", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa-4.0/long", "sharealike", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0-1.0", "publicdomain", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("gpl-3.0", "copyleft", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0/header", "copyleft", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("isc", "permissive", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("lgpl-3.0", "copyleft", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("mit", "permissive", "Released under the MIT License."),
    ("mit/licensed", "permissive", "Licensed under the MIT License."),
    ("mit/text", "permissive", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("mpl-2.0", "copyleft", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "publicdomain", "This is free and unencumbered software released into the public domain."),
]
#: Public licences in full, from the grant to the disclaimer.
LICENCES = [
    ("bsd-2-clause/text", "permissive", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("bsd-3-clause/text", "permissive", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("isc/text", "permissive", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("mit/full", "permissive", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("zlib/text", "permissive", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
]
RESTRICTED = ("noncommercial", "noderivatives", "copyleft", "sharealike")


def template_words(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def template_bigrams(text: str) -> list[str]:
    words = template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def _least(size: int, threshold: float) -> int:
    """How many of a template's ``size`` bigrams a part must hold to reach ``threshold``."""
    return max(1, math.ceil(size * threshold / (2 - threshold) - 1e-9))


def _sets(templates: list[tuple[str, str, str]], threshold: float) -> Column:
    """The templates with their sets and size bounds, one array that the optimizer folds to a constant."""
    most, least, rows = (2 - threshold) / threshold, threshold / (2 - threshold), []
    for name, family, text in templates:
        bs = template_bigrams(text)
        rows.append(
            {"name": name, "family": family, "length": len(template_words(text)) - 1, "need": _least(len(bs), threshold), "low": len(bs) * least, "high": len(bs) * most, "bigrams": bs}
        )
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<name:string,family:string,length:int,need:int,low:double,high:double,bigrams:array<string>>>")


def _bigrams(part: Column) -> Column:
    """All word bigrams of a part, in order."""
    return let(
        F.filter(F.split(F.lower(part), r"[^\p{L}\p{N}]+"), lambda w: w != ""),
        lambda w: F.when(
            F.size(w) > 1, F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat(F.get(w, i - 1), F.lit(" "), F.get(w, i)))
        ).otherwise(F.array().cast("array<string>")),
    )


def _parts(text: Column) -> Column:
    lines = F.split(text, "\n", -1)
    blocks = F.split(text, r"\n[\x20\x09\x0B-\x0D]*\n", -1)
    long = F.filter(blocks, lambda b: F.instr(b, "\n") > 0)
    whole = F.when(F.size(blocks) > 1, F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.concat(lines, long, whole)


def _common(a: Column, t: Column) -> Column:
    """The comparison of a part's bigrams with a template's, as struct<shared, dice, name, family>."""
    return let(
        F.size(F.array_intersect(a, t["bigrams"])),
        lambda n: F.struct(n.alias("shared"), (2.0 * n / (F.size(a) + F.size(t["bigrams"]))).alias("dice"), t["name"].alias("name"), t["family"].alias("family")),
    )


def _windows(g: Column, hits: Column, t: Column) -> Column:
    """Comparisons with template ``t`` of the windows that hold enough of its bigrams.

    ``g`` is the text's bigrams, ``hits`` those that are in any template, with their places from 1.
    """

    def cut(at: Column) -> Column:
        dense = F.filter(F.sequence(F.lit(0), F.size(at) - t["need"]), lambda k: F.get(at, k + t["need"] - 1) - F.get(at, k) < t["length"])
        return F.transform(dense, lambda k: let(F.array_distinct(F.slice(g, F.get(at, k), t["length"])), lambda a: _common(a, t)))

    places = F.transform(F.filter(hits, lambda h: F.array_contains(t["bigrams"], h["b"])), lambda h: h["i"])
    return let(places, lambda at: F.when(F.size(at) >= t["need"], cut(at)).otherwise(_none()))


def _none() -> Column:
    return F.array().cast("array<struct<shared:int,dice:double,name:string,family:string>>")


def matches(text: Column, templates: list[tuple[str, str, str]] = TEMPLATES + LICENCES, threshold: float = THRESHOLD) -> Column:
    """Every match as array<struct<shared, dice, name, family>>, one for each part and template.

    The whole text's distinct bigrams come first: only templates of which it has enough can match a part.
    """
    text = F.coalesce(text, F.lit(""))
    known = F.split(F.lit("|".join(sorted({b for *_, t in templates for b in template_bigrams(t)}))), r"\|")

    def found(g: Column, own: Column, able: Column) -> Column:
        parts = F.transform(_parts(text), lambda p: F.array_distinct(_bigrams(p)))
        placed = F.filter(F.transform(g, lambda b, i: F.when(F.array_contains(own, b), F.struct((i + 1).alias("i"), b.alias("b")))), lambda h: h.isNotNull())
        whole = F.flatten(F.transform(parts, lambda a: F.transform(F.filter(able, lambda t: F.size(a).between(t["low"], t["high"])), lambda t: _common(a, t))))
        windows = let(placed, lambda h: F.flatten(F.transform(able, lambda t: _windows(g, h, t))))
        return F.when(F.size(able) > 0, F.filter(F.concat(whole, windows), lambda s: s["dice"] >= threshold)).otherwise(_none())

    def able(own: Column) -> Column:
        return F.filter(_sets(templates, threshold), lambda t: F.size(F.array_intersect(own, t["bigrams"])) >= t["need"])

    return let(_bigrams(text), lambda g: let(F.array_intersect(known, g), lambda own: let(able(own), lambda ts: found(g, own, ts))))


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license and dice of the best match, family, n_matches (templates that match), all names, restricted."""
    best = F.reduce(
        F.col("m"),
        F.struct(F.lit(0).alias("shared"), F.lit(0.0).alias("dice"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("family")),
        lambda a, x: F.when(
            (x["shared"] > a["shared"])
            | ((x["shared"] == a["shared"]) & ((x["dice"] > a["dice"]) | ((x["dice"] == a["dice"]) & (x["name"] < a["name"])))),
            x,
        ).otherwise(a),
    )
    names = F.array_sort(F.array_distinct(F.transform("m", lambda x: x["name"])))
    return (
        docs.select(F.col(doc_id).alias("doc_id"), matches(F.col(text), threshold=threshold).alias("m"))
        .select("doc_id", best.alias("best"), F.size(names).cast("long").alias("n_matches"), F.array_join(names, ",").alias("licenses"), F.exists("m", lambda x: x["family"].isin(*RESTRICTED)).alias("restricted"))
        .select("doc_id", F.col("best.name").alias("license"), F.col("best.family").alias("family"), F.col("best.dice").alias("dice"), "n_matches", "licenses", "restricted")
    )


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ",\n  ".join(f"({quoted(n)}, {quoted(f)}, {len(template_words(t)) - 1}, {_least(len(template_bigrams(t)), THRESHOLD)}, [{', '.join(map(quoted, template_bigrams(t)))}])" for n, f, t in TEMPLATES + LICENCES)
    return rf"""
WITH tp(name, family, l, least_of, b) AS (VALUES
  {rows}),
d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_split_to_array(coalesce(text, ''), '\n[\x20\x09\x0B-\x0D]*\n') AS bl FROM documents),
u AS (SELECT doc_id, unnest(list_concat(list_concat(string_split(t, chr(10)), list_filter(bl, lambda x: contains(x, chr(10)))),
             CASE WHEN len(bl) > 1 THEN [t] ELSE []::VARCHAR[] END)) AS p FROM d),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(p), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM u),
a AS (SELECT doc_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS a FROM w WHERE len(w) > 1),
v AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(t), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM d),
g AS (SELECT doc_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM v WHERE len(w) > 1),
s AS (SELECT doc_id, unnest(g) AS x, generate_subscripts(g, 1) AS i FROM g),
tx AS (SELECT name, l, least_of, unnest(b) AS x FROM tp),
h AS (SELECT doc_id, name, i FROM s JOIN tx USING (x) QUALIFY lead(i, least_of - 1) OVER (PARTITION BY doc_id, name ORDER BY i) < i + l),
y AS (SELECT doc_id, name, family, b, list_distinct(g[i:i + l - 1]) AS a FROM h JOIN tp USING (name) JOIN g USING (doc_id)),
m AS (SELECT doc_id, name, family, len(list_intersect(a, b)) AS shared, 2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b)) AS dice
      FROM (SELECT doc_id, name, family, b, a FROM a, tp WHERE list_has_any(a, b) UNION ALL SELECT doc_id, name, family, b, a FROM y)),
k AS (SELECT * FROM m WHERE dice >= {THRESHOLD}),
n AS (SELECT doc_id, count(DISTINCT name) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses,
             bool_or(family IN ('{"', '".join(RESTRICTED)}')) AS restricted FROM k GROUP BY doc_id),
f AS (SELECT DISTINCT ON (doc_id) doc_id, name, family, dice FROM k ORDER BY doc_id, shared DESC, dice DESC, name)
SELECT d.doc_id, f.name AS license, f.family AS family, coalesce(f.dice, 0.0)::DOUBLE AS dice, coalesce(n.n, 0)::BIGINT AS n_matches,
       coalesce(licenses, '') AS licenses, coalesce(restricted, false) AS restricted
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN f ON d.doc_id = f.doc_id
"""


OP3_SQL = _sql()
