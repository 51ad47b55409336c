"""Licence scans by canonical digests.

A text is canonical after these steps: small letters; copyright lines go; equivalent spellings become one; every run of other
characters than letters and digits becomes one space. It is cut into sentences where a sentence or a paragraph ends, so that neither
wrapped lines, comment marks nor paragraphs matter, and numbers of list items alone go. Each sentence's digest is looked up by a hash join
in the sentences of the known texts; a known text is found where all its sentences stand one after the other. So a licence file with
its title, a licence or header above code, and a one-line notice are found alike. Lines are looked up as entire texts, too, for notices
without an end of sentence.

Known are the texts in the folder licence_texts (whole public licences, from their first section to their terms' end), KNOWN (short licences
and usual file headers), and one-line notices of NOTICES and IDENTIFIERS in the FORMS. This bounds what is broadcast: a few thousand
rows. Only sentences that are part of a known text are shuffled. A licence that quotes another's header counts for both.

Defined results: null, empty and blank texts match nothing; repeated ids and rows: n counts all places with the same id; null ids
are reported as null; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The wording of public licences and of their usual file headers.
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to
do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS
OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING
FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL
THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE,
DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE
SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY
DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed
to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This
program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy
of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""",
    "LGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.""",
    "AGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and
by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our
heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to
this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not
be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in
the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must
not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
}

_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution. """
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission. """
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT {} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT
NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND
ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF
THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: Names under which one-line notices give a licence, besides its SPDX identifier.
NOTICES = {
    "MIT": ["MIT License", "Expat License"],
    "Apache-2.0": ["Apache 2.0", "Apache License 2.0", "Apache License, Version 2.0", "Apache Software License 2.0"],
    "GPL-2.0": ["GPL v2", "GPLv2", "GNU General Public License v2", "GNU General Public License, version 2"],
    "GPL-3.0": ["GPL v3", "GPLv3", "GNU General Public License v3", "GNU General Public License, version 3"],
    "LGPL-2.1": ["LGPL v2.1", "LGPLv2.1", "GNU Lesser General Public License, version 2.1"],
    "LGPL-3.0": ["LGPL v3", "LGPLv3", "GNU Lesser General Public License, version 3"],
    "AGPL-3.0": ["AGPL v3", "AGPLv3", "GNU Affero General Public License, version 3"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, Version 2.0"],
    "ISC": ["ISC License"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC0-1.0": ["CC0 1.0", "CC0"],
}
#: Further SPDX identifiers; those of the GNU licences also have the forms -only and -or-later.
IDENTIFIERS = (
    "0BSD AFL-3.0 Artistic-2.0 BSL-1.0 CC-BY-3.0 CC-BY-ND-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-SA-3.0 ECL-2.0 EPL-1.0 EPL-2.0 "
    "EUPL-1.2 GFDL-1.3 LPPL-1.3c MIT-0 MPL-1.1 MS-PL NCSA ODbL-1.0 OFL-1.1 OSL-3.0 PostgreSQL Python-2.0 Unlicense UPL-1.0 WTFPL X11 Zlib ZPL-2.1"
).split()
FORMS = ["SPDX-License-Identifier: {}", "Licensed under {}", "Licensed under the {}", "Licensed under the terms of the {}"]

#: Ends a sentence, in canonical texts.
END = "\u00b6"
_NOUN = "(work|file|project|software|document|text|code|material|content|page|package|program|library)"
#: Patterns and what they become, in this order; both regular-expression dialects (Java's and RE2's) read them alike.
STEPS = [
    (END, " "),
    (r"\.[ \t]+licen[cs]ed under", ".\nlicensed under"),
    (r"\.[ \t]+released under", ".\nreleased under"),
    (r"(?m)^[^\p{L}\p{N}\n]*(copyright[ \t]*(\(c\)|©)|\(c\)|©|copyright[ \t]+[<\[{]?(\d{4}|year|yyyy))[^\n]*$", END),
    (r"all rights reserved\.?", ""),
    (r"\n[^\p{L}\p{N}\n]*\n", "\n" + END + "\n"),
    (r"[.:;!?][\"”’)\]]*\n", END + "\n"),
    (r"[.:;!?][\"”’)\]]*[ \t\r\f]", END + " "),
    (r"licence", "license"),
    (r"sub-license", "sublicense"),
    (r"non-infringement", "noninfringement"),
    (r"non-commercial", "noncommercial"),
    (r"(this|the) " + _NOUN + " is licensed under", "licensed under"),
    (r"((this|the) " + _NOUN + " is )?(released|distributed|available|made available|provided) under", "licensed under"),
    (r"https?://(www\.)?", ""),
    (r"[^\p{L}\p{N}\n" + END + "]+", " "),
]
#: A sentence of fewer characters is the number of a list item.
LEAST = 3


def canonical(text: Column) -> Column:
    """The canonical text, still with its line breaks and END marks."""
    out = F.lower(F.coalesce(text, F.lit("")))
    for pattern, to in STEPS:
        out = F.regexp_replace(out, pattern, to)
    return out


def canonical_sql(text: str) -> str:
    out = f"lower(coalesce({text}, ''))"
    for pattern, to in STEPS:
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return out


def known_texts() -> list[tuple[str, str, bool]]:
    """licence, text, and if the text is a one-line notice."""
    folder = Path(__file__).with_name("licence_texts")
    texts = [(p.name.removesuffix(".txt"), p.read_text(encoding="utf-8")) for p in sorted(folder.glob("*.txt"))]
    texts += KNOWN.items()
    texts += [("Apache-2.0", KNOWN["Apache-2.0"].replace(" at http", " at\n\nhttp").replace("-2.0 Unless", "-2.0\n\nUnless"))]  # as the usual file header has it
    texts += [(k, _BSD_HEAD + third + _BSD_TAIL.format(who)) for k, third in (("BSD-2-Clause", ""), ("BSD-3-Clause", _BSD_THIRD)) for who in ("HOLDER", "OWNER")]
    names = {k: [k, *v] for k, v in NOTICES.items()} | {k: [k] for k in IDENTIFIERS}
    for k in [k for k in names if "GPL" in k]:
        names |= {f"{k}-{form}": [f"{k}-{form}"] for form in ("only", "or-later")}
    return [(k, t, False) for k, t in texts] + [(k, form.format(n), True) for k, ns in names.items() for n in ns for form in FORMS]


def _whole(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, END), _whole), lambda x: F.length(x) >= LEAST)


def _line(text: Column) -> Column:
    return F.md5(_whole(F.translate(text, END, " ")))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, licence, unit (run: sentences of a known text; line) and n (at how many places)."""
    known = docs.sparkSession.createDataFrame([(i, *k) for i, k in enumerate(known_texts())], "known int, licence string, text string, notice boolean")
    known = known.withColumn("c", canonical(F.col("text")))
    runs = known.select("known", "licence", F.size(_sentences(F.col("c"))).alias("size"), F.posexplode(F.transform(_sentences(F.col("c")), F.md5)).alias("place", "digest"))
    lines = known.filter("notice").select("licence", _line(F.col("c")).alias("digest"), F.lit(True).alias("by_line")).distinct()
    table = F.broadcast(runs.select("digest", "known", "licence", "size", "place").withColumn("by_line", F.lit(False)).unionByName(lines, allowMissingColumns=True))

    text = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), canonical(F.col("text").cast("string")).alias("c"))

    def placed(by_line: bool):
        return lambda x, i: F.struct(F.lit(by_line).alias("by_line"), i.alias("at"), (_line(x) if by_line else F.md5(x)).alias("digest"))

    parts = F.concat(F.transform(_sentences(F.col("c")), placed(False)), F.transform(F.split("c", "\n"), placed(True)))
    found = text.select("doc_id", "text_hash", F.explode(parts).alias("p")).select("doc_id", "text_hash", "p.*").join(table, ["digest", "by_line"])
    shift = F.when(~F.col("by_line"), F.col("at") - F.col("place"))
    each = found.groupBy("doc_id", "text_hash", "licence", "by_line", "known", "size", shift.alias("shift")).agg(F.count("*").alias("c"))
    each = each.filter("by_line or c >= size")
    places = F.when(F.col("by_line"), F.col("c")).otherwise(F.floor(F.col("c") / F.col("size")))
    unit = F.when(F.col("by_line"), "line").otherwise("run").alias("unit")
    # equal rows stand at the same places: they count as often as they occur
    spans = each.groupBy("doc_id", "text_hash", "licence", unit, "shift").agg(F.max(places).alias("m"))
    return spans.groupBy("doc_id", "licence", "unit").agg(F.sum("m").cast("long").alias("n"))


def scan_sql() -> str:
    quoted = ", ".join(f"({i}, '{k}', '{t.replace(chr(39), chr(39) * 2)}', {str(notice).lower()})" for i, (k, t, notice) in enumerate(known_texts()))
    whole = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
    sentences = lambda c: f"list_filter(list_transform(string_split({c}, '{END}'), lambda x: {whole('x')}), lambda x: length(x) >= {LEAST})"
    line = lambda x: f"md5({whole(f'translate({x}, {chr(39)}{END}{chr(39)}, {chr(39)} {chr(39)})')})"
    return f"""
    WITH known AS (SELECT i, licence, notice, {canonical_sql('t')} AS c FROM (VALUES {quoted}) AS k(i, licence, t, notice)),
    known_lists AS (SELECT i, licence, {sentences('c')} AS u FROM known),
    runs AS (SELECT i, licence, len(u) AS size, unnest(u) AS x, generate_subscripts(u, 1) AS place FROM known_lists),
    lines AS (SELECT DISTINCT licence, {line('c')} AS digest FROM known WHERE notice),
    texts AS (SELECT doc_id, hash(text) AS text_hash, {canonical_sql('text')} AS c FROM documents),
    lists AS (SELECT doc_id, text_hash, {sentences('c')} AS u FROM texts),
    units AS (SELECT doc_id, text_hash, unnest(u) AS x, generate_subscripts(u, 1) AS stands FROM lists),
    met AS (
      SELECT doc_id, text_hash, licence, i, size, stands - place AS shift, count(*) AS c
      FROM (SELECT *, md5(x) AS digest FROM units) JOIN (SELECT i, licence, size, place, md5(x) AS digest FROM runs) USING (digest)
      GROUP BY ALL HAVING count(*) >= size),
    spans AS (SELECT doc_id, text_hash, licence, shift, max(c // size) AS m FROM met GROUP BY ALL)
    SELECT doc_id, licence, 'run' AS unit, CAST(sum(m) AS BIGINT) AS n FROM spans GROUP BY ALL
    UNION ALL
    SELECT doc_id, licence, 'line', count(*) FROM (SELECT doc_id, {line('x')} AS digest FROM (SELECT doc_id, unnest(string_split(c, chr(10))) AS x FROM texts))
    JOIN lines USING (digest) GROUP BY ALL"""
