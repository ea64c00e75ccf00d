"""Licence scans by canonical digest lookup, in DataFrame functions only.

``canonical`` lowers a text, drops copyright lines, turns every run of other
characters than letters and digits into one space and replaces equivalent
spellings. A whole text is a licence if the digest of its canonical form equals
that of a known licence: one hash join against the known digests, a table of
fixed size that is broadcast. Each line that has a notice's longest word is digested alike and
looked up among the digests of known one-line notices, so a document also tells what it refers to.
Nothing is shuffled; a hot source or a group of copies is spread as the scan is.

Known whole texts: MIT, BSD-2-Clause, BSD-3-Clause, ISC, 0BSD, Zlib and the files of
``licence_texts`` (Apache-2.0, Artistic, CC0, GFDL, GPL, LGPL and MPL). AGPL, BSL-1.0,
Unlicense and the Creative Commons licences other than CC0 are not among them, as no
copy of their texts was at hand; ``scan`` takes a caller's own table of digests.

Defined results: null text counts as empty; the digest of an empty canonical form
matches no licence; repeated rows are looked up once each; a null id is kept; an
empty table yields no rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines that only say who holds the rights: fixed values, after lowering.
COPYRIGHT = r"^[^\p{L}\p{N}\n]*(?:copyright[ \t]*(?:\(c\)|©|[0-9]{4}|<|\[)|\(c\)[ \t]*[0-9]{4}|©|all rights reserved)[^\n]*"
#: Equivalent spellings, as whole words of the canonical form; fixed values.
SPELLINGS = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sub license", "sublicense"),
    ("sub licence", "sublicense"),
    ("sublicence", "sublicense"),
    ("organisation", "organization"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("favour", "favor"),
    ("fulfil", "fulfill"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labour", "labor"),
    ("merchantability", "merchantability"),
    ("non commercial", "noncommercial"),
    ("per cent", "percent"),
    ("programme", "program"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("copyright owner", "copyright holder"),
    ("http", "https"),
    ("v2", "version 2"),
    ("v3", "version 3"),
)

_WARRANTY_BSD = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""

_WARRANTY_ISC = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""

#: Whole licence texts; public texts of fixed wording.
TEXTS = (
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy
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
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.""",
    ),
    ("BSD-2-Clause", _BSD + "\n" + _WARRANTY_BSD),
    (
        "BSD-3-Clause",
        _BSD
        + """
3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.

"""
        + _WARRANTY_BSD,
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

"""
        + _WARRANTY_ISC,
    ),
    (
        "0BSD",
        """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted.

"""
        + _WARRANTY_ISC,
    ),
    (
        "Zlib",
        """This software is provided 'as-is', without any express or implied warranty. In
no event will the authors be held liable for any damages arising from the use
of this software.

Permission is granted to anyone to use this software for any purpose, including
commercial applications, and to alter it and redistribute it freely, subject to
the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim
   that you wrote the original software. If you use this software in a product,
   an acknowledgment in the product documentation would be appreciated but is
   not required.

2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    ),
)
#: Titles that may stand above a whole text.
TITLES = {"MIT": ("MIT License", "The MIT License (MIT)", "The MIT License"), "BSD-2-Clause": ("BSD 2-Clause License",), "BSD-3-Clause": ("BSD 3-Clause License",), "ISC": ("ISC License",), "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"), "Zlib": ("zlib License", "The zlib License")}
#: Longer licences as files, named by their ids.
FILES = sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))
TEXTS += tuple((path.stem, path.read_text("utf-8")) for path in FILES)
TITLES |= {path.stem: () for path in FILES}

#: One-line notices; fixed values.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License v3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
)


def canonical(text: Column) -> Column:
    """The form that is digested: words of letters and digits, a space between them."""
    bare = F.regexp_replace(F.lower(text), "(?md)" + COPYRIGHT, " ")
    words = F.concat(F.lit(" "), F.regexp_replace(bare, r"[^\p{L}\p{N}]+", "  "), F.lit(" "))
    for old, new in SPELLINGS:
        if old != new:
            words = F.replace(words, F.lit(f" {old.replace(' ', '  ')} "), F.lit(f" {new.replace(' ', '  ')} "))
    return F.trim(F.regexp_replace(words, " +", " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def marks(notices) -> str:
    """A pattern that every line with the canonical form of a notice matches: each notice's longest word, in any spelling."""
    respelled = dict(SPELLINGS)
    loose = {word for _, new in SPELLINGS if " " in new for word in new.split()}
    found: set[str] = set()
    for _, line in notices:
        words = {word for word in (respelled.get(w, w) for w in re.findall(r"[^\W_]+", line.lower())) if " " not in word} - loose
        longest = max(words, key=lambda word: (len(word), word), default="")
        found |= {longest, *(old.split()[0] for old, new in SPELLINGS if new == longest)}
    return f"(?iu)(?:{'|'.join(map(re.escape, sorted(found)))})"


def known(spark: SparkSession, rows) -> DataFrame:
    """(license_id, digest) of texts, one row for each digest."""
    table = spark.createDataFrame(list(rows), "license_id string, text string")
    return table.groupBy(digest(F.col("text")).alias("digest")).agg(F.min("license_id").alias("license_id"))


def known_texts(spark: SparkSession) -> DataFrame:
    titled = [(name, f"{title}\n\n{text}") for name, text in TEXTS for title in TITLES[name]]
    return known(spark, [*TEXTS, *titled])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: DataFrame | None = None, notices=NOTICES) -> DataFrame:
    """(doc_id, digest, license_id, notice_lines, notice_ids) of every whole text.

    ``texts``: known (digest, license_id); the default list has a fixed size and is
    broadcast, a caller's own is joined as Spark sees fit.
    """
    spark = docs.sparkSession
    table = F.broadcast(known_texts(spark)) if texts is None else texts
    text = F.coalesce(F.col(text_col), F.lit(""))
    # a constant map: the optimiser folds the digests of the fixed notices
    ids = F.create_map(*(x for name, line in notices for x in (digest(F.lit(line)), F.lit(name))))
    able = F.filter(F.split(text, "\n"), lambda line: line.rlike(marks(notices)))
    lines = F.filter(F.transform(able, lambda line: F.try_element_at(ids, digest(line))), lambda name: name.isNotNull())
    own = docs.select(F.col(id_col).alias("doc_id"), digest(text).alias("digest"), lines.alias("found"))
    return own.join(table, "digest", "left").select("doc_id", "digest", "license_id", F.size("found").cast("long").alias("notice_lines"), F.sort_array(F.array_distinct("found")).alias("notice_ids"))


def oracle_sql() -> str:
    """DuckDB SQL of the query over ``documents``."""

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def form(text: str) -> str:
        words = f"concat(' ', regexp_replace(regexp_replace(lower({text}), {quoted('(?m)' + COPYRIGHT)}, ' ', 'g'), '[^\\p{{L}}\\p{{N}}]+', '  ', 'g'), ' ')"
        for old, new in SPELLINGS:
            if old != new:
                words = f"replace({words}, {quoted(' ' + old.replace(' ', '  ') + ' ')}, {quoted(' ' + new.replace(' ', '  ') + ' ')})"
        return f"sha256(trim(regexp_replace({words}, ' +', ' ', 'g')))"

    titled = [(name, f"{title}\n\n{text}") for name, text in TEXTS for title in TITLES[name]]
    texts = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in [*TEXTS, *titled])
    lines = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in NOTICES)
    return f"""
WITH known AS (SELECT {form('t')} AS digest, min(name) AS license_id FROM (VALUES {texts}) v(name, t) GROUP BY 1),
notices AS (SELECT {form('t')} AS digest, min(name) AS name FROM (VALUES {lines}) v(name, t) GROUP BY 1),
own AS (SELECT doc_id, {form("coalesce(text, '')")} AS digest FROM documents),
lines AS (SELECT doc_id, {form('line')} AS digest FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)),
found AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS ids FROM lines JOIN notices USING (digest) GROUP BY doc_id)
SELECT own.doc_id AS doc_id, own.digest AS digest, license_id, CAST(coalesce(n, 0) AS BIGINT) AS notice_lines, coalesce(ids, '') AS notice_ids
FROM own LEFT JOIN known USING (digest) LEFT JOIN found ON found.doc_id = own.doc_id
"""
