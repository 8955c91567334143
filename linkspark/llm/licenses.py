"""License scans by canonical digests, in DataFrame functions only.

A text is made canonical (case, copyright lines, equivalent spellings, punctuation
and spacing) and its digest is looked up among those of known licences. Whole
documents are looked up, and so is every line, since a notice of one line is a whole
text too. The known digests are a table of fixed size: whole texts are joined to it by
hash, lines are looked up in it where they stand. Only lines whose canonical form is
as long as a known notice's are digested, which leaves none out.

A text that is no known one is looked up once more without what stands before it: a
title that says "licence", and copyright lines, be they names alone.

Defined cases: a null text counts as empty and matches nothing; long texts are read
whole; repeated rows give repeated result rows; an empty table gives an empty result; other columns of the
input are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

# Spellings that count as one, the second form is the canonical one.
EQUIVALENT = (
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("noninfringement", "non-infringement"),
    ("acknowledgement", "acknowledgment"),
    ("copyright owner", "copyright holder"),
    ("authorisation", "authorization"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("judgement", "judgment"),
    ("whilst", "while"),
    ("organisation", "organization"),
    ("percent", "per cent"),
    ("http://", "https://"),
)
COPYRIGHT_LINE = r"(^|\n)[\x20\t*#/;]*(copyright[\x20\t]*(\(c\)|\x{00A9}|[0-9<\[])|\(c\)[\x20\t]*[0-9<\[]|\x{00A9}|all rights reserved)[^\n]*"
#: What may stand before a licence's own text, in lower case: titles, copyright lines with or
#: without a year, and blank lines; and whether a text has such a head with something in it.
HEAD = (
    r"^(?:[\x20\t*#/;=-]*(?:[a-z0-9\x22(][a-z0-9\x20\t.,/\x22\x27()+-]{0,80}licen[sc]e[a-z0-9\x20\t.,/\x22\x27():+-]{0,60}|copyright[^\n]*|\(c\)[^\n]*|\x{00A9}[^\n]*|all rights reserved[^\n]*)?"
    r"[\x20\t\r*#/;=-]*\n)+"
)
HEADED = r"^[\x20\t\r\n*#/;=-]*(?:[^\n]{0,82}licen[sc]e|copyright|\(c\)|\x{00A9}|all rights)"

_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT,
OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""
_BSD_NAME = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""

_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published
by the Free Software Foundation, either version {n} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.

You should have received a copy of the {name} along with this program. If not, see <https://www.gnu.org/licenses/>."""
_GNU_NAMES = (
    ("GPL", "GNU General Public License", ("2", "3")),
    ("LGPL", "GNU Lesser General Public License", ("2.1", "3")),
    ("AGPL", "GNU Affero General Public License", ("3",)),
)

# Licence texts and one-line notices.
KNOWN = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom
the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

""" + _WARRANTY),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

""" + _ISC_WARRANTY),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted.

""" + _ISC_WARRANTY),
    ("Unlicense", """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a
compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest
in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of
our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and
future rights to this software under copyright law.

""" + _WARRANTY.replace("AUTHORS OR\nCOPYRIGHT HOLDERS", "AUTHORS") + """

For more information, please refer to <https://unlicense.org/>"""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use
this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    *[(f"{short}-{n}-or-later", _GNU.format(name=name, n=n)) for short, name, versions in _GNU_NAMES for n in versions],
    ("BSD-2-Clause", "\n".join([_BSD_HEAD, _BSD_TAIL])),
    ("BSD-3-Clause", "\n".join([_BSD_HEAD, _BSD_NAME, _BSD_TAIL])),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
)

# Licences as notices name them, and what notices say of them.
NAMED = (
    ("MIT", "MIT License"),
    ("ISC", "ISC License"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("Apache-2.0", "Apache License 2.0"),
    ("GPL-2.0", "GNU General Public License v2.0"),
    ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-3.0", "GNU General Public License v3.0"),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "GNU Affero General Public License, version 3"),
    ("MPL-2.0", "Mozilla Public License, Version 2.0"),
    ("EPL-2.0", "Eclipse Public License 2.0"),
    ("BSL-1.0", "Boost Software License, Version 1.0"),
    ("Zlib", "zlib License"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
)
SAYING = ("Licensed under the {}.", "Released under the {}.", "Distributed under the {}.", "This work is licensed under the {}.", "This work is licensed under a {}.")
TAG = "SPDX-License-Identifier: {}"
TAGGED = tuple(dict.fromkeys(name for name, _ in NAMED)) + ("0BSD", "Unlicense", "CC0-1.0")
NOTICES = (
    *[(name, text) for name, text in KNOWN if "\n" not in text],
    *[(name, saying.format(full)) for name, full in NAMED for saying in SAYING],
    *[(name, TAG.format(name)) for name in TAGGED],
)
TEXTS = tuple((name, text) for name, text in KNOWN if "\n" in text)
# Digests of the canonical forms of long licences, as Debian's
# /usr/share/common-licenses has their texts.
DIGESTS = (
    ("Apache-2.0", "7ba14cacf20ca7e603ad62f6e32ee66b25ef98f0783a57d8355d6a9fa372e7d3"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "1c057ea35084eb195331cec1a49fca335c176422a7726a9a23636906fd4e241f"),
    ("GFDL-1.3", "7e8edd3abe6258bb82bb853d91a0c24fcd9976894fd0592747354cffe1cb18e7"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "2ccf6e5e40827e08f861c75b089d4ee0714ef61b39cfbbccc919708ff48113bd"),
    ("MPL-2.0", "406497d32b4dfaea83592fd2b0fab5ec8225c32393bd7f3e918b90d0ae6323c0"),
)


def canonical(text: Column) -> Column:
    """The text without what does not tell licences apart."""
    return _words(_plain(text))


def beheaded(text: Column) -> Column:
    """``canonical`` of the text behind its title and copyright lines; null without such."""
    low = F.lower(text)
    return F.when(F.regexp_like(low, F.lit(HEADED)), canonical(F.regexp_replace(low, HEAD, "")))


def _plain(text: Column) -> Column:
    """``canonical`` but for the last step, with the line ends still there."""
    t = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "\n")
    for old, new in EQUIVALENT:
        t = F.replace(t, F.lit(old), F.lit(new))
    return t


def _words(text: Column) -> Column:
    """Letters and digits, one space between."""
    return F.btrim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "))


def known_digests(spark) -> DataFrame:
    """``known, license``: a row for each known digest; its size is fixed."""
    rows = spark.createDataFrame([*TEXTS, *NOTICES], "license string, text string")
    made = rows.select(F.sha2(canonical(F.col("text")), 256).alias("known"), "license")
    given = spark.createDataFrame([(digest, name) for name, digest in DIGESTS], "known string, license string")
    return made.unionByName(given).groupBy("known").agg(F.min("license").alias("license"))


def notice_table(spark) -> list[tuple[str, str, int]]:
    """Digest, licence and canonical length of every known notice: a fixed number."""
    rows = spark.createDataFrame(list(NOTICES), "license string, text string").select("license", canonical(F.col("text")).alias("c"))
    found = rows.groupBy(F.sha2("c", 256).alias("known"), F.length("c").alias("n")).agg(F.min("license").alias("license"))
    return [(r["known"], r["license"], r["n"]) for r in found.orderBy("known").collect()]


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, digest, license, n_notices, notices``: the digest of the whole text and
    its licence, the number of lines that are notices, and their licences, sorted."""
    spark = docs.sparkSession
    known = F.broadcast(known_digests(spark))
    notices = notice_table(spark)
    table = F.create_map(*[F.lit(x) for digest, name, _ in notices for x in (digest, name)])
    lengths = F.array(*[F.lit(n) for n in sorted({n for _, _, n in notices})])
    plain = docs.select(F.col(key).alias("k"), _plain(text_of(docs, text)).alias("p"), F.sha2(beheaded(text_of(docs, text)), 256).alias("own"))
    lines = F.filter(F.transform(F.split("p", "\n", -1), _words), lambda x: F.array_contains(lengths, F.length(x)))
    found = F.filter(F.transform(lines, lambda x: F.try_element_at(table, F.sha2(x, 256))), lambda x: x.isNotNull())
    whole = plain.select("k", F.sha2(_words(F.col("p")), 256).alias("digest"), "own", found.alias("found"))
    whole = whole.join(known, whole["digest"] == known["known"], "left")
    named = known.select(F.col("known").alias("own"), F.col("license").alias("titled"))
    whole = whole.join(F.broadcast(named), "own", "left")
    return whole.select(F.col("k").alias(key), "digest", F.coalesce("license", "titled").alias("license"), F.size("found").cast("long").alias("n_notices"), F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("notices"))


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    """The licences of every document."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_canonical(text: str) -> str:
    t = f"regexp_replace(lower({text}), {_sql_text(COPYRIGHT_LINE)}, chr(10), 'g')"
    for old, new in EQUIVALENT:
        t = f"replace({t}, {_sql_text(old)}, {_sql_text(new)})"
    return f"trim(regexp_replace({t}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def oracle() -> str:
    """The same in DuckDB's SQL."""
    values = ", ".join(f"({_sql_text(name)}, {_sql_text(text)})" for name, text in (*TEXTS, *NOTICES))
    given = ", ".join(f"({_sql_text(digest)}, {_sql_text(name)})" for name, digest in DIGESTS)
    return f"""
WITH every AS (SELECT sha256({_sql_canonical("text")}) AS known, license FROM (VALUES {values}) v(license, text) UNION ALL SELECT * FROM (VALUES {given}) g(known, license)),
known AS (SELECT known, min(license) AS license FROM every GROUP BY 1),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
hits AS (SELECT r, k.license FROM lines JOIN known k ON sha256({_sql_canonical("line")}) = k.known),
notices AS (SELECT r, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM hits GROUP BY r),
w AS (SELECT r, doc_id, sha256({_sql_canonical("text")}) AS digest, CASE WHEN regexp_matches(lower(text), {_sql_text(HEADED)}) THEN sha256({_sql_canonical(f"regexp_replace(lower(text), {_sql_text(HEAD)}, '')")}) END AS own FROM d)
SELECT w.doc_id, w.digest, coalesce(k.license, t.license) AS license, coalesce(n.n, 0)::BIGINT AS n_notices, coalesce(n.notices, '') AS notices
FROM w LEFT JOIN known k ON w.digest = k.known LEFT JOIN known t ON w.own = t.known LEFT JOIN notices n ON w.r = n.r
"""
