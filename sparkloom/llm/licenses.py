"""Licence scans by canonical digest, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import without

#: Spellings that count as equal: words in lower case with one space between them, applied in this order.
SPELLINGS = (
    ("licence", "license"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("organisation", "organization"),
    ("authorisation", "authorization"), ("acknowledgement", "acknowledgment"), ("judgement", "judgment"), ("favour", "favor"), ("wilful", "willful"),
    ("fulfil ", "fulfill "), ("copyright owner", "copyright holder"), (" https ", " http "),
)
#: A copyright notice at a line's start, in lower case with single blanks: up to its first full stop that ends no abbreviation, or its
#: line's end; an initial counts as one only where a surname and a comma or `and` follow. Alike in both engines
#: but for the possessive mark, which spares Java the recursion and changes no match.
NOTICE = r"(?m)^[^\p{L}\p{N}\n]*(?:copyright:?\s{0,3}(?:\(c\)|©|[12][0-9]{3}|\[)|copyright[^.\n]{0,80}?[^0-9][12][0-9]{3}|\(c\)\s{0,3}[12][0-9]{3}|©)(?:\b(?:inc|ltd|corp|co|llc|jr)\.|\b\p{L}\. \p{L}+(?:,| and\b)|\.[^\s]|[^.\n])*(?:\.|$)"
RESERVED = r"all rights reserved\.?"

#: Texts of short public licences.
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
TEXTS = {
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n' + _AS_IS,
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_WARRANTY,
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _ISC_WARRANTY,
    "BSD-2-Clause": _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause": _BSD_HEAD + _BSD_THIRD + _BSD_TAIL,
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution.",
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
}
#: Canonical digests of whole long licences (SHA-256), as fixed values; the texts are those that Debian ships in /usr/share/common-licenses.
DIGESTS: dict[str, str] = {
    "Apache-2.0": "036b5ff6d47b44974c624da95e5bf0ac7ddfe5030e41dfa7ff8ac0c1daa9f32b",
    "Artistic": "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702",
    "CC0-1.0": "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    "GFDL-1.2": "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b",
    "GFDL-1.3": "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d",
    "GPL-1": "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224",
    "GPL-2": "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821",
    "GPL-3": "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a",
    "LGPL-2": "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908",
    "LGPL-2.1": "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891",
    "LGPL-3": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6",
    "MPL-2.0": "6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d",
}
#: Headings that a licence text may carry or lack: a first line which is one of these is left out.
TITLES = ("mit license", "the mit license", "the mit license (mit)", "isc license", "bsd zero clause license", "bsd 2-clause license", "bsd 3-clause license", "zlib license", "the zlib license")
#: Up to so many known licences are broadcast (about 100 bytes each).
BROADCAST_LICENSES = 50_000


def canonical(text: Column) -> Column:
    """Lower case; no copyright notices, no title line; each run of anything but letters and digits one space; then equal spellings.

    A notice that shares its line with the licence goes up to its first full stop, the rest stays. Spellings are replaced
    after white space is one space, so that a line break within one does not matter.
    """
    low = F.lower(text)
    suspect = F.contains(low, F.lit("copyright")) | F.contains(low, F.lit("(c)")) | F.contains(low, F.lit("©")) | F.contains(low, F.lit("all rights"))
    cut = F.when(suspect, F.regexp_replace(F.regexp_replace(F.regexp_replace(low, F.lit(r"[ \t\r]+"), F.lit(" ")), F.lit(NOTICE.replace(")*(?:", ")*+(?:")), F.lit(" ")), F.lit(RESERVED), F.lit(" "))).otherwise(low)
    head = F.regexp_extract(cut, r"^\s*([^\n]*)", 1)
    body = F.when(F.trim(head).isin(*TITLES), F.regexp_replace(cut, r"^\s*[^\n]*", "")).otherwise(cut)
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(body, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    for a, b in SPELLINGS:
        plain = F.replace(plain, F.lit(a), F.lit(b))
    return F.trim(plain)


def known_licenses(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """(license_id, digest) of the licence texts given, or of the short public ones above and the long ones' digests."""
    rows = [(k, v) for k, v in (TEXTS if texts is None else texts).items()]
    known = spark.createDataFrame(rows, "license_id string, text string").select("license_id", F.sha2(canonical(F.col("text")), 256).alias("digest"))
    return known if texts is not None else known.unionByName(spark.createDataFrame(list(DIGESTS.items()), known.schema))


def scan_licenses(docs: DataFrame, known: DataFrame) -> DataFrame:
    """docs with canonical_digest of the whole text and license_id, the known licence with that digest, or null.

    Null texts have a null digest; empty ones and those of signs only that of the empty text, which no licence has. Of
    known licences with one digest the least id counts. Columns of docs with these two names are replaced.
    """
    lookup = known.where("digest IS NOT NULL").groupBy(F.col("digest").alias("canonical_digest")).agg(F.min("license_id").alias("license_id"))
    d = without(docs, "canonical_digest", "license_id").withColumn("canonical_digest", F.sha2(canonical(F.col("text").cast("string")), 256))
    small = lookup.limit(BROADCAST_LICENSES + 1).count() <= BROADCAST_LICENSES
    return d.join(F.broadcast(lookup) if small else lookup, "canonical_digest", "left")


def licence_files(supplier: DataFrame) -> DataFrame:
    """(doc_id, text): a licence file of each supplier, with ids from -1 downwards: one of TEXTS under the supplier's copyright,
    as it stands, in capitals with a title, wrapped at every `the`, or on one line with its notice."""
    names = list(TEXTS)
    k = F.col("s_suppkey")
    text = F.element_at(F.array(*[F.lit(TEXTS[n]) for n in names]), (k % len(names) + 1).cast("int"))
    style = F.floor(k / len(names)) % 4
    holder = F.concat(F.lit("Copyright (c) 2019 "), F.col("s_name"), F.lit(" Inc."))
    made = (
        F.when(style == 0, text).when(style == 1, F.concat(F.lit("The MIT License (MIT)\n\n"), F.upper(holder), F.lit("\n\n"), F.upper(text)))
        .when(style == 2, F.concat(holder, F.lit("\n"), F.replace(text, F.lit(" the "), F.lit("\n   the\n")))).otherwise(F.concat(holder, F.lit(" All rights reserved. "), F.replace(text, F.lit("\n"), F.lit(" "))))
    )
    return supplier.select((-k.cast("bigint") - 1).alias("doc_id"), made.alias("text"))


def op6_licenses(docs: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """The digest and licence of each row of docs and of files (doc_id, text); scan_licenses states the rules."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows if files is None else rows.unionByName(files)
    return scan_licenses(rows, known_licenses(docs.sparkSession)).select("doc_id", "canonical_digest", "license_id")


def _sql_canonical(text: str) -> str:
    titles = ", ".join(f"'{t}'" for t in TITLES)
    cut = f"regexp_replace(regexp_replace(regexp_replace(lower({text}), '[ \\t\\r]+', ' ', 'g'), '{NOTICE}', ' ', 'g'), '{RESERVED}', ' ', 'g')"
    out = f"list_transform([{cut}], lambda c: CASE WHEN trim(regexp_extract(c, '^\\s*([^\\n]*)', 1), ' ') IN ({titles}) THEN regexp_replace(c, '^\\s*[^\\n]*', '') ELSE c END)[1]"
    out = f"' ' || trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ') || ' '"
    for a, b in SPELLINGS:
        out = f"replace({out}, '{a}', '{b}')"
    return f"sha256(trim({out}, ' '))"


_QUOTE = lambda v: "'" + v.replace("'", "''") + "'"
_TEXT = "[" + ", ".join(_QUOTE(v) for v in TEXTS.values()) + f"][s_suppkey % {len(TEXTS)} + 1]"
ORACLE = f"""
WITH k AS (SELECT digest, min(id) AS license_id FROM (SELECT id, {_sql_canonical('t')} AS digest FROM (VALUES {", ".join(f"({_QUOTE(k)}, {_QUOTE(v)})" for k, v in TEXTS.items())}) v(id, t)
  UNION ALL SELECT * FROM (VALUES {", ".join(f"('{k}', '{v}')" for k, v in DIGESTS.items())}) w(id, digest)) GROUP BY 1),
f AS (SELECT -s_suppkey - 1 AS doc_id, {_TEXT} AS t, 'Copyright (c) 2019 ' || s_name || ' Inc.' AS h, (s_suppkey // {len(TEXTS)}) % 4 AS style FROM supplier),
x AS (SELECT doc_id::BIGINT AS doc_id, text FROM documents UNION ALL SELECT doc_id, CASE style WHEN 0 THEN t WHEN 1 THEN 'The MIT License (MIT)' || chr(10) || chr(10) || upper(h) || chr(10) || chr(10) || upper(t)
  WHEN 2 THEN h || chr(10) || replace(t, ' the ', chr(10) || '   the' || chr(10)) ELSE h || ' All rights reserved. ' || replace(t, chr(10), ' ') END FROM f),
d AS (SELECT doc_id, {_sql_canonical('text')} AS canonical_digest FROM x)
SELECT doc_id, canonical_digest, license_id FROM d LEFT JOIN k ON canonical_digest = digest
"""
