"""Licence scans by canonical digests, by DataFrame functions only.

A text is brought into a canonical form: A-Z and all other letters in lower
case, copyright lines left out, equivalent spellings unified, and everything
but letters and digits, runs of white space included, taken as one space. Its
SHA-256 digest is joined with the digests of known licence texts. Texts are
compared as a whole: nothing but a text that says what the licence says, however
it is laid out, has its digest. Lines that speak of a licence are looked up by
themselves too, as notices.

Defined results: a null text has no digest; an empty text, or one of copyright
lines and punctuation only, has the digest of the empty text and no licence;
repeated rows are repeated; of known texts with one digest the smaller name
counts; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import materialize

#: Spellings that stand for the same; words of the canonical form.
SPELLINGS = {"acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization", "authorised": "authorized", "behaviour": "behavior", "calibre": "caliber", "cancelled": "canceled", "catalogue": "catalog", "centre": "center", "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "labour": "labor", "licence": "license", "licenced": "licensed", "licences": "licenses", "maximise": "maximize", "modelled": "modeled", "modelling": "modeling", "offence": "offense", "optimise": "optimize", "organisation": "organization", "organise": "organize", "practise": "practice", "programme": "program", "realise": "realize", "recognise": "recognize", "signalling": "signaling", "sub licence": "sublicense", "sub license": "sublicense", "utilisation": "utilization", "whilst": "while", "wilful": "willful", "noncommercial": "non commercial", "copyright holder": "copyright owner", "copyright holders": "copyright owners", "https": "http"}

_DISCLAIMER = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
_UNLICENSE = 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <http://unlicense.org/>'

#: (name, whole text); one name may have several texts.
KNOWN = [
    ("MIT", _MIT), ("MIT", "MIT License\n" + _MIT), ("MIT", "The MIT License (MIT)\n" + _MIT), ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("ISC", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies. {_DISCLAIMER}"), ("ISC", f"ISC License\n{_ISC}, provided that the above copyright notice and this permission notice appear in all copies. {_DISCLAIMER}"),
    ("0BSD", f"{_ISC}. {_DISCLAIMER}"), ("0BSD", f"BSD Zero Clause License\n{_ISC}. {_DISCLAIMER}"),
    ("BSD-2-Clause", f"{_BSD_START} {_BSD_END}"), ("BSD-2-Clause", f"BSD 2-Clause License\n{_BSD_START} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD_START} {_THIRD} {_BSD_END}"), ("BSD-3-Clause", f"BSD 3-Clause License\n{_BSD_START} {_THIRD} {_BSD_END}"),
    ("Apache-2.0", _APACHE), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Zlib", _ZLIB), ("Zlib", "zlib License\n" + _ZLIB), ("Unlicense", _UNLICENSE),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."),
]
# Canonical digests of whole licence texts as their stewards publish them (title and appendix included).
DIGESTS = [
    ("Apache-2.0", "e87dea5078ce2faaea46d3475af18d30a5c0ac0f09425b60b3e0c6569f72f8d2"),
    ("Artistic-1.0-Perl", "64e91f5cc481723b420f8e1ecf131ec7eba02da96cf0a78bb4b764fb30984f7a"),
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "b6270c129be9b0e0172ebf4f39b974d927f155b0569e6689a4fd15068977ecdd"),
    ("GFDL-1.3", "7a546845f0b9175c013adbd275ab046668c2cd62fa85809f866f6d3218d6adcd"),
    ("GPL-1.0", "e08c08387b3e9d9292a19e7b8b719bc2420466e91f96235d7addba9279c91199"),
    ("GPL-2.0", "c9150a998ddbe45123303bf71d093beee4baf803b1eaea84b34fd41189285f1f"),
    ("GPL-3.0", "18bdbf68197ce089f7847b43502283f0ab454abaeb31544c64ab7bf5461169ec"),
    ("LGPL-2.0", "59a061c498ef1c6b3fd9ad6466d69d12b400f64b87cb827d62c381d3bc6aca88"),
    ("LGPL-2.1", "1f0770d1499d1ef2c69208a3369d7d9f7722ab5c39fbad959327bed318feb554"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
    ("AGPL-3.0", "35d3d5431c56ffef50e4bc437e350837b018e16072b45028df7982903f158cb3"),
]
# End of fixed values.
#: Lines that only say who has the copyright. A line that a wrapped text begins with
#: "copyright notice" or "copyright holders" is none of them, nor is a list's item (c).
COPYRIGHT = r"(?im)^[\s\p{Punct}]*(portions\s+)?(copyright\b(?![\s\p{Punct}]+(notices?|holders?|owners?|laws?|interests?|licen[cs]es?)\b)|copr\b|\(c\)\s*\d|©).*$|^[\s\p{Punct}]*all\s+rights\s+reserved[\s\p{Punct}]*$"


def canonical(text: F.Column) -> F.Column:
    """The canonical form of a text; see above. Null stays null."""
    out = F.regexp_replace(text, COPYRIGHT, "")
    # Two spaces between words: each word then has its own on either side.
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(out), r"[^\p{L}\p{N}]+", "  ")), F.lit(" "))
    for old in sorted(SPELLINGS, key=lambda w: (-len(w), w)):
        out = F.replace(out, F.lit(f" {old.replace(' ', '  ')} "), F.lit(f" {SPELLINGS[old].replace(' ', '  ')} "))
    return F.replace(F.trim(out), F.lit("  "), F.lit(" "))


def known_digests(spark: SparkSession, known: list[tuple[str, str]] = KNOWN, digests: list[tuple[str, str]] = DIGESTS) -> DataFrame:
    """(digest, licence) of known texts, without texts that are empty in canonical form."""
    texts = spark.createDataFrame(known, "licence string, text string").withColumn("form", canonical(F.col("text"))).filter("form <> ''")
    every = texts.select(F.sha2("form", 256).alias("digest"), "licence").union(spark.createDataFrame(digests, "licence string, digest string").select("digest", "licence"))
    return every.groupBy("digest").agg(F.min("licence").alias("licence"))


def scan_licences(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (doc_id, digest, licence, notices), one for each of docs (doc_id, text);
    known has (digest, licence), a row for each digest. licence is that of the
    whole text; notices, parted by commas, those of its lines that are a known
    text by themselves and speak of a licence (null where there is none)."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("(?i)licen[cs]"))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(canonical(F.col("text")), 256).alias("digest"), F.array_distinct(F.transform(lines, lambda x: F.sha2(canonical(x), 256))).alias("lines"))
    named = materialize(named, "digests")
    # Equal texts have equal notices, so they are found once for each digest; copies don't add to a key.
    noticed = named.filter("size(lines) > 0").groupBy("digest").agg(F.collect_set("lines").alias("lines")).select("digest", F.explode(F.array_distinct(F.flatten("lines"))).alias("line"))
    noticed = noticed.join(known.select(F.col("digest").alias("line"), "licence"), "line").groupBy("digest").agg(F.array_join(F.sort_array(F.collect_set("licence")), ",").alias("notices"))
    return named.join(known.select("digest", "licence"), "digest", "left").join(noticed, "digest", "left").select("doc_id", "digest", "licence", "notices")


def _sql_canonical(text: str) -> str:
    """canonical() of a SQL expression. Copyright lines are told one by one, as
    DuckDB's patterns can't look ahead."""
    kept = f"""array_to_string(list_filter(string_split({text}, chr(10)), lambda x: NOT (
        regexp_matches(x, '(?i)^[\\s[:punct:]]*(portions\\s+)?(copyright\\b|copr\\b|\\(c\\)\\s*\\d|©)')
        AND NOT regexp_matches(x, '(?i)^[\\s[:punct:]]*(portions\\s+)?copyright[\\s[:punct:]]+(notices?|holders?|owners?|laws?|interests?|licen[cs]es?)\\b')
        OR regexp_matches(x, '(?i)^[\\s[:punct:]]*all\\s+rights\\s+reserved[\\s[:punct:]]*$'))), chr(10))"""
    out = f"' ' || trim(regexp_replace(lower({kept}), '[^\\p{{L}}\\p{{N}}]+', '  ', 'g'), ' ') || ' '"
    for old in sorted(SPELLINGS, key=lambda w: (-len(w), w)):
        out = f"replace({out}, ' {old.replace(' ', '  ')} ', ' {SPELLINGS[old].replace(' ', '  ')} ')"
    return f"replace(trim({out}, ' '), '  ', ' ')"


def _sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in KNOWN)
    digests = ", ".join(f"({quoted(n)}, {quoted(d)})" for n, d in DIGESTS)
    return f"""
WITH known(licence, text) AS (VALUES {rows}), texts AS (
  SELECT licence, {_sql_canonical('text')} AS form FROM known
), digests AS (
  SELECT digest, min(licence) AS licence FROM (SELECT licence, sha256(form) AS digest FROM texts WHERE form <> '' UNION ALL SELECT * FROM (VALUES {digests})) GROUP BY ALL
), d AS (
  SELECT doc_id, text, sha256({_sql_canonical('text')}) AS digest FROM documents
), lines AS (
  SELECT DISTINCT digest, unnest(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '(?i)licen[cs]'))) AS line FROM d
), noticed AS (
  SELECT l.digest, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices FROM lines l JOIN digests k ON k.digest = sha256({_sql_canonical('line')}) GROUP BY l.digest
)
SELECT d.doc_id, digest, licence, notices FROM d LEFT JOIN digests USING (digest) LEFT JOIN noticed USING (digest)
"""


SQL = _sql()
