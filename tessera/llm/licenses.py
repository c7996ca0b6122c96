"""Operator 2: licence scan by canonical digests (DataFrame functions only)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Licence texts and notices as published, by licence id.
LICENSE_TEXTS = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    (
        "MIT",
        'MIT License\n\nCopyright (c) <year> <copyright holders>\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    (
        "ISC",
        'ISC License\n\nCopyright (c) <year>, <owner>\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    (
        "Apache-2.0",
        'Copyright <year> <owner>\n\nLicensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    (
        "GPL-3.0",
        "Copyright (C) <year> <name of author>\n\nThis program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.\n\nYou should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    ("Proprietary", "All rights reserved."),
    (
        "BSD-2-Clause",
        'Copyright (c) <year>, <owner>\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ),
    (
        "BSD-3-Clause",
        'Copyright (c) <year>, <owner>\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ),
]
#: SHA-256 of the canonical form of long texts as published, whole and up to the end of their terms.
#: Each text holds one of LONG_ANCHORS.
LONG_ANCHORS = ("merchantab", "lesser", "invariant")
LICENSE_DIGESTS = [
    ("Apache-2.0", "1503ed7ce6c2188ed269646562607a76b5c74bff588f36b20862ee3af525f3ea"),
    ("Apache-2.0", "f9138026e58bdb767e6c6e974637ff9aacbaedf2695e30fef144e5d7d84448ff"),
    ("Apache-2.0", "6fb8411669deea22294b6190fad00b8e39899d0b7b6c5cf97a3b15b47e129c38"),
    ("GPL-2.0", "cf74dfa78ca9ac981c7ae9e50c4ecfb828df2e5ef2f1646368388676215766b5"),
    ("GPL-2.0", "c33d2f29477d94c3f3e48ae230c47966a4f4c05a0f6087cf607e1589848d2986"),
    ("GPL-2.0", "255577de4e1e5d93258ddab6c40c41231b97e109d43f4b552501c6d77285763b"),
    ("GPL-3.0", "12d8f4e278c8c411404b43181a57dd51df25a2cba4f4b870577ca182e8c8ce1e"),
    ("GPL-3.0", "31114d63f21f98048f8126b8ffdcccb9e0b86e51aa17a6a00ee539ce53157423"),
    ("GPL-3.0", "70ac7309e6ad0ee1f75f7fccaa1d5231fe2ffc554a66f733e2beac13806a9afa"),
    ("LGPL-2.1", "ac0856eb11aebb30c08445444c942c1ddcde9d0a0447c9ed2b8a19ab7d51eba5"),
    ("LGPL-2.1", "2858f5a00f6672bd47f63b69b9bf4e1bc31f3541b08a5a263e59d9b384f72fdc"),
    ("LGPL-2.1", "2a9689b90bf823adea3df9024818d21d6041c74f3f12ab46ac5ac4d86f654b2e"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
    ("CC0-1.0", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("GFDL-1.3", "721263d18ecadfea1ca07eb578792deb659598c9ead9414d2d662704dded1f8a"),
]
#: Spellings that licence guidelines call equivalent; the right one is used.
EQUIVALENT = [
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("copyright holder", "copyright owner"),
    ("https", "http"),
    ("favour", "favor"),
    ("organisation", "organization"),
]

# The same rules in both dialects: lower case, copyright lines out, punctuation to blanks, spellings.
_COPYRIGHT_LINE = r"(?md)^[^a-z0-9\n]*(copyright|\(c\)|©)[^\n]*[0-9<][^\n]*$"


#: Lines without letters and digits, which part blocks.
BLOCK_GAP = r"\n(?:[^\p{L}\p{N}\n]*\n)+"


def canonical(text: Column) -> Column:
    """Licence text without differences that don't matter; null stays null."""
    x = F.lower(text)
    x = F.regexp_replace(x, _COPYRIGHT_LINE, " ")
    x = F.concat(F.lit(" "), F.regexp_replace(x, r"[^a-z0-9\x{80}-\x{10FFFF}]+", "  "), F.lit(" "))
    for old, new in EQUIVALENT:
        x = F.replace(x, F.lit(f" {'  '.join(old.split())} "), F.lit(f" {'  '.join(new.split())} "))
    return F.trim(F.regexp_replace(x, " +", " "))


def anchors(texts: list[tuple[str, str]]) -> list[str]:
    """Words such that each known text has one of them, in any spelling: a unit without any of them is none of the texts.

    Of each text the longest word outside its copyright lines that no equivalent spelling touches.
    """
    touched = {w for pair in EQUIVALENT for side in pair for w in side.split()}
    found = set()
    for _, text in texts:
        lines = [x for x in text.lower().split("\n") if not re.search(r"copyright|\(c\)|©", x)]
        words = [w for w in re.findall("[a-z0-9]+", "\n".join(lines)) if w not in touched]
        if not words:
            return []
        found.add(max(words, key=len))
    return sorted(w for w in found if not any(o != w and o in w for o in found))


def license_digests(spark: SparkSession, texts: list[tuple[str, str]], digests: list[tuple[str, str]]) -> DataFrame:
    """(digest, license) of the known texts and digests, one row per digest."""
    known = spark.createDataFrame(texts, "license string, license_text string")
    known = known.select(F.sha2(canonical(F.col("license_text")), 256).alias("digest"), "license")
    if digests:
        known = known.unionByName(spark.createDataFrame(digests, "license string, digest string"))
    return known.groupBy("digest").agg(F.min("license").alias("license"))


def license_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    texts: list[tuple[str, str]] | None = None,
    digests: list[tuple[str, str]] | None = None,
) -> DataFrame:
    """Units of each document that are, as a whole, a known licence text: (id, unit, line, license).

    Units are the entire document (line null), each of its lines (line from 0), and the blocks of several
    lines between lines without letters and digits, such as a notice in a comment (line: number of the
    block, from 0). All are brought to the canonical form and hash-joined to the digests of the known
    texts, a fixed list of under a hundred rows, which is what is broadcast. A unit that canonicalises to
    nothing matches nothing. With own `texts` there are no `digests` unless given; their texts must hold
    one of LONG_ANCHORS.

    Cases: null and empty texts have no units; repeated rows repeat their matches; a document can
    match several licences; an empty table gives an empty result; other columns are not read.
    """
    digests = digests if digests is not None else [] if texts else LICENSE_DIGESTS
    texts = texts or LICENSE_TEXTS
    known = license_digests(docs.sparkSession, texts, digests)
    words = anchors(texts)
    if words and digests:
        words = [w for w in words if not any(a in w for a in LONG_ANCHORS)] + [*LONG_ANCHORS]
    # Only a unit with such a word can be a known text: documents without one are not split, units without one not rewritten.
    any_of = lambda c: reduce(Column.__or__, [F.lower(c).contains(w) for w in words], F.lit(not words))
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text <> ''").filter(any_of("text"))
    # All kinds of unit come out of one scan of the text.
    unit = lambda kind: lambda s, i: F.struct(F.lit(kind).alias("unit"), i.alias("line"), s.alias("s"))
    lines = F.transform(F.split("text", "\n", -1), unit("line"))
    blocks = F.filter(F.transform(F.split("text", BLOCK_GAP, -1), unit("block")), lambda u: u["s"].contains("\n") & (u["s"] != F.col("text")))
    whole = F.array(
        F.struct(F.lit("document").alias("unit"), F.lit(None).cast("int").alias("line"), F.col("text").alias("s"))
    )
    units = base.select("id", F.explode(F.concat(whole, lines, blocks)).alias("u")).select("id", "u.*").filter(any_of("s"))
    units = units.withColumn("c", canonical(F.col("s"))).filter("c <> ''")
    units = units.select("id", "unit", "line", F.sha2("c", 256).alias("digest"))
    return units.join(F.broadcast(known), "digest").select(F.col("id").alias(id_col), "unit", "line", "license")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every licence text or notice in the whole documents: (doc_id, unit, line, license)."""
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _op2_sql() -> str:
    def canonical_sql(x: str) -> str:
        x = f"lower({x})"
        x = f"regexp_replace({x}, '{_COPYRIGHT_LINE.replace('(?md)', '(?m)')}', ' ', 'g')"
        x = f"concat(' ', regexp_replace({x}, '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+', '  ', 'g'), ' ')"
        for old, new in EQUIVALENT:
            x = f"replace({x}, ' {'  '.join(old.split())} ', ' {'  '.join(new.split())} ')"
        return f"trim(regexp_replace({x}, ' +', ' ', 'g'), ' ')"

    rows = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in LICENSE_TEXTS)
    long = ", ".join(f"('{k}', '{d}')" for k, d in LICENSE_DIGESTS)
    return f"""
with known as (select d, min(license) as license from (
    select sha256({canonical_sql("t")}) as d, license from (values {rows}) v(license, t)
    union all select d, license from (values {long}) v(license, d)) group by 1),
docs as (select doc_id, text from documents where text <> ''),
lines as (select doc_id, string_split(text, chr(10)) as s from docs),
blocks as (select doc_id, text, string_split(regexp_replace(text, '{BLOCK_GAP}', chr(1114109), 'g'), chr(1114109)) as s from docs),
units as (
  select doc_id, 'document' as unit, cast(null as integer) as line, text as s from docs
  union all
  select doc_id, 'line', cast(unnest(range(len(s))) as integer), unnest(s) from lines
  union all
  select doc_id, 'block', line, s from (select doc_id, cast(unnest(range(len(s))) as integer) as line, unnest(s) as s, text from blocks)
  where contains(s, chr(10)) and s <> text)
select u.doc_id, u.unit, u.line, k.license
from (select *, {canonical_sql("s")} as c from units) u join known k on sha256(u.c) = k.d where u.c <> ''
"""


OP2_SQL = _op2_sql()
