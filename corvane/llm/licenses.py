"""License scans by canonical digests; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import scratched
from corvane.sources.workspace import stored

#: Spellings that count as equal, as (variant, canonical).
SPELLINGS = [
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("authorisation", "authorization"), ("authorised", "authorized"), ("behaviour", "behavior"),
    ("cancelled", "canceled"), ("centre", "center"), ("colour", "color"), ("favour", "favor"), ("fulfil", "fulfill"), ("initialise", "initialize"),
    ("labour", "labor"), ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("modelling", "modeling"), ("noncommercial", "non commercial"),
    ("organisation", "organization"), ("organisations", "organizations"), ("programme", "program"), ("recognise", "recognize"), ("sublicence", "sublicense"),
    ("utilise", "utilize"), ("whilst", "while"), ("wilful", "willful"),
]

#: Whole texts of licences, by SPDX identifier, with the titles that they may stand under.
BSD_DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
BSD_TERMS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: {a}Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. {b}Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
BSD_THIRD = "{c}Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
BODIES = [
    ("MIT", ["MIT License", "The MIT License", "The MIT License (MIT)"], "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MIT-0", ["MIT No Attribution", "MIT-0 License"], "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", ["ISC License", "The ISC License"], "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("0BSD", ["BSD Zero Clause License", "Zero-Clause BSD", "0BSD License"], "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", ["BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License"], BSD_TERMS.format(a="", b="") + BSD_DISCLAIMER),
    ("BSD-2-Clause", ["BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License"], BSD_TERMS.format(a="1. ", b="2. ") + BSD_DISCLAIMER),
    ("BSD-3-Clause", ["BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License"], BSD_TERMS.format(a="", b="") + BSD_THIRD.format(c="") + BSD_DISCLAIMER),
    ("BSD-3-Clause", ["BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License"], BSD_TERMS.format(a="1. ", b="2. ") + BSD_THIRD.format(c="3. ") + BSD_DISCLAIMER),
    ("Zlib", ["zlib License", "The zlib License"], "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", ["Boost Software License - Version 1.0 - August 17th, 2003"], "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Unlicense", ["The Unlicense", "Unlicense"], "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>"),
    ("Apache-2.0", [], "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MPL-2.0", [], "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("GPL-3.0-or-later", [], "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
]

#: What one-line notices call a licence, by SPDX identifier.
NAMES = [
    ("Apache-2.0", ["the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 License"]),
    ("MIT", ["the MIT License"]),
    ("ISC", ["the ISC License"]),
    ("BSD-2-Clause", ["the BSD 2-Clause License", "the Simplified BSD License"]),
    ("BSD-3-Clause", ["the BSD 3-Clause License", "the New BSD License"]),
    ("MPL-2.0", ["the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0"]),
    ("GPL-2.0-only", ["the GNU General Public License, version 2", "the GNU GPL v2", "the GPLv2"]),
    ("GPL-3.0-only", ["the GNU General Public License, version 3", "the GNU GPL v3", "the GPLv3"]),
    ("LGPL-2.1-only", ["the GNU Lesser General Public License, version 2.1", "the GNU LGPL v2.1"]),
    ("LGPL-3.0-only", ["the GNU Lesser General Public License, version 3", "the GNU LGPL v3"]),
    ("AGPL-3.0-only", ["the GNU Affero General Public License, version 3", "the GNU AGPL v3"]),
    ("Unlicense", ["the Unlicense"]),
    ("CC0-1.0", ["CC0 1.0", "the CC0 1.0 Universal license"]),
    *((f"CC-{k}-{v}", [f"CC {k} {v}", f"a CC {k} {v} license"]) for k in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND") for v in ("3.0", "4.0")),
]
PHRASES = ("Licensed under {}.", "Released under {}.", "Distributed under {}.", "This work is licensed under {}.", "This project is licensed under {}.", "This software is licensed under {}.")

#: Known texts as (identifier, text): bodies with and without a title, and notices made of each name and phrase, and of SPDX tags.
KNOWN = [(k, t) for k, titles, body in BODIES for t in (body, *(f"{title}\n{body}" for title in titles))]
KNOWN += [(k, phrase.format(n)) for k, names in NAMES for n in names for phrase in PHRASES]
KNOWN += [(k, f"SPDX-License-Identifier: {k}") for k in sorted({k for k, *_ in (*BODIES, *NAMES)})]

#: Canonical lines that only say who holds the copyright: those that begin so; and those that begin with the word and end with a holder's kind, if
#: they don't begin like a line of a licence's body.
NOTICE = "^(copyright (c |by |(19|20)[0-9][0-9]|yyyy|year)|c (19|20)[0-9][0-9]|all rights reserved)"
HOLDER = "^copyright (.* )?(authors|contributors|developers|inc|ltd|llc|gmbh|corporation|foundation)$"
BODY = "^copyright (notice|holder|owner)"
#: A known list of up to so many texts is broadcast, and lines are tried against its hashes before their digests are taken.
LISTED = 100_000


def canonical_lines(text: Column) -> Column:
    """The lines of a text in canonical form: lower case, one space for each run of anything but letters, digits and line ends,
    canonical spellings; without empty lines and copyright lines."""
    # Two spaces between words, so that each has its own for the replacements.
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\n]+", "  ")
    t = F.concat(F.lit(" "), F.replace(t, F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for variant, usual in SPELLINGS:
        t = F.replace(t, F.lit(f" {variant} "), F.lit(f" {usual} "))
    lines = F.split(F.regexp_replace(t, " +", " "), "\n")
    return F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: (x != "") & ~(x.rlike(NOTICE) | (x.rlike(HOLDER) & ~x.rlike(BODY))))


def digest(lines: Column) -> Column:
    """Of an entire canonical text; null if nothing is left of it."""
    return F.when(F.size(lines) > 0, F.sha2(F.array_join(lines, " "), 256))


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> tuple[DataFrame, list[int]]:
    """(digest, license) of known texts, and the hashes of their canonical forms. The list is an argument written in code or configuration."""
    rows = spark.createDataFrame(KNOWN if known is None else known, "license string, text string")
    rows = rows.select("license", canonical_lines(F.col("text")).alias("x")).filter(F.size("x") > 0).select("license", digest(F.col("x")).alias("digest"), F.xxhash64(F.array_join("x", " ")).alias("h"))
    found = rows.groupBy("digest").agg(F.min("license").alias("license"), F.min("h").alias("h")).collect()
    return spark.createDataFrame([(r.digest, r.license) for r in found], "digest string, license string"), [r.h for r in found]


@scratched
def license_scan(docs: DataFrame, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per document of docs (doc_id, text): doc_id, digest, license, notices.

    digest is that of the entire canonical text (null for null and empty texts and those of copyright lines alone), license what
    known text has the same (null: none). notices are the known texts that stand as whole lines in a longer one, sorted and distinct, joined by
    commas. Rows that repeat and null ids are scanned like others; of known texts with one digest the smallest name counts. Other columns are
    ignored.

    Each text is normalised once, and its digests go to a narrow table. Lines that can't be known by their hash are left out of it, so only the few
    that may be are joined. Both lookups are joins of digests by hash, by broadcast for a list of up to LISTED texts.
    """
    table, hashes = known_digests(docs.sparkSession, known)
    small = len(hashes) <= LISTED
    d = docs.select("doc_id", canonical_lines(F.col("text")).alias("x"))
    likely = F.filter("x", lambda s: F.xxhash64(s).isin(hashes)) if small else F.col("x")
    # One projection per value of x, which is an array and so would be computed again wherever it is named.
    one = F.transform(F.array("x"), lambda x: F.struct(digest(x).alias("digest"), x.alias("x")))[0]
    d = d.select("doc_id", one.alias("x")).select("doc_id", F.col("x.digest").alias("digest"), F.col("x.x").alias("x"))
    d = d.select(F.monotonically_increasing_id().alias("row"), "doc_id", "digest", F.transform(likely, lambda s: F.sha2(s, 256)).alias("lines"))
    d = stored(d, "digests")
    table = F.broadcast(table) if small else table
    whole = d.drop("lines").join(table, "digest", "left")
    lines = d.select("row", F.explode("lines").alias("digest")).join(table, "digest")
    notices = F.array_join(F.array_sort(F.collect_set("license")), ",")
    found = whole.join(lines.groupBy("row").agg(notices.alias("notices")), "row", "left")
    return found.select("doc_id", "digest", "license", F.coalesce("notices", F.lit("")).alias("notices"))
