"""License scans by canonical digests, on DataFrame operations only.

A text is brought to a canonical form (copyright lines dropped, lower case, punctuation and line ends to spaces,
equivalent spellings made equal) and its digest is joined with those of whole licence texts. Lines
that speak of a licence are looked up the same way in a list of notices of its own.
"""

from __future__ import annotations

import re
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Known licence texts and notices (name, text).
_MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use,
copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE
FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_BODY = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR
ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS
ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_1 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
the documentation and/or other materials provided with the distribution.
"""
_BSD_2 = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING,
BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED
AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.
"""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions
and limitations under the License."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
_UNLICENSE = "This is free and unencumbered software released into the public domain."
_END = "END OF TERMS AND CONDITIONS"
_TEMPLATE_LINES = ("Copyright (c) <year> <copyright holders>", "Copyright (c) [year] [fullname]", "Copyright <YEAR> <COPYRIGHT HOLDER>")
#: The line of a licence's appendix that users fill in; filled in, it is a copyright line.
_TO_FILL = re.compile(r"(?m)^ *Copyright \[yyyy\] \[name of copyright owner\]$")


def _whole_texts():
    """(name, text) of the files of whole licences, those with an appendix also up to the end of their terms."""
    for path in sorted((Path(__file__).parent / "licenses").glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        yield path.stem, text
        if _TO_FILL.search(text):
            yield path.stem, _TO_FILL.sub("", text)
        if _END in text:
            yield path.stem, text[:text.index(_END) + len(_END)]
            yield path.stem, text[:text.index(_END)]


def _variants():
    """(name, text) of the short licences: as they are, under their titles, and with the copyright lines of their templates."""
    for name, titles, text in (("MIT", ("MIT License", "The MIT License (MIT)"), _MIT_BODY), ("ISC", ("ISC License",), _ISC_BODY),
                               ("BSD-2-Clause", ("BSD 2-Clause License",), _BSD_1 + "\n" + _BSD_2),
                               ("BSD-3-Clause", ("BSD 3-Clause License",), _BSD_1 + _BSD_THIRD + "\n" + _BSD_2)):
        for title in ("", *(t + "\n\n" for t in titles)):
            for line in ("", *(x + "\n\n" for x in _TEMPLATE_LINES)):
                yield name, title + line + text


#: Whole texts (name, text).
KNOWN = (*_variants(), *_whole_texts())
#: Notices that name a licence in one line (name, text).
NOTICES = (
    ("Apache-2.0", " ".join(_APACHE.split())), ("MPL-2.0", " ".join(_MPL.split())), ("Unlicense", _UNLICENSE),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."), ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."), ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-only"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"), ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "This work is released into the public domain under the CC0 1.0 license."),
)
#: Spellings that count as equal, after lower case and punctuation.
EQUAL = (("licence", "license"), ("licenced", "licensed"), ("sub license", "sublicense"), ("non infringement", "noninfringement"),
         ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"), ("favour", "favor"), ("organisation", "organization"),
         ("per cent", "percent"), ("https", "http"))
#: Every known notice has one of these, so other lines need no digest.
MENTIONS = r"(?i)licen[cs]e|public domain|permission|redistribution|source code form"


#: A copyright line: the word and a mark or a year, or a mark and a year, at its head. Lines of the licences themselves are
#: none: those that leave year or holder open, and those of the foundation that wrote them. So how a text is wrapped
#: does not matter: no sentence of a licence can be taken for such a line.
COPYRIGHT = (r"(?im)^[ \t/*#;-]*(?:copyright[ \t]*(?:\(c\)|©)|(?:copyright|\(c\)|©)[ \t]*(?=(?:19|20)[0-9][0-9]))"
             r"(?![ \t]*(?:[<\[]|year))(?![^\n]*free software)[^\n]*$")


def canonical(text: Column) -> Column:
    """The canonical form, words apart by single spaces."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), COPYRIGHT, "")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)all\s+rights\s+reserved\.?", ""), "&", " and ")
    out = F.concat(F.lit(" "), F.regexp_replace(F.lower(out), "[^a-z0-9]+", " "), F.lit(" "))
    out = reduce(lambda x, pair: F.replace(x, F.lit(f" {pair[0]} "), F.lit(f" {pair[1]} ")), EQUAL, out)
    return F.trim(out)


def digest(text: Column) -> Column:
    return F.md5(canonical(text))


def known_digests(spark: SparkSession, texts=KNOWN) -> DataFrame:
    """(digest, license) of the known texts."""
    return spark.createDataFrame(list(texts), "license string, text string").select(digest(F.col("text")).alias("digest"), "license") \
        .groupBy("digest").agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, digest, license, n_notices, notices) for every input row: the digest of the whole canonical text, the licence
    whose entire text it is (else null), the number of lines that are a known notice, and their
    licences, sorted, each once, comma-joined.

    Null and empty texts, and texts of copyright lines only, have the digest of an empty text and no licence. Null and
    repeated ids and repeated rows give their own rows; further columns are ignored; an empty table gives
    no row. Texts are read as a whole, however long. ``known`` (digest, license) replaces the built-in list of whole texts; it
    may be of any length. The notices are a fixed list.
    """
    known = known_digests(docs.sparkSession) if known is None else known.filter("digest IS NOT NULL AND license IS NOT NULL") \
        .groupBy("digest").agg(F.min("license").alias("license"))
    pairs = [(r["digest"], r["license"]) for r in known_digests(docs.sparkSession, NOTICES).collect()]
    names = F.create_map(*[F.lit(x) for pair in pairs for x in pair]) if pairs else F.lit(None).cast("map<string,string>")
    work = docs.select("doc_id", "text").select("doc_id", digest(F.col("text")).alias("digest"), F.filter(
        F.split(F.coalesce("text", F.lit("")), "\n"), lambda line: F.rlike(line, F.lit(MENTIONS))).alias("lines"))
    found = F.filter(F.transform("lines", lambda line: F.element_at(names, digest(line))), lambda x: x.isNotNull())
    work = work.withColumn("found", F.when(F.size("lines") > 0, found).otherwise(F.array().cast("array<string>")))
    return work.join(known, "digest", "left").select(
        "doc_id", "digest", "license", F.size("found").cast("long").alias("n_notices"), F.concat_ws(",", F.array_sort(F.array_distinct("found"))).alias("notices"))
