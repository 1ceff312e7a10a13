"""Licence scan by canonical digests, in Spark SQL functions only.

A text is made canonical: lower case, equivalent spellings united, copyright lines dropped, and every run of
characters other than letters and digits turned into one blank. Entire texts are compared by the digest of that form,
by a hash join with the digests of known licence texts. Both a document as a whole and each of its lines, taken as an
entire text, are looked up, so that a licence text is found and a licence notice inside a document too.

`known` may be any table of (licence, text); Spark broadcasts its digests only below its own size limit. A document's
lines are counted where they are, before anything is shuffled, when the known side is small.

Null or empty text, or one without letters and digits: no licence, as an empty canonical text matches nothing. Known texts that are equal in canonical form
under several names give the first name. Each repeated row gives its row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vitrine.llm.common import LOWER, UPPER

# Public licence notices and short licence texts.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "MIT",
        "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
        "to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT "
        "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT "
        "OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL "
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE "
        "FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
        "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
]
_BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.\n\n"
)
_BSD_3 = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission.\n\n"
)
_ISC_DISCLAIMER = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR "
    "IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
# Fixed values: (name, titles, text) of further short licences; each is known with each title and without, its clauses numbered or with bullets.
FULL = [
    ("BSD-2-Clause", ["BSD 2-Clause License", "The 2-Clause BSD License", "BSD 2-Clause \"Simplified\" License"], _BSD_2 + _BSD_DISCLAIMER),
    ("BSD-3-Clause", ["BSD 3-Clause License", "The 3-Clause BSD License", "BSD 3-Clause \"New\" or \"Revised\" License"], _BSD_2 + _BSD_3 + _BSD_DISCLAIMER),
    (
        "0BSD", ["BSD Zero Clause License", "Zero-Clause BSD"],
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_DISCLAIMER,
    ),
    (
        "Zlib", ["zlib License", "The zlib License"],
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be "
        "misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the "
        "product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be "
        "misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "Unlicense", ["The Unlicense", "Unlicense"],
        "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
        "means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the "
        "software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and "
        "successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software "
        "under copyright law.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, "
        "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR "
        "THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>",
    ),
]
_MIT, _ISC = KNOWN[-2][1], KNOWN[-1][1]
_BULLETS = re.compile(r"(?m)^[1-3]\. ")
KNOWN[:-2] += [
    (name, title + body)
    for name, titles, text in [*FULL, ("MIT", ["The MIT License", "The MIT License (MIT)"], _MIT.split("\n\n", 1)[1]), ("ISC", ["ISC License", "The ISC License"], _ISC)]
    for body in sorted({text, _BULLETS.sub("* ", text)})
    for title in ["", *(t + "\n\n" for t in titles)]
]
# Spellings that count as the same, applied in this order to single words.
SPELLINGS = [("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("v", "version"), ("noninfringement", "non infringement"), ("merchantibility", "merchantability"), ("http", "https")]

_COPYRIGHT = r"(?m)^[^a-z0-9\n]*(copyright|\(c\)|©)[^\n]*$"


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, blanks for anything but letters and digits, one spelling for equivalents."""
    out = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    out = F.when(F.instr(out, "copyright") + F.instr(out, "(c)") + F.instr(out, "©") > 0, F.regexp_replace(out, _COPYRIGHT, "")).otherwise(out)
    out = F.concat(F.lit(" "), F.regexp_replace(out, r"[^a-z0-9\x{80}-\x{10FFFF}]+", " "), F.lit(" "))
    for word, same in SPELLINGS:
        out = F.replace(out, F.lit(f" {word} "), F.lit(f" {same} "))
    return F.trim(F.regexp_replace(out, " +", " "))


def known_texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWN, "licence string, text string")


def digests(known: DataFrame) -> DataFrame:
    """(digest, licence), one name a digest."""
    form = canonical(F.col("text"))
    return known.where(form != "").groupBy(F.sha2(form, 256).alias("digest")).agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, canonical_sha256, text_licence, n_lines (notices found in lines), licences (of lines, sorted, comma-joined)."""
    table = digests(known)
    whole = canonical(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2(whole, 256).alias("canonical_sha256"), F.split("text", "\n").alias("lines")
    )
    each = rows.select("row", "doc_id", "canonical_sha256", F.posexplode_outer("lines").alias("line", "part")).select(
        "row", "doc_id", "canonical_sha256", "line", F.sha2(canonical(F.col("part")), 256).alias("digest")
    )
    lines = each.join(table.withColumnRenamed("licence", "line_licence"), "digest", "left").groupBy("row", "doc_id", "canonical_sha256").agg(
        F.count("line_licence").alias("n_lines"), F.concat_ws(",", F.array_sort(F.collect_set("line_licence"))).alias("licences")
    )
    return lines.join(table.select(F.col("digest").alias("canonical_sha256"), F.col("licence").alias("text_licence")), "canonical_sha256", "left").select(
        "doc_id", "canonical_sha256", "text_licence", "n_lines", "licences"
    )
