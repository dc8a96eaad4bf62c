"""License scans by canonical digest lookup.

Texts are made canonical (letter case, punctuation and white space, copyright lines, holders' names in the clause on
endorsement, equivalent spellings), hashed, and
hash-joined to the digests of known licence texts and notices, which go through the same steps. A document is looked up
as a whole, and so is each of its lines, since notices often stand as lines of other texts.

Defined cases: null, empty and wordless texts match nothing; a known text that is repeated or equal under the canonical
form keeps its smallest name (ties too); very long texts are read to their end; a notice that runs over two lines is
found only as a whole text; rows repeated with the same id and text get the same result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm.common import ascii_lower, row_key

# Equivalent spellings, the first of each pair written as the second.
SPELLINGS = [
    ("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("sub license", "sublicense"), ("noncommercial", "non commercial"), ("non infringement", "noninfringement"), ("https", "http"),
    ("merchantibility", "merchantability"), ("organisation", "organization"), ("recognise", "recognize"), ("favour", "favor"), ("behaviour", "behavior"), ("whilst", "while"), ("judgement", "judgment"),
]

# Short licences and notices, as published.
_GRANT_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
_MIT_REST = 'The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_REST = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_REST = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_UNLICENSE_LINK = "For more information, please refer to <https://unlicense.org>"
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
# Headings that stand over a licence's text.
_TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "License: MIT", "Expat License"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "0BSD"],
    "BSD-2-Clause": ["BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "The BSD 2-Clause License", "Simplified BSD License", "FreeBSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "The BSD 3-Clause License", "New BSD License", "Modified BSD License", "Revised BSD License"],
    "Zlib": ["zlib License", "The zlib License", "zlib/libpng license", "The zlib/libpng License"],
}
_BODIES = [
    ("MIT", f"{_GRANT_MIT}\n\n{_MIT_REST}"),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_REST}"),
    ("0BSD", f"{_ISC_GRANT}.\n\n{_ISC_REST}"),
    ("BSD-2-Clause", f"{_BSD_GRANT}\n\n1. {_BSD_1}\n\n2. {_BSD_2}\n\n{_BSD_REST}"),
    ("BSD-2-Clause", f"{_BSD_GRANT}\n\n* {_BSD_1}\n\n* {_BSD_2}\n\n{_BSD_REST}"),
    ("BSD-3-Clause", f"{_BSD_GRANT}\n\n1. {_BSD_1}\n\n2. {_BSD_2}\n\n3. {_BSD_3}\n\n{_BSD_REST}"),
    ("BSD-3-Clause", f"{_BSD_GRANT}\n\n* {_BSD_1}\n\n* {_BSD_2}\n\n* {_BSD_3}\n\n{_BSD_REST}"),
    ("Zlib", _ZLIB),
]
KNOWN = [
    # a body with or without a heading, and with or without a line of reserved rights behind the copyright lines
    *[(name, "\n\n".join([*title, *rights, body])) for name, body in _BODIES for title in ([], *[[t] for t in _TITLES[name]]) for rights in ([], ["All rights reserved."])],
    ("Unlicense", f"{_UNLICENSE}\n\n{_UNLICENSE_LINK}"),
    ("BSL-1.0", _BOOST),
    ("BSL-1.0", f"Boost Software License - Version 1.0 - August 17th, 2003\n\n{_BOOST}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("all-rights-reserved", "All rights reserved."),
]

#: A holder's own name in the clause on endorsement, and what stands there in the text as published.
HOLDER = r"neither\s+the\s+names?\s+of\s+[^.]{1,300}?\s+nor\s+the\s+names\s+of\s+(?:its|their|any|the)\s+contributors"
PUBLISHED = "neither the name of the copyright holder nor the names of its contributors"
COPYRIGHT = r"(?m)^[ \t]*(?:copyright|\(c\)|©)[^\n]*$"


def with_digest(rows: DataFrame, text: str, name: str) -> DataFrame:
    """rows with the sha-256 of the canonical text (its words, spelled alike, without copyright lines and holders'
    names, one space between them) instead of the text; null if it has no words. In steps, so that no step is worked out twice."""
    rows = rows.withColumn(text, F.coalesce(text, F.lit(""))).withColumn(text, ascii_lower(F.col(text)))
    low = F.col(text)
    rows = rows.withColumn(text, F.when(low.contains("neither"), F.regexp_replace(low, HOLDER, PUBLISHED)).otherwise(low))
    signed = low.contains("copyright") | low.contains("(c)") | low.contains("©")  # few texts need the slower pass
    rows = rows.withColumn(text, F.when(signed, F.regexp_replace(low, COPYRIGHT, "")).otherwise(low))
    rows = rows.withColumn(text, F.concat(F.lit(" "), F.regexp_replace(text, r"[\x00-\x2F\x3A-\x60\x7B-\x7F©]+", " "), F.lit(" ")))
    spelled = F.replace(F.col(text), F.lit(" "), F.lit("  "))  # so that words side by side do not share a space
    for old, new in SPELLINGS:
        spelled = F.replace(spelled, F.lit(f" {old.replace(' ', '  ')} "), F.lit(f" {new.replace(' ', '  ')} "))
    odd = F.col(text).rlike(" (?:" + "|".join(old for old, _ in SPELLINGS) + ") ")
    rows = rows.withColumn(text, F.trim(F.when(odd, F.replace(spelled, F.lit("  "), F.lit(" "))).otherwise(F.col(text))))
    return rows.withColumn(name, F.when(F.col(text) != "", F.sha2(text, 256))).drop(text)


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """digest, license: one row a digest. Its size is that of the given list, so it may be broadcast."""
    rows = spark.createDataFrame(known if known is not None else KNOWN, "license string, body string")
    return with_digest(rows, "body", "digest").where("digest is not null").groupBy("digest").agg(F.min("license").alias("license"))


def license_scan(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", known: list[tuple[str, str]] | None = None) -> DataFrame:
    """Per row: doc_id, text_digest, license (of the whole text, or null), notices (names found on its lines, sorted) and
    n_notices (such lines)."""
    table = F.broadcast(known_digests(documents.sparkSession, known))
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"), row_key(F.col(doc_id), F.col(text)).alias("key"))
    lines = docs.select("key", F.posexplode(F.split("t", "\n")).alias("at", "line"))
    # never null, so that the join adds no null test, which would work out the canonical text again below it
    found = with_digest(lines, "line", "digest").withColumn("digest", F.coalesce("digest", F.lit(""))).join(table, "digest").dropDuplicates(["key", "at"])
    per_doc = found.groupBy("key").agg(F.array_sort(F.collect_set("license")).alias("names"), F.count(F.lit(1)).alias("n"))
    whole = with_digest(docs, "t", "text_digest")
    out = whole.join(table, whole.text_digest == table.digest, "left").join(per_doc, "key", "left")
    return out.select("doc_id", "text_digest", "license", F.coalesce(F.array_join("names", ","), F.lit("")).alias("notices"), F.coalesce("n", F.lit(0)).cast("long").alias("n_notices"))
