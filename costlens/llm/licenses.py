"""Licence texts by canonical digest.

A text is its statements, the parts between line ends and ends of sentences. The
canonical form of a statement is in lower case, with blanks for punctuation and white
space, and with one spelling for words that licences spell in several ways; copyright
and all-rights-reserved statements and lines that only name a licence have none. The canonical form of a text is those of
its statements in a row. The digests of the whole text and of each statement are joined
with those of known licences; a known text is matched entire.

Every text is normalised once, for both. If the known texts are at most
``MAX_BROADCAST``, counted before, their digests are a scalar that sifts each text's
statements before they are joined; a larger collection is joined without that sieve, by
shuffling the digests. The rows are the same.

Defined results: a null text, and one without letters or digits, matches nothing; equal
known texts under several names are all reported, the smallest name for the whole text;
null ids and repeated rows are rows like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from costlens.llm.rows import text_of

MAX_BROADCAST = 10_000

COPYRIGHT = r"^[^\p{L}]*(copyright|©|\(c\))[ \t]*(\(c\)|©|[0-9]|by ).*$"
RIGHTS = r"^[^\p{L}]*all rights reserved[^\p{L}]*$"
# A line that only names a licence.
TITLE = (
    r"^[^\p{L}\p{N}]*(the )?(mit|isc|zlib|0bsd|unlicense|boost software|"
    r"(new |modified |simplified )?bsd([ -]?[023][ -]clause)?|(zero|[023])[ -]clause bsd)"
    r" licen[sc]e( \((mit|isc|zlib|expat|0bsd)\))?( - version 1\.0 - august 17th, 2003)?[^\p{L}\p{N}]*$"
)
BETWEEN_WORDS = r"[^\p{L}\p{N}]+"
SENTENCE_END = r"([.!?])[ \t]+"

# Spellings and their equivalents.
SPELLINGS = {
    "sub licen": "sublicen",
    "licence": "license",
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "authorisation": "authorization",
    "favour": "favor",
    "fulfilment": "fulfillment",
    "https": "http",
    "judgement": "judgment",
    "labour": "labor",
    "merchantibility": "merchantability",
    "non commercial": "noncommercial",
    "organisation": "organization",
    "per cent": "percent",
    "programme": "program",
    "whilst": "while",
}

# Known licence texts and notices.
KNOWN = {
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "MIT notice": "Released under the MIT License.",
}


def _statement(text: Column) -> Column:
    """The canonical form of a statement; empty if it has neither letters nor digits."""
    out = F.lower(text)
    # Looking for the words first is cheaper than trying the patterns everywhere.
    named = F.contains(out, F.lit("copyright")) | F.contains(out, F.lit("©")) | F.contains(out, F.lit("(c)"))
    out = F.when(named, F.regexp_replace(out, COPYRIGHT, "")).otherwise(out)
    out = F.when(F.contains(out, F.lit("all rights reserved")), F.regexp_replace(out, RIGHTS, "")).otherwise(out)
    titled = F.rlike(out, F.lit("licen[sc]e")) & (F.length(out) < 100)
    out = F.when(titled, F.regexp_replace(out, TITLE, "")).otherwise(out)
    out = F.regexp_replace(out, BETWEEN_WORDS, " ")
    for spelling, usual in SPELLINGS.items():
        out = F.replace(out, F.lit(spelling), F.lit(usual))
    return F.trim(out)


def statements(text: Column) -> Column:
    """Canonical forms of all statements of a text, without the empty ones."""
    parts = F.split(F.regexp_replace(text, SENTENCE_END, "$1\n"), "\n")
    return F.filter(F.transform(parts, _statement), lambda x: x != "")


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(KNOWN.items()), "license string, text string")


def scan(docs: DataFrame, known: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, ``digest`` of the canonical text,
    ``license`` of the whole text and the ``notices`` among its statements."""
    known = known_licenses(docs.sparkSession) if known is None else known
    known = known.select("license", F.array_join(statements(text_of("text")), " ").alias("form")).filter("form <> ''")
    known = known.select("license", F.sha2("form", 256).alias("notice"))
    forms = docs.select(F.col(doc_id).alias("doc_id"), statements(text_of(text)).alias("forms"))
    digests = forms.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.sha2(F.array_join("forms", " "), 256).alias("digest"),
        F.transform("forms", lambda x: F.sha2(x, 256)).alias("parts"),
    )
    if known.count() <= MAX_BROADCAST:
        sieve = known.agg(F.collect_set("notice")).scalar()
        digests = digests.withColumn("parts", F.array_intersect("parts", sieve))
    notices = digests.withColumn("notice", F.explode_outer("parts")).drop("parts").join(known, "notice", "left")
    names = known.groupBy(F.col("notice").alias("digest")).agg(F.min("license").alias("license"))
    found = notices.groupBy("row", "doc_id", "digest").agg(F.array_sort(F.collect_set("license")).alias("notices"))
    return found.join(names, "digest", "left").select("doc_id", "digest", "license", "notices")
