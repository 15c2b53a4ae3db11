"""Licence scans by canonical digest lookup.

A text is normalised line by line (A-Z lower-cased, every run of punctuation and white space one space, equivalent spellings
made one, copyright lines left out), the lines joined by a space, and the digest of the result is hash-joined to the digests of
known licences, normalised alike.  Whole texts are looked up, and each line as a text of its own, which finds one-line notices.

Defined results: a null text counts as empty; an empty canonical text has no licence; licences of equal canonical text are
reported together; repeated rows get the same result each; other columns are ignored.  Only hits are shuffled: the lookups are
joins of digests with the known table, which is broadcast up to ``broadcast_rows`` rows and shuffled beyond.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Fixed values: (spelling, canonical spelling) within words.
SPELLINGS = (
    ("licence", "license"),
    ("sublicence", "sublicense"),
    ("organisation", "organization"),
    ("authoris", "authoriz"),
    ("recognis", "recogniz"),
    ("favour", "favor"),
    ("non infring", "noninfring"),
    ("wilful", "willful"),
    ("copyright owner", "copyright holder"),
)
#: Runs of ASCII and general punctuation, spaces and controls.
NOT_WORD = r"[\x{0}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{A0}\x{AB}\x{B7}\x{BB}\x{2000}-\x{206F}\x{3000}-\x{3003}]+"
#: Lines of a notice: a copyright mark with a year or (c), or a holder named as authors or a company; lines of prose are none.
COPYRIGHT_LINE = (
    r"^((copyright|c|©) )*(copyright|c|©) ([0-9][0-9][0-9][0-9]|year|yyyy|by)( |$)|^©|^all rights reserved$|^copyright c( |$)|"
    r"^(copyright|c) .* [0-9][0-9][0-9][0-9]$|^copyright the .*(authors|contributors)$|^copyright .*(corporation|foundation|inc|llc|ltd)$"
)

_MIT_BODY = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
    '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
    "the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions "
    'of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS "
    "BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
    "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = (
    '.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
    "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER "
    "TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
    "are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
    "this software without specific prior written permission.\n\n"
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON "
    "ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE "
    "USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_APACHE_NOTICE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
    "obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in "
    'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either '
    "express or implied. See the License for the specific language governing permissions and limitations under the License."
)

_UNLICENSE = (
    "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or "
    "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
    "means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest "
    "in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and "
    "successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software "
    'under copyright law.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, "
    "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR "
    "THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)

#: Fixed values: (licence, text) of short licences and of one-line notices.
KNOWN = (
    ("0BSD", f"BSD Zero Clause License\n\n{_ISC_GRANT}{_ISC_WARRANTY}"),
    ("0BSD", f"{_ISC_GRANT}{_ISC_WARRANTY}"),
    ("Apache-2.0", _APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", f"ISC License\n\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies{_ISC_WARRANTY}"),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies{_ISC_WARRANTY}"),
    ("MIT", "MIT License\n\n" + _MIT_BODY),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT_BODY),
    ("MIT", _MIT_BODY),
    ("MIT", "Released under the MIT License."),
    ("Unlicense", _UNLICENSE),
    ("Unlicense", _UNLICENSE + "\n\nFor more information, please refer to <https://unlicense.org/>"),
    ("Unlicense", _UNLICENSE + "\n\nFor more information, please refer to <http://unlicense.org/>"),
)

#: Fixed values: (licence, digest of the canonical text) of long licences, from the texts that Linux distributions ship.
KNOWN_DIGESTS = (
    ("Apache-2.0", "04e64e0427d80fdde16fa8415931bf2c09bc943f13ec322a09df188bf23a3543"),
    ("Artistic-1.0", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71"),
    ("GFDL-1.3", "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "e5eb815e1ee67968eaebfbfa2f5acfb5e56d26527c09e8151abcb9c187ee0e2a"),
    ("MPL-2.0", "12274540925f246f7614a52b7ebddfbe0463ff1ab194088c554c73552c45582d"),
)


def canonical_lines(text: Column) -> Column:
    """Canonical lines of a text, without empty and copyright lines."""

    def canonical(line: Column) -> Column:
        line = F.trim(F.regexp_replace(F.translate(line, UPPER, LOWER), NOT_WORD, " "))
        for spelling, canonical_spelling in SPELLINGS:
            line = F.replace(line, F.lit(spelling), F.lit(canonical_spelling))
        return line

    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), canonical)
    return F.filter(lines, lambda line: (line != "") & ~line.rlike(COPYRIGHT_LINE))


def canonical_text(lines: Column) -> Column:
    return F.array_join(lines, " ")


def known_digests(known: DataFrame, name: str = "license", text: str = "text", digest: str = "digest") -> DataFrame:
    """(known_digest, licenses) with the sorted names of each canonical text.  A known licence has a text or, in an optional column,
    the digest of its canonical text."""
    whole = canonical_text(canonical_lines(F.col(text)))
    told = F.col(digest) if digest in known.columns else F.lit(None).cast("string")
    rows = known.select(F.col(name).alias("name"), F.coalesce(F.lower(told), F.when(whole != "", F.sha2(whole, 256))).alias("known_digest"))
    return rows.where("known_digest IS NOT NULL").groupBy("known_digest").agg(F.array_sort(F.collect_set("name")).alias("licenses"))


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text: str = "text", broadcast_rows: int = 100_000) -> DataFrame:
    """(id, license, notices, n_notice_lines) per row: licences of the whole text, null if none, and of its lines."""
    digests = known_digests(known)
    digests = F.broadcast(digests) if digests.count() <= broadcast_rows else digests
    names = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), F.col(text).alias("text"))
    lines = names.select("id", "key", canonical_lines(F.col("text")).alias("lines"))
    # unit 0 is the whole text, the others are its lines
    units = lines.select("id", "key", F.posexplode(F.concat(F.array(canonical_text(F.col("lines"))), "lines")).alias("unit", "canonical"))
    hits = units.where("canonical <> ''").withColumn("digest", F.sha2("canonical", 256)).join(digests, F.col("digest") == F.col("known_digest"))
    found = hits.groupBy(F.col("id").alias("hit_id"), F.col("key").alias("hit_key")).agg(
        F.max(F.when(F.col("unit") == 0, F.col("licenses"))).alias("whole"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("unit") > 0, F.col("licenses")))))).alias("notices"),
        F.count_distinct(F.when(F.col("unit") > 0, F.col("unit"))).alias("n"),  # repeated rows count a line once
    )
    rows = names.select("id", "key").join(found, names["id"].eqNullSafe(found["hit_id"]) & (names["key"] == found["hit_key"]), "left")
    return rows.select(
        F.col("id").alias(id_col), F.array_join("whole", ",").alias("license"),
        F.coalesce(F.array_join("notices", ","), F.lit("")).alias("notices"), F.coalesce("n", F.lit(0)).cast("long").alias("n_notice_lines"),
    )


def known_table(spark: SparkSession, known: tuple[tuple[str, str], ...] = KNOWN, digests: tuple[tuple[str, str], ...] = KNOWN_DIGESTS) -> DataFrame:
    """(license, text, digest): the texts given here and the digests of longer ones."""
    rows = [(name, text, None) for name, text in known] + [(name, None, digest) for name, digest in digests]
    names, texts, told = zip(*rows, strict=True)
    return spark.createDataFrame(pa.table({"license": list(names), "text": pa.array(texts, pa.string()), "digest": pa.array(told, pa.string())}))
