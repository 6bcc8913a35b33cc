"""Licence scan by canonical digests (native: DataFrame functions only).

A text is made canonical: lower case, without copyright lines, with equivalent
spellings unified and everything but letters and digits as one space. Its digest
is looked up in a table of known licence texts by a hash join: the whole text's,
and that of each of its lines, since notices stand as lines in other texts. The
module knows the texts of ``KNOWN`` and ``KNOWN_DIGESTS``; a caller adds a table of
others. The known digests are counted, and broadcast up to ``BROADCAST_ROWS`` rows.

One narrow table (row, key, digest, lines' digests) is written; the texts are
read once and never shuffled.

Defined results: null and empty texts have the digest of the empty text and no
licence; rows repeat as given; other columns are ignored; an empty table gives an
empty result. Lines of any length are scanned whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakehook.llm.common import materialise, table, text_or_empty

# Pairs of equivalent spellings, after lower-casing; the second one stands.
SPELLINGS = [
    ("acknowledgement", "acknowledgment"), ("authoris", "authoriz"), ("behaviour", "behavior"),
    ("favour", "favor"), ("fulfilment", "fulfillment"), ("initialis", "initializ"),
    ("judgement", "judgment"), ("labour", "labor"), ("licence", "license"),
    ("merchantibility", "merchantability"), ("modernis", "moderniz"), ("non-commercial", "noncommercial"),
    ("organis", "organiz"), ("per cent", "percent"), ("practise", "practice"), ("programme", "program"),
    ("recognis", "recogniz"), ("sub-license", "sublicense"), ("utilis", "utiliz"), ("wilful", "willful"),
    ("https://", "http://"),
]

_GRANT_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
    "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE "
    "FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS "
    "OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT "
    "OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
# Known licence texts and notices, by SPDX identifier.
KNOWN = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "MIT License\n\nCopyright (c) <year> <copyright holders>\n\n"
     "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     'documentation files (the "Software"), to deal in the Software without restriction, including without '
     "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
     "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
     "conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or "
     'substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, '
     "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
     "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
     "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
     "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "ISC License\n\nCopyright (c) <year> <owner>\n\nPermission to use, copy, modify, and/or distribute this "
     "software for any purpose with or without fee is hereby granted, provided that the above copyright notice and "
     "this permission notice appear in all copies.\n\n" + _GRANT_AS_IS),
    ("0BSD", "BSD Zero Clause License\n\nCopyright (c) <year> <owner>\n\nPermission to use, copy, modify, and/or "
     "distribute this software for any purpose with or without fee is hereby granted.\n\n" + _GRANT_AS_IS),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except '
     "in compliance with the License. You may obtain a copy of the License at\n\n"
     "http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, "
     'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF '
     "ANY KIND, either express or implied. See the License for the specific language governing permissions and "
     "limitations under the License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("LicenseRef-all-rights-reserved", "All rights reserved."),
]
# Digests of whole licence texts, as distributed, after they are made canonical.
KNOWN_DIGESTS: dict[str, list[str]] = {
    # with the appendix, without its lines to fill in, without the appendix
    "Apache-2.0": ["b200db14d43f341836ccc14296f66944", "d44d7dd7bb33c43e91c9d5e48b1d489e", "2907559bf696d33fdfdc7da57023e979"],
    "Artistic-1.0-Perl": ["a8b0fb0c6e43a3b36bdc159e59dbfd1e"],
    "BSD-2-Clause": ["86f56c47a776acba8d7b43470d449555", "9f9962ab98a42b4004ece981910e78b9"],
    "BSD-3-Clause": ["6989781d8e3e31bf06f590dd203d4e65", "dbcc6b46cd5b3ad519ba6d13a4021fcd", "a7bff467668048cc8d597b480fb1b110"],
    "CC0-1.0": ["93a180096f6cfcf2c0dd24f75c2eec48"],
    "GFDL-1.2-only": ["49ffacd2fea52c0c124f0d16bc990c74"],
    "GFDL-1.3-only": ["2d7ce083c264cf7f093acc742260e501"],
    "GPL-1.0-only": ["97008616a6c74f408568b284dd04871d"],
    "GPL-2.0-only": ["bc956f44d1c84837504c207f245fa68b"],
    "GPL-3.0-only": ["973bd6aa012124b0398a2ebfb853eea4"],
    "LGPL-2.0-only": ["6885b1a1b528de907e6c89bd80a1ea4f"],
    "LGPL-2.1-only": ["79aa7998cfa6069eae71d7bea9b32641"],
    "LGPL-3.0-only": ["b31b7335bc37919e8cdd79154e04d88d"],
    "MPL-1.1": ["9fa8ae3e869a929215034d82982372b5"],
    "MPL-2.0": ["b5b7a0cf4994910cd0204fba4637d6ec"],
}
# 100 bytes a row.
BROADCAST_ROWS = 100_000
# A copyright line: the word or sign, at a line's start, with a year, owner or sign after it.
COPYRIGHT = r"(?m)^[ \t]*(?:copyright[ \t]*(?:\(c\)|©|[0-9<])|\(c\)[ \t]*[0-9<]|©)[^\n]*$"


def canonical(text: Column) -> Column:
    """Canonical lines, separated by line feeds."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT, "")
    for variant, standard in SPELLINGS:
        out = F.replace(out, F.lit(variant), F.lit(standard))
    return F.regexp_replace(F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", " "), r" *\n[ \n]*", "\n")


def one_line(canon: Column) -> Column:
    return F.trim(F.replace(canon, F.lit("\n"), F.lit(" ")))


def digests_of(texts: DataFrame) -> DataFrame:
    """(digest, license) of a table of known texts (license, text); of texts with one
    digest, the smallest licence name counts."""
    rows = texts.where("license is not null").select("license", F.md5(one_line(canonical(text_or_empty())).cast("binary")).alias("digest"))
    return rows.groupBy("digest").agg(F.min("license").alias("license"))


def known_table(spark: SparkSession) -> DataFrame:
    """(digest, license) of the texts that this module knows, some by their digests alone."""
    rows = spark.createDataFrame([(d, i) for i, ds in KNOWN_DIGESTS.items() for d in ds], "digest string, license string")
    return digests_of(spark.createDataFrame(KNOWN, "license string, text string")).union(rows)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", known: DataFrame | None = None) -> DataFrame:
    """One row per row: key, digest (of the whole canonical text), license (of the
    whole text, or null), notices (licences of its lines, sorted), n_notices.

    ``known`` is a table of licence texts (license, text) to look for besides the
    module's own; the module's name stands where both have a text.
    """
    table_ = known_table(docs.sparkSession)
    if known is not None:
        more = digests_of(known).join(table_, "digest", "left_anti")
        table_ = table_.unionByName(more)
    table_ = materialise(table_, "license-known")
    known = F.broadcast(table_) if table_.count() <= BROADCAST_ROWS else table_
    lines = F.filter(F.transform(F.split("canon", "\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    narrow = materialise(
        docs.select(F.col(key).alias("id"), canonical(text_or_empty(text)).alias("canon"))
        .select("id", F.monotonically_increasing_id().alias("row"),
                F.md5(one_line(F.col("canon")).cast("binary")).alias("digest"),
                F.transform(lines, lambda x: F.unhex(F.md5(x.cast("binary")))).alias("lines")), "license-digests")
    found = (narrow.select("row", F.explode("lines").alias("line"))
             .join(known.select(F.unhex("digest").alias("line"), "license"), "line")
             .groupBy("row").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"),
                                 F.count(F.lit(1)).alias("n_notices")))
    return (narrow.select("id", "row", "digest").join(known, "digest", "left").join(found, "row", "left")
            .select(F.col("id").alias(key), "digest", "license", "notices",
                    F.coalesce("n_notices", F.lit(0)).alias("n_notices")))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql_canonical(text: str) -> str:
    out = f"regexp_replace(lower({text}), '{COPYRIGHT}', '', 'g')"
    for variant, standard in SPELLINGS:
        out = f"replace({out}, '{variant}', '{standard}')"
    return rf"regexp_replace(regexp_replace({out}, '[^\p{{L}}\p{{N}}\n]+', ' ', 'g'), ' *\n[ \n]*', chr(10), 'g')"


def _oracle() -> str:
    digests = ", ".join(f"('{d}', '{i}')" for i, ds in KNOWN_DIGESTS.items() for d in ds)
    values = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in KNOWN)
    return f"""
WITH known AS (
  SELECT DISTINCT md5(trim(replace({_sql_canonical("t")}, chr(10), ' '))) AS digest, license
  FROM (VALUES {values}) k(license, t)
  UNION ALL SELECT * FROM (VALUES {digests})),
d AS (SELECT doc_id, {_sql_canonical("coalesce(text, '')")} AS canon FROM documents),
w AS (SELECT doc_id, md5(trim(replace(canon, chr(10), ' '))) AS digest FROM d),
n AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices, count(*) AS n_notices
      FROM (SELECT doc_id, unnest(string_split(canon, chr(10))) AS line FROM d) l
      JOIN known ON md5(trim(l.line)) = known.digest AND length(trim(l.line)) > 0 GROUP BY doc_id)
SELECT doc_id, digest, license, notices, coalesce(n_notices, 0) AS n_notices
FROM w LEFT JOIN known USING (digest) LEFT JOIN n USING (doc_id)
"""


ORACLE = _oracle()
