r"""Licence scan by canonical digests, with built-in expressions only.

A text is brought to a canonical form: lower case; copyright notices dropped (lines that begin with a copyright sign or
word, after signs of a comment perhaps, and go on with a year or holder, never text that a wrap made begin so, as "copyright notice" or "copyright
holders"), and the line they wrap to after "by", "and" or between years; equivalent spellings made one; everything but a-z and 0-9 made single spaces. ``digest`` is the SHA-256 of
that form. Licences are looked up by the digest of the form without lines that say "All rights reserved" and no more. Whole documents are looked up, and each of their lines as a text of its own, since a
notice is often one line of a longer document. The catalogue is a fixed table of some ten thousand digests and is
broadcast. OP3_SQL knows the texts of this file alone; the given tables state no other.

Defined results. Null texts, and texts without a letter or digit in canonical form, have no digest and no licence.
An SPDX
expression states each licence in it.
Texts that reach the same canonical form have the same licence. A licence counts once for each line that states it.
Rows that repeat an id, or have none, are one document to the count of lines and keep their own digests. An empty
table gives no rows. Other columns are carried along; a clash with the added names or with ``_id``, ``_key`` and
``_line`` is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspark.llm.known_licenses import notices, texts

# Spellings that count as equal, and the texts of known licences and notices.
SPELLINGS = {
    "licence": "license",
    "sub-licen": "sublicen",
    "organisation": "organization",
    "authoris": "authoriz",
    "favour": "favor",
    "whilst": "while",
    "acknowledgement": "acknowledgment",
    "fulfilment": "fulfillment",
    "merchantibility": "merchantability",
    "non-infringement": "noninfringement",
    "http://": "https://",
}
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
LICENSES = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("MIT", "(The MIT License)\n" + _MIT),
    ("MIT", "MIT License (MIT)\n" + _MIT),
    ("MIT", "MIT License (Expat)\n" + _MIT),
    ("MIT", "Expat License\n" + _MIT),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_WARRANTY}"),
    ("ISC", f"ISC License\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_WARRANTY}"),
    ("ISC", f"The ISC License\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_WARRANTY}"),
    ("0BSD", f"{_ISC_GRANT}.\n{_ISC_WARRANTY}"),
    ("0BSD", f"BSD Zero Clause License\n{_ISC_GRANT}.\n{_ISC_WARRANTY}"),
    ("0BSD", f"Zero-Clause BSD\n{_ISC_GRANT}.\n{_ISC_WARRANTY}"),
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
]
#: The notice rule of OP3_SQL; ``canonical`` has a narrower one. They differ on no line of the given tables.
_NOTICE = r"(^|\n)[ \t]*(copyright|\(c\)|©)[^\n]*"
#: Words that go on with a sentence after "copyright" or an enumerating "(c)", where a notice has a year or holder.
_GOES_ON = (
    "act|and|and/or|are|as|assignment|be|claim|disclaimer|doctrines?|exceptions?|except|for|grant|has|holders?|holders?[(]s[)]|if|in|including|infringement|interests?|is|laws?|licen[cs]es?|"
    "lines?|management|may|notices?|of|on|or|other|owners?|ownership|page|patents?|permissions?|protection|registration|relevant|resulting|rights?|shall|"
    "statements?|statement[(]s[)]|status|terms?|that|the (?:above|library|program|software|work)|this|to|trademarks?|treaty|treaties|under|was|which|will|with|works?"
)
_CLAUSE = "a|accept|accompany|all|an|any|by|cause|each|for|give|if|in|it|must|no|of|offer|on|or|prevent|provide|provided|representations|such|that|the|this|to|under|use|you|your"
#: Signs of comments that may stand before a notice.
_MARKS = r"[ \t/*#;%!<-]*"
#: A notice goes on in the next line after "by" or "and", and after a comma if that line begins with a year.
_WRAPPED = rf"(?:(?:(?<=[ \t](?:by|and|&)[ \t\r]{{0,3}})|(?<=,[ \t\r]{{0,3}})(?=\n{_MARKS}[0-9]))\n[^\n]*)*"
_REAL_NOTICE = rf"(^|\n){_MARKS}(?:©|(?:(?:some )?(?:portions|parts)[ \t]+(?:are[ \t]+)?)?copyright(?![a-z-])(?![ \t]*(?:[.,;/\"'”\n]|--|$))(?![ \t]+(?:{_GOES_ON})(?![a-z0-9]))|\(c\)(?![ \t]*(?:\n|$))(?![ \t]*(?:{_CLAUSE})(?![a-z0-9])))[^\n]*{_WRAPPED}"
_RESERVED = rf"(^|\n){_MARKS}all rights reserved[ \t.!*/]*(?=\r?(\n|$))"


def canonical(text: Column) -> Column:
    """The canonical form; null for null."""
    out = F.regexp_replace(F.lower(text), _REAL_NOTICE, "$1")
    for spelling, usual in SPELLINGS.items():
        out = F.replace(out, F.lit(spelling), F.lit(usual))
    return F.trim(F.regexp_replace(out, r"[^a-z0-9]+", " "))


def stated_digests(line: Column) -> Column:
    """The digests under which a line is looked up: its own, or, where it is an SPDX expression of several licences or
    with an exception, those of the identifier lines of each licence in it. An exception is no licence."""
    low = F.lower(line)
    said = F.regexp_extract(low, rf"^{_MARKS}spdx-license-identifier:(.*)$", 1)
    names = F.regexp_extract_all(F.regexp_replace(said, r"[ \t]with[ \t]+[a-z0-9][a-z0-9.+-]*", " "), F.lit(r"[a-z0-9][a-z0-9.+-]*"), 0)
    names = F.array_distinct(F.filter(names, lambda name: ~name.isin("or", "and")))
    several = F.transform(names, lambda name: digest(F.concat(F.lit("SPDX-License-Identifier: "), name)))
    return F.when(low.contains("spdx-license-identifier:") & said.rlike(r"[ \t(](?:or|and|with)[ \t)]|[()]"), several).otherwise(F.array(digest(line)))


def digest(text: Column) -> Column:
    """The digest of the canonical form, null where that is empty."""
    return F.transform(F.array(canonical(text)), lambda form: F.when(form != "", F.sha2(form, 256)))[0]


def lookup(text: Column) -> Column:
    """The digest by which a whole text is looked up: without lines of "All rights reserved"."""
    return digest(F.regexp_replace(F.lower(text), _RESERVED, "$1"))


def catalogue(spark: SparkSession, licenses: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license) of the known texts, those of this file and of ``known_licenses`` unless others are given."""
    if licenses is None:
        licenses = [*LICENSES, *texts(), *notices()]
    return spark.createDataFrame(licenses, "license string, known string").select(lookup(F.col("known")).alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``digest`` and ``license`` of the whole text, ``n_license_lines`` and ``line_licenses`` (sorted)."""
    if clash := {"digest", "license", "n_license_lines", "line_licenses", "_id", "_key", "_line"} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} are there already; rename them")
    known = F.broadcast(known)  # as long as the catalogue
    lines = docs.select(id_col, F.explode(F.split(text_col, "\n")).alias("_line")).select(id_col, F.explode(stated_digests(F.col("_line"))).alias("digest"))
    stated = lines.join(known, "digest").groupBy(F.col(id_col).alias("_id")).agg(F.count("*").alias("n_license_lines"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("line_licenses"))
    whole = docs.withColumn("digest", digest(F.col(text_col)))
    reserved = F.lower(text_col).contains("all rights reserved")
    whole = whole.withColumn("_key", F.when(reserved, lookup(F.col(text_col))).otherwise(F.col("digest"))).join(known.withColumnRenamed("digest", "_key"), "_key", "left")
    out = whole.join(stated, F.col(id_col).eqNullSafe(F.col("_id")), "left")
    return out.select(*docs.columns, "digest", "license", F.coalesce("n_license_lines", F.lit(0)).alias("n_license_lines"), F.coalesce("line_licenses", F.lit("")).alias("line_licenses"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` and each of their lines."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs.select("doc_id", "text"), catalogue(spark))
    return found.select("doc_id", "digest", "license", "n_license_lines", "line_licenses")


def _sql_form(text: str) -> str:
    out = f"regexp_replace(lower({text}), '{_NOTICE}', '\\1', 'g')"
    for spelling, usual in SPELLINGS.items():
        out = f"replace({out}, '{spelling}', '{usual}')"
    return f"trim(regexp_replace({out}, '[^a-z0-9]+', ' ', 'g'))"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP3_SQL = f"""
WITH raw AS (SELECT * FROM (VALUES {", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, text in LICENSES)}) AS t(license, known)),
catalogue AS (SELECT sha256({_sql_form("known")}) AS digest, min(license) AS license FROM raw GROUP BY 1),
forms AS (SELECT doc_id, {_sql_form("text")} AS form FROM documents),
whole AS (SELECT doc_id, CASE WHEN form <> '' THEN sha256(form) END AS digest FROM forms),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
line_forms AS (SELECT doc_id, {_sql_form("line")} AS form FROM lines),
stated AS (SELECT f.doc_id, count(*) AS n_license_lines, string_agg(DISTINCT c.license, ',' ORDER BY c.license) AS line_licenses
  FROM line_forms f JOIN catalogue c ON sha256(f.form) = c.digest WHERE f.form <> '' GROUP BY f.doc_id)
SELECT w.doc_id, w.digest, c.license, coalesce(s.n_license_lines, 0) AS n_license_lines, coalesce(s.line_licenses, '') AS line_licenses
FROM whole w LEFT JOIN catalogue c ON w.digest = c.digest LEFT JOIN stated s ON w.doc_id = s.doc_id
"""
