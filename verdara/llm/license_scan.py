"""Licence scan by canonical digests, with DataFrame functions.

A text is brought to a canonical form: lower case; lines that only state a copyright gone; everything but
letters and digits one space; equivalent spellings made one. Whole texts are joined by the digest of that form
to the digests of known licences, whose table is a constant of this module. Lines that name a licence are
looked up in the same way, so that a notice inside a longer document is reported beside the whole text's
verdict.

Defined cases: null text counts as empty, matches nothing and has the empty form's digest; repeated rows,
extra columns and very long texts change nothing; an empty table gives no rows. Several licences with one
canonical form are reported by the first id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdara.llm.license_texts import TEXTS

COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(?:copyright[ \t]*(?:\(c\)|©|[0-9]{4}|:|by )|\(c\)[ \t]|©|all rights reserved)[^\n]*$"
OTHER = r"[^\p{L}\p{N}]+"
LICENCE_WORD = r"licen[cs]e|spdx"
#: (spelling, canonical spelling), on the form with single spaces.
SPELLINGS = [
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("organisation", "organization"),
    ("authoris", "authoriz"),
    ("non infringement", "noninfringement"),
    ("merchantibility", "merchantability"),
    ("favour", "favor"),
    ("copyright owner", "copyright holder"),
    ("https", "http"),
]


def canonical(text: Column) -> Column:
    form = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT_LINE, ""), OTHER, " "))
    for other, usual in SPELLINGS:
        form = F.replace(form, F.lit(other), F.lit(usual))
    return form


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known(spark: SparkSession) -> DataFrame:
    """(digest, license_id, kind) of the known texts: as many rows as the constant table has."""
    rows = spark.createDataFrame(TEXTS, "license_id string, kind string, text string")
    return rows.select(digest(F.col("text")).alias("digest"), "license_id", "kind").groupBy("digest").agg(F.min("license_id").alias("license_id"), F.min("kind").alias("kind"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, text_digest, license_id (of the whole text), match_kind, notices (licence ids of its lines)."""
    spark = docs.sparkSession
    table = known(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.lower(x).rlike(LICENCE_WORD))
    rows = docs.select("doc_id", digest(text).alias("text_digest"), F.transform(lines, digest).alias("line_digests"))
    # The known table's size is fixed by this module, so it is broadcast, and as a map for the lines.
    notices = F.create_map(*[F.lit(x) for r in table.collect() for x in (r["digest"], r["license_id"])])
    ids = F.array_sort(F.array_distinct(F.array_compact(F.transform("line_digests", lambda d: F.try_element_at(notices, d)))))
    found = rows.join(F.broadcast(table), rows["text_digest"] == table["digest"], "left")
    return found.select("doc_id", "text_digest", "license_id", F.col("kind").alias("match_kind"), F.array_join(ids, ",").alias("notices"))
