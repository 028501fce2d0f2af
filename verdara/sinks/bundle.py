"""Bundles of analyses: rows of the store's tables and the contents of their files, written by one store, taken in by another.

A bundle is a folder of Parquet: a table for each of the store's tables, and `blobs` (path, size_bytes, sha256, content),
a file a row, read and written where its task is. Taking it in checks every digest before a row is given out, and gives what
the store doesn't hold yet, so doing it twice adds nothing.

Defined cases: files that rows name but that aren't there are errors when the bundle is written; a bundle of no analysis
is a bundle; a table that a bundle lacks gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdara.sources.stac_items import fresh

#: Tables of a bundle: the column that names the analysis, and the key.
TABLES = {"analyses": ("id", "id"), "scenes": ("analysis_id", "id"), "observations": ("analysis_id", "id"), "artifacts": ("analysis_id", "id")}


class BrokenBundle(Exception):
    """Files that are missing or aren't what the bundle says they are."""


def export(tables: dict[str, DataFrame], ids: DataFrame, files: str, path: str, kinds: list[str] | None = None) -> None:
    """Write the analyses named in `ids` (id): their rows, and of their artefacts (path, relative to `files`) those of the given kinds."""
    spark = ids.sparkSession
    wanted = ids.select(F.col("id").alias("_wanted")).distinct()
    for name, (owner, _) in TABLES.items():
        rows = tables[name].join(wanted, F.col(owner) == F.col("_wanted"), "left_semi")
        if name == "artifacts" and kinds is not None:
            rows = rows.where(F.col("artifact_type").isin(*kinds))
        rows.write.mode("overwrite").parquet(f"{path}/{name}")
    named = spark.read.parquet(f"{path}/artifacts").select(F.col("path").alias("_path")).distinct()
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(files)
    relative = F.regexp_replace("path", r"^.*?" + files.split(":")[-1].lstrip("/").replace(".", r"\."), "")
    blobs = found.select(F.ltrim(relative, F.lit("/")).alias("path"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), "content")
    blobs.join(named, F.col("path") == F.col("_path"), "left_semi").write.mode("overwrite").parquet(f"{path}/blobs")
    lost = named.join(spark.read.parquet(f"{path}/blobs").select("path"), F.col("_path") == F.col("path"), "left_anti")
    if missing := [r[0] for r in lost.orderBy("_path").limit(5).collect()]:
        raise BrokenBundle("no file for " + ", ".join(missing))


def broken(spark: SparkSession, path: str) -> DataFrame:
    """(path): artefacts whose bytes aren't there, or differ from their digest or size."""
    blobs = spark.read.parquet(f"{path}/blobs")
    held = blobs.select(F.col("path").alias("_path"), F.octet_length("content").cast("long").alias("_size"), F.sha2("content", 256).alias("_sha"))
    rows = spark.read.parquet(f"{path}/artifacts").join(held, F.col("path") == F.col("_path"), "left")
    sound = (F.col("_size") == F.col("size_bytes")) & (F.col("_sha") == F.col("sha256"))
    return rows.where(~F.coalesce(sound, F.lit(False))).select("path").distinct()


def take_in(spark: SparkSession, path: str, stored: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(rows to add to each table, files (path, size_bytes, sha256, content) to store), or BrokenBundle."""
    if wrong := [r[0] for r in broken(spark, path).orderBy("path").limit(5).collect()]:
        raise BrokenBundle("not as the bundle says: " + ", ".join(wrong))
    new = {name: fresh(spark.read.parquet(f"{path}/{name}"), stored[name], key) for name, (_, key) in TABLES.items()}
    files = spark.read.parquet(f"{path}/blobs").join(new["artifacts"].select(F.col("path").alias("_new")).distinct(), F.col("path") == F.col("_new"), "left_semi")
    return new, files
