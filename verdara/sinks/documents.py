"""Result documents and artefact rows: summaries, time series, checksums, demo export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The published header, in its order.
TIMESERIES_COLUMNS = """acquisition_key primary_item_id contributing_item_ids tile_ids granule_count observed_at
stac_cloud_cover_pct aoi_coverage_pct valid_coverage_pct missing_data_pct valid_pixel_count masked_pixel_count
valid_pixel_pct ndvi_min ndvi_max ndvi_mean ndvi_median ndvi_std ndvi_p10 ndvi_p25 ndvi_p75 ndvi_p90""".split()


def document(**fields: Column) -> Column:
    """JSON text of the fields, keys sorted, NULLs written as null."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in sorted(fields.items())]), {"ignoreNullFields": "false"})


def write_timeseries(rows: DataFrame, path: str) -> None:
    """One CSV file with the published header; ids are joined by spaces. The rows are one an acquisition of one analysis."""
    kinds = dict(rows.dtypes)
    made = [F.array_join(c, " ").alias(c) if kinds[c].startswith("array") else F.col(c) for c in TIMESERIES_COLUMNS]
    rows.orderBy("observed_at", "acquisition_key").select(*made).coalesce(1).write.mode("overwrite").csv(path, header=True)


def artifact_rows(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, size_bytes, sha256 of each file below a folder; contents stay in their tasks."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def provenance_problems(rows: DataFrame, required: list[str]) -> DataFrame:
    """Rows of provenance that break a constraint, with the names of the missing fields."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))
    return rows.withColumn("missing", missing).where(F.size("missing") > 0)


def export_demo(artifacts: DataFrame, analysis_id: str, kinds: list[str], path: str) -> DataFrame:
    """Write the manifest rows of one analysis's artefacts of the given kinds as JSON; returns them."""
    rows = artifacts.where((F.col("analysis_id") == analysis_id) & F.col("artifact_type").isin(*kinds))
    rows.write.mode("overwrite").json(path)
    return rows
