"""The store's reads and the intake of requests, under the names of its published interface.

A store is a folder of Parquet tables. Reads give DataFrames, so what a reader asks further (an order, a page, a few
columns) reaches the scan. Answers are those of one analysis or one page: nothing here gathers a table.

Defined cases: a table that isn't written yet is empty; an unknown id gives no rows; a request that breaks a rule adds nothing
and raises UserInput with every code, by request.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from verdara.operators import requests, store
from verdara.operators.process import UserInput
from verdara.sinks import provenance

_REQUEST = "region_id string, bbox array<double>, start_date date, end_date date, max_cloud_cover_pct double, scene_limit int, strategy string, target_month int"
#: The tables: their columns.
TABLES = {
    "analyses": f"id string, {_REQUEST}, area_km2 double, status string, submitted_at timestamp, processing_version string, is_demo boolean, failure_category string, failure_detail string",
    "scenes": "id string, analysis_id string, item_id string, acquisition_key string, observed_at timestamp, cloud_cover_pct double, selected boolean, reason string, contributing_item_ids array<string>",
    "observations": "id string, analysis_id string, scene_id string, ndvi_mean double, ndvi_median double, valid_pixel_pct double, usable boolean",
    "artifacts": "id string, analysis_id string, scene_id string, artifact_type string, path string, size_bytes long, sha256 string, created_at timestamp",
    "provenance": "analysis_id string, document string",
    "regions": "id string, name string, label string, bbox array<double>",
}


class Store:
    def __init__(self, spark: SparkSession, path: str, limits: requests.Limits | None = None) -> None:
        self.spark, self.path, self.limits = spark, path.rstrip("/"), limits or requests.Limits()

    def table(self, name: str) -> DataFrame:
        schema = StructType.fromDDL(TABLES[name])
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def add(self, name: str, rows: DataFrame) -> None:
        """Append rows; columns that they lack are NULL."""
        schema = StructType.fromDDL(TABLES[name])
        made = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
        rows.select(*made).write.mode("append").parquet(f"{self.path}/{name}")

    # -- intake ------------------------------------------------------------------------------------------
    def submit(self, asked: DataFrame, today: date, version: str = "2.0.0") -> None:
        """Queue requests (id and the fields of a request): all of them, or none if one breaks a rule or its region is unknown."""
        names = [f.name for f in StructType.fromDDL(_REQUEST)]
        rows = asked.select("id", *[(F.col(n) if n in asked.columns else F.lit(None)).cast(f.dataType).alias(n) for n, f in zip(names, StructType.fromDDL(_REQUEST), strict=True)])
        rows = rows.withColumn("two", ~requests.one_source(F.col("region_id"), F.col("bbox")) & F.col("region_id").isNotNull())
        boxes = self.regions().select(F.col("id").alias("_region"), F.col("bbox").alias("_bbox"))
        rows = rows.join(boxes, F.col("region_id") == F.col("_region"), "left").withColumn("bbox", F.coalesce("bbox", "_bbox"))
        unknown = F.when(F.col("region_id").isNotNull() & F.col("_region").isNull(), "unknown_region")
        judged = requests.violations(rows, self.limits, today)
        judged = judged.withColumn("problems", F.concat(F.array_compact(F.array(F.when(F.col("two"), "region_and_bbox"), unknown)), "problems"))
        wrong = judged.where(F.size("problems") > 0).select("id", "problems").orderBy("id").limit(20).collect()
        if wrong:
            raise UserInput("; ".join(f"{r['id']}: {', '.join(r['problems'])}" for r in wrong))
        self.add("analyses", judged.withColumns({"status": F.lit("queued"), "submitted_at": F.current_timestamp(), "processing_version": F.lit(version), "is_demo": F.lit(False)}))

    # -- reads -------------------------------------------------------------------------------------------
    def _records(self, rows: DataFrame) -> DataFrame:
        return store.records(rows, self.regions())

    def list_analyses(self, limit: int = 20, offset: int = 0) -> DataFrame:
        """A page of records, the newest first, each with the total."""
        page = store.page_with_total(self.table("analyses"), "submitted_at", "id", limit, offset)
        return self._records(page).orderBy(F.desc("submitted_at"), "id")

    def get_analysis(self, analysis_id: str) -> DataFrame:
        return self._records(store.by_key(self.table("analyses"), "id", analysis_id))

    def scenes(self, analysis_id: str) -> DataFrame:
        rows = store.scenes_of(self.table("scenes"), analysis_id)
        return rows.withColumn("contributing_item_ids", store.contributing(F.col("contributing_item_ids"), F.col("item_id")))

    def timeseries(self, analysis_id: str) -> DataFrame:
        """Observations of usable acquisitions with their scenes, by time."""
        own = self.table("observations").where((F.col("analysis_id") == analysis_id) & F.col("usable"))
        scenes = self.table("scenes").where(F.col("analysis_id") == analysis_id).select("id", "item_id", "acquisition_key", "observed_at", "cloud_cover_pct")
        return store.observations_of_scenes(own.drop("id"), scenes).orderBy("observed_at", "acquisition_key")

    def artifacts(self, analysis_id: str) -> DataFrame:
        return store.artifacts_of(self.table("artifacts"), self.table("scenes"), analysis_id)

    def provenance(self, analysis_id: str) -> DataFrame:
        """The record, and what it breaks of its schema."""
        return provenance.breaches(self.table("provenance").where(F.col("analysis_id") == analysis_id))

    def regions(self) -> DataFrame:
        return store.regions_in_order(self.table("regions"))

    def public_config(self) -> dict:
        """The limits in force."""
        return {k: v.isoformat() if isinstance(v, date) else v for k, v in vars(self.limits.effective()).items()}
