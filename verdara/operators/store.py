"""The result store's reads and changes: pages, joins of its tables, artefacts, upserts, deletion, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Statuses, artefact types that belong to a whole analysis, and the first version with one grid.
IN_FLIGHT = ("queued", "running")
ANALYSIS_LEVEL = ("timeseries_csv", "analysis_summary", "provenance")
GRID_MAJOR_VERSION = 2


# -- reads ---------------------------------------------------------------------------------------------
def page(rows: DataFrame, at: str, key: str, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of rows, the newest first; limit from 1 to 100."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit must be 1 to 100, offset 0 or more")
    return rows.orderBy(F.desc(at), key).offset(offset).limit(limit)


def page_with_total(rows: DataFrame, at: str, key: str, limit: int = 20, offset: int = 0) -> DataFrame:
    """`page` with `total`, the number of all rows, on each of its rows; a page beyond the end has no row to say it on."""
    return page(rows, at, key, limit, offset).join(F.broadcast(rows.agg(F.count("*").alias("total"))))  # one row


def regions_in_order(regions: DataFrame) -> DataFrame:
    return regions.orderBy("name", "id")


def scenes_of(scenes: DataFrame, analysis_id) -> DataFrame:
    """Scenes of one analysis, the earliest first."""
    return scenes.where(F.col("analysis_id") == analysis_id).orderBy("observed_at", "id")


def artifacts_of(artifacts: DataFrame, scenes: DataFrame, analysis_id) -> DataFrame:
    """Artefacts of one analysis with the items of their scenes, if they have one, the first made first."""
    item = scenes.select(F.col("id").alias("_sid"), "item_id")
    own = artifacts.where(F.col("analysis_id") == analysis_id)
    return own.join(item, own["scene_id"] == item["_sid"], "left").drop("_sid").orderBy("created_at", "id")


def by_key(rows: DataFrame, key: str, value) -> DataFrame:
    """The row of a key: one or none."""
    return rows.where(F.col(key) == value).limit(1)


def observations_of_scenes(observations: DataFrame, scenes: DataFrame) -> DataFrame:
    """The time series of all analyses: observations (scene_id) with the columns of their scenes (id)."""
    return observations.join(scenes, observations["scene_id"] == scenes["id"]).drop(scenes["id"])


def artifact_group(item_id: Column, scene_id: Column) -> Column:
    return F.coalesce(item_id.cast("string"), scene_id.cast("string"), F.lit("unattributed"))


def grouped_artifacts(artifacts: DataFrame) -> DataFrame:
    """artifacts (analysis_id, artifact_type, item_id, scene_id, path, size_bytes) by group: those of the analysis
    first, under NULL, then one group a scene, each with its paths, their number and their size in MB."""
    group = F.when(~F.col("artifact_type").isin(*ANALYSIS_LEVEL), artifact_group(F.col("item_id"), F.col("scene_id")))
    by = artifacts.groupBy("analysis_id", group.alias("item"))
    return by.agg(F.array_sort(F.collect_list("path")).alias("paths"), F.count("*").alias("n_files"), (F.sum("size_bytes") / 1e6).alias("size_mb"))


def first_artifacts(artifacts: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first artefact of each (item, type)."""
    return artifacts.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_k = 1").drop("_k")


def comparison_points(points: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """first and last observation of each key; NULL for fewer than two."""
    order, row, two = F.struct(at, tie), F.struct(*points.columns), F.count("*") >= 2
    return points.groupBy(key).agg(F.when(two, F.min_by(row, order)).alias("first"), F.when(two, F.max_by(row, order)).alias("last"))


def extremes_by_cloud(rows: DataFrame, key: str, cloud: str, item: str) -> DataFrame:
    """The cloudiest and the clearest row of each key; ties go to the least item."""
    return rows.where(F.col(cloud).isNotNull()).groupBy(key).agg(F.min_by(item, F.struct(-F.col(cloud), F.col(item))).alias("cloudiest"), F.min_by(item, F.struct(cloud, item)).alias("clearest"))


def axis_domain(points: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(low, high) of a chart's axis: the values' range, padded by 0.05, out to tenths, within -1 and 1."""
    by = points.groupBy(key).agg(F.min(F.least(*columns)).alias("lo"), F.max(F.greatest(*columns)).alias("hi"))
    low, high = F.floor((F.coalesce("lo", F.lit(0.0)) - 0.05) * 10) / 10, F.ceil((F.coalesce("hi", F.lit(1.0)) + 0.05) * 10) / 10
    return by.select(key, F.greatest(low, F.lit(-1.0)).alias("low"), F.least(high, F.lit(1.0)).alias("high"))


def analysis_summary(results: DataFrame, key: str = "analysis_id") -> DataFrame:
    """One row an analysis from results (observed_at, acquisition_key, usable, ndvi_mean, valid_pixel_pct,
    coverage_pct, grid): counts, first and last observation and their change, shares, and whether there is one grid."""
    ok = F.col("usable") & F.col("valid_pixel_pct").isNotNull()
    order = F.when(ok, F.struct("observed_at", "acquisition_key"))
    mean = F.struct("ndvi_mean")  # inside a struct a NULL mean of the first observation stays its mean
    out = results.groupBy(key).agg(
        F.count_if(ok).alias("usable_scene_count"), F.count_if(~F.col("usable")).alias("unusable_scene_count"), F.min(F.when(ok, F.col("observed_at"))).alias("first_observation"), F.max(F.when(ok, F.col("observed_at"))).alias("last_observation"),
        F.min_by(mean, order)["ndvi_mean"].alias("ndvi_mean_first"), F.max_by(mean, order)["ndvi_mean"].alias("ndvi_mean_last"), F.avg(F.when(ok, F.col("valid_pixel_pct"))).alias("mean_valid_pixel_pct"),
        F.min(F.when(ok, F.col("coverage_pct"))).alias("min_aoi_coverage_pct"), F.when(F.count_if(ok) > 0, F.count_distinct(F.when(ok, F.col("grid"))) <= 1).alias("identical_analytical_grid"),
    )
    return out.withColumn("ndvi_mean_change", F.col("ndvi_mean_last") - F.col("ndvi_mean_first"))


def records(analyses: DataFrame, regions: DataFrame) -> DataFrame:
    """Analyses as readers get them: area to two places, region, failure, and links."""
    base = F.concat(F.lit("/api/v1/analyses/"), F.col("id").cast("string"))
    links = F.struct(base.alias("self"), *[F.concat(base, F.lit(f"/{k}")).alias(k) for k in ("scenes", "timeseries", "artifacts", "provenance")])
    failure = F.when(F.col("failure_category").isNotNull(), F.struct(F.col("failure_category").alias("category"), F.col("failure_detail").alias("detail")))
    named = regions.select(F.col("id").alias("_rid"), F.struct(*[c for c in regions.columns]).alias("region"))
    out = analyses.join(named, F.col("region_id") == F.col("_rid"), "left").drop("_rid")
    return out.withColumns({"area_km2": F.round("area_km2", 2), "failure": failure, "links": links})


def contributing(item_ids: Column, own: Column) -> Column:
    """The contributing items of a scene; its own item if none is recorded."""
    return F.when(F.size(item_ids) > 0, item_ids).otherwise(F.array(own))


def group_regions(regions: DataFrame, label: str, first: list[str], member: str, order: str) -> DataFrame:
    """Members of each label in their order; labels of `first` come in that order, all others after them."""
    rank = F.array_position(F.array(*[F.lit(x) for x in first]), F.col(label)).cast("int")
    rank = F.when(rank > 0, rank - 1).otherwise(len(first))
    by = regions.groupBy(label, rank.alias("rank")).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(member).alias("m")))).alias("s"))
    return by.select(label, "rank", F.col("s")["m"].alias("members"))


# -- changes -------------------------------------------------------------------------------------------
def upsert(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """`stored` with the rows of `new` in place of those of the same key, or added."""
    fresh = new.select(F.col(key), F.struct(*new.columns).alias("_new"))
    both = stored.select(F.col(key), F.struct(*stored.columns).alias("_old")).join(fresh, key, "full")
    return both.select(F.coalesce("_new", "_old").alias("r")).select("r.*")


def charge(artifacts: DataFrame, key: str, size: str, order: list[str], limit: float) -> DataFrame:
    """Adds charged, the bytes stored up to each artefact of its analysis, and over_budget."""
    total = F.sum(size).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return artifacts.withColumn("charged", total).withColumn("over_budget", F.col("charged") > limit)


def major_version(version: Column) -> Column:
    return F.coalesce(F.get(F.split(version, r"\."), F.lit(0)).try_cast("int"), F.lit(0))


def demo_present(analyses: DataFrame) -> DataFrame:
    """Demonstration analyses that count as there: with a grid, and finished or under way."""
    return analyses.where(F.col("is_demo") & F.col("status").isin("succeeded", *IN_FLIGHT) & F.col("grid").isNotNull())


def deletion_plan(analyses: DataFrame, artifacts: DataFrame, ids: list | None = None, legacy: bool = False, force: bool = False) -> DataFrame:
    """(id, n_artifacts, size_mb, refused) of the analyses to delete: those named, or those of a version without a
    common grid. `refused` says why one may not go: it is in flight, or it is the newest finished demonstration."""
    if not ids and not legacy:
        raise ValueError("name analyses or ask for legacy ones")
    target = major_version(F.col("processing_version")) < GRID_MAJOR_VERSION if legacy else F.col("id").isin(*ids)
    newest = analyses.where(F.col("is_demo") & (F.col("status") == "succeeded")).agg(F.max_by("id", "submitted_at").alias("_demo"))
    sizes = artifacts.groupBy(F.col("analysis_id").alias("_aid")).agg(F.count("*").alias("n"), F.sum("size_bytes").alias("b"))
    rows = analyses.where(target).join(F.broadcast(newest)).join(sizes, F.col("id") == F.col("_aid"), "left")
    why = F.when(F.col("status").isin(*IN_FLIGHT), "in_flight").when(F.col("id") == F.col("_demo"), "demo")
    return rows.select("id", F.coalesce("n", F.lit(0)).alias("n_artifacts"), (F.coalesce("b", F.lit(0)) / 1e6).alias("size_mb"), (F.lit(None).cast("string") if force else why).alias("refused"))


def delete_analyses(plan: DataFrame, tables: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """Each table without the rows of the plan's analyses; tables: name to (table, its column of analysis ids).

    All or nothing: if one analysis of the plan is refused, this raises. Files go before rows, so that a run that
    is cut off leaves rows to be found, not files that nothing names."""
    if refused := sorted(f"{r['id']}: {r['refused']}" for r in plan.where("refused is not null").limit(10).collect()):
        raise ValueError("refusing to delete " + ", ".join(refused))
    gone = plan.select(F.col("id").alias("_gone"))
    return {name: t.join(gone, t[column] == gone["_gone"], "left_anti") for name, (t, column) in tables.items()}


def replace_attempt(rows: DataFrame, path: str, by: str = "analysis_id") -> None:
    """Write the rows of some analyses in place of all that earlier attempts stored for them; others stay."""
    rows.write.partitionBy(by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def register_artifacts(files: DataFrame, analysis_id: Column, kind: Column, content_type: Column) -> DataFrame:
    """Rows of the artefact table from (path, size_bytes, sha256)."""
    return files.select(analysis_id.alias("analysis_id"), kind.alias("artifact_type"), "path", content_type.alias("content_type"), "size_bytes", "sha256")
