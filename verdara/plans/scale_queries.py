"""Forms of queries for groups and joins of any size, each with the SQL of the plain form."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from verdara.operators import bucketed, percentiles, raster, selection, store
from verdara.plans.queries import _t, indexed, query
from verdara.plans.registry import QUERIES, SQL
from verdara.session import scratch_path
from verdara.streaming import metrics, state


@query(SQL["ndvi_scene_stats"])
def ndvi_scene_stats_refined(spark, d):
    return raster.scene_stats_refined(indexed(spark, d))


@query("SELECT l_returnflag, count(*) AS n, " + ", ".join(f"round(quantile_cont(l_extendedprice, {p}), 4) AS p{int(100 * p)}" for p in (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)) + " FROM lineitem GROUP BY 1")
def price_percentiles(spark, d):
    shares = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    found = percentiles.exact(_t(spark, d, "lineitem"), "l_returnflag", F.col("l_extendedprice"), list(shares))
    return found.select("l_returnflag", "n", *[F.round(F.col("shares")[k], 4).alias(f"p{int(100 * p)}") for k, p in enumerate(shares)])


def _table(spark, rows, name: str, key: str):
    """`rows` laid out by `key` in eight buckets."""
    return bucketed.store(rows, f"{name}_{uuid.uuid4().hex[:12]}", key, 8, scratch_path(spark, name))


@query(SQL["ts_join"])
def ts_join_bucketed(spark, d):
    """Every observation beside its scene, of tables that lie by scene."""
    scenes = _table(spark, _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderdate"), "scenes", "id")
    lines = _table(spark, _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("scene_id"), "l_linenumber", "l_partkey", "l_shipdate"), "observations", "scene_id")
    return bucketed.joined(lines, scenes, "scene_id", "id").select(F.col("scene_id").alias("o_orderkey"), "l_linenumber", "l_partkey", "o_orderdate", "l_shipdate")


@query(SQL["artifacts_outer_join"])
def artifacts_bucketed(spark, d):
    """Every customer beside its artefacts, if any, of tables that lie by customer."""
    items = _table(spark, _t(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey"), "artifacts", "o_custkey")
    owners = _table(spark, _t(spark, d, "customer").select("c_custkey"), "owners", "c_custkey")
    return bucketed.joined(owners, items, "c_custkey", "o_custkey", "left").select("c_custkey", "o_orderkey", store.artifact_group(F.col("o_orderkey"), F.lit(None)).alias("item"))


# -- late granules: events arrive in four lots without order, and each lot corrects what was published ----
@query("""SELECT event_type || '|R' || (user_id % 3) || '|' || strftime(ts, '%Y-%m-%d') AS acquisition_key, count(*) AS granule_count, epoch_us(min(ts)) AS observed_us, min(CAST(json_extract(props, '$.k') AS DOUBLE)) AS least_cloud,
 md5(string_agg(CAST(event_id AS VARCHAR), ' ' ORDER BY CAST(event_id AS VARCHAR))) AS items_md5 FROM events GROUP BY 1""")
def late_acquisitions(spark, d):
    e = _t(spark, d, "events")
    key = F.concat_ws("|", "event_type", F.concat(F.lit("R"), (F.col("user_id") % 3).cast("string")), F.date_format("ts", "yyyy-MM-dd"))
    granules = e.select(key.alias("acquisition_key"), F.col("event_id").cast("string").alias("item_id"), F.col("ts").cast("timestamp").alias("ts"), F.get_json_object("props", "$.k").cast("double").alias("cloud"), F.pmod(F.xxhash64("event_id"), F.lit(4)).alias("lot"))
    root = scratch_path(spark, "late")
    # A lot is written by all cores, a file each, and read at once.
    files = spark.sparkContext.defaultParallelism
    for lot in range(4):
        granules.where(F.col("lot") == lot).drop("lot").repartition(files).write.mode("append").parquet(f"{root}/in")
    arrived = spark.readStream.schema(granules.drop("lot").schema).option("maxFilesPerTrigger", files).parquet(f"{root}/in")
    state.publish(state.corrected(arrived, keep_days=60), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    found = state.series(spark.read.parquet(f"{root}/out"))
    return found.select("acquisition_key", "granule_count", F.unix_micros("observed_at").alias("observed_us"), "least_cloud", F.md5(F.array_join("item_ids", " ").cast("binary")).alias("items_md5"))


# -- metrics: a run for each order --------------------------------------------------------------------------
def runs(spark, d):
    price, k = F.col("o_totalprice"), F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "P", "failed").otherwise("running")
    delay = F.when(k % 7 != 0, F.round(price / 1000, 3))
    return _t(spark, d, "orders").select(status.alias("status"), F.round(price / 500, 3).alias("job_duration"), delay.alias("queue_delay"), (k % 101).cast("double").alias("valid_pixel_pct"))


def _histogram_sql(column: str) -> str:
    title, bounds = metrics.HISTOGRAMS[column]
    edges = [f"{column} <= {bounds[0]}", *[f"{column} > {a} AND {column} <= {b}" for a, b in zip(bounds, bounds[1:], strict=False)], f"{column} > {bounds[-1]}"]
    counts = " || ' ' || ".join(f"count(*) FILTER ({e})" for e in edges)
    return f"SELECT '{title}' AS name, count({column}) AS count, round(sum({column}), 2) AS sum, min({column}) AS least, max({column}) AS most, {counts} AS counts FROM r"


@query("""WITH r AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'P' THEN 'failed' ELSE 'running' END AS status, round(o_totalprice / 500, 3) AS job_duration, CASE WHEN o_orderkey % 7 <> 0 THEN round(o_totalprice / 1000, 3) END AS queue_delay, CAST(o_orderkey % 101 AS DOUBLE) AS valid_pixel_pct FROM orders) """ + " UNION ALL ".join(_histogram_sql(c) for c in ("job_duration", "queue_delay", "valid_pixel_pct")) + "".join(f" UNION ALL SELECT '{n}', count(*) FILTER (status = '{s}'), NULL, NULL, NULL, NULL FROM r" for s, n in metrics.COUNTERS.items()))
def job_histograms(spark, d):
    return metrics.histograms(runs(spark, d)).select("name", "count", F.round("sum", 2).alias("sum"), "least", "most", F.concat_ws(" ", F.transform("counts", lambda c: c.cast("string"))).alias("counts")).withColumn("counts", F.when(F.col("counts") != "", F.col("counts")))


# -- what selection and pages have to keep ------------------------------------------------------------------
@query("WITH s AS (" + SQL["select_temporal"] + """), n AS (SELECT analysis, reason || '=' || count(*) AS told FROM s WHERE reason IS NOT NULL GROUP BY analysis, reason)
SELECT s.analysis, count(*) AS candidates, count(*) FILTER (selected) AS selected, count(*) FILTER (NOT selected) AS excluded, bool_and(selected = (reason IS NULL)) AS whole, (SELECT string_agg(told, ' ' ORDER BY told) FROM n WHERE n.analysis = s.analysis) AS reasons FROM s GROUP BY s.analysis""")
def selection_partition(spark, d):
    found = selection.partition_check(QUERIES["select_temporal"](spark, d))
    return found.select("analysis", "candidates", "selected", "excluded", "whole", F.array_join("reasons", " ").alias("reasons"))


@query("SELECT o_orderkey, o_orderdate, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def list_with_total(spark, d):
    return store.page_with_total(_t(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", 20, 40)


@query("SELECT l_linenumber AS id, l_orderkey AS analysis_id, l_shipdate AS created_at, o_orderpriority AS item_id FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus = 'F' WHERE l_orderkey = 33")
def artifacts_of_one(spark, d):
    items = _t(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("item_id"))
    files = _t(spark, d, "lineitem").select(F.col("l_linenumber").alias("id"), F.col("l_orderkey").alias("analysis_id"), F.col("l_orderkey").alias("scene_id"), F.col("l_shipdate").alias("created_at"))
    return store.artifacts_of(files, items, 33).select("id", "analysis_id", "created_at", "item_id")
