"""Catalogue items as JSON text to granule rows, and the region and demo-bundle readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def epsg_of(item: Column) -> Column:
    """EPSG code of an item: proj:epsg when it is a whole number, else the number of a proj:code EPSG:n."""
    plain = F.get_json_object(item, "$.properties['proj:epsg']")
    code = F.upper(F.get_json_object(item, "$.properties['proj:code']"))
    own = F.when(plain.rlike(r"^-?\d+$"), plain.try_cast("int"))
    return F.coalesce(own, F.regexp_extract(code, r"^EPSG:\s*([+-]?\d+)\s*$", 1).try_cast("int"))


def granules(items: DataFrame, column: str = "item", keys: dict[str, str] | None = None, optional: dict[str, str] | None = None) -> DataFrame:
    """A granule row for each item's JSON; `problem` says why an item can't be used, else is NULL.

    keys: role to asset key of the assets that must be there; optional: of those that may be. Each value is
    taken by its path, so items with other fields, or broken JSON, give NULLs and a problem, never an error.
    """
    keys = keys or {"red": "B04", "nir": "B08", "scl": "SCL"}
    optional = {"visual": "visual"} if optional is None else optional
    item = F.col(column)
    get = lambda path: F.get_json_object(item, path)
    href = lambda key: get(f"$.assets['{key}'].href")
    lost = F.array_compact(F.array(*[F.when(href(k).isNull(), F.lit(f"{role}={k}")) for role, k in keys.items()]))
    box = F.from_json(get("$.bbox"), "array<double>")
    problem = (
        F.when(get("$.id").isNull(), "no_id")
        .when(F.size(lost) > 0, F.concat(F.lit("missing_assets:"), F.array_join(lost, ",")))
        .when(get("$.properties.datetime").try_cast("timestamp").isNull(), "no_datetime")
        .when(get("$.geometry").isNull() | box.isNull() | (F.size(box) != 4), "no_geometry")
    )
    assets = F.map_filter(F.create_map(*[x for role, k in {**keys, **optional}.items() for x in (F.lit(role), href(k))]), lambda _, v: v.isNotNull())
    return items.select(
        get("$.id").alias("item_id"),
        F.coalesce(get("$.collection"), F.lit("unknown")).alias("collection"),
        get("$.properties.datetime").try_cast("timestamp").alias("observed_at"),
        get("$.properties['eo:cloud_cover']").try_cast("double").alias("cloud_cover_pct"),
        get("$.geometry").alias("geometry"),
        box.alias("bbox"),
        epsg_of(item).alias("epsg"),
        get("$.properties.platform").alias("platform"),
        F.from_json(get("$.properties.instruments"), "array<string>").alias("instruments"),
        get("$.properties['s2:processing_baseline']").alias("processing_baseline"),
        assets.alias("assets"),
        problem.alias("problem"),
    )


def strict(rows: DataFrame) -> DataFrame:
    """`granules` rows, failing loudly at the first that has a problem."""
    told = F.raise_error(F.concat_ws(" ", F.lit("catalogue item"), "item_id", F.lit("can't be used:"), "problem"))
    return rows.withColumn("item_id", F.when(F.col("problem").isNotNull(), told).otherwise(F.col("item_id"))).drop("problem")


def regions(spark: SparkSession, path: str) -> DataFrame:
    """slug, name, description, bbox from a JSON document {"regions": [...]}."""
    schema = "regions array<struct<slug:string,name:string,description:string,bbox:array<double>>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.inline("regions"))


def fresh(rows: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    """The rows of a bundle that the store doesn't hold yet, one a key: importing twice adds nothing."""
    return rows.dropDuplicates([key]).join(stored.select(key), key, "left_anti")
