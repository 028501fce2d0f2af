"""The provenance document of an analysis: built from the result tables, checked by constraints on its fields."""

from __future__ import annotations

import hashlib
import platform
from importlib import metadata
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdara.functions import json_schema

from verdara.operators.process import MOSAIC

# The document's version, its source, the fields that it must have, and the classes' names.
SCHEMA_VERSION = "2.0.0"
SOURCE = {"provider": "Microsoft Planetary Computer", "license": "Copernicus Sentinel data terms"}
REQUIRED = """schema_version analysis_id created_at data_source.stac_endpoint data_source.collection request.aoi_geometry
request.start_date request.end_date request.max_cloud_cover_pct canonical_grid.schema_version canonical_grid.crs
canonical_grid.resolution canonical_grid.transform canonical_grid.width canonical_grid.height canonical_grid.bounds_projected
canonical_grid.bounds_geographic scene_selection.algorithm scene_selection.algorithm_version scene_selection.selected_count
scene_selection.excluded scene_selection.min_aoi_coverage_pct processing.operation processing.config
processing.mosaic_method software.processing_version scenes outputs""".split()
SCENE_REQUIRED = ("acquisition_key", "primary_item_id", "contributing_item_ids", "observed_at", "assets")
OUTPUT_REQUIRED = ("artifact_type", "path", "sha256", "size_bytes")
CLASS_NAMES = dict(enumerate("""NO_DATA SATURATED_OR_DEFECTIVE CAST_SHADOWS CLOUD_SHADOWS VEGETATION NOT_VEGETATED WATER UNCLASSIFIED
CLOUD_MEDIUM_PROBABILITY CLOUD_HIGH_PROBABILITY THIN_CIRRUS SNOW_OR_ICE""".split()))


def software(spark: SparkSession, processing_version: str, lock: str | None = None, packages: tuple[str, ...] = ("pyspark", "pyarrow", "numpy", "pandas"), **more: str) -> dict[str, str]:
    """What made a result, for `build`: versions, the digest of a lock file if one is named and there, and what the
    deployment adds (commit, image)."""
    known = {d.metadata["Name"].lower() for d in metadata.distributions() if d.metadata["Name"]}
    out = {f"package_{p}": metadata.version(p) if p in known else "unknown" for p in packages}
    if lock and Path(lock).is_file():
        out["dependency_lock_sha256"] = hashlib.sha256(Path(lock).read_bytes()).hexdigest()
    return out | {"processing_version": processing_version, "python_version": platform.python_version(), "spark_version": spark.version} | more


def dataset(spark: SparkSession, collection: str, endpoint: str, assets: dict[str, str], title: str, resolution_m: int = 10) -> DataFrame:
    """One row that describes the data a catalogue's collection gives; provider and licence are the document's."""
    held = F.create_map(*[F.lit(x) for kv in sorted(assets.items()) for x in kv])
    fields = {"id": F.lit(collection), "title": F.lit(title), "stac_endpoint": F.lit(endpoint), "assets_used": held, "gsd_meters": F.lit(resolution_m)}
    return spark.range(1).select(*[v.alias(k) for k, v in (fields | {k: F.lit(v) for k, v in SOURCE.items()}).items()])


def build(analyses: DataFrame, excluded: DataFrame, scenes: DataFrame, outputs: DataFrame, masked: tuple[int, ...], config: dict[str, str], software: dict[str, str]) -> DataFrame:
    """(analysis_id, document): JSON text of each analysis.

    analyses: analysis_id, created_at, stac_endpoint, collection, request, canonical_grid, catalog_search, algorithm,
    algorithm_version, min_aoi_coverage_pct, timing (structs where they nest); the other tables have an analysis_id and
    the fields of an entry. Entries are gathered by analysis, as many as its acquisitions, and put in order.
    """

    def gathered(rows: DataFrame, name: str, *order: str) -> DataFrame:
        fields = [c for c in rows.columns if c != "analysis_id"]
        entry = F.struct(F.struct(*order).alias("o"), F.struct(*fields).alias("e"))
        return rows.groupBy(F.col("analysis_id").alias(f"_{name}")).agg(F.array_sort(F.collect_list(F.struct(entry["o"].alias("o"), F.to_json(entry["e"], {"ignoreNullFields": "false"}).alias("j")))).alias(name))

    out = analyses
    for rows, name, order in ((excluded, "excluded", ("acquisition_key",)), (scenes, "scenes", ("observed_at", "acquisition_key")), (outputs, "outputs", ("path",))):
        more = gathered(rows, name, *order)
        out = out.join(more, F.col("analysis_id") == F.col(f"_{name}"), "left").drop(f"_{name}")
    text = lambda c: F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
    inner = lambda c: F.regexp_extract(text(c), r'(?s)^\{"v":(.*)\}$', 1)
    many = lambda name: F.concat(F.lit("["), F.array_join(F.coalesce(F.transform(name, lambda x: x["j"]), F.array().cast("array<string>")), ","), F.lit("]"))
    constant = lambda pairs: F.create_map(*[F.lit(x) for kv in sorted(pairs.items()) for x in kv])
    classes = F.array(*[F.lit(CLASS_NAMES.get(c, str(c))) for c in masked])

    def joined(**fields: Column) -> Column:
        parts = [F.concat(F.lit(f'"{k}":'), v) for k, v in sorted(fields.items())]
        return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))

    c, lit = F.col, lambda v: inner(F.lit(v))
    selection = joined(algorithm=inner(c("algorithm")), algorithm_version=inner(c("algorithm_version")), min_aoi_coverage_pct=inner(c("min_aoi_coverage_pct")), excluded=many("excluded"), selected_count=F.coalesce(F.size("scenes"), F.lit(0)).cast("string"))
    processing = joined(operation=lit("ndvi"), config=inner(constant(config)), masked_scl_classes=inner(F.array(*[F.lit(x) for x in masked])), masked_scl_class_names=inner(classes), **{k: lit(v) for k, v in MOSAIC.items()})
    source = joined(stac_endpoint=inner(c("stac_endpoint")), collection=inner(c("collection")), **{k: lit(v) for k, v in SOURCE.items()})
    document = joined(
        schema_version=lit(SCHEMA_VERSION), analysis_id=inner(c("analysis_id")), created_at=inner(c("created_at")), data_source=source, request=inner(c("request")), canonical_grid=inner(c("canonical_grid")), catalog_search=inner(c("catalog_search")),
        scene_selection=selection, processing=processing, software=inner(constant(software)), scenes=many("scenes"), outputs=many("outputs"), timing=inner(c("timing")),
    )
    return out.select("analysis_id", document.alias("document"))


def schema() -> dict:
    """The JSON Schema of a record: every field of `REQUIRED`, and the rules of entries, digests and times."""
    text, entries = {"type": "string", "minLength": 1}, {"type": "array"}
    root: dict = {"type": "object", "required": [], "properties": {}}
    for path in REQUIRED:
        at = root
        *above, last = path.split(".")
        for part in above:
            at["required"] += [part] if part not in at["required"] else []
            at = at["properties"].setdefault(part, {"type": "object", "required": [], "properties": {}})
            at.setdefault("required", [])
            at.setdefault("properties", {})
        at["required"] += [last] if last not in at["required"] else []
        at["properties"].setdefault(last, {})
    own = root["properties"]
    own["schema_version"] = {"const": SCHEMA_VERSION}
    own["analysis_id"] = {"type": "string", "format": "uuid"}
    own["created_at"] = text
    own["scenes"] = {**entries, "items": {"type": "object", "required": list(SCENE_REQUIRED), "properties": {"contributing_item_ids": {"type": "array", "minItems": 1, "items": text}}}}
    own["outputs"] = {**entries, "items": {"type": "object", "required": list(OUTPUT_REQUIRED), "properties": {"sha256": {"type": "string", "pattern": "^[0-9a-f]{64}$"}, "size_bytes": {"type": "integer", "minimum": 0}}}}
    own["canonical_grid"]["properties"]["transform"] = {"type": "array", "minItems": 6, "maxItems": 6, "items": {"type": "number"}}
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", **root}


def breaches(documents: DataFrame, column: str = "document") -> DataFrame:
    """Adds breaches: what each record breaks of `schema`, with its path."""
    return documents.withColumn("breaches", json_schema.problems(F.col(column), schema()))


def problems(documents: DataFrame, column: str = "document") -> DataFrame:
    """Adds problems: a text for each constraint that a document breaks, in a fixed order; empty if it is sound."""
    doc = F.col(column)
    get = lambda path: F.get_json_object(doc, "$." + path)
    said = [F.when(get(p).isNull(), f"missing {p}") for p in REQUIRED]
    said += [
        F.when(get("schema_version") != SCHEMA_VERSION, "schema_version"),
        F.when(~get("analysis_id").rlike(r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), "analysis_id is no uuid"),
        F.when(get("created_at").isNotNull() & get("created_at").try_cast("timestamp").isNull(), "created_at is no time"),
        F.when(F.size(F.from_json(get("canonical_grid.transform"), "array<double>")) != 6, "canonical_grid.transform hasn't six numbers"),
    ]

    def of_entries(path: str, required: tuple[str, ...], *more: tuple[str, object]) -> Column:
        entries = F.from_json(get(path), "array<string>")
        field = lambda e, k: F.get_json_object(e, "$." + k)
        lost = F.transform(entries, lambda e: F.concat_ws(",", *[F.when(field(e, k).isNull(), k) for k in required], *[F.when(rule(e, field), name) for name, rule in more]))
        return F.filter(F.transform(lost, lambda x, i: F.when(x != "", F.concat(F.lit(f"{path}["), i.cast("string"), F.lit("]: "), x))), lambda x: x.isNotNull())

    scenes = of_entries("scenes", SCENE_REQUIRED, ("contributing_item_ids is empty", lambda e, f: f(e, "contributing_item_ids") == "[]"))
    outputs = of_entries("outputs", OUTPUT_REQUIRED, ("sha256 is no digest", lambda e, f: ~f(e, "sha256").rlike("^[0-9a-f]{64}$")))
    none = F.array().cast("array<string>")
    return documents.withColumn("problems", F.concat(F.array_compact(F.array(*said)), F.coalesce(scenes, none), F.coalesce(outputs, none)))
