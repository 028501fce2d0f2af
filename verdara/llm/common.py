"""Helpers that the training-data operators share: the shared folder, cut lineage, column hygiene."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdara.session import ship

_OWN: dict[str, str] = {}

SMALL_BATCHES = {"spark__sql__execution__arrow__maxBytesPerBatch": "4m"}


def shared_root(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or a temporary one on a local master only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return _OWN.setdefault("root", "file://" + tempfile.mkdtemp(prefix="verdara-"))


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Session settings for what runs inside; `conf` keys use `__` for dots."""
    conf = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def write_at(df: DataFrame, path: str) -> DataFrame:
    """Write `df` as Parquet at a path of the shared folder and read it back.

    Once the table is written nothing reads the shuffles that made it, so their files go at once. Rows cross
    to Python in batches of 4 MB, since a worker holds a few copies of its batch.
    """
    with settings(df.sparkSession, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true", **SMALL_BATCHES):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    return write_at(df, shared_path(df.sparkSession, name))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Gives a `materialize` whose tables are deleted at the end; what is kept is written before by the other one."""
    paths: list[str] = []

    def write(df: DataFrame, name: str) -> DataFrame:
        paths.append(shared_path(spark, name))
        return write_at(df, paths[-1])

    try:
        yield write
    finally:
        for path in paths:
            remove(spark, path)


def spare(df: DataFrame) -> str:
    """A column name longer than any of `df`, so that it clashes with none."""
    return "_" * (1 + max((len(c) for c in df.columns), default=0))


def tidy(run: Callable, *forget: Callable[[], None]) -> Callable:
    """`run` for mapInArrow, leaving little in its worker: a reused worker keeps what its earlier tasks held.

    At the task's end what `forget` names is dropped and unused memory goes back to the system.
    """

    def wrapped(batches: Iterable) -> Iterator:
        try:
            yield from run(batches)
        finally:
            for clear in forget:
                clear()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return wrapped


def sample_by_group(ids: DataFrame, docs: DataFrame, text: Column, per_group: int) -> list[tuple]:
    """(group, text) of at most `per_group` documents a group, by group and hash: those of the least hashes.

    ids: (doc_id, grp); a doc_id of several groups counts in the least one, repeated rows once. `text` is an
    expression over `docs`; documents for which it is null are passed over and others take their places.

    Only ids that have such a text are counted and chosen from, so thresholds on the hash let pass some 1.25 *
    `per_group` + 50 ids of a group, at most four times as many where chance gave a group too few. Nothing but counts by
    group, those ids and the sample itself meets in one place; what is chosen depends on the hashes alone.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").alias("_id"), text.alias("_text")).where("_text is not null")
    own = ids.where("doc_id is not null and grp is not null").groupBy("doc_id").agg(F.min("grp").alias("grp"))
    usable = own.join(texts.select("_id").distinct(), F.col("doc_id") == F.col("_id")).select("doc_id", "grp", (F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(2**53))).alias("h"))
    with scratch(spark) as write:
        usable = write(usable, "sample-ids")
        cuts = {r["grp"]: min(1.0, (1.25 * per_group + 50) / r["count"]) for r in usable.groupBy("grp").count().collect()}
        found: dict = {}
        while cuts:
            cut = F.try_element_at(F.create_map(*[F.lit(x) for pair in cuts.items() for x in pair]), F.col("grp"))
            table = spark.createDataFrame(usable.where(F.col("h") < cut).collect(), usable.schema)  # bounded by the thresholds
            rows = texts.join(F.broadcast(table), F.col("_id") == F.col("doc_id")).groupBy("doc_id", "grp", "h").agg(F.min("_text").alias("text")).collect()
            found |= {g: sorted((r["h"], r["doc_id"], r["text"]) for r in rows if r["grp"] == g) for g in cuts}
            cuts = {g: min(1.0, 4 * c) for g, c in cuts.items() if c < 1 and len(found[g]) < per_group}
    return [(g, t) for g, rows in sorted(found.items()) for _, _, t in rows[:per_group]]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the queries; the package goes to the workers first."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII takes the JVM's byte-wise path; other texts are translated."""
    translated = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(translated)


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the decimal doc_id, modulo `modulus`; null ids count as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus
