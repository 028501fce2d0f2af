"""Size-tiered compaction of immutable shards under a versioned manifest; DataFrame functions only.

A store is a folder: `data/` holds immutable Parquet shards, `manifest/` one JSON document a version.
`append` writes an arrival as small shards and commits a version that adds them. `compact` puts shards of
similar size (tiers, by powers of `fanout`) into runs, merges every run of at least `fanout` shards into
files near the target size, and commits a version that swaps them. Merging packs whole shards into scan
partitions of the target size and writes each as it is read: no shuffle. A commit writes the manifest
aside and renames it to its version's name, which fails if that version exists, so readers see an old or
a new version and a failed or repeated task leaves only files that no manifest names.

Writers that lose a race try again on the newer version: an append adds its shards to that; a merge stands as long
as all shards that it replaces are still there, else its files are dropped. `vacuum` leaves the newest versions and
whatever is younger than a time of grace to readers and running writers, and deletes all other files, those of
failed tasks too.

The manifest is bounded by the number of shards, not rows. Defined cases: nulls, repeated rows, very long texts and
extra columns, one named `_metadata` too, are stored as they are; an empty arrival adds no shard; an empty store
reads as no rows with the given schema.
"""

from __future__ import annotations

import json
import math
import time
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from verdara.llm.common import settings, shared_path

TARGET_BYTES = 128 << 20
FANOUT = 4


@dataclass(frozen=True)
class Shard:
    path: str
    size: int
    rows: int


class CommitConflict(RuntimeError):
    """Another writer has committed this version."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, schema: StructType, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT):
        self.spark, self.root, self.schema, self.target, self.fanout = spark, root, schema, target_bytes, fanout
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(root).toUri(), conf)

    # -- manifest ---------------------------------------------------------------------------------
    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/manifest")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> tuple[int, list[Shard]]:
        """(version, shards); version 0 is the empty store."""
        known = self.versions()
        version = version if version is not None else (known[-1] if known else 0)
        if version == 0:
            return 0, []
        lines = self.spark.read.text(f"{self.root}/manifest/v{version:08d}.json", wholetext=True).first()[0]
        return version, [Shard(**s) for s in json.loads(lines)["shards"]]

    def commit(self, base: int, shards: list[Shard]) -> int:
        """Publish version base + 1, or raise CommitConflict when it exists."""
        jvm = self.spark._jvm
        target = self._path(f"{self.root}/manifest/v{base + 1:08d}.json")
        aside = self._path(shared_path(self.spark, "manifest-aside"))
        out = self._fs.create(aside, False)
        body = json.dumps({"version": base + 1, "parent": base, "shards": [asdict(s) for s in shards]})
        out.write(bytearray(body.encode()))
        out.close()
        self._fs.mkdirs(target.getParent())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            self._context.rename(aside, target, none)
        except Exception as e:
            if self._fs.exists(target):
                self._fs.delete(aside, False)
                raise CommitConflict(f"version {base + 1} exists") from e
            raise
        return base + 1

    def _publish(self, change) -> int:
        """Commit change(shards) upon the newest version, again upon a newer one as often as another writer is first.

        `change` gives None when it has become pointless; then nothing is committed.
        """
        while True:
            base, shards = self.manifest()
            made = change(shards)
            if made is None:
                return base
            try:
                return self.commit(base, made)
            except CommitConflict:
                continue

    # -- writing ----------------------------------------------------------------------------------
    def _written(self, folder: str) -> list[Shard]:
        files = {s.getPath().toString(): s.getLen() for s in self._fs.listStatus(self._path(folder)) if s.getPath().getName().endswith(".parquet")}
        if not files:
            return []
        found = self.spark.read.schema(self.schema).parquet(folder)
        rows = found.groupBy(found.metadataColumn("_metadata")["file_name"].alias("f")).count().collect()
        by_name = {r["f"]: r["count"] for r in rows}
        return [Shard(p, n, by_name[p.rsplit("/", 1)[1]]) for p, n in sorted(files.items()) if by_name.get(p.rsplit("/", 1)[1])]

    def _folder(self, kind: str) -> str:
        return f"{self.root}/data/{shared_path(self.spark, kind).rsplit('/', 1)[1]}"

    def append(self, arrival: DataFrame, rows_per_shard: int = 0) -> int:
        """Write an arrival as immutable shards and commit them.

        Each partition of the arrival is a shard, or several of `rows_per_shard` rows if that is given.
        """
        folder = self._folder("a")
        arrival.write.option("maxRecordsPerFile", rows_per_shard).parquet(folder)
        made = self._written(folder)
        return self._publish(lambda shards: shards + made)

    def runs(self, shards: list[Shard]) -> list[list[Shard]]:
        """Shards to merge, by tier: similar sizes, at least `fanout` of them, all below the target."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.size < self.target:
                tiers.setdefault(int(math.log(max(s.size, 1), self.fanout)), []).append(s)
        return [run for _, run in sorted(tiers.items()) if len(run) >= self.fanout]

    def compact(self) -> int:
        """Merge each run into files near the target size; one commit swaps all of them.

        What is merged is of a higher tier; a later call merges it again when that tier has a run. So a call
        writes no row twice, and takes as much disk as its runs have until the old shards are vacuumed.
        """
        base, shards = self.manifest()
        runs = self.runs(shards)
        if not runs:
            return base
        gone, made = set(), []
        with settings(self.spark, spark__sql__files__maxPartitionBytes=str(self.target), spark__sql__files__openCostInBytes="0", spark__sql__files__minPartitionNum="1"):
            for run in runs:
                folder = self._folder("c")
                self.spark.read.schema(self.schema).parquet(*[s.path for s in run]).write.parquet(folder)
                made += self._written(folder)
                gone |= {s.path for s in run}
        version = self._publish(lambda now: [s for s in now if s.path not in gone] + made if gone <= {s.path for s in now} else None)
        if not {s.path for s in made} <= {s.path for s in self.manifest(version)[1]}:
            self._drop([s.path for s in made])  # another merge was first
        return version

    def _drop(self, paths: list[str]) -> None:
        for path in paths:
            self._fs.delete(self._path(path), False)

    def vacuum(self, keep_versions: int = 2, grace_s: float = 3600.0) -> int:
        """Delete files that none of the newest versions names and that are older than the grace; returns how many shards."""
        now = time.time()
        old = lambda status: status.getModificationTime() / 1000 <= now - grace_s
        versions = self.versions()
        kept = versions[-keep_versions:]
        for v in versions[: -len(kept) or None] if kept else []:
            path = self._path(f"{self.root}/manifest/v{v:08d}.json")
            if old(self._fs.getFileStatus(path)):
                self._fs.delete(path, False)
        live = {s.path for v in self.versions() for s in self.manifest(v)[1]}
        data, gone = self._path(f"{self.root}/data"), []
        if self._fs.exists(data):
            files = self._fs.listFiles(data, True)
            while files.hasNext():
                status = files.next()
                if old(status) and status.getPath().toString() not in live:
                    gone.append(status.getPath().toString())
        self._drop(gone)
        return sum(path.endswith(".parquet") for path in gone)

    # -- reading ----------------------------------------------------------------------------------
    def read(self, version: int | None = None) -> DataFrame:
        """Rows of a version, with their shard and their place in it in the hidden `_metadata` column."""
        _, shards = self.manifest(version)
        if not shards:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[s.path for s in shards])


def place(store: ShardStore) -> DataFrame:
    """(doc_id, shard, position, version, shard_rows, shard_bytes) of each row of the newest version."""
    version, shards = store.manifest()
    if not shards:
        return store.spark.createDataFrame([], "doc_id long, shard string, position long, version int, shard_rows long, shard_bytes long")
    sizes = store.spark.createDataFrame([(s.path.rsplit("/", 2)[1] + "/" + s.path.rsplit("/", 1)[1], s.rows, s.size) for s in shards], "shard string, shard_rows long, shard_bytes long")
    found = store.read()
    place = found.metadataColumn("_metadata")
    rows = found.select("doc_id", F.regexp_extract(place["file_path"], r"([^/]+/[^/]+)$", 1).alias("shard"), place["row_index"].alias("position"))
    return rows.join(sizes, "shard").select("doc_id", "shard", "position", F.lit(version).alias("version"), "shard_rows", "shard_bytes")
