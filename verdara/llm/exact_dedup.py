"""Exact dedup through an extendible-hash index on shared files; DataFrame functions only.

Keys. A row's normalised text has a 64-bit key and a SHA-256. Both are written once, without the text, and serve
the directory and the look-ups.

Directory. It begins with one bucket of all keys. While a bucket holds more than `capacity` different keys it is
split by the next bits of its keys, as many as its load asks for, and the directory of 2**depth slots is doubled
as often as its deepest bucket needs; slots of empty buckets aren't stored. Splitting works on counts by key prefix of `DEEPEST` bits, so at most
2**DEEPEST rows however many documents there are; a bucket still overfull at that depth stays so, as one key's
texts do anyway, and costs its owner time, not the result. With the input the capacity grows too, so that the
directory has about `BUCKETS` buckets at most, which makes it a table of bounded size that every task may hold.

Insertion. Rows find their slot by their key's first bits, and by it their bucket. In a bucket copies meet by key
and by their whole bytes, after a map-side aggregate, so that a text that a third of all rows share moves as one
partial row a task. What is left has one entry for each different text: keep_id, group_size, SHA-256.

Owners. Each takes a range of buckets, that is of keys, chains the entries of one key, and writes its buckets in
order. Look-up. A document's key leads to slot, bucket and chain; in the chain its SHA-256 names the entry.

Defined cases: null text equals the empty text; null doc_ids take part and lose to any number; repeated
doc_ids are separate rows; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdara.llm.common import ascii_lower, materialize, remove, shared_path, spare, write_at

CAPACITY = 256
BUCKETS = 1 << 17
DEEPEST = 24
#: Slots of a directory that may be broadcast, 24 bytes each.
MOST_SLOTS = 1 << 20


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def _prefix(key: Column, bits: int) -> Column:
    """The first bits of a key."""
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


def split_buckets(keys: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """(bucket, local_depth) of the buckets and the directory's depth, for a table of different keys.

    A bucket is named by its first prefix of DEEPEST bits, so that buckets sort as the ranges of their keys do.
    """
    # One row a prefix that occurs, with the depth of the bucket that holds it.
    state = keys.groupBy(_prefix(F.col("key"), DEEPEST).alias("prefix")).agg(F.count("*").alias("n")).withColumn("local_depth", F.lit(0))
    state = materialize(state, "dedup-prefixes")
    depth = 0
    while True:
        buckets = state.groupBy(_start(F.col("prefix"), F.col("local_depth")).alias("bucket"), "local_depth").agg(F.sum("n").alias("load"))
        over = materialize(buckets.where((F.col("load") > capacity) & (F.col("local_depth") < DEEPEST)).select("bucket", F.least(F.col("local_depth") + F.ceil(F.log2(F.col("load") / capacity)), F.lit(DEEPEST)).cast("int").alias("deeper")), "dedup-overfull")
        deepest = over.agg(F.max("deeper")).first()[0]
        if deepest is None:
            return buckets.select("bucket", "local_depth"), depth
        depth = max(depth, deepest)  # the directory doubles until the deepest bucket has a slot of its own
        at = state.withColumn("bucket", _start(F.col("prefix"), F.col("local_depth")))
        state = materialize(at.join(over, "bucket", "left").select("prefix", "n", F.coalesce("deeper", "local_depth").alias("local_depth")), "dedup-prefixes")


def _start(prefix: Column, local_depth: Column) -> Column:
    """The first prefix of the bucket of that depth that holds `prefix`."""
    low = F.lit(DEEPEST) - local_depth
    return F.call_function("shiftleft", F.call_function("shiftright", prefix, low), low)


def directory_of(buckets: DataFrame, depth: int) -> DataFrame:
    """(slot, bucket, local_depth): a bucket of local depth l has 2**(depth - l) of the 2**depth slots."""
    first = F.shiftright("bucket", DEEPEST - depth)
    width = F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(depth) - F.col("local_depth"))
    return buckets.select(F.explode(F.sequence(first, first + width - 1)).alias("slot"), "bucket", "local_depth")


class Index:
    """The keys of all documents, the directory, and the files of the buckets."""

    def __init__(self, docs: DataFrame, capacity: int = CAPACITY, key: Callable[[Column], Column] = F.xxhash64):
        spark = docs.sparkSession
        norm = docs.select("doc_id", normalised(F.col("text")).alias("norm"))
        keyed = norm.select("doc_id", key(F.col("norm")).alias("key"), F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha"))
        self._paths = [shared_path(spark, n) for n in ("dedup-keys", "dedup-entries", "dedup-index")]
        self.rows = write_at(keyed, self._paths[0])
        keys = materialize(self.rows.select("key").distinct(), "dedup-distinct")
        self.capacity = max(capacity, -(-keys.count() // BUCKETS))
        buckets, self.depth = split_buckets(keys, self.capacity)
        self.directory = materialize(directory_of(buckets, self.depth), "dedup-directory")
        self.slots = self.directory.count()

        placed = self._placed(norm.withColumn("key", key(F.col("norm"))))
        copies = placed.groupBy("bucket", "local_depth", "key", "norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        entries = copies.select("bucket", "local_depth", "key", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha"), "keep_id", "group_size")
        entries = write_at(entries, self._paths[1])
        owners = entries.repartitionByRange("bucket", "key")
        entry = F.struct("sha", "keep_id", "group_size")
        chains = owners.groupBy("bucket", "key").agg(F.first("local_depth").alias("local_depth"), F.array_sort(F.collect_list(entry)).alias("chain"))
        self.files = write_at(chains.sortWithinPartitions("bucket", "key"), self._paths[2])
        remove(spark, self._paths[1])

    def _placed(self, rows: DataFrame) -> DataFrame:
        """Rows with the bucket of their key. A directory of `MOST_SLOTS` at most is broadcast, a larger one joined by slot."""
        at = rows.withColumn("slot", _prefix(F.col("key"), self.depth))
        return at.join(F.broadcast(self.directory) if self.slots <= MOST_SLOTS else self.directory, "slot").drop("slot")

    def find(self) -> DataFrame:
        """One row a document: doc_id, sha, keep_id, group_size."""
        chains = self.files.select("bucket", "key", "chain")
        rows = self._placed(self.rows).join(chains, ["bucket", "key"])
        own = F.filter("chain", lambda e: e["sha"] == F.col("sha"))[0]
        return rows.select("doc_id", "sha", own.alias("e")).select("doc_id", "sha", "e.keep_id", "e.group_size")


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY, key: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row a document: doc_id, keep_id (largest doc_id of equal texts), group_size, kept, text_sha256."""
    found = Index(docs, capacity, key).find()
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicate(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`docs` without all but one of each group of equal texts; columns as they were.

    Ids alone say which rows go; the SHA-256 is looked at for repeated ids only. Rows that share both text and
    doc_id are thinned to one by a row number within that id.
    """
    found = Index(docs, capacity).find()
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    by_id = materialize(found.groupBy(F.col("doc_id").alias("_id")).agg(F.max(stays).alias("stays"), F.count("*").alias("n")), "dedup-decided")
    # Written, so that its size is known: few ids to take out are broadcast, many are not.
    out = materialize(by_id.where("not stays or n > 1").select("_id"), "dedup-out")
    kept = docs.join(out, docs["doc_id"].eqNullSafe(out["_id"]), "left_anti")
    again = materialize(by_id.where("stays and n > 1").select("_id"), "dedup-again")
    if again.isEmpty():
        return kept
    own = found.where(stays).join(again, found["doc_id"].eqNullSafe(again["_id"]), "left_semi").select(F.col("doc_id").alias("_id"), F.col("sha").alias("_sha"))
    own = materialize(own.distinct(), "dedup-repeated")
    sha, nth = F.unhex(F.sha2(normalised(docs["text"]).cast("binary"), 256)), spare(docs)
    rows = docs.join(own, docs["doc_id"].eqNullSafe(own["_id"]) & (sha == own["_sha"]), "left_semi")
    numbered = rows.withColumn(nth, F.row_number().over(Window.partitionBy("doc_id", sha).orderBy(F.lit(1))))
    return kept.unionByName(numbered.where(F.col(nth) == 1).drop(nth))
