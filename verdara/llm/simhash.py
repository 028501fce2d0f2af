"""SimHash near-dedup: a byte-position inverted index with count filtering.

1. A text's words, A-Z lower-cased, give shingles of three words, repeats included. A fingerprint bit is one where
   over half of the shingles' XXH64 (seed 42) have it. Equal fingerprints are one node from here on, so copies meet
   in a map-side aggregate and never as pairs.
2. Two bits touch two of the eight positional bytes at most, so linked fingerprints share six positional bytes
   or more: that is the guaranteed minimum of the count filter.
3. The list of one positional byte holds a 256th of all fingerprints, and its pairs grow with their square. So
   lists are entered as intersections of four: bytes are taken two by two, and of the four couples two are
   untouched by any two bits. A fingerprint stands in six lists; what shares six bytes meets in one of them.
4. Lists come sorted, as a stream. In each, shared positional bytes are tallied for every two members, those that
   reach six are kept, and the differing bits of these are counted.
5. A list above `LONGEST` isn't paired; its members pass on to lists of six positional bytes. The other two
   bytes make 65,536 members the most that such a list can have, whatever the table's size.
6. Links are merged into components by large-star and small-star steps. A fingerprint has 2080 others within two
   bits at most, so links grow with fingerprints, not with their square.

Defined cases: null, empty or wordless text has the fingerprint zero and is linked like any other; with fewer words
than a shingle has, the whole sequence is the one shingle; repeated doc_ids are separate rows; a null doc_id is
never the least unless all are null; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdara.llm.common import materialize, scratch, tidy
from verdara.llm.jaccard_join import components
from verdara.session import ship

WORDS, SEED, BITS, BYTES = 3, 42, 2, 8
#: Positional bytes that linked fingerprints share at least.
SHARED = BYTES - BITS
#: Longest list whose members are compared with each other at once; members compared in one step.
LONGEST, STEP = 4096, 256


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """The 64 majority bits of the shingles of a UTF-8 text."""
    from xxhash import xxh64_intdigest

    parts = (text or b"").lower().split()  # bytes: A-Z and ASCII white space only
    if not parts:
        return 0
    k = min(words, len(parts))
    n = len(parts) - k + 1
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    ones = np.zeros(64, np.int64)
    for low in range(0, n, 65_536):  # a long text's bits are counted part by part
        high = min(n, low + 65_536)
        each = (joined[a:z] for a, z in zip(starts[low:high].tolist(), ends[low + k - 1 : high + k - 1].tolist(), strict=True))
        h = np.fromiter(map(xxh64_intdigest, each, repeat(SEED)), "<u8", high - low)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of each row."""

    def run(batches):
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(tidy(run), f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


def _byte(fp: Column, at: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * at).bitwiseAND(F.lit(255))


def _key(fp: Column, number: int, at: tuple[int, ...]) -> Column:
    """The list of a fingerprint's bytes at some positions: the positions' number, then the bytes."""
    key = F.lit(number).cast("long")
    for p in at:
        key = F.shiftleft(key, 8).bitwiseOR(_byte(fp, p))
    return key


#: Positions of the six lists that fingerprints stand in: two of the four couples of bytes each.
FOURS = [(2 * a, 2 * a + 1, 2 * b, 2 * b + 1) for a, b in combinations(range(4), 2)]
SIXES = list(combinations(range(BYTES), SHARED))


def near(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the members of one list the pairs that reach the count filter's minimum and differ in two bits at most."""
    a, b = [], []
    bytes_ = members.view(np.uint8).reshape(-1, BYTES)
    for x in range(0, len(members), STEP):
        for y in range(x, len(members), STEP):
            tally = sum((bytes_[x : x + STEP, None, p] == bytes_[None, y : y + STEP, p]).astype(np.uint8) for p in range(BYTES))
            i, j = np.nonzero(tally >= SHARED)
            p, q = members[x + i], members[y + j]
            close = (np.bitwise_count(p ^ q) <= BITS) & (p != q) & ((x < y) | (i < j))
            a.append(p[close])
            b.append(q[close])
    return np.concatenate(a), np.concatenate(b)


def _met(posts: DataFrame, longest: int) -> DataFrame:
    """(a, b) of linked members of each list, and (a, null) of each member of a list above `longest`."""

    def out(a, b=None):
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))], ["a", "b"])

    def run(batches):
        held, key, long = np.empty(0, np.uint64), None, False  # of the list that a batch left open
        for batch in batches:
            keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if low == high:
                    continue
                if keys[low] != key:
                    if len(held) > 1:
                        yield out(*near(held))
                    held, key, long = np.empty(0, np.uint64), keys[low], False
                held = np.concatenate((held, fps[low:high]))
                if long or len(held) > longest:
                    yield out(held)
                    held, long = held[:0], True
        if len(held) > 1:
            yield out(*near(held))

    return posts.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(run), "a long, b long")


def links(nodes: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(a, b): every two fingerprints of `nodes.fp`, which are distinct, that differ in two bits at most, once each."""
    fp = F.col("fp")
    posts = nodes.select(F.explode(F.array(*[_key(fp, n, at) for n, at in enumerate(FOURS)])).alias("key"), "fp")
    met = materialize(_met(posts, longest), "simhash-met")
    # The lists of six that a member of a long list of four stands in; those that it needn't go to do no harm.
    long = met.where("b is null").select(F.col("a").alias("fp")).distinct()
    finer = long.select(F.explode(F.array(*[_key(fp, n, at) for n, at in enumerate(SIXES)])).alias("key"), "fp")
    both = met.where("b is not null").unionByName(_met(finer, 1 << 8 * BITS))
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, longest: int = LONGEST) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id, the least doc_id that links reach, of each row."""
    ship(docs.sparkSession)
    with scratch(docs.sparkSession) as write:
        rows = materialize(fingerprints(docs), "simhash-rows")
        nodes = write(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
        roots = components(write(links(nodes, longest), "simhash-links"))
        placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
        found = materialize(placed.join(least, "root").select("fp", "component_id"), "simhash-found")
    return rows.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
