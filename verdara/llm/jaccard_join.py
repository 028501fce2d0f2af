"""Exact n-gram Jaccard join: rare-first prefix filtering, then one verification for each pair.

1. A text's set is its distinct word shingles, as 64-bit hashes. Equal sets collapse into one node, found by
   a 128-bit digest, so copies meet in a map-side aggregate and never as pairs.
2. A count sketch over all texts, of four counters a document up to 2**24 of them, orders shingles, rare ones
   first. Two sets of similarity t share a shingle among the first n - ceil(t n) + 1 of either, whatever the order,
   so only those are posted.
3. First round. In each posting list the node whose shingle stands earliest (the one with fewest rarities,
   that is the middle of a group of near copies) is the pivot; pairs of pivot and member pass the length and
   positional filters and are verified. Verified links are merged into components.
4. Second round. Only lists whose members still lie in different components give more pairs, only across
   components, and only those not verified before. Any link shares a posting list, so its ends are in one
   component or are verified: components are exact, though a group of m near copies costs about m pairs.
   Before nodes are paired, a node's size and its shingle's place bound the sizes of its partners; it looks in
   the bands of those sizes alone, and nodes that no partner is left for, in either role, are not looked at.
5. Pairs pass a suffix filter on counts by hash range that nodes carry, so few texts move. Verification joins
   the two texts, tries the suffix filter again (lower bounds of the difference from splits of the sorted
   hashes), then counts the intersection.

Components are found by alternating large-star and small-star steps on tables in the shared folder. The links
verified on the way (`Joined.spanning`) are whole for components only.

All links (`links`, `link_counts`). Both ends of a link lie in one component, so the sets of linked nodes are dealt
by component: small components share blocks, a large one is dealt by a hash into chunks, one block for each two
chunks. Any two nodes of a component meet in exactly one block, where the sizes of all intersections come from
products of incidence matrices: every pair is verified, once, none is left out.

Defined cases: null, empty or wordless text has the empty set and is linked with nothing; with fewer words
than a shingle has, the whole sequence is the one shingle; repeated doc_ids are separate rows; a null doc_id
is never the smallest unless all are null; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdara.llm.common import SMALL_BATCHES, materialize, scratch, settings, spare, tidy

_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BLOCK = 4096
BINS = 64
#: Most nodes and shingles of a chunk, on average, and columns of a matrix.
CHUNK_NODES, CHUNK_ITEMS, SLAB = 1024, 500_000, 2048


@dataclass(frozen=True)
class Likeness:
    """Shingles of `words` words; linked when den * |intersection| >= num * |union|."""

    words: int = 5
    num: int = 80
    den: int = 100

    def prefix(self, n: int) -> int:
        return n - -(-self.num * n // self.den) + 1


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _C2
    h = (h ^ (h >> np.uint64(27))) * _C3
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    from xxhash import xxh3_64_intdigest as digest

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII spaces only
    if not parts:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(digest, parts), np.uint64, len(parts))
    k = min(words, len(parts))
    n = len(parts) - k + 1
    with np.errstate(over="ignore"):
        h = np.full(n, k, np.uint64)
        for j in range(k):
            h = _mix(h * _C1 + each[j : j + n])
    return np.unique(h)


def signature(s: np.ndarray) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(s.tobytes())


def _gathered(rows: DataFrame, out: np.ndarray, fold: np.ufunc) -> np.ndarray:
    """The (block, values) rows that tasks made, folded into `out`, whose size is bounded whatever the input's."""

    def add(key, table):
        total = np.zeros(BLOCK, np.int64)
        for value in table.column("values").to_pylist():
            total = fold(total, np.frombuffer(value, f"<u{len(value) // BLOCK}"))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "values": pa.array([np.minimum(total, 2**31 - 1).astype("<u4").tobytes()], pa.binary())})

    with settings(rows.sparkSession, **SMALL_BATCHES):
        for r in rows.groupBy("block").applyInArrow(add, "block int, values binary").toLocalIterator():
            out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["values"], "<u4")
    return out


def _blocks(counts: np.ndarray) -> pa.RecordBatch:
    """The blocks in use, in as few bytes a counter as a block's largest needs."""
    number, values = [], []
    for b in range(len(counts) // BLOCK):
        part = counts[b * BLOCK : (b + 1) * BLOCK]
        if top := int(part.max()):
            number.append(b)
            values.append(part.astype("u1" if top < 256 else "<u2" if top < 65_536 else "<u4").tobytes())
    return pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(values, pa.binary())], ["block", "values"])


def count_sketch(docs: DataFrame, words: int, bits: int) -> np.ndarray:
    """Occurrences of shingles by the low bits of their hash, over all texts."""

    def run(batches):
        counts = np.zeros(1 << bits, np.uint32)
        mask = np.uint64((1 << bits) - 1)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                np.add.at(counts, (shingles(text, words) & mask).astype(np.int64), 1)
        yield _blocks(counts)

    return _gathered(docs.select("text").mapInArrow(tidy(run), "block int, values binary"), np.zeros(1 << bits, np.int32), np.add)


def profiles(docs: DataFrame, like: Likeness, sketch: np.ndarray) -> DataFrame:
    """doc_id, n, sig, prefix (shingles rare first), bins of each document; the last three null for an empty set."""
    counts = docs.sparkSession.sparkContext.broadcast(sketch)
    mask = np.uint64(len(sketch) - 1)

    def run(batches):
        rank = counts.value
        for batch in batches:
            n, sig, prefix, bins = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text, like.words)
                n.append(len(s))
                if not len(s):
                    sig.append(None)
                    prefix.append(None)
                    bins.append(None)
                    continue
                order = np.argsort(rank[(s & mask).astype(np.int64)], kind="stable")
                sig.append(signature(s))
                prefix.append(s[order[: like.prefix(len(s))]].view(np.int64))
                # Counts that stop at 255 still bound the difference from below.
                bins.append(np.minimum(np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(prefix, pa.list_(pa.int64())), pa.array(bins, pa.binary())], ["doc_id", "n", "sig", "prefix", "bins"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {dict(docs.dtypes)['doc_id']}, n long, sig binary, prefix array<bigint>, bins binary")


def _wanted_bits(ids: DataFrame, bits: int) -> np.ndarray:
    """A bit for each doc_id's hash, eight to a byte: a filter that only saves work."""

    def run(batches):
        seen = np.zeros(1 << bits - 3, np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy()
            np.bitwise_or.at(seen, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield _blocks(seen)

    places = ids.select(F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits)).alias("at"))
    return _gathered(places.mapInArrow(tidy(run), "block int, values binary"), np.zeros(1 << bits - 3, np.uint8), np.bitwise_or)


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, sig, text) of the nodes' representatives; wanted has node, sig and the doc_id that stands for it.

    A filter of 16 bits a wanted row, up to 2**26, keeps most other texts out of the shuffle. A doc_id that
    several rows share brings several texts; those that don't have the node's signature are left out at verification.
    """
    bits = min(26, max(18, math.ceil(math.log2(16 * max(wanted.count(), 1)))))
    seen = docs.sparkSession.sparkContext.broadcast(_wanted_bits(wanted, bits))

    def run(batches):
        have = seen.value
        for batch in batches:
            at = batch.column(2).to_numpy()
            part = batch.filter(pa.array((have[at >> 3] >> (at & 7) & 1).astype(bool)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["doc_id", "text"])

    near = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits)).alias("at")).mapInArrow(tidy(run), docs.select("doc_id", "text").schema)
    wanted = wanted.withColumnRenamed("doc_id", "_id")
    return near.join(wanted, near["doc_id"].eqNullSafe(wanted["_id"])).select("node", "sig", "text")


def suffix_difference(x: np.ndarray, y: np.ndarray, depth: int = 3) -> int:
    """Lower bound of the size of the symmetric difference of sorted sets, by splits at the middle."""
    if depth == 0 or not len(x) or not len(y):
        return abs(len(x) - len(y))
    at = len(y) // 2
    cut = int(np.searchsorted(x, y[at]))
    return suffix_difference(x[:cut], y[:at], depth - 1) + suffix_difference(x[cut:], y[at:], depth - 1)


def linked(x: np.ndarray, y: np.ndarray, like: Likeness) -> bool:
    """Whether two sorted sets are as similar as asked."""
    total = len(x) + len(y)
    need = -(-like.num * total // (like.den + like.num))  # least intersection
    if min(len(x), len(y)) < need or suffix_difference(x, y) > total - 2 * need:
        return False
    return len(np.intersect1d(x, y, assume_unique=True)) >= need


def plausible(pairs: DataFrame, nodes: DataFrame, like: Likeness) -> DataFrame:
    """The pairs whose sets, counted by the top bits of their hashes, don't differ too much to be linked.

    This is the suffix filter's bound with fixed splits of the hash range, tried before any text moves: the
    sum of the counts' differences is at most that of the sets.
    """
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("nx"), F.col("bins").alias("x"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("ny"), F.col("bins").alias("y"))

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, BINS).astype(np.int64) for k in (3, 5))
            total = batch.column(2).to_numpy() + batch.column(4).to_numpy()
            most = total - 2 * -(-like.num * total // (like.den + like.num))
            keep = pa.array(np.abs(x - y).sum(axis=1) <= most)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "nx", "x", "ny", "y").mapInArrow(tidy(run), "a long, b long")


def verify(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, like: Likeness) -> DataFrame:
    """Of the (a, b) pairs of nodes those that are linked."""
    with scratch(docs.sparkSession) as write:
        pairs = write(plausible(pairs, nodes, like), "jaccard-plausible")
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = write(ends.join(nodes.select("node", "sig", F.col("min_doc").alias("doc_id")), "node"), "jaccard-wanted")
        texts = write(_texts(docs, wanted), "jaccard-texts")
        return materialize(_verified(pairs, texts, like), "jaccard-verified")


def _verified(pairs: DataFrame, texts: DataFrame, like: Likeness) -> DataFrame:
    left = texts.select(F.col("node").alias("a"), F.col("sig").alias("sx"), F.col("text").alias("x"))
    right = texts.select(F.col("node").alias("b"), F.col("sig").alias("sy"), F.col("text").alias("y"))

    def run(batches):
        known: dict[int, np.ndarray | None] = {}  # sets of nodes just met, a few MB at most
        held = 0

        def items(node: int, sig: bytes, text: pa.StringScalar) -> np.ndarray | None:
            nonlocal held
            if node not in known:
                s = shingles(text.as_py(), like.words)
                if held + len(s) > 1_000_000:
                    known.clear()
                    held = 0
                held += len(s)
                if signature(s) != sig:
                    return None  # another text of the same doc_id
                known[node] = s
            return known[node]

        for batch in batches:
            a, b, sx, sy = (batch.column(k).to_pylist() for k in range(4))
            x, y = batch.column(4), batch.column(5)  # a text is decoded only if its set isn't known
            keep = []
            for row in zip(a, sx, x, b, sy, y, strict=True):
                p, q = items(*row[:3]), items(*row[3:])
                keep.append(p is not None and q is not None and linked(p, q, like))
            kept = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], ["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "sx", "sy", "x", "y").mapInArrow(tidy(run), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node of each linked node's component, by large-star and small-star steps."""
    with scratch(links.sparkSession) as write:
        edges = write(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "jaccard-edges")
        while not _is_stars(edges):
            # Large star: hang each node's larger neighbours on its least one.
            both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            large = write(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), "jaccard-large")
            # Small star: hang each node and its smaller neighbours on the least of them.
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            edges = write(small.union(low.select("u", F.col("m").alias("v"))).where("u > v").distinct(), "jaccard-edges")
        return materialize(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v"), F.col("v"))).distinct(), "jaccard-roots")


def _is_stars(edges: DataFrame) -> bool:
    """Whether each node hangs on one other at most, and none that hangs has others on it."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(edges.select("v", F.lit(0), F.lit(1)))
    by = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return by.where("hangs > 1 or hangs = 1 and holds = 1").isEmpty()


@dataclass
class Joined:
    """nodes: (node, sig, n, min_doc, copies); spanning: the (a, b) verified for components; rows: doc_id, n, sig; roots: (node, root)."""

    rows: DataFrame
    nodes: DataFrame
    spanning: DataFrame
    roots: DataFrame


def _filters(nx, ny, px, py, like: Likeness):
    """Length filter, and the bound on the intersection if this common shingle is the pair's first: no earlier
    one is shared, so what follows it in the shorter rest bounds the whole. Every link passes at its first."""
    small, large = F.least(nx, ny), F.greatest(nx, ny)
    upper = F.least(nx - px, ny - py)
    return (like.den * small >= like.num * large) & (upper * (like.den + like.num) >= like.num * (nx + ny))


def _partners(nx, px, like: Likeness):
    """Bounds of the sizes of partners of a set of nx shingles whose first shared one is at px: (least, most)."""
    return F.ceil(like.num * nx / like.den), F.floor((nx - px) * (like.den + like.num) / like.num) - nx


def _across(placed: DataFrame, like: Likeness) -> DataFrame:
    """(a, b): pairs of a list's nodes from different components that pass the length and positional filters.

    The larger set looks for the smaller, by token and band of sizes; bands are as wide as sizes of linked sets may
    differ, so it looks in two or three. Sets of one size are told apart by their nodes' numbers.
    """
    band = lambda n: F.floor(F.log(n) / F.lit(math.log(like.den / like.num)))
    least, most = _partners(F.col("n"), F.col("pos"), like)
    named = lambda end: [F.col(c).alias(f"{c}_{end}") for c in ("node", "n", "pos", "root")]
    x = placed.withColumns({"low": F.greatest(least, F.lit(1)), "high": F.least(most, F.col("n"))}).where("low <= high")
    x = x.select("token", *named("x"), F.explode(F.sequence(band(F.col("low")), band(F.col("high")))).alias("band"))
    y = placed.where(most >= F.col("n")).select("token", *named("y"), band(F.col("n")).alias("band"))
    c = F.col
    once = (c("n_y") < c("n_x")) | ((c("n_y") == c("n_x")) & (c("node_y") < c("node_x")))
    far = once & (c("root_x") != c("root_y")) & _filters(c("n_x"), c("n_y"), c("pos_x"), c("pos_y"), like)
    return x.join(y, ["token", "band"]).where(far).select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def jaccard_join(docs: DataFrame, like: Likeness = Likeness(), bits: int | None = None) -> Joined:
    docs = docs.select("doc_id", "text")
    if bits is None:
        bits = min(24, max(20, math.ceil(math.log2(4 * max(docs.count(), 1)))))
    with scratch(docs.sparkSession) as write:
        heavy = write(profiles(docs, like, count_sketch(docs, like.words, bits)), "jaccard-profiles")
        by_sig = heavy.where("sig is not null").groupBy("sig").agg(F.first("n").alias("n"), F.min("doc_id").alias("min_doc"), F.count("*").alias("copies"), F.first("prefix").alias("prefix"), F.first("bins").alias("bins"))
        nodes = materialize(by_sig.select(F.monotonically_increasing_id().alias("node"), "*"), "jaccard-nodes")
        rows = materialize(heavy.select("doc_id", "n", "sig"), "jaccard-rows")  # prefixes stand with the nodes
    with scratch(docs.sparkSession) as write:
        posts = nodes.select("node", "n", F.posexplode("prefix").alias("pos", "token"))
        star = posts.groupBy("token").agg(F.min(F.struct("pos", "n", "node")).alias("p"), F.count("*").alias("m")).where("m > 1")
        star = star.select("token", F.col("p.node").alias("p_node"), F.col("p.n").alias("p_n"), F.col("p.pos").alias("p_pos"))
        lists = write(posts.join(star, "token"), "jaccard-lists")

        near = _filters(F.col("n"), F.col("p_n"), F.col("pos"), F.col("p_pos"), like)
        first = lists.where((F.col("node") != F.col("p_node")) & near).select(F.least("node", "p_node").alias("a"), F.greatest("node", "p_node").alias("b")).distinct()
        first = write(first, "jaccard-pairs")
        spanning = verify(first, nodes, docs, like)
        roots = components(spanning)

        placed = lists.select("token", "node", "n", "pos").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        open_ = placed.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("token")
        placed = write(placed.join(open_, "token", "left_semi"), "jaccard-open")
        second = write(_across(placed, like).join(first, ["a", "b"], "left_anti"), "jaccard-pairs")
        if not second.isEmpty():
            spanning = materialize(spanning.unionByName(verify(second, nodes, docs, like)), "jaccard-spanning")
            roots = components(spanning)
    return Joined(rows, nodes, spanning, roots)


def _dealt(joined: Joined, docs: DataFrame, like: Likeness) -> DataFrame:
    """(grp, i, j, chunk, root, node, copies, items): the sets of linked nodes, once for each block they are compared in."""
    ends = joined.roots.join(joined.nodes.select("node", "sig", "n", "copies", F.col("min_doc").alias("doc_id")), "node")
    ends = materialize(ends, "jaccard-ends")
    texts = _texts(docs.select("doc_id", "text"), ends.select("node", "sig", "doc_id"))

    def run(batches):
        for batch in batches:
            node, items = [], []
            for at, sig, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                s = shingles(text.as_py(), like.words)
                if signature(s) == sig:  # else another text of the same doc_id
                    node.append(at)
                    items.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(items, pa.binary())], ["node", "items"])

    # Rows that share a doc_id and a set bring it once each; one is enough.
    sets = materialize(texts.mapInArrow(tidy(run), "node long, items binary").groupBy("node").agg(F.first("items").alias("items")), "jaccard-sets")
    sizes = ends.groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("total"))
    sizes = materialize(sizes.select("root", "total", F.ceil(F.greatest(F.col("m") / CHUNK_NODES, F.col("total") / CHUNK_ITEMS)).alias("k")), "jaccard-sizes")
    small = sizes.where("k = 1").agg(F.sum("total")).first()[0] or 0
    buckets = max(1, -(-small // CHUNK_ITEMS))
    rows = ends.select("node", "root", "copies").join(sizes.select("root", "k"), "root").join(sets, "node")
    rows = rows.withColumns({"chunk": F.pmod(F.xxhash64("node"), "k"), "grp": F.when(F.col("k") == 1, -1 - F.pmod(F.xxhash64("root"), F.lit(buckets))).otherwise(F.col("root"))})
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    return rows.select("grp", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "root", "node", "copies", "items")


def _intersections(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of x with each of y."""
    both = np.intersect1d(np.unique(np.concatenate(x)), np.unique(np.concatenate(y)), assume_unique=True)

    def places(sets):
        items, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(both, items), max(len(both) - 1, 0))
        known = both[at] == items if len(both) else np.zeros(len(items), bool)
        order = np.argsort(at[known], kind="stable")
        return row[known][order], at[known][order]

    (rx, cx), (ry, cy) = places(x), places(y)
    out = np.zeros((len(x), len(y)), np.float32)  # whole numbers below 2^24 are exact
    for low in range(0, len(both), SLAB):
        width = min(SLAB, len(both) - low)
        part = []
        for rows, cols, height in ((rx, cx, len(x)), (ry, cy, len(y))):
            a, b = np.searchsorted(cols, (low, low + width))
            m = np.zeros((height, width), np.float32)
            m[rows[a:b], cols[a:b] - low] = 1
            part.append(m)
        out += part[0] @ part[1].T
    return out.astype(np.int64)


def _blocks_links(table: pa.Table, like: Likeness):
    """(nodes x, nodes y, copies x, copies y, linked?) of each component in a block; y is x where a chunk meets itself."""
    table = table.sort_by("root")
    root, chunk, node, copies = (table.column(k).to_numpy() for k in ("root", "chunk", "node", "copies"))
    sets = [np.frombuffer(v, np.uint64) for v in table.column("items").to_pylist()]
    cuts = [0, *(np.flatnonzero(np.diff(root)) + 1).tolist(), len(root)]
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    for low, high in zip(cuts, cuts[1:], strict=False):
        ix = low + np.flatnonzero(chunk[low:high] == i)
        iy = low + np.flatnonzero(chunk[low:high] == j)
        if not len(ix) or not len(iy):
            continue
        x, y = [sets[k] for k in ix], [sets[k] for k in iy]
        both = _intersections(x, y)
        total = np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in y])[None, :]
        near = like.den * both >= like.num * (total - both)
        if i == j:
            np.fill_diagonal(near, False)
        yield node[ix], node[iy], copies[ix], copies[iy], near, i == j


def links(docs: DataFrame, joined: Joined, like: Likeness = Likeness()) -> DataFrame:
    """(a, b), a < b: all pairs of nodes that are linked. Documents of one node have equal sets, so they are linked too."""

    def run(table):
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for nx, ny, _, _, near, same in _blocks_links(table, like):
            p, q = np.nonzero(np.triu(near) if same else near)
            a.append(np.minimum(nx[p], ny[q]))
            b.append(np.maximum(nx[p], ny[q]))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return _dealt(joined, docs, like).groupBy("grp", "i", "j").applyInArrow(run, "a long, b long")


def link_counts(docs: DataFrame, joined: Joined, like: Likeness = Likeness()) -> DataFrame:
    """(node, others): rows of other nodes that each node with any link is linked to; no pair leaves its block."""

    def run(table):
        node, count = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for nx, ny, cx, cy, near, same in _blocks_links(table, like):
            node.append(nx)
            count.append(near @ cy)
            if not same:
                node.append(ny)
                count.append(cx @ near)
        return pa.table({"node": np.concatenate(node), "others": np.concatenate(count).astype(np.int64)})

    return _dealt(joined, docs, like).groupBy("grp", "i", "j").applyInArrow(run, "node long, others long").groupBy("node").agg(F.sum("others").alias("others"))


def linked_documents(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """The members with n_links: the other rows of `docs` whose sets are as similar as asked, equal sets among them."""
    joined = jaccard_join(docs, like)
    others = joined.nodes.select("node", "sig", "copies").join(link_counts(docs, joined, like), "node", "left")
    others = materialize(others.select(F.col("sig").alias("_sig"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")), "jaccard-counts")
    found = membership(joined, "sig")
    return found.join(others, found["sig"] == others["_sig"], "left").select("doc_id", "n_shingles", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def membership(joined: Joined, *also: str) -> DataFrame:
    """doc_id, n_shingles, component_id: the least doc_id that links and equal sets reach."""
    node = joined.nodes.select("node", "sig", "min_doc").join(joined.roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = node.groupBy("root").agg(F.min("min_doc").alias("component_id"))
    by_sig = node.join(least, "root").select("sig", "component_id")
    rows = joined.rows.select("doc_id", "n", "sig").join(by_sig, "sig", "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), *also)


def components_of(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    return membership(jaccard_join(docs, like))


def thin(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """`docs` with one document of each component, the one with the least doc_id; columns as they were.

    Documents without a set stay. Rows that share a doc_id are judged together: if one of them is its
    component's least, one row for each of their texts stays, else none.
    """
    found = components_of(docs, like).groupBy("doc_id").agg(F.max((F.col("n_shingles") == 0) | F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays"), F.count("*").alias("n"))
    found = materialize(found, "jaccard-members")
    # The ids to take out are written, so that their size is known: few are broadcast, many are not.
    out = materialize(found.where("not stays or n > 1").select(F.col("doc_id").alias("_out")), "jaccard-out")
    kept = docs.join(out, docs["doc_id"].eqNullSafe(out["_out"]), "left_anti")
    shared = materialize(found.where("stays and n > 1").select(F.col("doc_id").alias("_shared")), "jaccard-shared")
    if shared.isEmpty():
        return kept
    rows = docs.join(shared, docs["doc_id"].eqNullSafe(shared["_shared"]), "left_semi")
    first, nth = F.row_number().over(Window.partitionBy("doc_id", F.sha2(F.col("text").cast("binary"), 256)).orderBy(F.lit(1))), spare(docs)
    return kept.unionByName(rows.withColumn(nth, first).where(F.col(nth) == 1).drop(nth))
