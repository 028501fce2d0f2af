"""Phrase collocation mining: tries of Apriori-safe candidates, advanced over all text positions at once.

1. Words are counted by language. Each (lang, word) has a 64-bit key; no two of the table have the same, or another salt is taken,
   so that keys stand for words exactly. A phrase occurs no oftener than any part of it, so only words, and then pairs, that
   occur often enough can be parts of a candidate. Levels hand on a bitmap of the keys that are left, 16 bits for each up to
   2**27 bits: beyond, more positions pass than need to, but none is lost.
2. A level takes one pass over the texts, for pairs, then for triples. Tasks hand on the positions whose parts may all occur often
   enough, as the keys of their words, equal ones of a task added up, dealt by a hash of the phrase into shards of some
   `SHARD` words of text, however many share a word.
3. A shard's phrases whose hash is met often enough are its candidates. Its task builds their double-array trie: first,
   second, third word, each word in two digits, and advances the states of all its positions by numpy, a
   digit at a time: next = base[state] + code, where check[next] is the state. Accepting states are counted by `bincount`.
   No trie leaves its task: neither passes over the texts nor memory grow with the candidates, only the number of shards does.
4. Scores, the loss of candidates that stand inside longer ones, and ranks are joins and windows over the exact counts.

Defined cases: null text is empty; null language is `und`; an empty piece, or one of white space, has no word;
repeated rows count each; equal scores rank by count, then by phrase in byte order; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdara.llm.common import SMALL_BATCHES, materialize, scratch, settings, tidy
from verdara.llm.jaccard_join import _C1, _blocks, _gathered, _mix
from verdara.session import ship

#: Words of text of a shard, on average, and words or positions that a task holds before it hands them on.
SHARD, HELD = 1_000_000, 2_000_000
#: Bits of a hash in a bitmap, and bytes that a task hands on at once.
PROBES, AT_ONCE = 5, 4_000_000
SPACE, STOP = 32, 10
_TABLE = bytes.maketrans(bytes(range(65, 91)) + b"\t.,;:!?\n\x0b\x0c\r", bytes(range(97, 123)) + b" " + b"\n" * 10)
KEYS = "k1", "k2", "k3"


@dataclass(frozen=True)
class Rule:
    """Phrases of two or three words that occur `least` times; inside a longer one with `num` of `den` of them it is dropped."""

    least: int = 10
    num: int = 50
    den: int = 100
    top: int = 2000


def read(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array, np.ndarray, np.ndarray]]:
    """For each language of a batch of (lang, text): its name, its distinct words, A-Z lower-cased, the number among these of each
    word of its texts, and whether a piece ends after it."""
    langs = batch.column(0).dictionary_encode()
    order = np.argsort(langs.indices.to_numpy(), kind="stable")
    lang = langs.indices.to_numpy()[order]
    texts = batch.column(1).take(pa.array(order)).fill_null(b"")
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or bounds[0] == bounds[-1]:
        return
    data = texts.buffers()[2].slice(int(bounds[0]), int(bounds[-1] - bounds[0])).to_pybytes()
    low = np.frombuffer(data.translate(_TABLE), np.uint8)
    bounds = bounds - bounds[0]
    inner = bounds[(bounds > 0) & (bounds < len(low))]
    stop = low == STOP
    word = ~(stop | (low == SPACE))
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    first[inner], last[inner - 1] = word[inner], word[inner - 1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return
    ends = np.concatenate(([0], np.cumsum(np.flatnonzero(last) + 1 - starts))).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(low[word])])
    piece = np.cumsum(stop, dtype=np.int32)[starts]
    end = np.concatenate((piece[1:] != piece[:-1], [True]))
    of_text = np.searchsorted(starts, bounds)  # its first word
    end[of_text[of_text > 0] - 1] = True
    cuts = np.flatnonzero(np.concatenate(([True], lang[1:] != lang[:-1], [True])))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        low_at, high_at = int(of_text[a]), int(of_text[b])
        if low_at < high_at:
            own = words.slice(low_at, high_at - low_at).dictionary_encode()
            yield langs.dictionary[int(lang[a])].as_py(), own.dictionary, own.indices.to_numpy(), end[low_at:high_at]


def key(salt: str) -> Column:
    """The key of a row's (lang, word)."""
    return F.xxhash64(F.lit(salt), "word").bitwiseXOR(F.xxhash64(F.lit(f"{salt} lang"), "lang"))


def keys_of(lang: str, words: pa.Array, salt: str) -> np.ndarray:
    """The same of words of one language."""
    from xxhash import xxh64_intdigest as digest

    seed, of_lang = digest(salt.encode(), 42), digest(lang.encode(), digest(f"{salt} lang".encode(), 42))
    bounds = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].tolist()
    data = words.buffers()[2].to_pybytes()
    return np.fromiter((digest(data[a:b], seed) for a, b in pairwise(bounds)), np.uint64, len(words)) ^ np.uint64(of_lang)


def phrase_hash(words: list[np.ndarray]) -> np.ndarray:
    """A hash of phrases, by the keys of their first words, their second and so on; never zero."""
    h = words[0]
    with np.errstate(over="ignore"):
        for k in words[1:]:
            h = np.maximum(_mix(h * _C1 + k), np.uint64(1))
    return h


def _probes(h: np.ndarray, mask: int):
    """The places of a hash in a bitmap, one after the other."""
    with np.errstate(over="ignore"):
        step = h >> np.uint64(32) | np.uint64(1)
        for k in range(PROBES):
            yield (h + np.uint64(k) * step) & np.uint64(mask)


def _set(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash is in a bitmap; zero never is."""
    left = np.flatnonzero(h)
    mask = np.uint64(8 * len(bits) - 1)
    with np.errstate(over="ignore"):
        at = h[left]
        step = at >> np.uint64(32) | np.uint64(1)
        for _ in range(PROBES):
            place = at & mask
            on = np.flatnonzero(bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1)
            left, step = left[on], step[on]
            at = at[on] + step
    out = np.zeros(len(h), bool)
    out[left] = True
    return out


def _bitmap(phrases: DataFrame) -> np.ndarray:
    """Some bits for each phrase of the keys k1, k2 and so on; only ever lets too much pass, one in 700 while there are 16 bits a phrase."""
    bits = min(27, max(18, math.ceil(math.log2(16 * max(phrases.count(), 1)))))

    def run(batches):
        seen = np.zeros(1 << bits - 3, np.uint8)
        for batch in batches:
            h = phrase_hash([c.to_numpy().view(np.uint64) for c in batch.columns])
            for at in _probes(h, (1 << bits) - 1):
                np.bitwise_or.at(seen, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7))).astype(np.uint8))
        yield _blocks(seen)

    rows = phrases.select([k for k in KEYS if k in phrases.columns])
    return _gathered(rows.mapInArrow(tidy(run), "block int, values binary"), np.zeros(1 << bits - 3, np.uint8), np.bitwise_or)


def word_counts(docs: DataFrame, held: int = HELD) -> DataFrame:
    """(lang, word, f) of every word; docs: (lang, text as binary)."""

    def out(parts: dict[str, list[pa.Table]]) -> Iterator[pa.RecordBatch]:
        for lang, own in parts.items():
            total = pa.concat_tables(own).group_by("word").aggregate([("f", "sum")]).combine_chunks()
            for rows in total.to_batches(max_chunksize=AT_ONCE // 20):
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, rows.num_rows), rows.column("word").cast(pa.string()), rows.column("f_sum")], ["lang", "word", "f"])

    def run(batches):
        parts: dict[str, list[pa.Table]] = {}
        n = 0
        for batch in batches:
            for lang, words, codes, _ in read(batch):
                parts.setdefault(lang, []).append(pa.table({"word": words, "f": np.bincount(codes, minlength=len(words))}))
                n += len(words)
            if n > held:
                yield from out(parts)
                parts, n = {}, 0
        yield from out(parts)

    return docs.mapInArrow(tidy(run), "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def positions(docs: DataFrame, size: int, singles, pairs, salt: str, shards: int, held: int = HELD) -> DataFrame:
    """(shard, keys, counts): phrases of `size` words all of whose parts may occur often enough, and how often tasks met them.

    A row has all that a task held of a shard: the keys of first words, then of second ones and so on, and the counts.
    """

    def out(words: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h = phrase_hash(words)
        order = np.argsort(h)
        h, words = h[order], [k[order] for k in words]
        new = np.concatenate(([True], h[1:] != h[:-1]))
        for k in words:
            new[1:] |= k[1:] != k[:-1]
        starts = np.flatnonzero(new)
        c = np.diff(np.concatenate((starts, [len(h)])))
        words = [k[starts] for k in words]
        shard = ((h[starts] >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]))
        numbers, keys, counts, n = [], [], [], 0
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            numbers.append(int(shard[a]))
            keys.append(b"".join(k[a:b].tobytes() for k in words))
            counts.append(c[a:b].astype(np.min_scalar_type(c[a:b].max())).tobytes())
            n += len(keys[-1])
            if n > AT_ONCE or b == cuts[-1]:
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], ["shard", "keys", "counts"])
                numbers, keys, counts, n = [], [], [], 0

    def run(batches):
        met: list[list[np.ndarray]] = [[] for _ in range(size)]
        n = 0
        for batch in batches:
            for lang, words, codes, end in read(batch):
                own = keys_of(lang, words, salt)
                own[~_set(singles.value, own)] = 0
                own = own[codes]
                on = (own[:-1] != 0) & (own[1:] != 0) & ~end[:-1]
                if size == 3:
                    at = np.flatnonzero(on)
                    on[at] = _set(pairs.value, phrase_hash([own[at], own[at + 1]]))
                    on = on[:-1] & on[1:]
                at = np.flatnonzero(on)
                for k in range(size):
                    met[k].append(own[at + k])
                n += len(at)
            if n > held:
                yield from out([np.concatenate(k) for k in met])
                met, n = [[] for _ in range(size)], 0
        if n:
            yield from out([np.concatenate(k) for k in met])

    return docs.mapInArrow(tidy(run), "shard int, keys binary, counts binary")


def radix(words: int) -> int:
    """A word's number is two digits of this many values each, so that no state has more children."""
    return 1 << -(-max(1, words.bit_length()) // 2)


def digits(codes: np.ndarray, base: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both digits, of 1 and more, of numbers from 1 on; zeros for zero."""
    known = codes > 0
    return np.where(known, (codes - 1) // base + 1, 0), np.where(known, (codes - 1) % base + 1, 0)


class Trie:
    """A double-array trie over rows of codes of 1 and more; zeros end a row.

    A level's parents with several children get a base in a region of their own, those with most children first; those
    with one child then fill free cells anywhere.
    """

    FEW = 64

    def __init__(self, rows: np.ndarray) -> None:
        self.rng = np.random.default_rng(1)
        self.widest = int(rows.max(initial=0))
        self.base, self.check, self.accept = (np.full(1, fill, np.int32) for fill in (0, -1, -1))
        self.used = np.ones(1, bool)
        state = np.zeros(len(rows), np.int64)  # of each row's prefix so far
        live = np.arange(len(rows))
        for level in range(rows.shape[1]):
            live = live[rows[live, level] > 0]
            if not len(live):
                break
            # Parents are numbered by their states; each parent's children are its distinct codes.
            edges, back = np.unique(state[live] * (self.widest + 1) + rows[live, level], return_inverse=True)
            parent, code = edges // (self.widest + 1), edges % (self.widest + 1)
            self._place(parent, code)
            state[live] = self.base[parent][back] + code[back]
        self.accept[state] = np.arange(len(rows))
        last = int(np.flatnonzero(self.used)[-1]) + self.widest + 2  # so that no step leaves the arrays
        self._grow(last)
        self.base, self.check, self.accept = self.base[:last], self.check[:last], self.accept[:last]

    def _grow(self, size: int) -> None:
        more = max(0, size - len(self.used))
        self.base, self.check, self.accept = (np.concatenate((a, np.full(more, fill, np.int32))) for a, fill in ((self.base, 0), (self.check, -1), (self.accept, -1)))
        self.used = np.concatenate((self.used, np.zeros(more, bool)))

    def _place(self, parent: np.ndarray, code: np.ndarray) -> None:
        """Give each parent a base so that its children's cells are free; parents come sorted."""
        starts = np.flatnonzero(np.concatenate(([True], parent[1:] != parent[:-1])))
        counts = np.diff(np.concatenate((starts, [len(parent)])))
        size = np.repeat(counts, counts)
        region = len(self.used)
        for p in np.flatnonzero(counts > self.FEW):
            at, end = slice(starts[p], starts[p] + counts[p]), len(self.used)
            self._grow(end + self.widest + 1)
            self._take(parent[at], code[at], np.full(counts[p], end))
        self._grow(len(self.used) + 4 * int(((size > 1) & (size <= self.FEW)).sum()) + self.widest)
        for low, high in ((17, self.FEW), (5, 16), (2, 4)):
            among = (size >= low) & (size <= high)
            self._scatter(parent[among], code[among], region)
        alone = size == 1
        self._fill(parent[alone], code[alone])

    def _scatter(self, parent: np.ndarray, code: np.ndarray, region: int) -> None:
        """Random bases in the region, until all children of each parent are in free cells."""
        while len(parent):
            first = np.concatenate(([True], parent[1:] != parent[:-1]))
            group = np.cumsum(first) - 1
            base = self.rng.integers(region, len(self.used) - self.widest, group[-1] + 1)[group]
            cell = base + code
            own = np.zeros(len(cell), bool)
            own[np.unique(cell, return_index=True)[1]] = True  # of two that want a cell the first gets it
            good = np.logical_and.reduceat(own & ~self.used[cell], np.flatnonzero(first))[group]
            self._take(parent[good], code[good], base[good])
            if good.mean() < 0.05:
                self._grow(len(self.used) + (len(self.used) - region) // 4 + self.widest)
            parent, code = parent[~good], code[~good]

    def _fill(self, parent: np.ndarray, code: np.ndarray) -> None:
        """One child each: any free cell beyond its code will do."""
        self._grow(int(self.used.sum()) + len(parent) + self.widest + 1)
        free = np.flatnonzero(~self.used)
        cell = free[free > self.widest][: len(parent)]
        if len(cell) < len(parent):
            end = len(self.used)
            self._grow(end + len(parent) - len(cell) + self.widest)
            cell = np.concatenate((cell, np.arange(end + self.widest, end + self.widest + len(parent) - len(cell))))
        self._take(parent, code, cell - code)

    def _take(self, parent: np.ndarray, code: np.ndarray, base: np.ndarray) -> None:
        self.base[parent], self.check[base + code], self.used[base + code] = base, parent, True


def advance(base: np.ndarray, check: np.ndarray, state: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next states, and the places of those that have one."""
    to = base[state] + code
    on = np.flatnonzero((check[to] == state) & (code > 0))
    return to[on], on


def counted(h: np.ndarray, words: np.ndarray, c: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The phrases that occur `least` times or more, and how often; words: a row of keys for each word of the phrases, which may
    recur, h: their hashes, c: how often each was met."""
    order = np.argsort(h)
    h, c = h[order], c[order]
    first = np.concatenate(([True], h[1:] != h[:-1]))
    starts = np.flatnonzero(first)
    often = np.repeat(np.add.reduceat(c, starts) >= least, np.diff(np.concatenate((starts, [len(h)]))))
    words, c, first = words[:, order[often]], c[often], first[often]
    if not len(c):
        return words, c
    lead = words[:, first]
    other = (words != lead[:, np.cumsum(first) - 1]).any(axis=0)  # another phrase of the same hash
    phrases = np.concatenate((lead, np.unique(words[:, other], axis=1)), axis=1) if other.any() else lead
    known = np.unique(phrases)
    base = radix(len(known))
    trie = Trie(np.stack([d for k in phrases for d in digits(np.searchsorted(known, k) + 1, base)], axis=1))
    state, at = np.zeros(len(c), np.int64), np.arange(len(c))
    for k in words:
        for code in digits(np.searchsorted(known, k[at]) + 1, base):
            state, on = advance(trie.base, trie.check, state, code)
            at = at[on]
    f = np.bincount(trie.accept[state], weights=c[at], minlength=phrases.shape[1]).astype(np.int64)
    return phrases[:, f >= least], f[f >= least]


def phrases_of(met: DataFrame, size: int, least: int) -> DataFrame:
    """(k1, k2 and so on, f): the phrases of `positions` that occur `least` times or more."""
    names = KEYS[:size]

    def run(table: pa.Table) -> pa.Table:
        keys, counts = table.column("keys").to_pylist(), table.column("counts").to_pylist()
        words = np.concatenate([np.frombuffer(k, np.uint64).reshape(size, -1) for k in keys], axis=1)
        c = np.concatenate([np.frombuffer(v, f"<u{len(v) * 8 * size // len(k)}") for k, v in zip(keys, counts, strict=True)], dtype=np.int64)
        words, f = counted(phrase_hash(list(words)), words, c, least)
        return pa.table([*(pa.array(k.view(np.int64)) for k in words), pa.array(f)], [*names, "f"])

    return met.groupBy("shard").applyInArrow(run, ", ".join(f"{k} long" for k in (*names, "f")))


def salt_of(words: DataFrame, salts: Iterator[str]) -> tuple[str, int]:
    """The first salt by which all words have keys of their own, none of them zero; how many words the texts have."""
    for salt in salts:
        of_key = words.groupBy(key(salt).alias("key")).agg(F.count("*").alias("c"), F.sum("f").alias("f"))
        most, zero, n = of_key.agg(F.max("c"), F.max((F.col("key") == 0).cast("int")), F.sum("f")).first()
        if (most or 1) == 1 and not zero:
            return salt, n or 0


def phrase_counts(docs: DataFrame, rule: Rule, write, shard: int = SHARD, held: int = HELD) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """All words (lang, word, f, key), pairs (k1, k2, f) and triples (k1, k2, k3, f) that occur `least` times or more; (lang, n) of all words."""
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    words = write(word_counts(docs, held), "collocation-words")
    salt, n = salt_of(words, map(str, count()))
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // shard))
    names = write(words.where(F.col("f") >= rule.least).withColumn("key", key(salt)), "collocation-keys")
    with settings(spark, **SMALL_BATCHES):
        singles = share(_bitmap(names.select(F.col("key").alias("k1"))))
        two = write(phrases_of(positions(docs, 2, singles, None, salt, shards, held), 2, rule.least), "collocation-pairs")
        pairs = share(_bitmap(two))
        three = write(phrases_of(positions(docs, 3, singles, pairs, salt, shards, held), 3, rule.least), "collocation-triples")
    for b in (singles, pairs):
        b.unpersist()
    return names, two, three, words.groupBy("lang").agg(F.sum("f").alias("n"))


def best(names: DataFrame, two: DataFrame, three: DataFrame, total: DataFrame, rule: Rule, write) -> DataFrame:
    """The phrases of each language by the score of their worst cut; the tables of `phrase_counts`."""
    c = F.col
    left, right = (names.select(*more, c("key").alias(f"k{k}"), c("word").alias(f"w{k}"), c("f").alias(f)) for k, f, more in ((1, "l", ["lang"]), (2, "r", [])))
    pair = write(two.withColumnRenamed("f", "a").join(left, "k1").join(right, "k2"), "collocation-scored")
    first = pair.select("lang", "k1", "k2", "w1", "w2", c("l").alias("l1"), c("a").alias("l2"))
    second = pair.select(c("k1").alias("k2"), c("k2").alias("k3"), c("w2").alias("w3"), c("a").alias("r1"), c("r").alias("r2"))
    cuts = three.withColumnRenamed("f", "a").join(first, ["k1", "k2"]).join(second, ["k2", "k3"])
    cuts = cuts.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", "l1", "r1", "l2", "r2")
    # Only a pair can stand inside a longer candidate.
    longer = three.select("k1", "k2", "f").unionByName(three.select(c("k2").alias("k1"), c("k3").alias("k2"), "f")).groupBy("k1", "k2").agg(F.max("f").alias("longer"))
    kept = pair.join(longer, ["k1", "k2"], "left").where(F.coalesce(rule.den * c("longer") < rule.num * c("a"), F.lit(True)))
    cut = kept.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", c("l").alias("l1"), c("r").alias("r1"), c("l").alias("l2"), c("r").alias("r2"))
    score = lambda k: F.expr(f"1000000 * cast(a as decimal(15,0)) * cast(a as decimal(15,0)) div (cast(l{k} as decimal(15,0)) * cast(r{k} as decimal(15,0)))")
    scored = cut.unionByName(cuts).withColumns({"s1": score(1), "s2": score(2)})
    least = c("s1") <= c("s2")
    scored = scored.select("lang", "phrase", "a", F.when(least, c("l1")).otherwise(c("l2")).alias("l"), F.when(least, c("r1")).otherwise(c("r2")).alias("r"), F.least("s1", "s2").alias("score"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    first = scored.withColumn("rank", rank).where(c("rank") <= rule.top)
    return first.join(total, "lang").select("lang", c("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def ranked(counts: DataFrame, total: DataFrame, rule: Rule) -> DataFrame:
    """The same of counts (lang, w1, w2, w3, f) by words, where a word's key is itself with its language."""
    key = lambda k: F.struct("lang", F.col(f"w{k}").alias("word")).alias(f"k{k}")
    names = counts.where("w2 is null").select("lang", F.col("w1").alias("word"), "f", key(1).alias("key"))
    two = counts.where("w2 is not null and w3 is null").select(key(1), key(2), "f")
    three = counts.where("w3 is not null").select(key(1), key(2), key(3), "f")
    return best(names, two, three, total, rule, lambda table, _: table)


def collocations(docs: DataFrame, rule: Rule = Rule(), shard: int = SHARD, wave: int = HELD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first phrases; `wave`: positions that a task holds at once."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    # Spark takes the first rows of a window before they are dealt only up to this many; beyond, a language's candidates all meet in one task.
    with scratch(spark) as write, settings(spark, spark__sql__optimizer__windowGroupLimitThreshold=str(rule.top)):
        return materialize(best(*phrase_counts(docs, rule, write, shard, wave), rule, write), "collocations")
