"""Best-fit packing of token pieces into sequences, improved by a swap-based local search.

Tokens. A text splits into the tokenizer's own words, whose ids are remembered as bytes within a fixed
bound; unknown words go to the tokenizer together. Texts with characters beyond printable Latin-1, for
which normalisation reaches across words, are encoded whole by the tokenizer.

Packing. Full pieces are sequences of their own. The others, one a document at most, are dealt by a hash
into groups of about `GROUP` pieces; each group is packed by one task in bounded memory, so the number of
tasks grows with the input. In a group, best fit in
decreasing order comes first. Then the search takes each underfull bin, the emptiest first, and lets its
documents move into fuller bins, swap one for one, or swap two for one, whenever that fills the other bin
further: each such step raises the sum of squared fills. Empty bins are dropped. It ends when no underfull
bin has such a step with any other; an index of bins by length and room finds the partners.

Defined cases: null text is empty and is one piece of the closing id alone; repeated rows and repeated
doc_ids are separate pieces; null doc_ids are packed; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdara.llm.common import materialize, tidy

LIMIT = 2048
GROUP = 20_000
REMEMBERED = 500_000
_PLAIN = re.compile("[\t\n\r -~¡-ÿ]*")
_WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\\sa-z0-9ª²³µ¹º¼-¾ß-öø-ÿ]+")


class WordTokens(dict):
    """Word -> its ids as little-endian bytes."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # Special tokens are what the library makes of their strings; texts that hold one go to it whole.
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Words are normalised and split already: the same model without those steps.
        self.by_word = Tokenizer.from_file(path)
        self.by_word.encode_special_tokens = True
        self.by_word.normalizer = normalizers.Sequence([])
        self.by_word.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        n = self.tokenizer.get_vocab_size()
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(n)])

    def learn(self, new: list[str]) -> None:
        """Encode unknown words in one call; a word's ids end with a word-end token."""
        if len(self) + len(new) > REMEMBERED:
            self.clear()
        ids = np.array(self.by_word.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, dtype="<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        assert len(stops) == len(new), "the tokenizer split a word"
        raw, start = ids.tobytes(), 0
        for w, stop in zip(new, (4 * stops).tolist(), strict=True):
            self[w] = raw[start:stop]
            start = stop

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian ids of each text."""
        plain = [_WORD.findall(t.lower()) if t and _PLAIN.fullmatch(t) and not any(s in t for s in self.special) else None for t in texts]
        get = self.get
        found = [list(map(get, w)) if w else [] for w in plain]
        new = {w for words, ids in zip(plain, found, strict=True) if None in ids for w, i in zip(words, ids, strict=True) if i is None}
        if new:
            self.learn(list(new))
        out = []
        for text, words, ids in zip(texts, plain, found, strict=True):
            if words is None:
                out.append(self._whole(text))
            else:
                out.append(b"".join([self[w] if i is None else i for w, i in zip(words, ids, strict=True)] if None in ids else ids))
        return out

    def _whole(self, text: str | None) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes() if text else b""


_TOKENS: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    if path not in _TOKENS:
        _TOKENS[path] = WordTokens(path)
    return _TOKENS[path]


def pieces(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        tokens = word_tokens(path)
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            texts = batch.column(1).to_pylist()
            encoded = (x for at in range(0, len(texts), 64) for x in tokens.encode_all(texts[at : at + 64]))
            for row, ids in enumerate(encoded):
                ids += b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), 4 * limit)):
                    part = ids[at : at + 4 * limit]
                    rows.append(row)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", "text").mapInArrow(tidy(run, lambda: word_tokens(path).clear()), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Bins of one group: items by bin, and the bins in use by the room they have left."""

    def __init__(self, lengths: list[int], limit: int):
        self.lengths, self.limit = lengths, limit
        self.items: list[list[int]] = []
        self.room: list[int] = []
        self.by_room: list[list[int]] = [[] for _ in range(limit + 1)]  # may hold stale bins
        self.rooms: list[int] = []  # sorted rooms that have bins

    def _file(self, b: int) -> None:
        r = self.room[b]
        if not self.by_room[r]:
            insort(self.rooms, r)
        self.by_room[r].append(b)

    def _take(self, least: int) -> int:
        """A bin with the least room of at least `least`, taken off the index; -1 if there is none."""
        at = bisect_left(self.rooms, least)
        if at == len(self.rooms):
            return -1
        r = self.rooms[at]
        b = self.by_room[r].pop()
        if not self.by_room[r]:
            self.rooms.pop(at)
        return b

    def best_fit(self) -> None:
        for i in sorted(range(len(self.lengths)), key=lambda i: -self.lengths[i]):
            n = self.lengths[i]
            b = self._take(n)
            if b < 0:
                b = len(self.items)
                self.items.append([])
                self.room.append(self.limit)
            self.items[b].append(i)
            self.room[b] -= n
            self._file(b)

    def improve(self) -> None:
        """Empty the emptiest bins into the others until no underfull bin has a step with any other one.

        A sweep takes the underfull bins from the emptiest on. The index holds those still to come and those
        of the source's own room, so each pair is judged with its emptier bin as the source. Each step
        raises the sum of squared fills, so the sweeps end; the last one finds no step.
        """
        self.by_room, self.rooms = [], []
        while self._sweep():
            pass

    def _sweep(self) -> bool:
        under = [b for b in range(len(self.items)) if self.items[b] and self.room[b]]
        self._holding: list[list[tuple[int, int]]] = [[] for _ in range(self.limit + 1)]  # by length: sorted (room, bin); 0: all
        self._reach = np.arange(self.limit + 1)  # length and the most room beside it; the length alone if no bin has it
        for b in under:
            for v in {0, *(self.lengths[i] for i in self.items[b])}:
                self._holding[v].append((self.room[b], b))
        for v, held in enumerate(self._holding):
            if held:
                held.sort()
                self._reach[v] = v + held[-1][0]
        coming, grown = [(-self.room[b], b) for b in under], False
        level: set[int] = set()  # judged, with the same room as the source
        heapify(coming)
        while coming:
            r, s = heappop(coming)
            if -r != self.room[s]:  # filled since
                if self.room[s]:
                    heappush(coming, (-self.room[s], s))
                continue
            if level and self.room[next(iter(level))] != -r:
                for b in level:
                    self._index(b, False)
                level.clear()
            self._index(s, False)
            while self.items[s] and (step := self._best(s)):
                out, back, t = step
                self._index(t, False)
                self._shift(out, back, s, t)
                if self.room[t]:
                    self._index(t, True)
                    if t in level:
                        heappush(coming, (-self.room[t], t))
                level.discard(t)
                grown = True
            if self.room[s] == -r:
                self._index(s, True)
                level.add(s)
        return grown

    def _index(self, b: int, add: bool) -> None:
        for v in {0, *(self.lengths[i] for i in self.items[b])}:
            held, entry = self._holding[v], (self.room[b], b)
            if add:
                insort(held, entry)
            else:
                held.pop(bisect_left(held, entry))
            self._reach[v] = v + (held[-1][0] if held else 0)

    def _best(self, s: int) -> tuple[list[int], list[int], int] | None:
        """The step from s that fills another bin furthest: one or two documents out, at most one back."""
        n, by = self.lengths, {}
        for i in self.items[s]:
            by.setdefault(n[i], []).append(i)
        sizes = {v: same[:1] for v, same in by.items()}
        each = sorted(by)
        for a, v in enumerate(each):
            for w in each[a:]:
                if v != w or len(by[v]) > 1:
                    sizes.setdefault(v + w, [by[v][0], by[w][v == w]])
        gain, best = 0, None
        for size, out in sizes.items():
            low, high = max(0, size - self.room[s]), min(size - gain, self.limit + 1)
            if low < high:
                fits = self._reach[low:high] >= size
                k = int(fits.argmax())
                if fits[k]:
                    gain, best = size - low - k, (out, low + k)
        if best is None:
            return None
        out, v = best
        held = self._holding[v]
        t = held[bisect_left(held, (gain, -1))][1]  # the fullest bin that the gain fits
        return out, [next(j for j in self.items[t] if n[j] == v)] if v else [], t

    def _shift(self, out: list[int], back: list[int], s: int, t: int) -> None:
        for i in out:
            self.items[s].remove(i)
            self.items[t].append(i)
        for j in back:
            self.items[t].remove(j)
            self.items[s].append(j)
        gain = sum(self.lengths[i] for i in out) - sum(self.lengths[j] for j in back)
        self.room[s] += gain
        self.room[t] -= gain


def pack_group(lengths: list[int], limit: int = LIMIT) -> tuple[list[int], list[int]]:
    """(bin, offset) of each piece of a group."""
    bins = Bins(lengths, limit)
    bins.best_fit()
    bins.improve()
    where, offset, used = [0] * len(lengths), [0] * len(lengths), 0
    for items in bins.items:
        if items:
            at = 0
            for i in sorted(items):
                where[i], offset[i] = used, at
                at += lengths[i]
            used += 1
    return where, offset


def pack(docs: DataFrame, path: str, limit: int = LIMIT, group: int = GROUP) -> DataFrame:
    """The pieces with sequence_id and offset, gapless from 0 in each sequence."""
    cut = materialize(pieces(docs, path, limit), "packing-pieces")
    n_open = cut.where(F.col("length") < limit).count()
    groups = max(1, round(n_open / group))
    # Full pieces take the ids below 0, numbered within the partition that wrote them.
    full = cut.where(F.col("length") == limit).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    salt = F.pmod(F.xxhash64("doc_id", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups))  # ids: repeated rows spread too
    schema = "doc_id {}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long".format(dict(docs.dtypes)["doc_id"])

    def run(key, table):
        table = table.drop_columns(["grp"]).sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        where, offset = pack_group(table.column("length").to_pylist(), limit)
        ids = pa.array(np.array(where, dtype=np.int64) + (key[0].as_py() << 32))
        return table.append_column("sequence_id", ids).append_column("offset", pa.array(offset, pa.int64()))

    parts = cut.where(F.col("length") < limit).withColumn("grp", salt.cast("long")).groupBy("grp").applyInArrow(run, schema)
    return full.select(*parts.columns).unionByName(parts)
