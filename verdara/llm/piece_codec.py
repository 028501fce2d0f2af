"""SentencePiece BPE encoding and decoding from a prefix table.

For every prefix of a segment the table holds the one token that ends the prefix's encoding. An automaton
lists the tokens that end at a place, longest first; the first that is compatible with the last token of
the prefix before it is the one, since a BPE encoding is right exactly when all its neighbours are. Ids are
then read backwards from the last prefix. A pair is compatible when merging its joined text gives the pair
back; pairs are remembered.

A text splits into segments where no token can span: before a run of spaces that follows another character,
around line feeds, and before marks that the vocabulary never has behind a letter. Segments of up to `LONGEST` characters are remembered, within a fixed bound. Runs of
two or more spaces hold tokens of equal score, for which the table's argument fails; those segments are
merged step by step in the library's order. Characters outside the vocabulary become their bytes' tokens.

Decoding joins pieces, turns byte tokens back to characters and drops the leading dummy space, as the
library's decode(ids) does.

Defined cases: null text counts as empty and gives the end id alone; any length is encoded whole; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from verdara.llm.common import tidy

SPACE = "▁"
NEVER = float("-inf")
LONGEST = 48
REMEMBERED = 400_000


class PieceTable:
    """Vocabulary, scores and the automaton of a SentencePiece BPE model."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.end = sp.eos_id()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.silent = {i for i in range(n) if sp.is_control(i)}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            # A token that its own text doesn't merge to is never part of an encoding.
            if len(p) == 1 or self.merged(p) == [p]:
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self._pairs: dict[int, bool] = {}
        self.known = frozenset(p for p in self.ids if len(p) == 1)
        marks = re.escape("".join(sorted(self._marks())))
        first = f"{SPACE}*[{marks}][^{SPACE}\n]*|" if marks else ""
        self.segment = re.compile(f"\n|{SPACE}*[^{SPACE}\n{marks}]+|{first}{SPACE}+")

    def _marks(self) -> set[str]:
        """Characters other than letters and digits that no piece has behind a character outside this set: a
        segment may end before them."""
        before: dict[str, set[str]] = {}
        for p in self.ids:
            for a, b in zip(p, p[1:], strict=False):
                before.setdefault(b, set()).add(a)
        marks = {p for p in self.ids if len(p) == 1 and p != SPACE and not p.isalnum()}
        while bad := {m for m in marks if before.get(m, set()) - marks - {SPACE}}:
            marks -= bad
        return marks

    def segments(self, text: str) -> list[str]:
        return self.segment.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def merged(self, text: str) -> list[str]:
        """Merge step by step: the best scored neighbours first, the leftmost on a tie."""
        if len(text) <= 24:
            return self._merged_short(text)
        parts: list[str | None] = list(text)
        left, right = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(parts):
                joined = parts[a] + parts[b]  # type: ignore[operator]
                if (s := self.score.get(joined)) is not None:
                    heapq.heappush(heap, (-s, a, b, joined))

        for k in range(len(parts) - 1):
            offer(k, k + 1)
        while heap:
            _, a, b, joined = heapq.heappop(heap)
            if parts[a] is None or parts[b] is None or parts[a] + parts[b] != joined or right[a] != b:
                continue
            parts[a], parts[b] = joined, None
            right[a] = right[b]
            if right[b] < len(parts):
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [p for p in parts if p is not None]

    def _merged_short(self, text: str) -> list[str]:
        """The same without a heap: the scores of neighbours in a list."""
        get = self.score.get
        parts = list(text)
        scores = [get(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while scores:
            best = max(scores)
            if best == NEVER:
                break
            k = scores.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del scores[k]
            if k < len(scores):
                scores[k] = get(parts[k] + parts[k + 1], NEVER)
            if k:
                scores[k - 1] = get(parts[k - 1] + parts[k], NEVER)
        return parts

    def compatible(self, a: int, b: int) -> bool:
        key = a << 20 | b
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) > 1_000_000:
                self._pairs.clear()
            x, y = self.pieces[a], self.pieces[b]
            known = self._pairs[key] = self.merged(x + y) == [x, y]
        return known

    def prefix_ids(self, segment: str) -> list[int]:
        """Ids of a segment whose characters are all in the vocabulary, by the prefix table."""
        n = len(segment)
        last, width = [-1] * (n + 1), [0] * (n + 1)
        pairs = self._pairs
        for end, (token, size) in self.automaton.iter(segment):
            if last[end + 1] >= 0:
                continue
            start = end + 1 - size
            if start:
                if (before := last[start]) < 0:
                    continue
                fits = pairs.get(before << 20 | token)
                if not (self.compatible(before, token) if fits is None else fits):
                    continue
            last[end + 1], width[end + 1] = token, size
        out = []
        while n:
            out.append(last[n])
            n -= width[n]
        out.reverse()
        return out

    def encode_segment(self, segment: str) -> list[int]:
        if SPACE * 2 not in segment and self.known.issuperset(segment):
            return self.prefix_ids(segment)
        ids, out, run = self.ids, [], []

        def flush() -> None:
            if run:
                text = "".join(run)
                out.extend([ids[p] for p in self.merged(text)] if SPACE * 2 in text else self.prefix_ids(text))
                run.clear()

        for ch in segment:
            if ch in ids:
                run.append(ch)
            else:
                flush()
                out.extend(self.byte_id[b] for b in ch.encode())
        flush()
        return out

    def decode_segment(self, ids: list[int]) -> str:
        """Joined pieces of the ids, byte tokens as characters, spaces still marked."""
        out, raw = [], bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if i not in self.silent:
                out.append(self.pieces[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out)


class _Remembered(dict):
    """Segment -> (ids as decimal text, decoded text), with a bound on its size."""

    def __init__(self, table: PieceTable):
        super().__init__()
        self.table = table

    def __missing__(self, segment: str) -> tuple[str, str]:
        ids = self.table.encode_segment(segment)
        made = (" ".join(map(str, ids)), self.table.decode_segment(ids))
        if len(segment) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[segment] = made
        return made


_TABLES: dict[str, _Remembered] = {}


def remembered(path: str) -> _Remembered:
    """The table of a model file, built once in a worker."""
    if path not in _TABLES:
        _TABLES[path] = _Remembered(PieceTable(path))
    return _TABLES[path]


def encode(text: str | None, path: str) -> list[int]:
    """Ids of a text with the end id."""
    memory = remembered(path)
    return [int(i) for s in memory.table.segments(text or "") for i in memory[s][0].split()] + [memory.table.end]


def decode(ids: list[int], path: str) -> str:
    text = remembered(path).table.decode_segment(ids).replace(SPACE, " ")
    return text[1:] if text.startswith(" ") else text


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document."""

    def run(batches):
        memory = remembered(path)
        end = str(memory.table.end)
        get, segments = memory.__getitem__, memory.table.segments
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in batch.column(1).to_pylist():
                made = list(map(get, segments(text or "")))
                ids = " ".join([m[0] for m in made] + [end])
                decoded = "".join([m[1] for m in made]).replace(SPACE, " ")
                n.append(ids.count(" ") + 1)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                text_sha.append(hashlib.sha256(decoded[1:].encode() if decoded.startswith(" ") else decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
