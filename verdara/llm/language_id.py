"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

Each language has a model of order `ORDER` over the characters of words (runs of letters, lower-cased, with
a start and an end mark; longer runs are cut every `CHUNK` letters). An order's n-grams are hashes in a sorted
array beside their discounted probabilities, its contexts likewise beside their back-off weights; a look-up is
a binary search. The language with the least cross-entropy per character wins. A character's probability
depends on the last `ORDER` characters of its word only, so scores are summed from words; those of words
already met are remembered within a fixed bound, and nothing of a text is left out.

Calibration uses texts that the models haven't seen: a softmax temperature that makes the score a probability,
and for each language a ceiling on the cross-entropy of its own texts. A text's excess is its distance from the
mean of held-back texts in standard deviations, wider for short texts; the ceiling is the conformal quantile of
their excesses at which a text of the language is rejected with a probability of `FALSE_REJECTION` at most. A
language with fewer held-back texts than that level needs, 1 / FALSE_REJECTION - 1, rejects no text with letters.

Models are fitted on a bounded sample: the `FIT` training texts of each language with the least hash of their
doc_id; the next `HELD` calibrate. With fewer texts a fifth is held back, never a language's only one. Sampled
texts are learned from whole.

Defined cases: a text that is null or has no letter is `und`, score 0 and rejected, and isn't learned from; ties
go to the language first by name; without any training text all documents are `und`; repeated rows and extra
columns do no harm.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdara.llm.common import id_remainder, sample_by_group, tidy

ORDER = 5
CHUNK = 32
FIT, HELD = 500, 600
REMEMBERED = 250_000
FALSE_REJECTION = 0.002
UND = "und"
_RUN = re.compile(r"[^\W\d_]{1,%d}" % CHUNK)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_ALPHABET = 2_000.0


def words_of(text: str) -> list[str]:
    return _RUN.findall(text.lower())


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _B
    return h ^ (h >> np.uint64(29))


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(symbols, place in word, word number, hashes by order) over the words written one after another."""
    codes = np.frombuffer(("".join(f"\x02{w}\x03" for w in words)).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(sizes) - sizes
    number = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(codes)) - starts[number]
    with np.errstate(over="ignore"):
        hashes, h = [], np.zeros(len(codes), np.uint64)
        for n in range(1, ORDER + 1):
            back = np.concatenate([np.zeros(n - 1, np.uint64), codes[: len(codes) - n + 1]])[: len(codes)]
            h = _mix(h * _A + back + np.uint64(n << 24))
            hashes.append(h)
    return codes, place, number, hashes


@dataclass
class Model:
    """grams[n] and contexts[n]: sorted hashes with their values, for orders 1 to ORDER."""

    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def fit(cls, counts: Counter) -> Model:
        words = sorted(counts)
        weight = np.fromiter((counts[w] for w in words), np.float64, len(words))
        _, place, number, hashes = _grams(words)
        each = weight[number]
        grams, contexts = [], []
        for n in range(1, ORDER + 1):
            at = np.flatnonzero((place >= n - 1) & (place > 0))
            types, first, inverse = np.unique(hashes[n - 1][at], return_index=True, return_inverse=True)
            count = np.bincount(inverse, each[at], len(types))
            if n < ORDER:
                # Continuation counts: how many different characters come before; grams at a word's start keep theirs.
                wider = at[place[at] >= n]
                longer, one = np.unique(hashes[n][wider], return_index=True)
                follow = np.bincount(np.searchsorted(types, hashes[n - 1][wider[one]]), minlength=len(types)).astype(np.float64)
                anchored = place[at[first]] == n - 1
                count = np.where(anchored, count, follow)
            at = at[first]
            context = hashes[n - 2][at - 1] if n > 1 else np.zeros(len(at), np.uint64)
            kinds, where = np.unique(context, return_inverse=True)
            once, twice = (count == 1).sum(), (count == 2).sum()
            discount = float(np.clip(once / max(once + 2 * twice, 1), 0.1, 0.95))
            total = np.bincount(where, count, len(kinds))
            grams.append((types, (np.maximum(count - discount, 0) / total[where]).astype(np.float64)))
            contexts.append((kinds, np.bincount(where, np.minimum(count, discount), len(kinds)) / total))
        return cls(grams, contexts)

    def log_probability(self, place: np.ndarray, hashes: list[np.ndarray], at: np.ndarray) -> np.ndarray:
        """Natural logarithm of each character's probability at the places `at`."""
        p = np.full(len(at), 1 / _ALPHABET)
        for n in range(1, ORDER + 1):
            ok = place[at] >= n - 1
            context = hashes[n - 2][at - 1] if n > 1 else np.zeros(len(at), np.uint64)
            keep = _find(self.contexts[n - 1], context, 1.0)
            mass = _find(self.grams[n - 1], hashes[n - 1][at], 0.0)
            p = np.where(ok, mass + keep * p, p)
        return np.log(p)


def _find(table: tuple[np.ndarray, np.ndarray], wanted: np.ndarray, missing: float) -> np.ndarray:
    keys, values = table
    if not len(keys):
        return np.full(len(wanted), missing)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], missing)


class Identifier:
    """Models of all languages with their calibration; remembers words' scores."""

    def __init__(self, models: dict[str, Model]):
        self.langs = sorted(models)
        self.models = [models[x] for x in self.langs]
        self.sharpness, self.usual = 1.0, np.tile([0.0, 1.0, 1.0], (len(self.langs), 1))
        self.ceilings = np.full(len(self.langs), np.inf)
        self._known: dict[str, int] = {}
        self._scores = np.zeros((0, len(self.langs) + 2))

    def __getstate__(self):
        return {**self.__dict__, "_known": {}, "_scores": np.zeros((0, len(self.langs) + 2))}

    def forget(self) -> None:
        self._known, self._scores = {}, np.zeros((0, len(self.langs) + 2))

    def word_scores(self, words: list[str]) -> np.ndarray:
        """A row a word: log-probability by language, characters predicted, letters."""
        _, place, number, hashes = _grams(words)
        at = np.flatnonzero(place > 0)
        longest = np.zeros(len(place), np.uint64)
        for n in range(1, ORDER + 1):
            longest = np.where(place >= n - 1, hashes[n - 1], longest)
        _, first, inverse = np.unique(longest[at], return_index=True, return_inverse=True)
        out = np.empty((len(words), len(self.langs) + 2))
        for k, model in enumerate(self.models):
            logs = model.log_probability(place, hashes, at[first])
            out[:, k] = np.bincount(number[at], logs[inverse], len(words))
        out[:, -2] = np.fromiter(map(len, words), np.float64, len(words)) + 1
        out[:, -1] = np.fromiter((sum(map(str.isalpha, w)) for w in words), np.float64, len(words))
        return out

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self._known]
        if not new:
            return
        if len(self._known) + len(new) > REMEMBERED:
            self._known, self._scores, new = {}, self._scores[:0], list(words)
        have = len(self._known)
        if have + len(new) > len(self._scores):
            grown = np.zeros((max(2 * len(self._scores), have + len(new)), self._scores.shape[1]))
            grown[:have] = self._scores[:have]
            self._scores = grown
        self._scores[have : have + len(new)] = self.word_scores(new)
        self._known.update(zip(new, range(have, have + len(new)), strict=True))

    def sums(self, texts: list[str | None]) -> np.ndarray:
        """A row a text: summed log-probabilities, characters, letters."""
        out = np.zeros((len(texts), len(self.langs) + 2))
        lists = [words_of(t) if t else [] for t in texts]
        self._learn(set().union(*lists) if lists else set())
        for k, words in enumerate(lists):
            if words:
                out[k] = self._scores[np.fromiter(map(self._known.__getitem__, words), np.int64, len(words))].sum(axis=0)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, cross-entropy in nats per character, rejected) of each text."""
        sums = self.sums(texts)
        if not self.langs:
            return [UND] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan), np.ones(len(texts), bool)
        n = np.maximum(sums[:, -2], 1)
        entropy = -sums[:, :-2] / n[:, None]
        best = entropy.argmin(axis=1)
        least = entropy[np.arange(len(texts)), best]
        odds = np.exp(-self.sharpness * (entropy - least[:, None]))
        score = odds[np.arange(len(texts)), best] / odds.sum(axis=1)
        none = sums[:, -1] == 0
        rejected = none | (self._excess(least, n, best) > self.ceilings[best])
        names = [UND if z else self.langs[b] for b, z in zip(best, none, strict=True)]
        return names, np.where(none, 0.0, score), np.where(none, np.nan, least), rejected

    def _excess(self, entropy: np.ndarray, n: np.ndarray, lang: np.ndarray | int) -> np.ndarray:
        """How far a text of n characters lies above its language's usual cross-entropy, in standard deviations."""
        mean, spread, per_char = self.usual[lang].T
        return (entropy - mean) / np.sqrt(spread**2 + per_char**2 / n)

    def calibrate(self, texts: dict[str, list[str]]) -> None:
        """Fit the softmax and the ceilings on texts that the models haven't seen."""
        rows, truth = [], []
        for k, lang in enumerate(self.langs):
            sums = self.sums(texts.get(lang, []))
            sums = sums[sums[:, -1] > 0]
            if not len(sums):
                continue
            entropy = -sums[:, :-2] / sums[:, -2:-1]
            rows.append(entropy)
            truth += [k] * len(sums)
            own, n = entropy[:, k], sums[:, -2]
            per_char = float(np.sqrt(np.average((own - np.average(own, weights=n)) ** 2 * n)))
            self.usual[k] = (np.average(own, weights=n), own.std() if len(own) > 4 else 1.0, max(per_char, 1.0))
            # Of m held-back texts and one more, the latter has the r-th least excess or less with probability r / (m + 1).
            place = math.ceil((len(own) + 1) * (1 - FALSE_REJECTION))
            if place <= len(own):
                self.ceilings[k] = np.sort(self._excess(own, n, k))[place - 1]
        if rows:
            entropy, truth = np.concatenate(rows), np.array(truth)
            losses = []
            for s in (grid := [2.0**k for k in range(0, 9)]):
                z = -s * (entropy - entropy.min(axis=1, keepdims=True))
                losses.append((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(truth)), truth]).mean())
            self.sharpness = grid[int(np.argmin(losses))]


def sample(train: DataFrame, per_lang: int = FIT + HELD) -> list[tuple[str, str]]:
    """(lang, text) of the bounded training sample, from rows with doc_id, text and lang."""
    usable = F.when(F.col("text").rlike(r"\p{L}"), F.col("text"))
    return sample_by_group(train.select("doc_id", F.col("lang").alias("grp")), train, usable, per_lang)


def fit(pairs: list[tuple[str, str]]) -> Identifier:
    """Models from the first texts of each language, calibration from the rest."""
    by_lang: dict[str, list[str]] = {}
    for lang, text in pairs:
        by_lang.setdefault(lang, []).append(text)
    models, held = {}, {}
    for lang, texts in by_lang.items():
        n = min(FIT, len(texts) - len(texts) // 5)
        counts = Counter(w for text in texts[:n] for w in words_of(text))
        if counts:
            models[lang], held[lang] = Model.fit(counts), texts[n:]
    made = Identifier(models)
    made.calibrate(held)
    made.forget()
    return made


def identify(docs: DataFrame, identifier: Identifier) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy, rejected of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(identifier)

    def run(batches):
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                names, score, entropy, rejected = model.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(entropy, from_pandas=True), pa.array(rejected)], ["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run, lambda: shared.value.forget()), f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double, cross_entropy double, rejected boolean")


def train(docs: DataFrame) -> Identifier:
    """An identifier from the texts and langs of documents whose crc32(doc_id) mod 4 isn't 2."""
    return fit(sample(docs.select("doc_id", "text", "lang").where(id_remainder(F.col("doc_id"), 4) != 2)))


def accepted(docs: DataFrame, identifier: Identifier) -> DataFrame:
    """`docs` without the rejected ones; columns as they were. One pass over whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(identifier)
    at = docs.columns.index("text")

    def run(batches):
        model = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                _, _, _, rejected = model.predict(part.column(at).to_pylist())
                yield part.filter(pa.array(~rejected))

    return docs.mapInArrow(tidy(run, lambda: shared.value.forget()), docs.schema)
