"""Models against plain restatements, shards read back, each pipeline stage against brute force, and empty tables."""

import random
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import DATA
from verdara.llm import jaccard_join, language_id, quality_net, sharding
from verdara.llm.common import shared_path

SF = f"{DATA}/sf0.001"


class PlainKneserNey:
    """Interpolated Kneser-Ney over the characters of words, with dictionaries of tuples."""

    def __init__(self, counts, order):
        self.order, self.mass, self.keep = order, {}, {}
        padded = {("\x02", *w, "\x03"): n for w, n in counts.items()}
        raw = [None] + [Counter() for _ in range(order + 1)]
        for w, n in padded.items():
            for k in range(1, order + 2):
                for end in range(max(1, k - 1), len(w)):
                    raw[k if k <= order else order + 1][w[end - k + 1 : end + 1]] += n
        for k in range(1, order + 1):
            count = dict(raw[k])
            if k < order:
                before = defaultdict(set)
                for gram in raw[k + 1]:
                    before[gram[1:]].add(gram[0])
                count = {g: n if g[0] == "\x02" else len(before[g]) for g, n in count.items()}
            once, twice = sum(n == 1 for n in count.values()), sum(n == 2 for n in count.values())
            discount = min(max(once / max(once + 2 * twice, 1), 0.1), 0.95)
            total, lost = Counter(), Counter()
            for g, n in count.items():
                total[g[:-1]] += n
                lost[g[:-1]] += min(n, discount)
            self.mass |= {g: max(n - discount, 0) / total[g[:-1]] for g, n in count.items()}
            self.keep |= {c: lost[c] / total[c] for c in total}

    def log_probability(self, word):
        w, out = ("\x02", *word, "\x03"), 0.0
        for end in range(1, len(w)):
            p = 1 / language_id._ALPHABET
            for k in range(1, min(self.order, end + 1) + 1):
                gram = w[end - k + 1 : end + 1]
                p = self.mass.get(gram, 0.0) + self.keep.get(gram[:-1], 1.0) * p
            out += np.log(p)
        return out


def test_kneser_ney_against_dictionaries():
    rng = random.Random(1)
    words = {k: Counter("".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(3000)) for k, letters in (("x", "abcde"), ("y", "cdefé"), ("z", "a中b"))}
    made = language_id.Identifier({k: language_id.Model.fit(c) for k, c in words.items()})
    asked = ["".join(rng.choice("abcdefé中q") for _ in range(rng.randint(1, 12))) for _ in range(300)] + list(words["x"])[:50] + ["a"]
    got = made.word_scores(asked)
    for k, name in enumerate(made.langs):
        plain = PlainKneserNey(words[name], language_id.ORDER)
        assert got[:, k] == pytest.approx([plain.log_probability(w) for w in asked], rel=1e-9)
    texts = [" ".join(rng.choices(asked, k=rng.randint(1, 30))) + ", 12!" for _ in range(50)] + ["", None, "12 34", "A a"]
    plain = [PlainKneserNey(words[n], language_id.ORDER) for n in made.langs]
    best, _, entropy, _ = made.predict(texts)
    for text, name, value in zip(texts, best, entropy, strict=True):
        own = language_id.words_of(text or "")
        if not own:
            assert name == language_id.UND and np.isnan(value)
            continue
        each = [-sum(map(p.log_probability, own)) / sum(len(w) + 1 for w in own) for p in plain]
        assert value == pytest.approx(min(each), rel=1e-9) and name == made.langs[int(np.argmin(each))]
    same = language_id.Identifier({k: language_id.Model.fit(words["x"]) for k in ("b", "a", "c")})
    assert same.predict(["abc bcd"])[0] == ["a"]  # ties go to the first by name


def plain_score(net, text):
    """A document's probability by convolving each place of each chunk on its own."""
    raw = text.encode()
    step, rows = quality_net.CHUNK - quality_net.OVERLAP, []
    for start in range(0, max(1, len(raw) - quality_net.OVERLAP), step):
        part = list(raw[start : start + quality_net.CHUNK]) + [256] * max(0, start + quality_net.CHUNK - len(raw))
        top = np.full(quality_net.FILTERS, -np.inf)
        for at in range(0, quality_net.CHUNK - quality_net.WIDTH + 1, quality_net.STRIDE):
            window = np.concatenate([quality_net.VECTORS[b] for b in part[at : at + quality_net.WIDTH]])
            top = np.maximum(top, window @ net.filters)
        rows.append(np.maximum(top + net.bias, 0))
    h = np.array(rows)
    doc = (np.concatenate([h.mean(axis=0), h.max(axis=0), h.min(axis=0)]) - net.mean) / net.scale
    return 1 / (1 + np.exp(-(doc @ net.out + net.shift)))


def test_convolution_against_loops():
    rng = random.Random(2)
    good = ["the quiet river runs past the old mill " * rng.randint(1, 9) for _ in range(24)]
    bad = ["$$$ BUY!!! ### 9999 %% " * rng.randint(1, 9) for _ in range(24)]
    net = quality_net.fit(good + bad, [1] * 24 + [0] * 24)
    texts = [good[0], bad[0], "x", "é中" * 700, good[1] * 20 + bad[1] * 5, good[0], "a" * quality_net.CHUNK, "a" * (quality_net.CHUNK + 1)]
    got = net.scores([*texts, "", None])
    assert got[:-2] == pytest.approx([plain_score(net, t) for t in texts], abs=1e-5)
    assert got[-1] == got[-2] == 0.5 and got[0] == got[5] and got[0] > 0.5 > got[1]
    for text in texts:  # chunks cover every byte
        part = quality_net.chunks(text)
        step = quality_net.CHUNK - quality_net.OVERLAP
        back = {k * step + i: int(v) for k, row in enumerate(part) for i, v in enumerate(row) if v < 256}
        assert bytes(back[i] for i in range(len(back))) == text.encode()


def test_every_row_comes_back_from_shards(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    store = sharding.ShardStore(spark, shared_path(spark, "t"), docs.schema, target_bytes=200_000, fanout=3)
    for k in range(3):
        store.append(docs.where(F.col("doc_id") % 3 == k), 16)
    rows = sorted(map(tuple, docs.collect()), key=str)
    assert sorted(map(tuple, store.read().collect()), key=str) == rows
    before = len(store.manifest()[1])
    store.compact()
    assert len(store.manifest()[1]) < before and sorted(map(tuple, store.read().collect()), key=str) == rows
    store.vacuum(keep_versions=1, grace_s=0)
    assert sorted(map(tuple, store.read().collect()), key=str) == rows


def passes_base(text):
    words = brute.WORD.findall(text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    inside = {i + j for i, g in enumerate(grams) if often[g] > 1 for j in range(3)}
    return len(words) >= 50 and 100 * len(inside) <= 50 * len(words)


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    table = {r["doc_id"]: r["text"] for r in docs.collect()}

    def after(name, kept):
        return {r["doc_id"] for r in stages[name](spark, docs.where(F.col("doc_id").isin(sorted(kept))), SF).collect()}

    # So few labels certify no cutoff: the base rules alone decide.
    kept = {i for i, t in table.items() if passes_base(t)}
    assert after("quality_rules", table) == kept
    who = language_id.train(docs.where(F.col("doc_id").isin(sorted(kept))))
    order = sorted(kept)
    rejected = who.predict([table[i] for i in order])[3]
    spoken = {i for i, no in zip(order, rejected, strict=True) if not no}
    assert after("language_id", kept) == spoken
    last = {brute.lower(table[i] or ""): i for i in sorted(spoken)}
    assert after("exact_dedup", spoken) == set(last.values())
    groups = brute.components([(i, table[i]) for i in sorted(last.values())], 5, 80, 100)
    lone = {i for i, n, c in groups if i == c or n == 0}
    assert after("ngram_jaccard_join", set(last.values())) == lone
    packed = stages["best_fit_packing"](spark, docs.where(F.col("doc_id").isin(sorted(lone))), SF).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == brute.packed_pieces([(i, table[i]) for i in sorted(lone)])


def test_empty_and_hard_tables_through_links_and_pipeline(spark, tmp_path):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    none = docs.where("false")
    assert jaccard_join.linked_documents(none).count() == 0
    joined = jaccard_join.jaccard_join(none)
    assert jaccard_join.links(none, joined).count() == 0 and jaccard_join.link_counts(none, joined).count() == 0
    texts = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (4, "one two"), (5, "ONE TWO"), (None, "one two"), (6, "wort " * 20_000), (7, "wort " * 20_001), (8, "a b c d e f")]
    got = jaccard_join.linked_documents(spark.createDataFrame([(*t, "x") for t in texts], "doc_id long, text string, sig string"), jaccard_join.Likeness(3, 90, 100)).collect()
    found = sorted(((r["doc_id"] or 0), r["n_shingles"], r["n_links"], r["component_id"]) for r in got)
    assert found == [(0, 1, 3, 4), (1, 0, 0, 1), (2, 0, 0, 2), (3, 0, 0, 3), (4, 1, 3, 4), (4, 1, 3, 4), (5, 1, 3, 4), (6, 1, 1, 6), (7, 1, 1, 6), (8, 4, 0, 8)]
    for name, documents, marks in (("empty", none, labels.where("false")), ("unlabelled", docs.limit(40), labels.where("false"))):
        documents.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        marks.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        assert (corpus_pipeline.run(spark, f"{tmp_path}/{name}").count() == 0) == (name == "empty")
