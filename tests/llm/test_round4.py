"""Collocations: passes over the texts, phrases of one hash, keys of words."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from test_round3 import COL, plain_collocations, rows
from verdara.llm import collocations


def test_texts_are_passed_three_times_however_many_candidates_there_are(spark):
    rng = random.Random(6)
    table = [(rng.choice(("en", "fr")), " ".join(f"w{rng.randint(0, 12)}" for _ in range(80))) for _ in range(60)]
    read = spark.sparkContext.accumulator(0)

    def counting(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    frame = spark.createDataFrame(table, "lang string, text string").mapInArrow(counting, "lang string, text string")
    want = plain_collocations(table)
    assert len(want) > 200
    for shard, wave in ((7, 20), (2_000_000, 2_000_000)):
        before = read.value
        assert sorted(rows(collocations.collocations(frame, shard=shard, wave=wave), *COL)) == want
        assert read.value - before == 3 * len(table)


def test_only_first_rows_of_a_task_go_to_the_window(spark, monkeypatch):
    plans = []
    write = collocations.materialize
    monkeypatch.setattr(collocations, "materialize", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    table = [("en", " ".join(random.Random(k).choices("abcdefgh", k=50))) for k in range(80)]
    frame = spark.createDataFrame(table, "lang string, text string")
    for rule in (collocations.Rule(), collocations.Rule(top=3)):
        assert sorted(rows(collocations.collocations(frame, rule), *COL)) == plain_collocations(table, top=rule.top)
        partial, dealt = plans[-1].rfind("WindowGroupLimit"), plans[-1].rfind("Exchange hashpartitioning(lang", 0, plans[-1].rfind("WindowGroupLimit"))
        assert f"row_number(), {rule.top}, Partial" in plans[-1] and -1 < dealt < partial


def test_phrases_of_one_hash_are_counted_apart():
    rng = np.random.default_rng(7)
    words = rng.integers(1, 2**64, 40, np.uint64)
    for size in (2, 3):
        met = words[rng.zipf(1.4, (size, 5000)) % 40]
        c = rng.integers(1, 4, 5000)
        want: dict = {}
        for k, n in zip(map(tuple, met.T.tolist()), c.tolist(), strict=True):
            want[k] = want.get(k, 0) + n
        want = {k: n for k, n in want.items() if n >= 10}
        for h in (collocations.phrase_hash(list(met)), met[0] % np.uint64(5), np.ones(5000, np.uint64)):
            phrases, f = collocations.counted(h, met, c, 10)
            assert dict(zip(map(tuple, phrases.T.tolist()), f.tolist(), strict=True)) == want and phrases.shape[1] == len(want) > 50
    none, f = collocations.counted(np.arange(3, dtype=np.uint64), np.ones((2, 3), np.uint64), np.ones(3, np.int64), 10)
    assert none.shape == (2, 0) and len(f) == 0


def test_words_of_one_key_take_another_salt(spark, monkeypatch):
    words = [("en", "the"), ("en", "中文"), ("fr", "the"), ("", "x" * 70), ("und", "\x85")]
    table = spark.createDataFrame([(*w, 2) for w in words], "lang string, word string, f long")
    for salt in ("0", "1"):
        keys = {(r["lang"], r["word"]): r["key"] for r in table.withColumn("key", collocations.key(salt)).collect()}
        for lang, word in words:
            assert collocations.keys_of(lang, pa.array(["-", word.encode()], pa.binary()).slice(1), salt).view(np.int64).tolist() == [keys[lang, word]]
    usual = collocations.key
    for bad in (F.xxhash64("word"), F.when(F.col("word") == "the", F.lit(0)).otherwise(F.xxhash64("lang", "word"))):
        monkeypatch.setattr(collocations, "key", lambda salt, bad=bad: bad if salt == "0" else usual(salt))
        assert collocations.salt_of(table, iter("012")) == ("1", 10)
    assert collocations.salt_of(table.where("false"), iter("1")) == ("1", 0)
