"""Conversation repair, SimHash near-dedup and collocations against brute force, and their defined cases."""

import random
import re
from collections import Counter
from itertools import product

import brute
import duckdb
import numpy as np
import pytest

from conftest import DATA
from verdara.llm import collocations, conversation_repair, simhash
from verdara.llm.queries import queries
from verdara.llm.sql import oracle_sql

SF = f"{DATA}/sf0.001"
ODD = "fp", "key", "symbol", "_conv", "h", "number", "vector"


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=lambda r: tuple(map(str, r)))


# --- conversation repair


def cheapest(turns):
    """(cost, audit) of the cheapest edits, tried state by state; turns: (initial, must go, breaks off)."""
    best = {"": (0, "")}  # by the initials' state: nothing, s, u, a

    def insert(at):
        for _ in range(2):
            for state, (cost, audit) in list(at.items()):
                to = "a" if state == "u" else "u"
                at[to] = min(at.get(to, (10**9, "")), (cost + 5, audit + "I"))
        return at

    best = insert(best)
    for initial, must, broken in turns:
        after = {}

        def put(state, cost, audit, after=after):
            after[state] = min(after.get(state, (10**9, "")), (cost, audit))

        for state, (cost, audit) in best.items():
            put(state, cost + 2, audit + "D")
            if not must:
                due = "a" if state == "u" else "u"
                put(due, cost + 1 + 5 * broken, audit + "R")
                if initial == due or (initial == "s" and state == ""):
                    put(initial, cost + 5 * broken, audit + "K")
        best = insert(after)
    return min(best[s] for s in ("", "a") if s in best)


def edited(turns):
    """The operator's streams, without Spark."""
    t = conversation_repair.tables()
    vector, ends = 0, []
    for n, symbol in enumerate(reversed(turns)):
        ends.append((vector, n // conversation_repair.BLOCK))
        if (n + 1) % conversation_repair.BLOCK == 0:
            code = 0
            for s in turns[len(turns) - 1 - n : len(turns) - n + conversation_repair.BLOCK - 1][::-1]:
                code = code * conversation_repair.SYMBOLS + s
            vector = int(t.block[vector, code])
    ends.reverse()
    audit, state = "", 0
    for block in sorted({b for _, b in ends}, reverse=True):
        own = [k for k, (_, b) in enumerate(ends) if b == block]
        letters, state = t.expand(ends[own[0]][0], tuple(turns[k] for k in own), state)
        audit += "".join(letters)
    return audit + conversation_repair.closing(state)


def test_blocks_give_the_least_audit():
    assert len(conversation_repair.tables().vectors) < 100
    kinds = [("s", True, False), *product("sua?", (False,), (False, True))]  # as symbols are numbered
    rng = random.Random(1)
    for n in range(4):
        for turns in product(range(9), repeat=n):
            assert edited(turns) == cheapest([kinds[k] for k in turns])[1]
    for _ in range(3000):
        turns = tuple(rng.choice((rng.randrange(9), 3, 5)) for _ in range(rng.randint(4, 40)))
        assert edited(turns) == cheapest([kinds[k] for k in turns])[1]


def repaired(turns):
    """What the query returns but for conv_id, of one conversation's (turn, role, text) rows."""
    import hashlib

    turns = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in turns), key=lambda y: (y[0] is not None, y[0] or 0, y[1], y[2]))
    seen, kinds, count = set(), [], Counter()
    for _, role, text in turns:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        count[fault] += 1
        kinds.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    cost, audit = cheapest(kinds)
    out, left, state = [], iter(turns), ""
    for letter in audit:
        _, role, text = (None, None, "") if letter == "I" else next(left)
        if letter != "D":
            due = "assistant" if state == "u" else "user"
            out.append((role if letter == "K" else due, text))
            state = out[-1][0][0]
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out))
    numbers = {t for t, _, _ in turns if t is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
    whole = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest()
    return (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, whole)


NAMES = "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"


def test_repair_of_hard_conversations(spark):
    rng = random.Random(2)
    table = []
    for conv in [None, *range(120)]:
        for k in range(rng.choice((0, 1, 2, 5, 9, 30))):
            role = rng.choice(("user", "assistant", "user", "assistant", "system", "tool", "", None, "unknown"))
            table.append((conv, rng.choice((None, k, k, k, k + 3)), role, rng.choice((None, "", " \n", f"t{k}.", f"t{k}", "same!", "é中?\n")), "x"))
    table.append((500, 1, "user", "long words. " * 200_000, "x"))
    frame = spark.createDataFrame(table, "conv_id long, turn long, role string, text string, symbol string").repartition(5)
    got = rows(conversation_repair.reports(frame, frame), *NAMES)
    by = {}
    for conv, *turn in table:
        by.setdefault(conv, []).append(turn[:3])
    assert got == sorted(((conv, *repaired(turns)) for conv, turns in by.items()), key=lambda r: tuple(map(str, r)))
    none = frame.where("false")
    assert conversation_repair.reports(none, none).count() == 0 and conversation_repair.repair(none).count() == 0
    lost = rows(conversation_repair.reports(frame.where("conv_id = 500"), none), *NAMES)
    assert lost == [(500, 0, 0, 0, 0, 0, 0, "", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855")]


def test_op11_damage(spark):
    duck = duckdb.connect()
    turns = duck.sql(f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet'").fetchall()
    import zlib

    by = {}
    for conv, turn, role, text in turns:
        how, own = zlib.crc32(f"{conv}:{turn}".encode()) % 20, by.setdefault(conv, [])
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        own += [(turn, "user" if how == 4 else role, text)] * (how != 0) * (2 if how == 3 else 1)
    got = rows(queries()["op11_conversation_repair"](spark, SF), *NAMES)
    assert got == sorted(((conv, *repaired(t)) for conv, t in by.items()), key=lambda r: tuple(map(str, r)))


# --- SimHash


def plain_fingerprint(text):
    from xxhash import xxh64_intdigest

    words = brute.WORD.findall(brute.lower(text or ""))
    k = min(3, len(words))
    h = [xxh64_intdigest(" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_components(table, fp):
    """(doc_id, fingerprint, component_id), by comparing every two fingerprints."""
    distinct = sorted(set(fp))
    root = {f: f for f in distinct}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, f in enumerate(distinct):
        for g in distinct[:i]:
            if (f ^ g).bit_count() <= 2:
                root[find(f)] = find(g)
    least = {}
    for (doc, _), f in zip(table, fp, strict=True):
        if doc is not None:
            least[find(f)] = min(doc, least.get(find(f), doc))
    return sorted(((doc, f"{f:016x}", least.get(find(f))) for (doc, _), f in zip(table, fp, strict=True)), key=lambda r: tuple(map(str, r)))


SIM = "doc_id", "fingerprint", "component_id"


def test_op12(spark):
    table = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    assert rows(queries()["op12_simhash"](spark, SF), *SIM) == near_components(table, [plain_fingerprint(t) for _, t in table])


def test_op12_on_hard_rows(spark):
    table = [(1, None), (2, ""), (3, " \n\t"), (None, "a null id"), (None, "A NULL ID"), (5, "One two"), (5, "one two"), (6, "wort " * 30_000), (7, "É é 中文 \x1c x")]
    frame = spark.createDataFrame([(*r, *ODD) for r in table], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in ODD))
    assert rows(simhash.near_duplicates(frame), *SIM) == near_components(table, [plain_fingerprint(t) for _, t in table])
    assert simhash.near_duplicates(frame.where("false")).count() == 0


@pytest.mark.parametrize("longest", [4096, 6])
def test_index_finds_every_link(spark, longest):
    """Balls of fingerprints around common ones: lists get long, and are entered again by six bytes."""
    rng = random.Random(3)
    found = {0, (1 << 64) - 1}
    for _ in range(12):
        centre = rng.getrandbits(64)
        found |= {centre ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 4))}) for _ in range(40)}
        found |= {centre ^ rng.getrandbits(32) for _ in range(30)}  # share four bytes
    found = sorted(found)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in found]
    got = simhash.links(spark.createDataFrame(signed, "fp long").repartition(4), longest)
    want = {tuple(sorted((signed[i][0], signed[j][0]))) for i in range(len(found)) for j in range(i) if (found[i] ^ found[j]).bit_count() <= 2}
    pairs = [tuple(r) for r in got.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want and len(want) > 100


# --- collocations


def plain_collocations(table, least=10, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) of (lang, text) rows."""
    f, n = Counter(), Counter()
    for lang, text in table:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", brute.lower(text or "")):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    out = {}
    known = {p: a for p, a in f.items() if a >= least}
    for p, a in known.items():
        lang, *w = p
        if len(w) > 1 and not any(q[0] == lang and len(q) > len(p) and 100 * b >= 50 * a and any(q[1 + i : 1 + i + len(w)] == tuple(w) for i in range(len(q) - len(w))) for q, b in known.items()):
            score, _, left, right = min((1_000_000 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k, f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w)))
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, k, p.decode(), -a, left, right, n[lang], -s) for lang, own in out.items() for k, (s, a, p, left, right) in enumerate(sorted(own)[:top], 1))


COL = "lang", "rank", "phrase", "a", "l", "r", "n", "score"


@pytest.mark.parametrize("shard, wave", [(2_000_000, 2_000_000), (7, 20), (5, 1000)])
def test_collocations(spark, shard, wave):
    rng = random.Random(4)
    words = ["the", "The", "of", "é", "中文", "new", "york", "x\x1cy", "\x85", "a\xa0b"]
    table = [(rng.choice(("en", "fr", None, "und", "")), "".join(rng.choice(words) + rng.choice((" ", " ", " \t", ". ", "\n", "\x0b", ";", "  ")) for _ in range(rng.randint(0, 60)))) for _ in range(120)]
    table += [("en", None), (None, ""), ("de", " .,; \n"), ("zz", "only nine times " * 9), ("long", "ein langer text " * 20_000)]
    frame = spark.createDataFrame([(k, *r, "x") for k, r in enumerate(table)], "doc_id long, lang string, text string, h string").repartition(4)
    got = rows(collocations.collocations(frame, shard=shard, wave=wave), *COL)
    assert sorted(got) == plain_collocations(table)
    few = rows(collocations.collocations(frame, collocations.Rule(least=30, top=5), shard=shard, wave=wave), *COL)
    assert sorted(few) == plain_collocations(table, 30, 5)
    assert collocations.collocations(frame.where("false")).count() == 0


def test_trie_holds_what_was_put_in():
    rng = np.random.default_rng(5)
    words = rng.zipf(1.3, (4000, 3)) % 500 + 1
    lengths = rng.integers(1, 4, 4000)
    put = np.unique(np.concatenate((rng.integers(1, 4, 4000)[:, None], np.where(np.arange(3) < lengths[:, None], words, 0)), axis=1), axis=0)
    trie = collocations.Trie(put)
    known = {tuple(r): k for k, r in enumerate(put.tolist())}
    asked = np.concatenate((put, rng.integers(0, 501, (20_000, 4))))
    asked[len(put) :, 0] = rng.integers(1, 4, 20_000)
    for row in asked.tolist():
        state = np.zeros(1, np.int64)
        for code in [c for k, c in enumerate(row) if all(row[: k + 1])]:
            state, _ = collocations.advance(trie.base, trie.check, state, np.array([code])) if len(state) else (state, None)
        size = next((k for k, c in enumerate(row) if c == 0), 4)
        got = int(trie.accept[state[0]]) if len(state) else -1
        assert got == known.get(tuple(row[:size]) + (0,) * (4 - size), -1)


def test_exact_scores_beyond_64_bits(spark):
    big = 3_000_000_000_000
    counts = spark.createDataFrame([("en", "a", None, None, big + 1), ("en", "b", None, None, big + 7), ("en", "a", "b", None, big)], "lang string, w1 string, w2 string, w3 string, f long")
    total = spark.createDataFrame([("en", 9 * big)], "lang string, n long")
    assert [tuple(r) for r in collocations.ranked(counts, total, collocations.Rule()).collect()] == [("en", 1, "a b", big, big + 1, big + 7, 9 * big, 1_000_000 * big * big // ((big + 1) * (big + 7)))]


def test_sql_of_round3(spark):
    duck = duckdb.connect()
    for t in ("documents", "conversations"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name in ("op11_conversation_repair", "op13_collocations"):
        got, want = queries()[name](spark, SF), duck.sql(oracle_sql()[name])
        names = sorted(got.columns)
        assert names == sorted(want.columns) and rows(got, *names) == sorted(want.select(*names).fetchall(), key=lambda r: tuple(map(str, r)))
