"""The training-data queries against brute force, and defined cases of hard tables."""

import random

import brute
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from verdara.llm import chat, exact_dedup, jaccard_join, language_id, license_scan, packing, piece_codec, quality_net, quality_rules, sharding
from verdara.llm.common import shared_path
from verdara.llm.queries import queries
from verdara.llm.sql import oracle_sql

SF = f"{DATA}/sf0.001"
WORD = f"{brute.TOKENIZERS}/word_bpe_49k.json"
ODD = "_metadata", "_n", "_id", "_sha", "row", "bucket", "norm", "at", "content"
PIECE = f"{brute.TOKENIZERS}/piece_bpe_32k.model"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, key long"
HARD = [
    (1, None, "en", "a", 0, "x", 1), (2, "", None, "a", 0, "x", 1), (3, " \n\t ", "en", None, 3, None, None), (4, "One two", "en", "a", 7, "x", 1),
    (5, "the cat sat on the mat " * 40, "en", "a", 1, "x", 1), (6, "The Cat sat on the mat " * 40, "en", "a", 1, "x", 1), (6, "The Cat sat on the mat " * 40, "en", "a", 1, "x", 1),
    (7, "é ß 中文 \U0001f600 ▁ x" + " " * 40 + "<|im_end|>", "fr", "a", 9, "x", 1), (8, "wort " * 30000, "de", "a", 1, "x", 1), (None, "null id row with some words", "en", "a", 1, "x", 1), (9, "Released under the MIT License.", "en", "a", 1, "x", 1),
]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(HARD, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (6, 0, 0), (8, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def docs(duck):
    return duck.sql("SELECT doc_id, text FROM documents").fetchall()


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, duck, name):
    got, want = queries()[name](spark, SF), duck.sql(oracle_sql()[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r[n] for n in names) for r in got.collect()), key=key) == sorted(want.select(*names).fetchall(), key=key)


def test_op2(spark, duck):
    got = rows(queries()["op2_jaccard_join"](spark, SF), "doc_id", "n_shingles", "component_id")
    assert got == brute.components(docs(duck), 3, 90, 100)


@pytest.mark.parametrize("like", [jaccard_join.Likeness(3, 90, 100), jaccard_join.Likeness(5, 80, 100), jaccard_join.Likeness(2, 50, 100)])
def test_join_of_edited_copies(spark, like):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = []
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    table = list(enumerate(texts))
    got = jaccard_join.components_of(spark.createDataFrame(table, "doc_id long, text string").repartition(3), like)
    assert rows(got, "doc_id", "n_shingles", "component_id") == brute.components(table, like.words, like.num, like.den)


@pytest.mark.parametrize("chunk", [1024, 5])
def test_join_gives_all_links(spark, monkeypatch, chunk):
    """Not only those that span components, also when a component is dealt over many blocks."""
    monkeypatch.setattr(jaccard_join, "CHUNK_NODES", chunk)
    like, rng = jaccard_join.Likeness(3, 80, 100), random.Random(4)
    texts = ["", None, "alone in the table"]
    for _ in range(4):
        base = [rng.choice("abcdefghij") + str(rng.randint(0, 30)) for _ in range(90)]
        for _ in range(30):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = f"z{rng.randint(0, 5)}"
            texts.append(" ".join(copy))
    table = list(enumerate(texts + texts[3:9] + [t.upper() for t in texts[3:6]]))
    sets = [brute.shingle_set(t, 3) for _, t in table]
    near = {(i, j) for j in range(len(sets)) for i in range(j) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    frame = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    got = jaccard_join.linked_documents(frame, like)
    assert rows(got, "doc_id", "n_links") == [(i, sum(i in p for p in near)) for i in range(len(table))]
    assert rows(got, "doc_id", "n_shingles", "component_id") == brute.components(table, 3, 80, 100)
    joined = jaccard_join.jaccard_join(frame, like)
    stands = {r["node"]: r["min_doc"] for r in joined.nodes.collect()}
    links = [tuple(sorted((stands[r["a"]], stands[r["b"]]))) for r in jaccard_join.links(frame, joined, like).collect()]
    assert len(links) == len(set(links)) and set(links) == {p for p in near if set(p) <= set(stands.values()) and sets[p[0]] != sets[p[1]]}
    assert joined.spanning.count() < len(links)


def test_join_of_templated_texts(spark):
    """One shingle of the prefix stands in all texts, and no two are linked: no pair is even tried."""
    like = jaccard_join.Likeness(3, 90, 100)
    table = [(i, f"this text has some more words of which only the last one differs x{i}") for i in range(3000)] + [(3000, "this text has some more words of which only the last one differs x5")]
    frame = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    got = jaccard_join.components_of(frame, like)
    assert rows(got, "doc_id", "n_shingles", "component_id") == [(i, 12, 5 if i == 3000 else i) for i in range(3001)]
    placed = spark.createDataFrame([(1, n, 10, 1, n) for n in range(500)] + [(1, 500, 9, 0, 500)], "token long, node long, n long, pos int, root long")
    assert jaccard_join._across(placed, like).count() == 500  # each with the smaller set, which it might hold


def test_op3(spark, duck):
    got = queries()["op3_sharding"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, _ in docs(duck))
    assert len({(r["shard"], r["position"]) for r in got}) == len(got)
    # Three arrivals of 16 shards at least; merging made a version of its own and few shards.
    assert {r["version"] for r in got} == {4} and len({r["shard"] for r in got}) <= 6


def test_sharding_of_hard_rows_and_races(spark, monkeypatch):
    frame = spark.createDataFrame([(1, None, "m"), (1, None, "m"), (None, "x" * 300_000, None), (2, "", "m")], "doc_id long, text string, _metadata string")
    store = sharding.ShardStore(spark, shared_path(spark, "t"), frame.schema)
    store.append(frame.where("false"))
    assert store.manifest() == (1, [])
    for _ in range(4):
        store.append(frame.coalesce(1))
    other = sharding.ShardStore(spark, store.root, frame.schema)
    real, first = store.commit, []

    def late(base, shards):
        if not first:
            first.append(other.append(frame.coalesce(1)))  # another writer is first
        return real(base, shards)

    monkeypatch.setattr(store, "commit", late)
    assert store.append(frame.coalesce(1)) == first[0] + 1 and store.read().count() == 24
    first.clear()
    assert store.compact() == first[0] + 1 and store.read().count() == 28  # merged beside the arrival
    first.clear()
    monkeypatch.setattr(store, "commit", real)
    orphan = f"{store.root}/data/a-lost"
    frame.write.parquet(orphan)
    assert store.vacuum() == 0 and store.vacuum(keep_versions=1, grace_s=0) >= 6
    assert store.read().count() == 28 and not store._fs.exists(store._path(f"{orphan}/part-0")) and len(store.versions()) == 1
    assert sorted(map(str, store.read().select("text").distinct().collect()))[0][:11] == "Row(text=''"
    assert sharding.place(store).count() == 28


def test_sharding_compacts_and_commits(spark):
    frame = spark.range(4000).selectExpr("id doc_id", "repeat(string(id), 20) text")
    store = sharding.ShardStore(spark, shared_path(spark, "t"), frame.schema, target_bytes=60_000, fanout=4)
    for k in range(3):
        store.append(frame.where(f"doc_id % 3 = {k}").repartition(6))
    before = len(store.manifest()[1])
    version = store.compact()
    assert version == 4 and len(store.manifest()[1]) < before == 18
    assert store.read(3).count() == store.read().count() == 4000
    with pytest.raises(sharding.CommitConflict):
        store.commit(version - 1, [])
    store.vacuum()
    assert sorted(r[0] for r in sharding.place(store).select("doc_id").collect()) == list(range(4000))
    empty = sharding.ShardStore(spark, shared_path(spark, "t"), frame.schema)
    assert empty.read().count() == 0 and sharding.place(empty).count() == 0 and empty.compact() == 0


@pytest.mark.parametrize("capacity, key", [(4, None), (4, lambda n: F.lit(7).cast("long")), (3, lambda n: F.pmod(F.xxhash64(n), F.lit(5))), (64, None)])
def test_dedup_through_the_index(spark, duck, capacity, key):
    """Small buckets, and keys that collide: the same result, through split buckets and chains."""
    own = {} if key is None else {"key": key}
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    names = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert rows(exact_dedup.exact_dedup(frame, capacity, **own), *names) == sorted(duck.sql(oracle_sql()["op8_exact_dedup"]).select(*names).fetchall())
    index = exact_dedup.Index(frame, capacity, **own)
    loads = [r["count"] for r in index.files.groupBy("bucket").count().collect()]
    longest = index.files.selectExpr("max(size(chain))").first()[0]
    if key is None:
        assert index.depth > 0 and max(loads) <= capacity and longest == 1 and 2 ** (index.depth - 1) < index.directory.count() <= 2**index.depth
        ids = index.directory.groupBy("bucket", "local_depth").count().collect()
        assert all(r["count"] == 2 ** (index.depth - r["local_depth"]) for r in ids)
    else:
        assert longest > 1 and max(loads) <= 5


def test_op5(spark, duck):
    got = queries()["op5_best_fit_packing"](spark, SF)
    assert rows(got, "doc_id", "piece", "start", "length", "ids_crc32") == brute.packed_pieces(docs(duck))
    bins = {}
    for r in got.collect():
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= 1.02 * sum(n for b in bins.values() for _, n in b) / 2048 + 1


def fewest(lengths, limit):
    """Least number of bins, tried by force."""
    best = len(lengths)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for room in sorted({r for r in rooms if r >= lengths[k]}):
            at = rooms.index(room)
            place(k + 1, rooms[:at] + [room - lengths[k]] + rooms[at + 1 :])
        place(k + 1, rooms + [limit - lengths[k]])

    place(0, [])
    return best


def bins_of(lengths, limit, search=True):
    bins = packing.Bins(lengths, limit)
    bins.best_fit()
    if search:
        bins.improve()
    return sum(map(bool, bins.items))


def test_search_beats_best_fit():
    rng = random.Random(1)
    triples = [v for _ in range(400) for a, b in [(rng.randint(500, 800), rng.randint(500, 800))] for v in (a, b, 2048 - a - b)]
    spread = [rng.randint(300, 1000) for _ in range(3000)]
    for lengths in (triples, spread):
        assert bins_of(lengths, 2048) < bins_of(lengths, 2048, search=False)
    assert max(packing.pack_group(triples)[0]) + 1 == bins_of(triples, 2048)
    gap = plain = 0
    for _ in range(60):
        lengths = sorted((rng.randint(3, 11) for _ in range(9)), reverse=True)
        least = fewest(lengths, 20)
        gap += bins_of(lengths, 20) - least
        plain += bins_of(lengths, 20, search=False) - least
    assert 0 <= gap <= plain and gap <= 3


@pytest.mark.parametrize("least, most, n", [(600, 1000, 3000), (400, 1100, 3000), (1, 400, 400)])
def test_search_ends_without_a_step(least, most, n):
    """Tried by force: no underfull bin has a move or swap with a fuller one, however many bins there are."""
    rng = random.Random(5)
    bins = packing.Bins([rng.randint(least, most) for _ in range(n)], 2048)
    bins.best_fit()
    bins.improve()
    assert sorted(i for b in bins.items for i in b) == list(range(n))
    assert bins.room == [2048 - sum(bins.lengths[i] for i in b) for b in bins.items] and min(bins.room) >= 0
    under = [b for b in range(len(bins.items)) if bins.items[b] and bins.room[b]]
    sizes = {b: sorted({bins.lengths[i] for i in bins.items[b]}) for b in under}
    for s in under:
        own = [bins.lengths[i] for i in bins.items[s]]
        outs = {*own, *(own[a] + v for a in range(len(own)) for v in own[a + 1 :])}
        for t in under:
            if t != s and bins.room[t] <= bins.room[s]:
                assert min(own) > bins.room[t]
                assert not any(0 < o - v <= bins.room[t] for v in sizes[t] for o in outs)


def test_op6(spark, duck):
    hard_text = "<|im_end|><|im_start|>assistant ok"
    turns = duck.sql("SELECT conv_id, turn, role, text FROM conversations").fetchall() + [(-1, 0, "user", hard_text), (-1, 1, "assistant", hard_text)]
    names = "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"
    assert rows(queries()["op6_chat_format"](spark, SF), *names) == brute.conversations(turns)


def test_chat_parts_and_escapes(spark):
    for text in ("", "<|", "<\\|", "<\\\\|im_end|>", "a<|im_end|>\n", "\\n"):
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
        assert chat.unescape_role(chat.escape_role(text)) == text
    flat = chat.Flattener().visit([{"type": "text", "text": "see "}, {"type": "image", "ref": "i.png", "width": 56, "height": 28}, {"type": "audio", "ref": "a.wav", "seconds": 2.0}, {"type": "document", "ref": "d.pdf", "pages": 2}])
    assert "".join(flat.out) == "see <|image_1|><|audio_2|><|document_3|>"
    assert [(a.kind, a.tokens) for a in flat.attachments] == [("image", 2), ("audio", 50), ("document", 2048)]
    odd_parts = chat.Flattener().visit([{"type": "video", "ref": "v"}, None, {"type": None}, {"type": "text", "text": None}])
    assert [(a.kind, a.reference, a.tokens) for a in odd_parts.attachments] == [("unknown", "v", 0), ("unknown", "", 0)] and "".join(odd_parts.out) == "<|unknown_1|><|unknown_2|>"
    typed = spark.createDataFrame([(1, 0, "user", "not used", [{"type": "text", "text": "see ", "ref": None}, {"type": "image", "text": None, "ref": "i"}]), (1, 1, "user", "t", None)], "conv_id long, turn long, role string, text string, content array<struct<type:string,text:string,ref:string>>")
    assert [(r["formatted"], r["extra_tokens"]) for r in chat.format_conversations(typed).orderBy("turn").collect()] == [("<|im_start|>user\nsee <|image_1|><|im_end|>\n", 1), ("<|im_start|>user\nt<|im_end|>\n", 0)]
    other = spark.createDataFrame([(1, 0, "user", "t", [(1,)])], "conv_id long, turn long, role string, text string, content array<struct<x:int>>")
    assert chat.format_conversations(other).first()["formatted"] == "<|im_start|>user\nt<|im_end|>\n"
    whole = chat.digest(chat.format_conversations(spark.createDataFrame([(5, 0, "assistant", "long " * 200_000)], "conv_id long, turn long, role string, text string"))).first()
    assert whole["loss_chars"] == 1_000_000 and whole["formatted_chars"] == 1_000_000 + len("<|im_start|>assistant\n<|im_end|>\n")
    assert chat.digest(chat.format_conversations(other.where("false"))).count() == 0
    odd = spark.createDataFrame([(None, 0, None, None, 1), (None, 0, None, None, 1), (1, None, "assistant", "x", 1)], "conv_id long, turn long, role string, text string, formatted long")
    assert {(r["conv_id"], r["n_turns"], r["loss_chars"]) for r in chat.digest(chat.format_conversations(odd)).collect()} == {(None, 2, 0), (1, 1, 1)}


def test_op7(spark, duck):
    got = queries()["op7_piece_codec"](spark, SF)
    assert rows(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == brute.piece_rows(docs(duck))


def test_piece_codec_on_odd_texts():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    rng = random.Random(2)
    letters = "abcdeiorstn ,.!?'\"-()0123▁\n\t€中é  \U0001f600"
    for _ in range(1500):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        ids = piece_codec.encode(text, PIECE)
        assert ids == [*sp.encode(text), sp.eos_id()]
        assert piece_codec.decode(ids, PIECE) == sp.decode(ids)


def test_word_tokens_on_odd_texts():
    tokens = packing.word_tokens(WORD)
    assert np.frombuffer(tokens.encode_all(["<|endoftext|> hello"])[0], "<u4").tolist() == [49407, 3306]
    rng = random.Random(2)
    letters = "abcDEF'stlrvemd0129²ß ÀÉ\n\t.,!#<|>«»×÷ªº½\xa0’"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += ["<|endoftext|> hello", "a<|startoftext|>b", "x <|ENDOFTEXT|> y", "<|endoftext|><|endoftext|>", "é<|endoftext|>"]
    want = [np.array(tokens.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert tokens.encode_all(texts) == want


def test_op1_and_op9_held_out(spark):
    sf = f"{DATA}/sf0.01"
    base = duckdb.connect()
    lang = dict(base.sql(f"SELECT doc_id, lang FROM '{sf}/documents.parquet'").fetchall())
    got = [r for r in queries()["op1_language_id"](spark, sf).collect()]
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(lang) and sum(lang[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.99 * len(held)
    quality = dict(base.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall())
    scored = [r for r in queries()["op9_quality_net"](spark, sf).collect()]
    held = [r for r in scored if r["held_out"] and r["doc_id"] in quality]
    assert len(scored) == len(lang) and sum(quality[r["doc_id"]] == r["predicted"] for r in held) >= 0.93 * len(held)


def test_training_takes_long_texts_and_rare_languages(spark):
    """Texts of any length are learned from, and no language's only text is held back."""
    train = [(i, ("the house and the garden of the old man " if i % 2 else "la maison et le jardin du vieil homme ") * 1000, "en" if i % 2 else "fr") for i in range(24)]
    train += [(100, "das haus und der garten des alten mannes", "de"), (101, None, "es"), (102, "12 34", "es")]
    frame = spark.createDataFrame(train, "doc_id long, text string, lang string")
    learned = language_id.fit(language_id.sample(frame))
    assert learned.langs == ["de", "en", "fr"]
    assert learned.predict(["the old garden", "le vieil jardin", "der alte garten"])[0] == ["en", "fr", "de"]
    assert [k for k, _ in language_id.sample(frame, 3)].count("en") == 3 and len(language_id.sample(frame, 3)) == 7
    marks = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    texts, ys = quality_net.sample(frame, marks, 5)
    assert sorted(set(ys)) == [0, 1] and len(texts) == 10 and {len(t) for t in texts} <= {len(t) for _, t, _ in train if t}


def test_samples_are_bounded(spark, monkeypatch):
    """Of a language almost without texts no more ids are collected than are chosen, and none of its texts is missed."""
    from verdara.llm import common

    many = spark.range(100_000).selectExpr("id doc_id", "if(id % 40000 = 7, 'le chat noir', null) text", "'fr' lang").unionByName(spark.range(100_000, 130_000).selectExpr("id doc_id", "'the black cat' text", "'en' lang"))
    sizes = []
    make = type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, rows, *a, **k: (sizes.append(len(rows)), make(self, rows, *a, **k))[1])
    got = common.sample_by_group(many.select("doc_id", F.col("lang").alias("grp")), many, F.col("text"), 100)
    assert [g for g, _ in got].count("fr") == 3 and [g for g, _ in got].count("en") == 100
    assert sum(sizes) < 2 * (1.25 * 100 + 50) + 3


def test_rejection_is_calibrated():
    """Of texts of a language as many as FALSE_REJECTION allows are rejected, or fewer; texts of no language are."""
    rng = random.Random(7)
    words = {"a": [f"{rng.choice('bdgk')}a{rng.choice('mnr')}e{rng.choice('stl')}" for _ in range(300)], "b": [f"{rng.choice('pfv')}o{rng.choice('xyz')}u{rng.choice('qwc')}" for _ in range(300)]}
    text = lambda k: " ".join(rng.choice(words[k]) for _ in range(rng.randint(20, 80)))
    found = language_id.fit([(k, text(k)) for k in "ab" for _ in range(1100)])
    fresh = found.predict([text(k) for k in "ab" for _ in range(2000)])
    assert fresh[3].mean() <= 2.5 * language_id.FALSE_REJECTION and fresh[0] == ["a"] * 2000 + ["b"] * 2000
    assert found.predict(["ijh ijh hij jih jhi hhj " * 20])[3].all() and not np.isinf(found.ceilings).any()
    few = language_id.fit([("a", text("a")) for _ in range(50)])
    assert np.isinf(few.ceilings).all() and not few.predict([text("b")])[3].any() and few.predict(["123"])[3].all()


def test_clashing_names(spark, labels):
    """Columns named as helpers are, in every operator and stage that hands whole rows on."""
    import corpus_pipeline

    base = [(1, "some words that are long enough to be a text", "en"), (2, "some words that are long enough to be a text", "en"), (2, "some words that are long enough to be a text", "en"), (3, None, None)]
    frame = spark.createDataFrame([(*r, *ODD) for r in base], "doc_id long, text string, lang string, " + ", ".join(f"`{c}` string" for c in ODD))
    for thin in (jaccard_join.thin, exact_dedup.deduplicate):
        kept = thin(frame)
        assert kept.columns == frame.columns and kept.count() == 2
    for name, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, frame, SF).columns == frame.columns, name
    judged = quality_rules.passing(frame, labels)
    assert judged.columns == frame.columns and judged.count() == 0
    assert chat.format_conversations(frame.selectExpr("doc_id conv_id", "doc_id turn", "lang role", *[f"`{c}`" for c in ("text", *ODD)])).count() == 4
    for made in (piece_codec.encode_documents(frame, PIECE), packing.pack(frame, WORD), license_scan.scan(frame), exact_dedup.exact_dedup(frame), jaccard_join.linked_documents(frame)):
        assert made.count() == 4


def test_hard_rows(spark, hard, labels):
    n = len(HARD)
    dedup = exact_dedup.exact_dedup(hard).collect()
    assert len(dedup) == n and {r["keep_id"] for r in dedup if r["doc_id"] in (1, 2)} == {2} and {r["group_size"] for r in dedup if r["doc_id"] in (5, 6)} == {3}
    assert exact_dedup.deduplicate(hard).columns == hard.columns and sorted(str(r["doc_id"]) for r in exact_dedup.deduplicate(hard).collect()) == sorted("2 3 4 6 7 8 9 None".split())
    judged = quality_rules.judge(hard, labels).collect()
    assert len(judged) == n and all(r["base_failed"] for r in judged if r["doc_id"] in (1, 2, 3, 4))
    assert quality_rules.passing(hard, labels).columns == hard.columns
    members = jaccard_join.components_of(hard).collect()
    assert len(members) == n and {r["component_id"] for r in members if r["doc_id"] in (5, 6)} == {5} and all(r["n_shingles"] == 0 for r in members if r["doc_id"] in (1, 2, 3))
    assert sorted(str(r["doc_id"]) for r in jaccard_join.thin(hard).collect()) == sorted("1 2 3 4 5 7 8 9 None".split())
    assert piece_codec.encode_documents(hard, PIECE).count() == n
    assert packing.pack(hard, WORD).agg({"length": "sum"}).first()[0] > 30000
    scan = {r["doc_id"]: r for r in license_scan.scan(hard).collect()}
    assert scan[9]["license_id"] == "MIT" and scan[9]["match_kind"] == "notice" and scan[1]["license_id"] is None
    who = language_id.train(hard)
    found = {r["doc_id"]: r for r in language_id.identify(hard, who).collect()}
    assert found[1]["lang_pred"] == found[3]["lang_pred"] == "und" and found[1]["score"] == 0
    assert language_id.accepted(hard, who).columns == hard.columns
    scores = quality_net.score(hard, quality_net.fit(*quality_net.sample(hard, labels))).collect()
    assert len(scores) == n and all(0 <= r["score"] <= 1 for r in scores)


def test_whole_licences_and_identifiers(spark):
    from pathlib import Path

    from verdara.llm import license_texts

    folder = Path(license_texts.__file__).parent / "licenses"
    assert len({i for i, kind, _ in license_texts.TEXTS if kind == "text"}) >= 30
    whole = ["Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "CC-BY-SA-4.0", "Unlicense", "BSL-1.0"]
    lines = ["BSD-3-Clause", "ISC", "LGPL-2.1-only", "MPL-2.0", "GPL-2.0-only", "GPL-3.0-or-later", "EPL-2.0", "AGPL-3.0-only"]
    table = [(k, (folder / f"{i}.txt").read_text()) for k, i in enumerate(whole)] + [(100 + k, f"code\n# SPDX-License-Identifier: {i}\nmore") for k, i in enumerate(lines)]
    table += [(200, license_texts._APACHE_NOTICE)]
    # Variants of whole texts: case, punctuation, copyright lines, line breaks, spellings.
    texts = {i: t for i, kind, t in reversed(license_texts.TEXTS) if kind == "text"}
    variants = {
        "MIT": "Copyright (c) 2020 A. Person\n\n" + texts["MIT"].upper(),
        "Zlib": texts["Zlib"].replace("\n", "\n\n    ").replace("license", "licence").replace(";", " -"),
        "BSD-3-Clause": "Copyright 1999, Somebody. All rights reserved.\n" + texts["BSD-3-Clause"].replace("1. ", "  (1) ").replace('"AS IS"', "``AS IS''").replace("copyright holder nor", "copyright owner nor"),
        "X11": texts["X11"].replace("authorization", "authorisation"),
    }
    table += [(300 + k, v) for k, v in enumerate(variants.values())] + [(400, texts["MIT"] + " and one word more")]
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert [(got[k]["license_id"], got[k]["match_kind"]) for k in range(len(whole))] == [(i, "text") for i in whole]
    assert [got[100 + k]["notices"] for k in range(len(lines))] == lines
    assert (got[200]["license_id"], got[200]["match_kind"]) == ("Apache-2.0", "notice")
    assert [(got[300 + k]["license_id"], got[300 + k]["match_kind"]) for k in range(len(variants))] == [(i, "text") for i in variants]
    assert got[400]["license_id"] is None


def test_empty_tables(spark, hard, labels):
    none = hard.where("false")
    assert exact_dedup.exact_dedup(none).count() == 0 and exact_dedup.deduplicate(none).count() == 0
    assert quality_rules.judge(none, labels.where("false")).count() == 0 and quality_rules.judge(hard, labels.where("false")).count() == len(HARD)
    assert jaccard_join.components_of(none).count() == 0 and jaccard_join.thin(none).count() == 0
    assert packing.pack(none, WORD).count() == 0 and piece_codec.encode_documents(none, PIECE).count() == 0 and license_scan.scan(none).count() == 0
    who = language_id.train(none)
    assert language_id.identify(none, who).count() == 0 and {r["lang_pred"] for r in language_id.identify(hard, who).collect()} == {"und"}
    assert quality_net.score(none, quality_net.fit([], [])).count() == 0


def test_certified_cutoffs_hold(spark):
    """Of a stratum's good documents that chose nothing, all its rules together reject no more than is allowed."""
    sf = f"{DATA}/sf0.1"
    text, marks = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    known = marks.where("doc_id % 5 < 3")  # the rest judges
    judged = quality_rules.judge(text, known, max_false=0.04).join(marks.join(known, "doc_id", "left_anti"), "doc_id").join(text.select("doc_id", "lang"), "doc_id").where("not base_failed")
    by = judged.groupBy("lang").agg(*[F.count_if(F.expr(e)).alias(n) for n, e in (("good", "quality = 1"), ("lost", "quality = 1 and not kept"), ("caught", "quality = 0 and not kept"))]).collect()
    assert sum(r["caught"] for r in by) > 0
    assert all(r["lost"] <= 0.04 * r["good"] + 2 for r in by)


def test_certifies_unions_by_exact_binomial(spark):
    """A stratum of known counts: the union of rules is certified up to the last that the holdout allows."""
    from math import comb

    names = ["doc_id long", "lang string", "n_words long", "word_chars long", "n_symbols long", "n_dup_lines long", "n_repeat_words long"]
    good = [(i, "en", 100, 500, 200 if i % 40 == 0 else 0, 0, 0) for i in range(4000)]
    bad = [(i, "en", 100, 500, 400, 0, 0) if i % 2 else (i, "en", 100, 1200, 0, 0, 0) for i in range(4000, 5000)]
    few = [(i, "fr", 100, 500, 400, 0, 0) for i in range(5000, 5100)]
    measures = spark.createDataFrame(good + bad + few, ", ".join(names))
    marks = spark.createDataFrame([(i, int(i < 4000)) for i in range(5100)], "doc_id long, quality int")
    got = sorted(map(tuple, quality_rules.certify(measures, marks).collect()))
    # Symbols reject 1 in 40 good documents from 2000 a thousand words on, and half of the bad ones from 4000 on.
    assert got == [("en", "long_words", 12000), ("en", "symbols", 3000)]
    assert quality_rules.certify(measures, marks, max_false=0.0001).count() == 0
    cdf = spark.range(1).select(quality_rules._binomial_cdf(F.lit(3).cast("long"), F.lit(500).cast("long"), 0.01)).first()[0]
    assert cdf == pytest.approx(sum(comb(500, k) * 0.01**k * 0.99 ** (500 - k) for k in range(4)))


def test_pipeline(spark):
    import corpus_pipeline

    sf = SF
    kept = spark.read.parquet(f"{sf}/documents.parquet")
    columns = kept.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept.count()
        kept = spark.createDataFrame(stage(spark, kept, sf).collect(), kept.schema)
        assert kept.columns == columns and 0 < kept.count() <= before, name
    ids = {r["doc_id"] for r in kept.collect()}
    packed = corpus_pipeline.run(spark, sf)
    assert {r["doc_id"] for r in packed.collect()} == ids
    rest = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert all(i == c for i, _, c in brute.components(rest, 5, 80, 100))
