"""Plain restatements of what the llm queries return, for small tables."""

import hashlib
import re
import struct
import zlib
from itertools import combinations

import public_tokenizers

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKENIZERS = public_tokenizers.path("word_bpe_49k.json").rsplit("/", 1)[0]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingle_set(text, k):
    words = WORD.findall(lower(text or ""))
    if not words:
        return frozenset()
    if len(words) < k:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def components(rows, k, num, den):
    """(doc_id, n_shingles, component_id) of each (doc_id, text)."""
    sets = [(i, shingle_set(t, k)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by_item = {}
    for i, s in sets:
        for x in s:
            by_item.setdefault(x, []).append(i)
    have = dict(sets)
    pairs = {p for ids in by_item.values() for p in combinations(ids, 2)}
    for a, b in pairs:
        both = len(have[a] & have[b])
        if den * both >= num * (len(have[a]) + len(have[b]) - both):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return sorted((i, len(s), root(i)) for i, s in sets)


def packed_pieces(rows, limit=2048):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{TOKENIZERS}/word_bpe_49k.json")
    out = []
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for p, at in enumerate(range(0, len(ids), limit)):
            part = ids[at : at + limit]
            out.append((i, p, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    return sorted(out)


def conversations(rows):
    """rows: (conv_id, turn, role, text)."""
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((turn, role, text or ""))
    out = []
    for c, turns in by.items():
        turns.sort()
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        # What escaping adds: a backslash at each "<", run of backslashes and "|"; and the four markers of a turn.
        size = sum(len(r) + len(t) + len(re.findall(r"<\\*\|", t)) + len("<|im_start|>\n<|im_end|>\n") for _, r, t in turns)
        out.append((c, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), size))
    return sorted(out)


def piece_rows(rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=f"{TOKENIZERS}/piece_bpe_32k.model")
    out = []
    for i, text in rows:
        ids = [*sp.encode(text or ""), sp.eos_id()]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((i, len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids))))
    return sorted(out)
