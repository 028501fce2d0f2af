"""DuckDB SQL that states what the queries return."""

from __future__ import annotations

from verdara.llm.license_scan import COPYRIGHT_LINE, LICENCE_WORD, OTHER, SPELLINGS
from verdara.llm.license_texts import TEXTS
from verdara.llm.quality_rules import COST, LEVEL, MAX_FALSE, RULES


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _lower(x: str) -> str:
    return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quality() -> str:
    ladders = ", ".join(f"('{r}', {s}, {c})" for r, (_, _, _, cuts) in RULES.items() for s, c in enumerate(cuts))
    hit = " ".join(f"WHEN rule = '{r}' THEN 1000 * {num} {'>=' if way > 0 else '<='} cutoff * {den}" for r, (num, den, way, _) in RULES.items())
    rules = f"[{', '.join(_text(r) for r in RULES)}]"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, stratum, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
u AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w),
g AS (SELECT doc_id, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS tri FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, tri) AS c FROM g WHERE tri IS NOT NULL),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r WHERE c > 1) GROUP BY 1),
m0 AS (SELECT w.doc_id, stratum, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m0),
marks AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
steps(rule, step, cutoff) AS (VALUES {ladders}),
held AS (SELECT m.*, quality, substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) < '4' AS selects, row_number() OVER () AS rid FROM m JOIN marks USING (doc_id) WHERE NOT base_failed),
sel AS (SELECT stratum, rule, step, cutoff, count(*) FILTER (quality = 1) AS n, count(*) FILTER (quality = 1 AND (CASE {hit} END)) AS k,
  count(*) FILTER (quality <> 1 AND (CASE {hit} END)) - {COST} * count(*) FILTER (quality = 1 AND (CASE {hit} END)) AS gain
  FROM held CROSS JOIN steps WHERE selects GROUP BY ALL),
chosen AS (SELECT stratum, rule, arg_max(cutoff, gain * 1000 - step) AS cutoff, max(gain) AS gain FROM sel WHERE gain > 0 AND k <= n * {MAX_FALSE} GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY gain DESC, list_position({rules}, rule)) AS rank FROM chosen),
good AS (SELECT stratum, count(*) AS n FROM held WHERE NOT selects AND quality = 1 GROUP BY 1),
first AS (SELECT stratum, rid, min(rank) AS rank FROM held JOIN ranked USING (stratum) WHERE NOT selects AND quality = 1 AND (CASE {hit} END) GROUP BY 1, 2),
tested AS (SELECT r.stratum, r.rule, r.cutoff, any_value(good.n) AS n, count(first.rid) AS k FROM ranked r JOIN good USING (stratum) LEFT JOIN first ON first.stratum = r.stratum AND first.rank <= r.rank GROUP BY ALL),
best AS (SELECT stratum, rule, cutoff FROM tested WHERE list_sum(list_transform(range(k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({MAX_FALSE}) + (n - j) * ln(1 - {MAX_FALSE}))))
  <= {LEVEL} / (SELECT count(DISTINCT stratum) FROM held)),
failed AS (SELECT doc_id, string_agg(rule, ',' ORDER BY rank) AS rules FROM (
  SELECT m.doc_id, rule, list_position({rules}, rule) AS rank FROM m JOIN best USING (stratum) WHERE CASE {hit} END) GROUP BY 1)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rules IS NULL AS kept, coalesce(rules, '') AS failed_rules
FROM m LEFT JOIN failed ON failed.doc_id = m.doc_id"""


_DEDUP = f"""
WITH d AS (SELECT doc_id, {_lower("coalesce(text, '')")} AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM d WINDOW g AS (PARTITION BY norm)"""


def _canonical(x: str) -> str:
    form = f"trim(regexp_replace(regexp_replace(lower({x}), {_text(COPYRIGHT_LINE)}, '', 'g'), {_text(OTHER)}, ' ', 'g'))"
    for other, usual in SPELLINGS:
        form = f"replace({form}, {_text(other)}, {_text(usual)})"
    return form


def _licences() -> str:
    known = ", ".join(f"({_text(i)}, {_text(k)}, {_text(t)})" for i, k, t in TEXTS)
    return f"""
WITH k0(license_id, kind, text) AS (VALUES {known}),
k AS (SELECT sha256({_canonical("text")}) AS digest, min(license_id) AS license_id, min(kind) AS match_kind FROM k0 GROUP BY 1),
d AS (SELECT doc_id, sha256({_canonical("coalesce(text, '')")}) AS text_digest FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
n AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices FROM l JOIN k ON k.digest = sha256({_canonical("line")})
  WHERE regexp_matches(lower(line), {_text(LICENCE_WORD)}) GROUP BY 1)
SELECT d.doc_id, text_digest, license_id, match_kind, coalesce(notices, '') AS notices
FROM d LEFT JOIN k ON k.digest = d.text_digest LEFT JOIN n ON n.doc_id = d.doc_id"""


def _edited(x: str, letter: str, cost: str, line: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN {{'c': {x}.c + {cost}, 'k': {x}.k || '{letter}', 'o': {x}.o || {line}}} END"


def _repair() -> str:
    """The automaton's four states carry the least (cost, audit) of the turns so far, and the repaired lines with it."""
    keep = lambda x, role: f"CASE WHEN ini = '{role}' THEN {_edited(x, 'K', 'broken', 'line')} END"
    rerole = lambda x, role: _edited(x, "R", "1 + broken", f"chr(10) || '{role}:' || text")
    insert = lambda x, role: _edited(x, "I", "5", f"chr(10) || '{role}:'")
    delete = lambda x: _edited(x, "D", "2", "''")
    to_user = ", ".join(f"CASE WHEN NOT must THEN {how(x, r)} END" for x in ("x0", "x1", "x3") for how, r in ((keep, "u"), (rerole, "user")))
    to_assistant = ", ".join(f"CASE WHEN NOT must THEN {how('x2', r)} END" for how, r in ((keep, "a"), (rerole, "assistant")))
    start = "{'c': CAST(0 AS BIGINT), 'k': '', 'o': ''}"
    return rf"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce([4294967295] || list_transform(string_split(
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS BIGINT)),
  lambda c, b: xor(c >> 8, crc[1 + (xor(c, b) & 255)])), 4294967295) % 20 AS how FROM conversations, t),
w AS (SELECT conv_id, turn, CASE how WHEN 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE how WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM d WHERE how <> 0),
m AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth FROM w),
o AS (SELECT *, dense_rank() OVER (ORDER BY conv_id) AS g, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth) AS i FROM m),
s AS (SELECT *, left(role, 1) AS ini, chr(10) || role || ':' || text AS line, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM o),
f AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  lag(ini) OVER (PARTITION BY g ORDER BY i) || ini AS two FROM s),
e AS (SELECT *, fault IN ('blank', 'duplicate') AS must, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS broken FROM f),
r(g, i, x0, x1, x2, x3) AS (
  SELECT g, CAST(0 AS BIGINT), x0, NULL::STRUCT(c BIGINT, k VARCHAR, o VARCHAR), x2, {insert("x2", "assistant")} FROM (SELECT g, x0, {insert("x0", "user")} AS x2 FROM (SELECT DISTINCT g, {start} AS x0 FROM o))
  UNION ALL
  SELECT g, i, h0, h1, h2, list_min([h3, {insert("h2", "assistant")}]) FROM (
    SELECT g, i, h0, h1, list_min([h2, {insert("h0", "user")}, {insert("h1", "user")}, {insert("h3", "user")}]) AS h2, h3 FROM (
      SELECT e.g, e.i, {delete("x0")} AS h0, list_min([{delete("x1")}, CASE WHEN NOT must THEN {keep("x0", "s")} END]) AS h1,
        list_min([{delete("x2")}, {to_user}]) AS h2, list_min([{delete("x3")}, {to_assistant}]) AS h3
      FROM r JOIN e ON e.g = r.g AND e.i = r.i + 1))),
n AS (SELECT g, any_value(conv_id) AS conv_id, max(i) AS i, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM e GROUP BY g),
best AS (SELECT n.*, list_min([x0, x3]) AS x FROM n JOIN r ON r.g = n.g AND r.i = n.i)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(x.c, 0) AS cost, coalesce(x.k, '') AS audit, sha256(coalesce(substr(x.o, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id"""


_COLLOCATIONS = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_lower("coalesce(text, '')")}, '[.,;:!?
-
]')) AS piece FROM documents),
q AS (SELECT lang, row_number() OVER () AS id, list_filter(string_split_regex(piece, '[ 	]+'), lambda x: x <> '') AS ws FROM p),
u AS (SELECT lang, id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM q),
g AS (SELECT lang, w AS w1, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM u WINDOW o AS (PARTITION BY id ORDER BY i)),
total AS (SELECT lang, count(*) AS n FROM u GROUP BY 1),
f1 AS (SELECT lang, w1, count(*) AS f FROM g GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM g WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
cuts AS (
  SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, f2.f AS a, x.f AS l, y.f AS r, 1 AS k FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.w1 = f2.w1 JOIN f1 y ON y.lang = f2.lang AND y.w1 = f2.w2
  UNION ALL SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.f, x.f, y.f, 1 FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.w1 = f3.w1 JOIN f2 y ON y.lang = f3.lang AND y.w1 = f3.w2 AND y.w2 = f3.w3
  UNION ALL SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.f, x.f, y.f, 2 FROM f3 JOIN f2 x ON x.lang = f3.lang AND x.w1 = f3.w1 AND x.w2 = f3.w2 JOIN f1 y ON y.lang = f3.lang AND y.w1 = f3.w3),
scored AS (SELECT *, CAST(1000000 * CAST(a AS HUGEINT) * a // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cuts),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, phrase, max(f) AS longer FROM (SELECT lang, w1 || ' ' || w2 AS phrase, f FROM f3 UNION ALL SELECT lang, w2 || ' ' || w3, f FROM f3) GROUP BY 1, 2),
kept AS (SELECT least.* FROM least LEFT JOIN inside USING (lang, phrase) WHERE coalesce(100 * longer < 50 * a, true)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    return {"op4_quality_rules": _quality(), "op8_exact_dedup": _DEDUP, "op10_license_scan": _licences(), "op11_conversation_repair": _repair(), "op13_collocations": _COLLOCATIONS}
