"""Quality rules whose cutoffs carry a guarantee; DataFrame functions only.

Rules compare integer measures of a text with a fixed ladder of cutoffs, lenient to strict. Labelled documents
that pass the base rule are dealt by a hash of their doc_id: a quarter selects, the rest, the holdout, certifies.
Strata are languages.

Selection. For each stratum and rule, of the cutoffs that reject at most a share `max_false` of the quarter's good
documents (quality = 1) the one with most bad documents rejected, less `cost` times the good ones; the lenient one
on a tie; none if nothing is gained. A stratum's rules are ranked by that gain.

Certification. What may be rejected falsely is bounded for a stratum's rules together. U_j is the union of its
first j rules. If it rejects k of the holdout's n good documents, P(X <= k | n, max_false) is the exact binomial
(Clopper-Pearson) p-value of "U_j rejects more than max_false of good documents". The U_j are nested and their
order is fixed before the holdout is looked at, so they are tested one after another, each at the whole level,
until one fails (fixed-sequence testing); across strata the level is divided by their number (Bonferroni). So
with confidence 1 - level no stratum's rules in use, all taken together, reject more than max_false of its good
documents. With fewer than log(level / strata) / log(1 - max_false) good documents in the holdout, 436 for four
strata, no rule of a stratum can be certified and only the base rule rejects.

Measures are computed inside each row (no explode), so a long document costs its length and no shuffle
carries words.

Defined cases: null text has no words and fails the base rule; null or unknown language is a stratum of
its own; strata without labels have no cutoffs; repeated labels of a document count as one, 1 winning;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdara.llm.common import materialize

SPACE = r"[\x20\x09-\x0D]+"
MAX_FALSE = 0.01
LEVEL = 0.05
COST = 5
#: rule -> (numerator, denominator, direction, cutoffs lenient to strict): reject when
#: 1000 * numerator >= cutoff * denominator (direction 1) or <= (direction -1).
RULES: dict[str, tuple[str, str, int, list[int]]] = {
    "symbols": ("n_symbols", "n_words", 1, [3000, 2000, 1500, 1000, 800, 600, 500, 400, 300, 200, 150, 100]),
    "dup_lines": ("n_dup_lines", "n_words", 1, [200, 100, 60, 40, 30, 20, 15, 10]),
    "repeats": ("n_repeat_words", "n_words", 1, [480, 450, 400, 350, 300, 250, 200, 150, 100]),
    "long_words": ("word_chars", "n_words", 1, [16000, 14000, 12000, 10000, 9000, 8000, 7500, 7000]),
    "short_words": ("word_chars", "n_words", -1, [1500, 2000, 2500, 3000, 3500]),
}


def _let(value: Column, body) -> Column:
    """Evaluate `value` once per row and hand it to `body`; projections could inline it otherwise."""
    return F.transform(F.array(value), body).getItem(0)


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the text, the first one included."""

    def windows(w: Column) -> Column:
        return F.transform(F.slice(w, 1, F.size(w) - 2), lambda a, i: F.xxhash64(a, F.get(w, i + 1), F.get(w, i + 2)))

    def covered(h: Column) -> Column:
        # Sorted (hash, place) pairs; a pair is repeated if a neighbour has its hash. Then the places in order,
        # each adding the words that the one before hasn't covered.
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        flagged = _let(pairs, lambda p: F.filter(p, lambda x, k: (F.get(p, k - 1)["h"] == x["h"]) | (F.get(p, k + 1)["h"] == x["h"])))
        places = F.array_sort(F.transform(flagged, lambda x: x["i"]))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(places, start, lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"])

    zero = F.lit(0).cast("long")
    unique = lambda h: F.size(F.array_distinct(h)) == F.size(h)
    return F.when(F.size(words) < 4, zero).otherwise(_let(windows(words), lambda h: F.when(unique(h), zero).otherwise(covered(h))))


def measure(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of each document, then `more`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    by_words = _let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w).alias("n_repeat_words"),
        ),
    )
    dup = _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    symbols = F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long")
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    out = docs.select("doc_id", lang.alias("lang"), by_words.alias("m"), symbols.alias("n_symbols"), dup.alias("n_dup_lines"), *more)
    names = out.columns[5:]
    return out.select("doc_id", "lang", "m.n_words", "m.word_chars", "n_symbols", "n_dup_lines", "m.n_repeat_words", *names)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _hits(num: str, den: str, direction: int, cut: Column | int) -> Column:
    left, right = 1000 * F.col(num), cut * F.col(den)
    return left >= right if direction > 0 else left <= right


def _binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), summed from terms kept as logarithms."""
    from math import log, log1p

    first = n * F.lit(log1p(-p))
    ratio = F.lit(log(p) - log1p(-p))
    start = F.struct(first.alias("t"), F.exp(first).alias("s"))

    def add(a: Column, j: Column) -> Column:
        t = a["t"] + F.ln((n - j + 1).cast("double") / j) + ratio
        return F.struct(t.alias("t"), (a["s"] + F.exp(t)).alias("s"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.least(F.lit(1.0), F.aggregate(steps, start, add, lambda a: a["s"]))


def selects(doc_id: Column) -> Column:
    """Whether a labelled document belongs to the quarter that selects cutoffs."""
    return F.substring(F.md5(doc_id.cast("string").cast("binary")), 1, 1) < "4"


def _named(cutoffs: DataFrame, value: str, prefix: str) -> DataFrame:
    """A row a stratum, with a column for each rule."""
    return cutoffs.groupBy("stratum").pivot("rule", list(RULES)).agg(F.first(value)).withColumnsRenamed({r: prefix + r for r in RULES})


def _hit_rules(value) -> Column:
    """Array of value(rule) for the rules whose cutoff, in the columns cut_*, rejects the row."""
    return F.array_compact(F.array(*[F.when(F.coalesce(_hits(num, den, way, F.col(f"cut_{r}")), F.lit(False)), value(r)) for r, (num, den, way, _) in RULES.items()]))


def _few(table: DataFrame) -> DataFrame:
    """A table of a row a stratum, to be broadcast while it is small; beyond that joins are left to the optimizer."""
    return F.broadcast(table) if table.count() <= 10_000 else table


def select_cutoffs(held: DataFrame, max_false: float, cost: int) -> DataFrame:
    """(stratum, rule, cutoff, rank) from labelled rows (stratum, quality, measures)."""
    steps = [(rule, step, cut, num, den, way) for rule, (num, den, way, cuts) in RULES.items() for step, cut in enumerate(cuts)]
    good, bad = F.col("quality") == 1, F.col("quality") != 1
    counts = [F.count_if(good & _hits(num, den, way, cut)).alias(f"g{i}") for i, (_, _, cut, num, den, way) in enumerate(steps)]
    counts += [F.count_if(bad & _hits(num, den, way, cut)).alias(f"b{i}") for i, (_, _, cut, num, den, way) in enumerate(steps)]
    by = held.groupBy("stratum").agg(F.count_if(good).alias("n"), *counts)
    order = {r: i for i, r in enumerate(RULES)}
    rows = [F.struct(F.lit(r).alias("rule"), F.lit(order[r]).alias("place"), F.lit(s).alias("step"), F.lit(c).alias("cutoff"), F.col(f"g{i}").alias("k"), F.col(f"b{i}").alias("bad")) for i, (r, s, c, *_) in enumerate(steps)]
    gain = F.col("bad") - cost * F.col("k")
    fits = by.select("stratum", "n", F.inline(F.array(*rows))).withColumn("gain", gain).where((F.col("gain") > 0) & (F.col("k") <= F.col("n") * max_false))
    best = fits.groupBy("stratum", "rule", "place").agg(F.max_by(F.struct("cutoff", "gain"), F.struct(F.col("gain"), -F.col("step"))).alias("b"))
    ranked = F.row_number().over(Window.partitionBy("stratum").orderBy(F.desc("b.gain"), "place"))  # as many rows as there are rules
    return best.select("stratum", "rule", "b.cutoff", ranked.alias("rank"))


def certify(measures: DataFrame, labels: DataFrame, max_false: float = MAX_FALSE, level: float = LEVEL, cost: int = COST) -> DataFrame:
    """(stratum, rule, cutoff): the cutoffs in use."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    numbers = sorted({x for num, den, _, _ in RULES.values() for x in (num, den)})
    held = measures.where(~base_failed()).select("doc_id", F.coalesce(F.col("lang"), F.lit("")).alias("stratum"), *numbers).join(marks, "doc_id")
    held = materialize(held.select("stratum", "quality", selects(F.col("doc_id")).alias("selects"), *numbers), "quality-held")
    strata = max(1, held.select("stratum").distinct().count())
    chosen = materialize(select_cutoffs(held.where("selects"), max_false, cost), "quality-chosen")
    wide = materialize(_named(chosen, "cutoff", "cut_").join(_named(chosen, "rank", "rank_"), "stratum"), "quality-wide")
    first = F.array_min(_hit_rules(lambda r: F.col(f"rank_{r}")))
    good = held.where("not selects and quality = 1").join(_few(wide), "stratum").select("stratum", first.alias("first"))
    tests = F.array(*[F.struct(F.lit(j).alias("rank"), F.count_if(F.col("first") <= j).alias("k")) for j in range(1, len(RULES) + 1)])
    by = materialize(good.groupBy("stratum").agg(F.count("*").alias("n"), tests.alias("tests")), "quality-tests")
    certified = by.select("stratum", "n", F.inline("tests")).where(_binomial_cdf(F.col("k"), F.col("n"), max_false) <= level / strata)
    # p-values rise with the rank, so the ranks that pass are those before the first that fails.
    return chosen.join(certified.select("stratum", "rank"), ["stratum", "rank"]).select("stratum", "rule", "cutoff")


def judge(docs: DataFrame, labels: DataFrame, max_false: float = MAX_FALSE, level: float = LEVEL, cost: int = COST) -> DataFrame:
    """One row a document: doc_id, the measures, base_failed, kept, failed_rules."""
    return _verdicts(materialize(measure(docs), "quality-measures"), labels, max_false, level, cost)


def passing(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` without those that fail; columns as they were.

    Measures are written beside the rows' columns, so that the verdict needs no join of texts.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    measures = materialize(measure(docs, own), "quality-measures")
    return _verdicts(measures, labels, MAX_FALSE, LEVEL, COST, keep=["row"]).where("kept").select("row.*")


def _verdicts(measures: DataFrame, labels: DataFrame, max_false: float, level: float, cost: int, keep: list[str] | None = None) -> DataFrame:
    cutoffs = materialize(_named(certify(measures, labels, max_false, level, cost), "cutoff", "cut_"), "quality-cutoffs")
    joined = measures.join(_few(cutoffs), F.coalesce(measures["lang"], F.lit("")) == cutoffs["stratum"], "left")
    failed, base = _hit_rules(F.lit), base_failed()
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return joined.select(*(keep or []), *names, base.alias("base_failed"), (~base & (F.size(failed) == 0)).alias("kept"), F.array_join(failed, ",").alias("failed_rules"))
