"""Quality rules with risk-controlled thresholds.

Base rules are fixed: too few words, too many words in repeated windows. The learnt rules each compare one measure of a text (shares of
symbols, capitals, marks, repeated lines and repeated words) with a cutoff, per stratum of text length. A cutoff is taken from
labelled holdouts so that it is *certain enough* to spare good texts: with k of n good texts beyond it, the exact binomial tail
P(X <= k | n, rate) must be at most ``DOUBT`` divided by the number of (stratum, rule) pairs (Bonferroni). Cutoffs of a pair are
tried from the loosest on and the last that holds is taken; k only grows along the way, so this fixed sequence needs no further
correction. A rule may reject ``RISK`` / number of rules of a stratum's good texts, all rules together ``RISK``, with confidence
1 - ``DOUBT``. A pair with too few labels gets no cutoff and rejects nothing.

DataFrame functions only; one pass over the texts, whose measures (a few numbers a row) are checkpointed and serve both the holdout
and the verdict. The cutoffs are at most strata x rules values and become literals. The held-out fourth of the labels (crc32 of the
id) is not used, so that the promise can be measured there.

Null, empty and white-space texts have no words and fail the base. Repeated rows are judged each. Labels that are null are none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.llm.ftrl import held_out
from driftloom.operators.once import with_once
from driftloom.session import reliable_checkpoint

WINDOW, FEWEST, MOST_REPEATED = 8, 20, 30

#: Accepted share of rejected good texts, the chance that it is exceeded anywhere, and the steps of a cutoff.
RISK, DOUBT, STEPS = 0.05, 0.05, 200

#: Length strata end at these numbers of words.
STRATA = (100, 400)

RULES = {
    "symbols": "n_symbols / nullif(word_chars, 0)",
    "capitals": "n_capitals / nullif(word_chars, 0)",
    "marks": "n_marks / nullif(word_chars, 0)",
    "lines": "n_dup_lines / nullif(n_lines, 0)",
    "repeats": "n_repeat_words / nullif(n_words, 0)",
}

SPACE = r"[\x20\x09-\x0D]"


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without its text, with the measures; the words of 8-word windows that are found twice are counted once.

    Windows are compared by 64-bit hashes. Most texts repeat none, which a set of the hashes tells; only the others sort theirs, so
    no step is more than n log n in a text's length.
    """
    keys = [c for c in docs.columns if c != text]
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(*keys, t.alias("_text"))
    lines = F.filter(F.split("_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    rows = with_once(with_once(rows, "_words", F.filter(F.split("_text", SPACE + "+"), lambda w: w != "")), "_lines", F.transform(lines, lambda line: F.xxhash64(line)))
    bare = without(F.col("_text"), " \t\n\x0b\x0c\r")
    size = F.length(bare)
    rows = rows.select(
        *keys,
        "_words",
        F.size("_words").cast("long").alias("n_words"),
        size.cast("long").alias("word_chars"),
        (size - F.length(without(bare, "#*$%&|<>"))).cast("long").alias("n_symbols"),
        (size - F.length(without(bare, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))).cast("long").alias("n_capitals"),
        (size - F.length(without(bare, "!?"))).cast("long").alias("n_marks"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
    )
    starts = F.when(F.col("n_words") >= WINDOW, F.sequence(F.lit(1), F.size("_words") - (WINDOW - 1)))
    rows = with_once(rows, "_windows", F.transform(starts, lambda i: F.xxhash64(F.slice("_words", i, WINDOW)))).drop("_words")
    pairs = F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    twice = F.size(F.array_distinct("_windows")) < F.size("_windows")
    rows = with_once(rows, "_sorted", F.when(twice, F.array_sort(pairs))).drop("_windows")
    next_equal = F.zip_with("_sorted", F.slice("_sorted", 2, F.size("_sorted")), lambda a, b: F.coalesce(a.h == b.h, F.lit(False)))
    rows = with_once(rows, "_next", next_equal)
    marked = F.zip_with("_sorted", F.zip_with("_next", F.concat(F.array(F.lit(False)), "_next"), lambda a, b: F.coalesce(a, F.lit(False)) | b), lambda s, m: F.when(m, s.i))
    rows = with_once(rows, "_places", F.sort_array(F.filter(marked, lambda i: i.isNotNull()))).drop("_sorted", "_next")
    steps = F.zip_with("_places", F.slice("_places", 2, F.size("_places")), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    repeated = F.when(F.col("_places").isNull(), F.lit(0)).otherwise(F.aggregate(steps, F.lit(0), lambda s, x: s + x))
    return rows.withColumn("n_repeat_words", repeated.cast("long")).drop("_places")


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x >= 1: Stirling's series ten places further up."""
    z = x + 10
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    return series - sum((F.log(x + i) for i in range(1, 10)), F.log(x))


def log_tail(k: Column, n: Column, rate: float) -> Column:
    """ln P(X <= k) of a binomial of ``n`` trials, for k below its mean; terms fall from k down, and beyond 10 sqrt(n) are nothing."""
    top = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * math.log(rate) + (n - k) * math.log1p(-rate)
    places = F.sequence(F.lit(0), F.least(k, 10 * F.ceil(F.sqrt(n)) + 50).cast("int"))
    step = lambda acc, j: F.struct((acc.sum + acc.term).alias("sum"), (acc.term * (k - j) * (1 - rate) / ((n - k + j + 1) * rate)).alias("term"))
    return top + F.log(F.aggregate(places, F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term")), step, lambda acc: acc.sum))


def stratum() -> Column:
    return sum(((F.col("n_words") >= end).cast("int") for end in STRATA), F.lit(0))


def step_of(rule: str) -> Column:
    """A measure as one of ``STEPS`` + 1 steps; nothing to measure is step 0."""
    return F.coalesce(F.ceil(F.least(F.expr(RULES[rule]), F.lit(1.0)) * STEPS), F.lit(0)).cast("int")


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, doubt: float = DOUBT) -> DataFrame:
    """(stratum, rule, cutoff): steps beyond the cutoff are rejected."""
    good = labels.filter((F.col("quality") == 1) & ~held_out(F.col("doc_id"))).select("doc_id").distinct()
    steps = F.explode(F.array(*(F.struct(F.lit(rule).alias("rule"), step_of(rule).alias("step")) for rule in RULES)))
    counts = measured.join(good, "doc_id", "left_semi").select(stratum().alias("stratum"), steps.alias("s")).groupBy("stratum", "s.rule", "s.step").agg(F.count("*").alias("texts"))
    # At most strata x rules x steps rows from here on.
    pair = Window.partitionBy("stratum", "rule")
    ranked = counts.select("stratum", "rule", "step", F.sum("texts").over(pair).alias("n"), (F.sum("texts").over(pair.orderBy(F.desc("step"))) - F.col("texts")).alias("k"))
    rate, pairs = risk / len(RULES), (len(STRATA) + 1) * len(RULES)
    k, n = F.col("k").cast("double"), F.col("n").cast("double")
    sure = (k < n * rate) & (log_tail(k, n, rate) <= math.log(doubt / pairs))
    return ranked.filter(sure).groupBy("stratum", "rule").agg(F.min("step").alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, doubt: float = DOUBT) -> DataFrame:
    """The measures, ``base_failed``, the rule that fails first (null: none) and ``kept``, for every row of ``docs`` (doc_id, text)."""
    measured = reliable_checkpoint(measures(docs.select("doc_id", "text")))
    table = cutoffs(measured, labels, risk, doubt).collect()
    failing = [F.when((stratum() == r["stratum"]) & (step_of(r["rule"]) > r["cutoff"]), F.lit(r["rule"])) for r in sorted(table)]
    base = (F.col("n_words") < FEWEST) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = measured.withColumn("base_failed", base).withColumn("failed_rule", F.coalesce(*failing) if failing else F.lit(None).cast("string"))
    return rows.withColumn("kept", ~F.col("base_failed") & F.col("failed_rule").isNull())
