"""Deterministic confidence of a proposed selector against a last-known-good sample."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.functions.let import let

# Fixed weights and scores.
W_STRUCTURE, W_TEXT, W_ROLE, W_FORMAT = 0.30, 0.30, 0.25, 0.15
NO_BASELINE_FACTOR = 0.85

# Letters, digits and underscore of any script: Java's plain \w would split accented words.
WORD = r"[\p{L}\p{N}_]+"


def words(s: Column) -> Column:
    return F.regexp_extract_all(F.lower(s), F.lit(WORD), F.lit(0))


def _letters(s: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(s), F.lit("[a-z]+"), F.lit(0)))


def _empty_cases(p: Column, score: Column) -> Column:
    no_left, no_right = F.size(p["l"]) == 0, F.size(p["r"]) == 0
    return F.when(no_left & no_right, F.lit(1.0)).when(no_left | no_right, F.lit(0.5)).otherwise(score)


def structure_similarity(a: Column, b: Column) -> Column:
    """Jaccard of the letter-run sets; both empty 1.0, one empty 0.5."""

    def jaccard(p: Column) -> Column:
        shared = F.size(F.array_intersect(p["l"], p["r"]))
        return _empty_cases(p, shared / (F.size(p["l"]) + F.size(p["r"]) - shared).cast("double"))

    return let(F.struct(_letters(a).alias("l"), _letters(b).alias("r")), jaccard)


def _squares(ordered: Column) -> Column:
    """Sum of the squared counts of the words of a sorted bag: the k-th copy of a word adds ``2 * k - 1``."""
    start = F.struct(F.lit(None).cast("string").alias("word"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("sum"))

    def step(acc: Column, w: Column) -> Column:
        before = F.when(acc["word"] == w, acc["run"]).otherwise(F.lit(0).cast("long"))
        return F.struct(w.alias("word"), (before + 1).alias("run"), (acc["sum"] + 2 * before + 1).alias("sum"))

    return F.aggregate(ordered, start, step, lambda acc: acc["sum"])


def text_similarity(a: Column, b: Column) -> Column:
    """Cosine of word counts, in time and memory of one sort of both texts' words.

    The words of both texts together have the squares of each and twice the product, so sorted bags are all that is needed.
    """

    def cosine(p: Column) -> Column:
        dot = (p["both"] - p["left"] - p["right"]) / F.lit(2.0)
        return dot / (F.sqrt(p["left"].cast("double")) * F.sqrt(p["right"].cast("double")))

    def counted(p: Column) -> Column:
        both = F.sort_array(F.concat(p["l"], p["r"]))
        sums = F.struct(_squares(p["l"]).alias("left"), _squares(p["r"]).alias("right"), _squares(both).alias("both"))
        return _empty_cases(p, let(sums, cosine))

    return let(F.struct(F.sort_array(words(a)).alias("l"), F.sort_array(words(b)).alias("r")), counted)


def cosine_pairs(pairs: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """``keys, text_similarity`` for pairs of whole texts; rows that agree in their keys are one pair, of all their words.

    A pair is scored where it lies, so a task holds the words of one pair. Only rows that share their keys, which one job looks for
    by the keys alone, become rows of words and are counted with map-side combine.
    """
    score = text_similarity(F.coalesce(left, F.lit("")), F.coalesce(right, F.lit("")))
    repeated = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)])
    if repeated.isEmpty():
        return pairs.select(*keys, score.alias("text_similarity"))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)])
    once = pairs.join(repeated, same, "left_anti").select(*keys, score.alias("text_similarity"))
    return once.unionByName(_cosine_rows(pairs.join(repeated, same, "left_semi"), keys, left, right))


def _cosine_rows(pairs: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """``cosine_pairs`` by rows of words."""

    def side(column: str, is_left: bool) -> DataFrame:
        # posexplode_outer keeps a pair whose text has no word at all.
        return pairs.select(
            *keys,
            F.explode_outer(words(F.col(column))).alias("_word"),
            F.lit(1 if is_left else 0).alias("_l"),
            F.lit(0 if is_left else 1).alias("_r"),
        )

    has_word = F.col("_word").isNotNull()
    counts = (
        side(left, True).unionByName(side(right, False))
        .groupBy(*keys, "_word")
        .agg(
            F.sum(F.when(has_word, F.col("_l")).otherwise(0)).cast("double").alias("_l"),
            F.sum(F.when(has_word, F.col("_r")).otherwise(0)).cast("double").alias("_r"),
        )
    )
    sums = counts.groupBy(*keys).agg(
        F.sum(F.col("_l") * F.col("_r")).alias("_dot"),
        F.sum(F.col("_l") * F.col("_l")).alias("_ll"),
        F.sum(F.col("_r") * F.col("_r")).alias("_rr"),
    )
    score = (
        F.when((F.col("_ll") == 0) & (F.col("_rr") == 0), F.lit(1.0))
        .when((F.col("_ll") == 0) | (F.col("_rr") == 0), F.lit(0.5))
        .otherwise(F.col("_dot") / (F.sqrt("_ll") * F.sqrt("_rr")))
    )
    return sums.select(*keys, score.alias("text_similarity"))


def role_score(proposed: Column, known: Column) -> Column:
    p, k = F.lower(F.trim(proposed)), F.lower(F.trim(known))
    return (
        F.when(proposed.isNull() & known.isNull(), F.lit(1.0))
        .when(proposed.isNull() | known.isNull(), F.lit(0.8))
        .when(p == k, F.lit(1.0))
        .when(F.contains(k, p) | F.contains(p, k), F.lit(0.7))
        .otherwise(F.lit(0.5))
    )


def format_class(s: Column) -> Column:
    """Any digit makes a value ``currency_or_number``, so a numeric date is never ``date``."""
    t = F.trim(s)
    return (
        F.when(t.rlike(r"\p{Nd}"), F.lit("currency_or_number"))
        .when(F.contains(t, F.lit("@")) & F.contains(t, F.lit(".")), F.lit("email"))
        .otherwise(F.lit("string"))
    )


def format_score(proposed: Column, sample: Column) -> Column:
    no_sample = sample.isNull() | (sample == "")
    return (
        F.when(no_sample & (F.trim(proposed) != ""), F.lit(1.0))
        .when(no_sample, F.lit(0.5))
        .when(format_class(proposed) == format_class(sample), F.lit(1.0))
        .otherwise(F.lit(0.4))
    )


def confidence(
    outline: Column,
    text: Column,
    role: Column,
    has_baseline: Column,
    known_outline: Column,
    known_text: Column,
    known_role: Column,
    known_sample: Column,
) -> Column:
    """Weighted score in 0..1; without a baseline only the value format counts.

    An empty ``text`` is scored through the outline, as the proposed value is then unknown.
    """
    blank = F.lit("")
    text = F.coalesce(text, blank)
    outline = F.coalesce(outline, blank)
    words_of = F.when(text != "", text).otherwise(outline)
    weighted = (
        W_STRUCTURE * structure_similarity(outline, F.coalesce(known_outline, blank))
        + W_TEXT * text_similarity(words_of, F.coalesce(known_text, blank))
        + W_ROLE * role_score(role, known_role)
        + W_FORMAT * format_score(text, F.coalesce(known_sample, blank))
    )
    bounded = F.greatest(F.least(weighted, F.lit(1.0)), F.lit(0.0))
    return F.when(has_baseline, bounded).otherwise(NO_BASELINE_FACTOR * format_score(text, blank))
