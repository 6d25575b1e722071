"""Secret scans: fixed patterns, and a randomness test battery with length-aware control of false discoveries.

Three kinds are found by pattern alone (``assign``, ``access``, ``hex``), leftmost and without overlap per kind. The method adds
``random`` spans: runs of 20 or more characters of an encoding's alphabet that look drawn at random.

* Each run's encoding is inferred from its characters (hex, base32, base36, base64 with both of its last pairs); its symbols are
  tested for a uniform alphabet (chi-squared, by the Wilson-Hilferty normal), for runs above and below the alphabet's middle
  (Wald-Wolfowitz) and for serial correlation. The three two-sided p-values are combined by Bonferroni.
* Passing these tests is weak evidence, as 20 symbols contradict little. So a run must also contradict ordinary text: a model of
  adjacent letters and digits is counted over all tokens of the corpus, and a run is read in segments, cut at marks (``/ _ + -``)
  and where a capital follows a small letter, so that paths, slugs and names of functions are judged by their words; pairs of digits
  are numbers and say nothing. The mean log
  probability of its pairs, against that of text, gives a p-value for being text.
* A length class accepts the p-values that keep its false discoveries at ``RATE`` (Benjamini-Hochberg over whole decimal places): a
  class with few or doubtful discoveries needs better evidence. Runs of letters of one case, or capitalised, are never spans.

DataFrame functions only. The pairs are one pass over the texts that gives at most 36 x 36 rows, the scan another; its narrow result is
checkpointed, and the limits have one row per length class, so both become literals. Positions are code points, ends exclusive.

Null texts scan as empty, repeated rows each by themselves, and texts of any length whole. Other columns are not touched.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.functions.let import let
from driftloom.operators.once import with_once
from driftloom.session import reliable_checkpoint

# Fixed patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"

RUN = r"[A-Za-z0-9+/_-]{20,}"

#: Alphabets in the order of their values; what looks like the encoding; the test's symbols are ranks in the alphabet.
ENCODINGS = (
    ("letters", "abcdefghijklmnopqrstuvwxyz", r"^([A-Za-z]?[a-z]+|[A-Z]+)$"),
    ("hex", "0123456789abcdef", r"^(?=.*[0-9])([0-9a-f]*[a-f][0-9a-f]*|[0-9A-F]*[A-F][0-9A-F]*)$"),
    ("base32", "abcdefghijklmnopqrstuvwxyz234567", r"^(?=.*[2-7])[A-Z2-7]*[A-Z][A-Z2-7]*$"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz", r"^(?=.*[0-9])([0-9a-z]*[a-z][0-9a-z]*|[0-9A-Z]*[A-Z][0-9A-Z]*)$"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", r"[A-Za-z]"),
)

#: The combined p-value that a run must reach; the share of false discoveries, small since names are made of words that the corpus may lack;
#: ends of the length classes.
LEVEL, RATE, LENGTHS = 0.001, 1e-6, (24, 32, 48, 64, 128)

#: Symbols of the text model, what ends a segment, the least log probability of a pair, by how much the pairs of a word vary together,
#: and the decimal places to which p-values are told apart.
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0123456789"
CUTS, FLOOR, SPREAD, PLACES = r"[/_+-]+|(?<=[a-z])(?=[A-Z])", -5.0, 1.5, 30


def occurrences(text: Column, pattern: str, group: int = 0) -> Column:
    """What ``placed`` needs of all matches: their text, a group of each, and the lengths of the gaps between them."""
    scan = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
        F.transform(F.split(text, pattern, -1), F.length).alias("gap"),
    )
    none = F.lit(None).cast("struct<hit:array<string>,value:array<string>,gap:array<int>>")
    return F.when(text.rlike(pattern), scan).otherwise(none)


def placed(found: Column, least: int) -> Column:
    """(start, end, hit) of the matches whose group has ``least`` characters. ``found`` must be a plain column."""
    before = lambda i: F.aggregate(F.slice(found.gap, 1, i + 1), F.lit(0), lambda s, x: s + x) + F.aggregate(F.slice(found.hit, 1, i), F.lit(0), lambda s, x: s + F.length(x))
    rows = F.transform(found.hit, lambda hit, i: let(before(i), lambda at: F.struct(at.alias("start"), (at + F.length(hit)).alias("end"), hit.alias("hit"), F.length(F.get(found.value, i)).alias("size"))))
    kept = F.transform(F.filter(rows, lambda r: r.size >= least), lambda r: F.struct(r.start.alias("start"), r.end.alias("end"), r.hit.alias("hit")))
    return F.coalesce(kept, F.array().cast("array<struct<start:int,end:int,hit:string>>"))


def two_sided(z: Column) -> Column:
    """The chance of a normal value as far out as ``z``."""
    x = F.abs(z) / F.lit(2.0**0.5)
    t = 1 / (1 + 0.3275911 * x)
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    return poly * F.exp(-x * x)


def battery(codes: Column, k: int) -> Column:
    """The combined p-value of symbols ``codes`` (0 to k - 1) being drawn evenly and independently."""
    n = F.size(codes).cast("double")
    total = lambda values, f: F.aggregate(values, F.lit(0.0), lambda s, x: s + f(x))
    pairs = lambda f: F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes) - 1), f)
    squares = total(F.array_distinct(codes), lambda v: F.pow(F.size(F.filter(codes, lambda x: x == v)), F.lit(2.0)))
    free = k - 1.0
    chi = let(k / n * squares - n, lambda x2: (F.pow(F.greatest(x2, F.lit(0.0)) / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / (2 / (9 * free)) ** 0.5)
    low = total(codes, lambda x: (x < k / 2).cast("double"))
    turns = total(pairs(lambda a, b: ((a < k / 2) != (b < k / 2)).cast("double")), lambda x: x) + 1
    runs = let(2 * low * (n - low), lambda m: F.when(m > n, (turns - 1 - m / n) / F.sqrt(m * (m - n) / (n * n * (n - 1)))).otherwise(F.lit(40.0)))
    centred = lambda mean: F.when(
        squares < n * n, total(pairs(lambda a, b: (a - mean) * (b - mean)), lambda x: x) / total(codes, lambda x: (x - mean) * (x - mean)) * F.sqrt(n)
    ).otherwise(F.lit(40.0))
    serial = let(total(codes, lambda x: x.cast("double")) / n, centred)
    return F.least(F.lit(1.0), 3 * F.least(two_sided(chi), two_sided(runs), two_sided(serial)))


def tested(run: Column, name: str, alphabet: str) -> Column:
    plain = F.translate(run, "-_", "+/") if name == "base64" else F.lower(run)
    symbols = F.transform(F.filter(F.split(plain, ""), lambda c: c != ""), lambda c: F.instr(F.lit(alphabet), c) - 1)
    return let(symbols, lambda codes: battery(codes, len(alphabet)))


def text_pairs(docs: DataFrame, text: str = "text") -> dict[str, int]:
    """How often two letters or digits (small ones) stand side by side in the tokens of all texts. Tokens are counted first, in pieces of
    19 characters at most; a piece is short, so its pairs are taken one by one."""
    tokens = docs.select(F.explode_outer(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{2,19}"), F.lit(0))).alias("token"))
    counted = tokens.where("token is not null").groupBy("token").agg(F.count("*").alias("n"))
    pairs = counted.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring("token", i, 2))).alias("pair"))
    return {r["pair"]: r["n"] for r in pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect()}


class TextModel:
    """Log probabilities of a symbol after another, and their mean and variance in text."""

    def __init__(self, pairs: dict[str, int]) -> None:
        k = len(SYMBOLS)
        count = np.array([[pairs.get(a + b, 0) for b in SYMBOLS] for a in SYMBOLS], dtype=float)
        count[26:, 26:] = 0  # numbers say nothing
        self.log_p = np.maximum(FLOOR, np.log((count + 0.5) / (count.sum(1, keepdims=True) + 0.5 * k)))
        share = count / max(1.0, count.sum())
        self.mean = float((share * self.log_p).sum())
        self.variance = float((share * (self.log_p - self.mean) ** 2).sum())

    def places(self, run: Column) -> Column:
        """Decimal places of the p-value of a run being text, rounded down; 0 for all above a tenth."""
        if not self.variance:
            return F.lit(0)
        values, k = F.lit([float(v) for v in self.log_p.ravel()]), len(SYMBOLS)
        plain = F.lower(F.regexp_replace(run, CUTS, " "))
        codes = F.transform(F.filter(F.split(plain, ""), lambda c: c != ""), lambda c: F.instr(F.lit(SYMBOLS), c))

        def found(x: Column) -> Column:
            pairs = F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), lambda a, b: F.when((F.least(a, b) > 0) & (F.least(a, b) <= 26), F.get(values, (a - 1) * k + b - 1)))
            return F.filter(pairs, lambda v: v.isNotNull())

        def score(v: Column) -> Column:
            n = F.size(v).cast("double")
            return F.when(n > 0, (F.aggregate(v, F.lit(0.0), lambda s, x: s + x) - n * self.mean) / F.sqrt(n * self.variance * SPREAD)).otherwise(F.lit(0.0))

        # The normal's lower tail is below its density over the distance.
        tail = lambda z: F.when(z < -1.3, (z * z / 2 + F.log(-z * 2.506628274631)) / math.log(10)).otherwise(F.lit(0.0))
        return F.least(F.floor(let(let(let(codes, found), score), tail)), F.lit(PLACES)).cast("int")


def judged(run: Column, model: TextModel) -> Column:
    """Encoding, length class, p-value of the battery and ``places`` of a run; the encoding is null for digits alone and marks alone."""
    kind = F.coalesce(*(F.when(run.hit.rlike(pattern), F.lit(name)) for name, _, pattern in ENCODINGS))
    value = F.lit(None).cast("double")
    for name, alphabet, _ in reversed(ENCODINGS):
        value = F.when(kind == name, tested(run.hit, name, alphabet)).otherwise(value)
    size = run.end - run.start
    length = sum(((size >= end).cast("int") for end in LENGTHS), F.lit(0))
    return F.struct(run.start.alias("start"), run.end.alias("end"), kind.alias("encoding"), length.alias("length"), value.alias("p"), model.places(run.hit).alias("places"))


def scan(docs: DataFrame, keys: list[str], model: TextModel, text: str = "text") -> DataFrame:
    """(keys, assign, access, hex, runs): matches by kind, and the judged runs outside them. ``keys`` without these names."""
    rows = docs.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    found = F.struct(
        occurrences(F.col("_text"), ASSIGN, 2).alias("assign"),
        occurrences(F.col("_text"), ACCESS).alias("access"),
        # All of a run of hex digits matches, so runs too short need not be looked at.
        occurrences(F.col("_text"), HEX + r"(?<=[0-9a-f]{24})").alias("hex"),
        occurrences(F.col("_text"), RUN).alias("runs"),
    )
    rows = with_once(rows, "_found", found).select(*keys, "_found")
    places = F.struct(*(placed(F.col("_found")[kind], least).alias(kind) for kind, least in (("assign", 6), ("access", 20), ("hex", 24), ("runs", 20))))
    rows = with_once(rows, "_at", places).select(*keys, "_at.*")
    base = F.concat("assign", "access", "hex")
    free = F.filter("runs", lambda r: ~F.exists(base, lambda b: (b.start < r.end) & (r.start < b.end)))
    bare = lambda c: F.transform(c, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"))).alias(c)
    judged_runs = F.filter(F.transform(free, lambda r: judged(r, model)), lambda r: r.encoding.isNotNull())
    return rows.select(*keys, bare("assign"), bare("access"), bare("hex"), judged_runs.alias("runs"))


def limits(scanned: DataFrame) -> list[tuple[int, int]]:
    """(length class, decimal places that a run must have): the fewest for which the runs expected to have them by chance are at most
    ``RATE`` of those that do. A row per class and place, whatever the input."""
    runs = scanned.select(F.explode("runs").alias("r")).select("r.*").filter("encoding <> 'letters'")
    counts: dict[int, list[int]] = {}
    for r in runs.groupBy("length", "places").count().collect():
        counts.setdefault(r["length"], [0] * (PLACES + 1))[r["places"]] += r["count"]
    out = []
    for length, found in sorted(counts.items()):
        fewest = [k for k in range(1, PLACES + 1) if sum(found[k:]) and sum(found) * 10.0**-k <= RATE * sum(found[k:])]
        out += [(length, fewest[0])] if fewest else []
    return out


def accepted(table: list[tuple[int, int]], runs: str = "runs") -> Column:
    """The spans of the runs that pass the battery and that their length class accepts."""
    sure = lambda r: F.coalesce(*(F.when(r.length == n, r.places >= least) for n, least in table), F.lit(False))
    good = lambda r: (r.encoding != "letters") & (r.p >= LEVEL) & sure(r)
    return F.transform(F.filter(runs, good), lambda r: F.struct(r.start.alias("start"), r.end.alias("end")))


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, assign, access, hex, random) for each row: arrays of (start, end)."""
    scanned = reliable_checkpoint(scan(docs, [key], TextModel(text_pairs(docs, text)), text))
    return scanned.select(key, "assign", "access", "hex", accepted(limits(scanned)).alias("random"))


def redacted(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """The rows with every secret in ``text`` replaced by a mark, and ``length`` (where there is one) set to the new length.

    The limits are read off a first scan. The second finds the spans beside the text, so texts are never joined or shuffled.
    """
    model = TextModel(text_pairs(docs, text))
    table = limits(reliable_checkpoint(scan(docs, [], model, text).select("runs")))
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_given"))
    spans_of = F.array_sort(F.concat("assign", "access", "hex", accepted(table)))
    done = with_once(scan(packed, ["_row"], model, "_given"), "_clean", masked(F.col("_row")[text], spans_of))
    new = {text: F.col("_clean")}
    if length in docs.columns:
        new[length] = F.when(F.size(spans_of) > 0, F.length("_clean")).otherwise(F.col("_row")[length]).cast(docs.schema[length].dataType)
    return done.select(*(new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns))


def listed(*kinds: str) -> Column:
    """``kind:start:end`` of all spans, by start, then kind as given here, comma-joined."""
    def named(k: int, kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s.start.alias("start"), F.lit(k).alias("k"), s.end.alias("end"), F.lit(kind).alias("kind")))

    rows = F.concat(*(named(k, kind) for k, kind in enumerate(kinds)))
    return F.array_join(F.transform(F.array_sort(rows), lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def masked(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """A text with its spans (sorted by start) replaced; spans that overlap become one mark."""
    step = lambda acc, s: F.when(s.start < acc.at, F.struct(acc.out.alias("out"), F.greatest(acc.at, s.end).alias("at"))).otherwise(
        F.struct(F.concat(acc.out, F.substring(text, acc.at + 1, s.start - acc.at), F.lit(mark)).alias("out"), s.end.alias("at"))
    )
    done = F.aggregate(found, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda acc: F.concat(acc.out, F.substring(text, acc.at + 1, F.length(text))))
    return F.when(F.size(found) > 0, done).otherwise(text)
