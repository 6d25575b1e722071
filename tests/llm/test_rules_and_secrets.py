import math
import random
import re
from collections import defaultdict

import pytest

from driftloom.llm import quality_rules, secret_scan

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measured(text):
    text = text or ""
    words = WORD.findall(text)
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    covered = {p for at in windows.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    marks = sum(c in "#*$%&|<>" for w in words for c in w)
    return len(words), sum(map(len, words)), marks, len(lines) - len(set(lines)), len(covered)


REPEATS = ["a b c d e f g h " * 5, "x " * 7, "x " * 8, "x " * 9, "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 Z 1 2 3 4 5 6 7 8", "l\nl\n \nl\x0bm\n\n", "#* $% é|é <> 🙂&", "w w  x"]


def test_measures(spark, docs, texts):
    rows = texts + [(500 + i, t) for i, t in enumerate(REPEATS)]
    found = quality_rules.measures(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found)
    assert got == sorted((str(i), *measured(t)) for i, t in rows)


def test_judge(spark, docs, none, texts):
    labels = spark.createDataFrame([(i, 1, None) for i, _ in texts if i], "doc_id long, quality int, toxic int")
    rows = quality_rules.judge(docs, labels).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed and r.failed_rule is None)
    # Too few labels for any promise: no rule rejects.
    assert all(r.failed_rule is None for r in rows)
    assert quality_rules.judge(none, labels).count() == 0
    assert quality_rules.judge(docs, labels.limit(0)).filter("failed_rule IS NOT NULL").count() == 0


def test_cutoffs_spare_good_texts(spark):
    rng = random.Random(3)
    good = [(i, " ".join("word" + ("#" if rng.random() < 0.01 else "") for _ in range(50))) for i in range(6000)]
    labels = spark.createDataFrame([(i, 1) for i, _ in good], "doc_id long, quality int")
    measures = quality_rules.measures(spark.createDataFrame(good, "doc_id long, text string")).cache()
    table = {(r.stratum, r.rule): r.cutoff for r in quality_rules.cutoffs(measures, labels, risk=0.2).collect()}
    cut = table[0, "symbols"]
    beyond = [r for r in measures.collect() if math.ceil(r.n_symbols / r.word_chars * quality_rules.STEPS) > cut]
    assert 0 < len(beyond) <= 0.2 / len(quality_rules.RULES) * len(good)
    assert all(stratum == 0 for stratum, _ in table)  # the other strata have no labels


@pytest.mark.parametrize("n, k, rate", [(100, 0, 0.05), (1000, 12, 0.02), (50_000, 800, 0.02), (10, 0, 0.9), (3_000_000, 29_000, 0.01)])
def test_binomial_tail(spark, n, k, rate):
    from pyspark.sql import functions as F

    got = spark.range(1).select(quality_rules.log_tail(F.lit(float(k)), F.lit(float(n)), rate).alias("t")).first().t
    terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(rate) + (n - i) * math.log1p(-rate) for i in range(k + 1)]
    top = max(terms)
    assert got == pytest.approx(top + math.log(sum(math.exp(t - top) for t in terms)), abs=1e-6)


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")

SECRETS = [
    "PASSWORD: 'hunter22' é🙂 token=abc secret==abcdefgh password=token:abcdef",
    "AKIA" + "A1" * 8 + " AKIAAKIA AKIA" + "B" * 40,
    "x" + "0123456789abcdef" * 2 + "g" + "a" * 23 + " " + "f" * 24,
    "api_key=" + "a1" * 20 + "\napikey : \"" + "z" * 6 + "\" passwd=" + "q" * 5,
    "token=secret=abcdef token = \t x",
    "🙂" * 50 + " Secret=🙂abcdefg secret=abcdefg",
    "AKIA" + "C" * 16 + "d" * 30,
]


def base_of(text):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))


def test_base_spans(spark, docs, texts):
    rng = random.Random(9)
    parts = ["password", "Token", "api_key", "=", ":", " ", "'", "abcdef", "AKIA", "A1B2", "0a" * 6, "é", "🙂", ".", "=="]
    rows = texts + [(1000 + i, t) for i, t in enumerate(SECRETS)] + [(2000 + i, "".join(rng.choice(parts) for _ in range(40))) for i in range(300)]
    found = secret_scan.spans(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", secret_scan.listed("assign", "access", "hex").alias("base")).collect()
    assert sorted((str(r.doc_id), r.base) for r in found) == sorted((str(i), base_of(t or "")) for i, t in rows)


def random_rows():
    rng = random.Random(4)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    words = ["".join(rng.choice(["tion", "ment", "ver", "heit", "lich", "ung", "ing", "ed"]) for _ in range(8)) for _ in range(3000)]
    keys = ["".join(rng.choice(letters) for _ in range(44)) for _ in range(40)]
    plain = ["/".join(rng.choice(["usr", "share", "lib2", "docs"]) for _ in range(9)) for _ in range(40)]
    rows = [(i, f"é {words[i]} {words[-i]} here") for i in range(1500)]
    return rows + [(5000 + i, f"see {k} now") for i, k in enumerate(keys)] + [(6000 + i, f"see {p} now") for i, p in enumerate(plain)], keys


def test_random_keys_are_found_and_words_are_not(spark):
    rows, keys = random_rows()
    found = secret_scan.spans(spark.createDataFrame(rows, "doc_id long, text string")).filter("size(random) > 0").collect()
    at = dict(rows)
    hits = [(r.doc_id, at[r.doc_id][s.start : s.end]) for r in found for s in r.random]
    assert sum(i in range(5000, 6000) for i, _ in hits) >= 36 and all(t == keys[i - 5000] for i, t in hits if 5000 <= i < 6000)
    assert sum(i < 5000 or i >= 6000 for i, _ in hits) <= 2


def test_redaction(spark, docs, none, texts):
    rows, keys = random_rows()
    done = {r.doc_id: r for r in secret_scan.redacted(spark.createDataFrame([(i, t, len(t)) for i, t in rows + list(enumerate(SECRETS, 9000))], "doc_id long, text string, n_chars long")).collect()}
    assert sum(done[5000 + i].text == "see [SECRET] now" for i in range(len(keys))) >= 36
    assert done[9000].text == "[SECRET]' é🙂 token=abc [SECRET] password=token:abcdef"
    assert all(r.n_chars == len(r.text) for r in done.values())
    same = secret_scan.redacted(docs)
    assert same.columns == docs.columns and sorted(map(str, same.collect())) == sorted(map(str, docs.collect()))
    assert secret_scan.redacted(none).count() == 0 and secret_scan.spans(none).count() == 0




def by_plain_python(rows):
    """The method's spans (row, text) one run at a time: battery, text model and limits."""
    count = defaultdict(int)
    for _, text in rows:
        for token in re.findall("[a-z0-9]{2,19}", (text or "").lower()):
            for a, b in zip(token, token[1:]):
                count[a, b] += not (a.isdigit() and b.isdigit())
    symbols = "abcdefghijklmnopqrstuvwxyz0123456789"
    after = {a: sum(count[a, b] for b in symbols) for a in symbols}
    log_p = {(a, b): max(-5.0, math.log((count[a, b] + 0.5) / (after[a] + 18))) for a in symbols for b in symbols}
    total = sum(count.values())
    mean = sum(n * log_p[p] for p, n in count.items() if n) / total
    variance = sum(n * (log_p[p] - mean) ** 2 for p, n in count.items() if n) / total
    normal = lambda z: math.erfc(abs(z) / math.sqrt(2))
    runs = []
    for i, text in rows:
        base = [(m.start(), m.end()) for m in secret_base(text)]
        for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}", text):
            if any(a < m.end() and m.start() < b for a, b in base):
                continue
            name, alphabet = next(((n, a) for n, a, p in secret_scan.ENCODINGS if re.search(p, m[0])), (None, None))
            if name in (None, "letters"):
                continue
            plain = m[0].replace("-", "+").replace("_", "/") if name == "base64" else m[0].lower()
            x, k = [alphabet.index(c) for c in plain], len(alphabet)
            n, free = len(x), k - 1
            chi = ((max(0, k / n * sum(x.count(v) ** 2 for v in set(x)) - n) / free) ** (1 / 3) - (1 - 2 / (9 * free))) / (2 / (9 * free)) ** 0.5
            low, turns = sum(v < k / 2 for v in x), 1 + sum((a < k / 2) != (b < k / 2) for a, b in zip(x, x[1:]))
            t = 2 * low * (n - low)
            z_runs = (turns - 1 - t / n) / math.sqrt(t * (t - n) / (n * n * (n - 1))) if t > n else 40.0
            mid = sum(x) / n
            spread = sum((v - mid) ** 2 for v in x)
            z_serial = sum((a - mid) * (b - mid) for a, b in zip(x, x[1:])) / spread * math.sqrt(n) if spread else 40.0
            p = min(1.0, 3 * min(normal(chi), normal(z_runs), normal(z_serial)))
            segments = re.split(r"[/_+-]+|(?<=[a-z])(?=[A-Z])", m[0])
            own = [log_p[a, b] for s in segments for a, b in zip(s.lower(), s.lower()[1:]) if not (a.isdigit() and b.isdigit())]
            z = (sum(own) - len(own) * mean) / math.sqrt(len(own) * variance * 1.5) if own else 0.0
            places = min(30, math.floor((z * z / 2 + math.log(-z * math.sqrt(2 * math.pi))) / math.log(10))) if z < -1.3 else 0
            runs.append((i, m[0], sum(len(m[0]) >= e for e in (24, 32, 48, 64, 128)), p, places))
    out = []
    for length in {r[2] for r in runs}:
        mine = [r for r in runs if r[2] == length]
        fits = [k for k in range(1, 31) if (found := sum(r[4] >= k for r in mine)) and len(mine) * 10.0**-k <= secret_scan.RATE * found]
        out += [r[:2] for r in mine if fits and r[4] >= fits[0] and r[3] >= 0.001]
    return sorted(out)


def secret_base(text):
    yield from (m for m in ASSIGN.finditer(text) if len(m[2]) >= 6)
    yield from (m for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20)
    yield from (m for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24)


NAMES = [
    "static/js/main/bundle/vendor", "https://x.com/blog/2024/05/why-we-moved-to-rust ok", "org/apache/spark/sql/functions", "updateUserProfileSettings",
    "requestAnimationFrameCallback", "src/components/navigation/HeaderDropdownMenu", "AbstractSingletonProxyFactoryBean", "2024-05-17-release-notes-for-version-3",
]


@pytest.fixture(scope="module")
def keyed(spark, sf):
    """The test documents, names and paths of programs, and keys of several kinds."""
    rng = random.Random(3)
    kinds = [("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 40), ("abcdefghijklmnopqrstuvwxyz0123456789", 32), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 32), ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 36)]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(10_000 + i, n) for i, n in enumerate(NAMES)]
    for k, (letters, n) in enumerate(kinds):
        rows += [(20_000 + 1000 * k + i, "key " + "ghp_" * (k == 3) + "".join(rng.choice(letters) for _ in range(n))) for i in range(40)]
    found = secret_scan.spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).filter("size(random) > 0").collect()
    texts = dict(rows)
    return rows, sorted((r.doc_id, texts[r.doc_id][s.start : s.end]) for r in found for s in r.random)


def test_names_and_paths_are_text_and_keys_are_not(keyed):
    _, found = keyed
    assert not [f for f in found if f[0] < 20_000]
    for k in range(4):
        assert len([f for f in found if 20_000 + 1000 * k <= f[0] < 21_000 + 1000 * k]) >= 38


def test_random_spans_by_plain_python(keyed):
    rows, found = keyed
    assert found == by_plain_python(rows)
