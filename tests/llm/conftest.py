"""Small tables with the cases that every operator must bear."""

import random
import zlib

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, n int, size string, _text string"


def table(spark, rows):
    """Documents with columns whose names operators might use themselves."""
    return spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 3}", None if t is None else len(t), 7, "wide", "kept") for i, t in rows], COLUMNS)


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text): copies, near copies, short, empty, white, null and very long texts, a repeated row and a null id."""
    rng = random.Random(5)
    base = [sentence(rng, rng.choice([3, 6, 8, 12, 30, 60, 200])) for _ in range(60)]
    rows = list(enumerate(base))
    for i in range(60, 130):
        words = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 6])):
            words[rng.randrange(len(words))] = rng.choice(["Zz", "q", "new"])
        rows.append((i, " ".join(words) + rng.choice(["", "", " tail", "\n"])))
    line = sentence(rng, 9)
    rows += [(i, f"{line} {sentence(rng, 3)}") for i in range(130, 150)]
    rows += [(150, ""), (151, " \t\n"), (152, None), (153, sentence(rng, 20_000)), (154, "One"), (155, "one two three"), (156, "ONE Two three"), (157, "é" * 3000)]
    return [*rows, (155, "one two three"), (None, base[0]), (None, None)]


@pytest.fixture(scope="session")
def docs(spark, texts):
    return table(spark, texts)


@pytest.fixture(scope="session")
def none(spark):
    return table(spark, [])


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2
