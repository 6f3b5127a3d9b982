import random

import pytest

from murmuration.llm.common import importable

SCHEMA = "doc_id long, text string, lang string, source string, key string, kept string, size string, n string, uid string, row string, spans string"
WORDS = [a + b for a in ("the", "ing", "ouer", "re", "at", "ion", "es", "th", "wh", "blen") for b in ("", "a", "st", "nd", "ti", "ly", "hou")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(seed=0, n=60):
    """Texts with exact copies, near copies, repeated lines and passages, blanks and nulls."""
    rng = random.Random(seed)
    base = [sentence(rng, rng.randint(30, 120)) for _ in range(8)]
    line = sentence(rng, 30)
    out = []
    for i in range(n):
        kind = i % 10
        words = rng.choice(base).split()
        if kind < 3:
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            text = " ".join(words)
        elif kind == 3:
            text = rng.choice(base)
        elif kind == 4:
            text = rng.choice(base).replace(" ", " \n\t", 3)
        elif kind == 5:
            text = f"{sentence(rng, 20)}\n{line}\n{sentence(rng, 9)}\n\n{line.upper()}"
        elif kind == 6:
            text = f"{sentence(rng, 40)} {rng.choice(base)[:200]} é ü {sentence(rng, 5)}"
        elif kind == 7:
            text = sentence(rng, rng.randint(0, 6))
        elif kind == 8:
            text = rng.choice([None, "", " \n ", "12 34"])
        else:
            text = sentence(rng, 200)
        out.append((i * 3 % (3 * n), text))
    return out


@pytest.fixture(scope="session")
def frame(spark):
    importable(spark)

    def make(rows, lang=None):
        filled = [(i, t, lang(i) if lang else None, None, "key", "kept", "size", "n", "uid", "row", "spans") for i, t in rows]
        return spark.createDataFrame(filled, SCHEMA).repartition(3)

    return make


#: Rows that every operator has to take: null ids, null and empty texts, repeated rows, one id with two texts.
ODD = [(None, "a b c d e f g h"), (None, None), (5, None), (5, None), (7, "x y z"), (7, "x y z"), (7, "other words here and there now"), (9, ""), (11, " \n\t "), (13, "a b c d e f g h")]
LONG = "word " * 200_000 + "9" * 100_000 + "a" * 300_000 + "." * 50_000 + " 1" * 100_000
