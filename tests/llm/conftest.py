from __future__ import annotations

import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def table(spark):
    def make(rows, schema="doc_id long, text string"):
        return spark.createDataFrame(rows, schema).repartition(3)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and white-space texts, ties, repeated rows and a long text."""
    long = " ".join(f"w{i % 977}" for i in range(40_000))
    return [
        (1, "one two three four five six seven"),
        (1, "one two three four five six seven"),
        (1, "another text of the same id"),
        (2, None),
        (3, ""),
        (4, " \n\t "),
        (None, "one two three four five six seven"),
        (None, None),
        (5, long),
        (6, long + " end"),
        (7, "x"),
    ]


@pytest.fixture(scope="session")
def prose():
    """Seeded texts with copies, changed copies and shared passages."""
    rnd = random.Random(5)
    vocabulary = [f"{a}{b}" for a in "abcdefgh" for b in ("an", "en", "é", "ost", "u.", "i,")]
    make = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    passages = [make(30) for _ in range(3)]
    out = []
    for i in range(90):
        kind = i % 6
        if kind < 3 or not out:
            text = make(rnd.randint(3, 120))
        elif kind == 3:
            text = list(rnd.choice(out)[1])
        elif kind == 4:
            text = list(rnd.choice(out)[1])
            for _ in range(max(1, len(text) // 60)):
                text[rnd.randrange(len(text))] = rnd.choice(vocabulary)
        else:
            text = make(rnd.randint(0, 40)) + rnd.choice(passages) + make(rnd.randint(0, 40))
        out.append((i, text))
    return [(i, " ".join(t)) for i, t in out]
