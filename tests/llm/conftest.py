from __future__ import annotations

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

CLASHING = "n_words string, score string, kept string, id string, key string, bucket string, label string"
SCHEMA = f"doc_id long, text string, lang string, {CLASHING}"


def prose(rng, n, vocabulary=400):
    return " ".join(
        "".join(rng.choice("aeioustnrlmd") for _ in range(rng.randint(2, 7)))
        if rng.random() < 0.5
        else f"w{int(rng.random() ** 2 * vocabulary)}"
        for _ in range(n)
    )


def messy_rows():
    """Documents with everything that a table may bring along."""
    rng = random.Random(5)
    texts = [prose(rng, rng.choice([1, 2, 3, 8, 60, 90, 300])) for _ in range(60)]
    passage = prose(rng, 60)
    texts += [f"{prose(rng, 40)} {passage}\n{prose(rng, 30)}" for _ in range(6)]
    texts += [texts[40], texts[40].upper(), texts[41], texts[41]]  # copies
    for _ in range(8):  # near copies
        words = texts[45].split()
        words[rng.randrange(len(words))] = "edited"
        texts.append(" ".join(words))
    texts += ["", " \n\t ", None, "!!! ...", "Ünïcödé 中文 😀  naïve", "a", "a b", "a b", "A B"]
    texts += ["same " * 200, "x" * 5000, prose(rng, 20_000)]
    rows = [(i, t, ["en", "de", None][i % 3]) for i, t in enumerate(texts)]
    rows += [rows[40], rows[40], rows[66]]  # repeated rows
    rows += [(None, "a text without an id " * 20, "en"), (None, None, None)]
    rows += [(3, prose(rng, 80), "en")]  # an id that is taken
    return [(*row, *["clash"] * 7) for row in rows]


@pytest.fixture(scope="session")
def rows():
    return messy_rows()


@pytest.fixture(scope="session")
def messy(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
