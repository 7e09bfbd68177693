import random

import pytest

from batchloom.llm import near_dedup
from batchloom.llm.graph import components
from batchloom.llm.near_dedup import keep_one, near_duplicates

from conftest_words import words_of


def sets_of(rows, width):
    out = []
    for doc_id, text, *_ in rows:
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in words_of(text)]
        grams = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
        out.append((doc_id, grams))
    return out


def brute_force(rows, width):
    sets = sets_of(rows, width)
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    known = [(i, s) for i, s in sets if i is not None]
    for i, s in known:
        root(i)
        for j, t in known:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    out = []
    for i, s in sets:
        component = None if i is None else root(i) if s else i
        out.append((i, len(s), component, i is None or i == component))
    return sorted(map(str, out))


@pytest.mark.parametrize("width", [4, 5])
def test_equals_brute_force(messy, rows, width):
    got = near_duplicates(messy, width=width)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_force(rows, width)


def test_large_groups_of_near_copies(spark, monkeypatch):
    """Long lists: pivots and what they leave give the same groups as all pairs."""
    monkeypatch.setattr(near_dedup, "SHORT", 4)
    rng = random.Random(3)
    word = lambda: f"v{rng.randrange(5000)}"
    line = [word() for _ in range(12)]
    rows = []
    for group in range(4):
        base = [word() for _ in range(120)]
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.randrange(6)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
    for _ in range(40):  # unrelated texts with a line in common
        rows.append((len(rows), " ".join([word() for _ in range(30)] + line + [word() for _ in range(20)])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = near_duplicates(df, width=4)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_force(rows, 4)


def test_keep_one(messy, rows, empty):
    kept = keep_one(messy, width=4)
    assert kept.columns == messy.columns
    ids = [r["doc_id"] for r in kept.collect()]
    named = [i for i in ids if i is not None]
    assert len(named) == len(set(named))
    expected = {eval(x)[0] for x in brute_force(rows, 4) if eval(x)[3]}
    assert set(ids) == expected
    assert near_duplicates(empty).collect() == [] and keep_one(empty).collect() == []


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)]
    star = [(100, i) for i in range(101, 160)]
    odd = [(7, 7), (None, 3), (200, 201), (201, 200), (200, 201)]
    got = components(spark.createDataFrame(chain + star + odd, "a long, b long"))
    found = {r["node"]: r["component"] for r in got.collect()}
    assert found == {
        **{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200
    }
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
