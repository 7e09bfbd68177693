import random

import numpy as np
import pytest

from batchloom.llm import decontaminate
from batchloom.llm.decontaminate import GAP, MATCH, MISMATCH, SEED, align, contaminated, without_contaminated

from conftest_words import words_of


def slow_align(own, other):
    best, last = 0, 0
    table = [[0] * (len(other) + 1) for _ in range(len(own) + 1)]
    for i, a in enumerate(own, 1):
        for j, b in enumerate(other, 1):
            table[i][j] = max(
                0, table[i - 1][j - 1] + (MATCH if a == b else MISMATCH), table[i - 1][j] + GAP, table[i][j - 1] + GAP
            )
            if table[i][j] > best:
                best = table[i][j]
    ends = [j for j in range(1, len(other) + 1) for i in range(len(own) + 1) if best and table[i][j] == best]
    return best, min(ends) - 1 if ends else 0


def test_alignment():
    rng = random.Random(4)
    for _ in range(300):
        own = [rng.randrange(4) for _ in range(rng.randint(1, 9))]
        other = [rng.randrange(4) for _ in range(rng.randint(1, 14))]
        assert align(np.array(own), np.array(other)) == slow_align(own, other)


def words(rng, n):
    return [f"q{rng.randrange(3000)}" for _ in range(n)]


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(8)
    items = [(i, words(rng, rng.randint(13, 50))) for i in range(40)]
    docs, expected = [], set()
    for i, (item, own) in enumerate(items):
        copy = list(own)
        kind = i % 5
        if kind == 1:  # edited
            for k in range(2, len(copy), 6):
                copy[k] = "changed"
        elif kind == 2:  # cut short
            copy = copy[: int(len(copy) * 0.8)]
        elif kind == 3:  # words put in
            copy = [x for k, w in enumerate(copy) for x in ([w, "added"] if k % 7 == 3 else [w])]
        elif kind == 4:  # too little of it
            copy = copy[: max(SEED, len(copy) // 5)]
        text = words(rng, 80) + [w.upper() + "," for w in copy] + words(rng, 60)
        docs.append((i, " ".join(text)))
        if kind != 4:
            expected.add((i, item))
    docs += [(100 + i, " ".join(words(rng, 200))) for i in range(30)]
    docs += [(200, None), (201, ""), (0, docs[0][1]), (None, docs[5][1])]
    items = [(i, " ".join(w)) for i, w in items] + [(50, None), (51, ""), (52, "two words"), (0, " ".join(items[0][1]))]
    d = spark.createDataFrame([(*r, "clash", "clash") for r in docs], "doc_id long, text string, item_id string, score string")
    b = spark.createDataFrame([(*r, "clash") for r in items], "item_id long, text string, doc_id string")
    return d.repartition(4), b, expected


def test_planted_copies(planted):
    docs, items, expected = planted
    rows = contaminated(docs, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == expected | {(None, 5)}
    whole = [r for r in rows if r["doc_id"] is not None and r["doc_id"] % 5 == 0]
    assert all(r["score"] == 1 and r["first_word"] == 80 for r in whole)
    texts = {r["doc_id"]: words_of(r["text"]) for r in docs.collect()}
    for r in whole:
        assert r["last_word"] < len(texts[r["doc_id"]]) - 59
    kept = without_contaminated(docs, items)
    assert kept.columns == docs.columns
    left = [r["doc_id"] for r in kept.collect()]
    assert set(left) == set(texts) - {i for i, _ in expected} - {None}


def test_blocks_of_items(planted, monkeypatch):
    docs, items, expected = planted
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 200)
    found = contaminated(docs, items)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == expected | {(None, 5)}


def test_an_item_in_a_third_of_all_documents(spark):
    rng = random.Random(9)
    item = words(rng, 30)
    docs = [(i, " ".join(words(rng, 50) + (item if i % 3 == 0 else []) + words(rng, 9))) for i in range(90)]
    found = contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"),
    )
    assert {r["doc_id"] for r in found.collect()} == set(range(0, 90, 3))


def test_no_copy_is_missed(spark):
    """The same copies as alignment of every item with every text, without seeds."""
    rng = random.Random(12)
    common = ["the", "of", "and", "to"]
    some = lambda n: [rng.choice(common) if rng.random() < 0.4 else f"q{rng.randrange(300)}" for _ in range(n)]
    items = [some(n) for n in (3, 4, 6, 9, 12, 15, 15, 18, 20, 20, 25, 30)]
    docs = []
    for own in items:
        copies = [
            ["changed" if k % 3 == 2 else w for k, w in enumerate(own)],
            [x for w in own for x in (w, "added")],
            [w for k, w in enumerate(own) if k % 3 != 1],
            *[[w if rng.random() > 0.3 else f"r{rng.randrange(99)}" for w in own] for _ in range(4)],
            own[len(own) // 2 :],
        ]
        docs += [some(rng.randrange(50)) + copy + some(rng.randrange(30)) for copy in copies]
    docs += [some(150) for _ in range(20)]
    expected = {}
    for d, text in enumerate(docs):
        for i, own in enumerate(items):
            score, last = slow_align(own, text)
            if score >= decontaminate.THRESHOLD * MATCH * len(own):
                expected[d, i] = (score / (MATCH * len(own)), last)
    rows = contaminated(
        spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(docs)], "doc_id long, text string"),
        spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string"),
    ).collect()
    assert {(r["doc_id"], r["item_id"]): (r["score"], r["last_word"]) for r in rows} == expected
    assert len(rows) == len(expected) > 70


def test_items_of_one_and_two_words(spark):
    """Found as a whole, each in every text that holds it, beside longer items."""
    rng = random.Random(21)
    some = lambda n: [f"w{rng.randrange(60)}" for _ in range(n)]
    docs = [some(rng.randrange(60)) for _ in range(150)] + [["w1"], ["w2", "w1"], [], some(9) * 300]
    items = [["w1"], ["w2"], ["W1"], ["w2", "w1"], ["w2", "w1"], ["w3", "w3"], ["gone"], ["w7", "gone"], []]
    items += [["w8", "w9"], some(12)]
    expected = {}
    for d, text in enumerate(docs):
        for i, own in enumerate(items[:-1]):
            own = [w.lower() for w in own]
            places = [k for k in range(len(text)) if own and text[k : k + len(own)] == own]
            if places:
                expected[d, i] = (1.0, places[0], places[0] + len(own) - 1)
    d = spark.createDataFrame([(n, ", ".join(t)) for n, t in enumerate(docs)], "doc_id long, text string").repartition(3)
    b = spark.createDataFrame([(n, " ".join(t)) for n, t in enumerate(items)], "item_id long, text string")
    rows = [r for r in contaminated(d, b).collect() if r["item_id"] < len(items) - 1]
    assert {(r["doc_id"], r["item_id"]): (r["score"], r["first_word"], r["last_word"]) for r in rows} == expected
    assert len(rows) == len(expected) > 150
    only = contaminated(d, b.where("item_id < 9"))
    assert {(r["doc_id"], r["item_id"]) for r in only.collect()} == {k for k in expected if k[1] < 9}
    left = {r["doc_id"] for r in without_contaminated(d, b.where("item_id < 9")).collect()}
    assert left == set(range(len(docs))) - {doc for doc, item in expected if item < 9}


def test_nothing(planted, empty):
    docs, items, _ = planted
    assert contaminated(docs, items.limit(0)).collect() == []
    assert contaminated(empty, items).collect() == []
    assert without_contaminated(docs, items.limit(0)).count() == docs.count()
