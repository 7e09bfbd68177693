import re
from collections import Counter

import pytest

from batchloom.llm.substring_dedup import ADDED, remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_force(rows, window):
    words = [WORD.findall(text or "") for _, text, *_ in rows]
    seen = Counter(
        tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1)
    )
    out = []
    for (doc_id, *_), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        spans = []
        for i in sorted(gone):
            if spans and spans[-1][1] == i:
                spans[-1][1] = i + 1
            else:
                spans.append([i, i + 1])
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, kept, len(w), len(gone), [tuple(s) for s in spans]))
    return out


def result(df):
    return [
        (r["doc_id"], r["text"], r["n_words"], r["n_removed"], [tuple(s) for s in r["removed"]])
        for r in df.collect()
    ]


@pytest.mark.parametrize("window", [3, 35])
def test_equals_brute_force(messy, rows, window):
    got = remove_repeats(messy, window=window)
    assert sorted(map(str, result(got))) == sorted(map(str, brute_force(rows, window)))


def test_other_columns_stay(messy, empty):
    got = remove_repeats(messy)
    assert [c for c in got.columns if c not in ADDED] == [c for c in messy.columns if c not in ADDED]
    assert {r["key"] for r in got.collect()} == {"clash"}
    assert remove_repeats(empty).collect() == []


def test_partitions_do_not_matter(spark, messy):
    one = sorted(map(str, result(remove_repeats(messy.coalesce(1), window=3))))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        assert sorted(map(str, result(remove_repeats(messy.repartition(11), window=3)))) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_copies_of_a_row_in_several_pieces(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(1, text)] * 4 + [(2, text + " more"), (3, "other " * 3 + text[:400])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    expected = brute_force(rows, 35)
    assert sorted(map(str, result(remove_repeats(df)))) == sorted(map(str, expected))
