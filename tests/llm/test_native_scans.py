"""License scans and quality rules against plain Python."""

import math
import re
import string
from collections import Counter

import pytest

from batchloom.llm import quality
from batchloom.llm.license_scan import (
    LEAST, PHRASES, SLACK, TEMPLATES, scan_licenses,
)
from batchloom.llm.quality import judge_quality, shapes_of

from conftest_words import words_of

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
LICENSE_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

TEXTS = [
    "Released under the MIT License.",
    "x " * 40 + "Licensed under the Apache License, Version 2.0. and more",
    "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under CC BY-NC 4.0.",
    "ALL rights\nreserved. all rights reserved all rights",
    "cc by cc by cc by",
    "the general public license",
    "mit license",
    "apache license",
    "Permission is hereby granted, free of charge, to any person getting a copy of this software",
    "permission is hereby granted",
    "KK cc by ćc by Ünder CC-BY; ÄLL RIGHTS RESERVED",
    "cc by" * 3,
    "released under an mit license or licensed under the apache license version 2 0, all rights reserved",
    "license public general",
    "redistribution and use in source and binary forms, with modification, are permitted",
    None,
    "",
    "...",
    "word " * 3000 + "all rights reserved " + "of the mozilla public license " * 3,
]


def places(words, phrase):
    return [i for i in range(len(words) - len(phrase) + 1) if words[i : i + len(phrase)] == phrase]


def brute_licenses(texts):
    out = []
    for text in texts:
        words = LICENSE_WORD.findall((text or "").translate(LOWER))
        base = {p: places(words, p.split()) for p in PHRASES}
        at = [i for found in base.values() for i in found]
        labels, score, _ = every_place(text or "")
        out.append(
            (
                len(words), len(at), min(at, default=None), max(at, default=None),
                ",".join(sorted(PHRASES[p] for p, hits in base.items() if hits)), labels, round(score, 9),
            )
        )
    return out


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, t, "clash", "clash") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + rows[:1], "doc_id long, text string, n_words string, word string")


def listed(df):
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    return [(r["doc_id"], *(round(r[n], 9) if n == "score" else r[n] for n in names)) for r in df.collect()]


def test_licenses(texts, messy, rows):
    got = scan_licenses(texts)
    expected = brute_licenses(TEXTS + TEXTS[:1])
    assert sorted(listed(got)) == sorted((i % len(TEXTS), *e) for i, e in enumerate(expected))
    labels = dict((r[0], r[6]) for r in listed(got))
    assert labels[0] == "mit" and labels[1] == "apache" and labels[3] == "cc-by" and labels[14] == ""
    assert labels[13] == "apache,mit,reserved"
    got = scan_licenses(messy)
    expected = brute_licenses([r[1] for r in rows])
    assert sorted(map(str, listed(got))) == sorted(str((r[0], *e)) for r, e in zip(rows, expected))
    assert {r["word"] for r in scan_licenses(texts).collect()} == {"clash"}


def every_place(text):
    """Labels, score and spans by trying every template at every place."""
    words = LICENSE_WORD.findall(text.translate(LOWER))
    found = []
    for t in TEMPLATES:
        own = t.text.split()
        for place in range(-len(own), len(words)):
            near = words[max(0, place - SLACK) : max(0, place + len(own) + SLACK)]
            same = sum(0 <= place + j < len(words) and words[place + j] == w for j, w in enumerate(own))
            if same / len(own) >= LEAST and places(near, t.phrase.split()):
                found.append((t.label, place, round(same / len(own), 9)))
    base = {label for phrase, label in PHRASES.items() if places(words, phrase.split())}
    score = max((s for *_, s in found), default=1.0 if base else 0.0)
    return ",".join(sorted(base | {label for label, *_ in found})), score, sorted(found)


def test_no_licence_hides_another(spark):
    """Two templates in one file, in all orders, with and without edits and a text between."""
    pairs = [(a.text, b.text) for a in TEMPLATES for b in TEMPLATES if a != b]
    texts = [f"{a}. {b}" for a, b in pairs]
    texts += [f"intro {a} {'the work of 2 and 0 under the form ' * 30} {b}" for a, b in pairs]
    texts += [f"{' '.join(['x', *a.split()[1:]])} {' '.join([*b.split()[:-1], 'x'])}" for a, b in pairs]
    texts += [" ".join(t.text for t in TEMPLATES), TEMPLATES[0].text]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in scan_licenses(df).collect():
        spans = sorted((s["label"], s["place"], round(s["score"], 9)) for s in r["spans"] or [])
        assert (r["labels"], round(r["score"], 9), spans) == every_place(texts[r["doc_id"]])


def test_licenses_in_an_empty_table(empty):
    assert scan_licenses(empty).collect() == []


def test_native(texts, spark):
    labels = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    for df in (scan_licenses(texts), judge_quality(texts, labels)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan


def counts(text):
    text = text or ""
    words = words_of(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {
        i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)
    }
    lines = [line for line in text.split("\n") if words_of(line)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)), len(covered), failed,
    )


QUALITY_TEXTS = [
    "De De De De", "a b c a b c", "a b c b c a b c", "x y z " * 60, "one\ntwo\none\n \n \none ", "a\n\na",
    "#*$%&|<> # **", "naïve 中文 words " * 30, " ".join(map(str, range(100))), None, "", "\x0b\x0c\r\n\t ",
    " ".join(map(str, range(100))) + " 5 6 7 8", "   x",
]


def test_counts(spark, messy, rows):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(QUALITY_TEXTS)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = {r["doc_id"]: tuple(r[n] for n in names) for r in judge_quality(df, labels).collect()}
    assert got == {i: counts(t) for i, t in enumerate(QUALITY_TEXTS)}
    found = judge_quality(messy, labels)
    assert [c for c in messy.columns if c not in found.columns] == []
    assert sorted(str((r["doc_id"], *(r[n] for n in names))) for r in found.collect()) == sorted(
        str((r[0], *counts(r[1]))) for r in rows
    )
    assert all(abs(r["score"]) < 1e-9 for r in found.collect())


def test_ratio(spark):
    """The score is the mean log ratio of smoothed shares over pairs of shapes."""
    good = [f"Some words here, and more of them {i} " * 12 for i in range(20)]
    junk = ["LOUD!! TEXT!! HERE!! " * 30, "a%%% b### c$$$ " * 30]
    texts = good + junk * 5
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame(
        [(i, 1) for i in range(0, 20, 2)] + [(21, 0), (0, 1), (1, None), (None, 1), (999, 1)],
        "doc_id long, quality int",
    )
    got = {r["doc_id"]: r for r in judge_quality(df, labels).collect()}
    shapes = {
        r["doc_id"]: r["s"].split(" ") for r in df.select("doc_id", shapes_of(df["text"]).alias("s")).collect()
    }
    pairs = {i: list(zip(s, s[1:])) for i, s in shapes.items()}
    raw = Counter(p for own in pairs.values() for p in own)
    target = Counter(p for i in range(0, 20, 2) for p in pairs[i])
    n_raw, n_target = sum(raw.values()), sum(target.values())

    def weight(p):
        share = (raw[p] + 1) / (n_raw + quality.BUCKETS)
        return math.log((target[p] + quality.PRIOR * share) / (n_target + quality.PRIOR) / share)

    for i, own in pairs.items():
        assert got[i]["score"] == pytest.approx(sum(map(weight, own)) / len(own), abs=1e-9)
    assert shapes[20][:3] == ["^", "A!", "A!"] and shapes[0][1:4] == ["Aa", "a", "a,"]
    assert not any(got[i]["score"] >= quality.THRESHOLD for i in range(20, 30))
    assert all(got[i]["score"] >= quality.THRESHOLD for i in range(20))


def test_quality_of_nothing(empty, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert judge_quality(empty, labels).collect() == []
