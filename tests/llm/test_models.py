"""Language identification and the language model."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from batchloom.llm.language_id import UNKNOWN, Model, codewords, features, predict_language
from batchloom.llm import language_model
from batchloom.llm.language_model import LogBilinear, Vocabulary, score_texts
from batchloom.llm.words import Words

from conftest_words import words_of


def held(doc_id, folds):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == 2


def test_languages_of_held_out_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = predict_language(docs).collect()
    assert len(rows) == len(truth)
    for row in rows:
        assert row["held_out"] == held(row["doc_id"], 4) and 0 <= row["score"] <= 1
    own = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in own) >= 0.97 * len(own)
    # source, id and the language of the row itself are not looked at
    from pyspark.sql import functions as F

    blind = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 != 2, F.col("lang")))
    blind = blind.withColumn("source", F.lit(None).cast("string"))
    again = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in predict_language(blind).collect()}
    assert again == {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows}


def test_messy_texts(messy, rows, empty):
    got = predict_language(messy)
    assert got.columns == [c for c in messy.columns if c != "score"] + ["held_out", "lang_pred", "score", "ambiguous"]
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == UNKNOWN) == (not letters) and (r["score"] == 0) == (not letters)
        assert r["lang_pred"] in ("en", "de", UNKNOWN)
    assert predict_language(empty).collect() == []
    assert {r["lang_pred"] for r in predict_language(messy.where("lang IS NULL")).collect()} == {UNKNOWN}


def test_slices_of_long_texts(monkeypatch):
    from batchloom.llm import language_id

    texts = pa.array(["Ünïcödé 中文 naïve", None, "ab", "", "1 ab cd é" * 20, "ß"])
    whole = sorted(zip(*[x.tolist() for x in features(texts)]))
    for size in (1, 2, 3, 7, 50):
        monkeypatch.setattr(language_id, "SLICE_BYTES", size)
        assert sorted(zip(*[x.tolist() for x in features(texts)])) == whole
    monkeypatch.undo()
    model = Model(["a", "b"], np.ones((2, language_id.BUCKETS)))
    margins, size = model.margins(pa.array(["word " * 10_000_000]))
    assert size.tolist() == [2 * 4 * 10_000_000] and margins.shape == (1, 1)


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 6, 12, 30):
        code = codewords(n)
        distance = min(
            int((code[i] != code[j]).sum()) for i in range(n) for j in range(i)
        )
        assert distance >= (1 if n == 2 else 2 if n == 3 else 4)
        assert len({tuple(c) for c in code.T}) > 0 and not (abs(code.sum(axis=0)) == n).any()


def test_a_wrong_bit_is_corrected():
    model = Model(["a", "b", "c", "d"], np.ones((4, 8)))
    for i in range(4):
        for bit in range(model.code.shape[1]):
            margins = model.code[i : i + 1].copy()
            margins[0, bit] *= -1
            assert model.decode(margins)[0][0] == i
    assert model.decode(np.zeros((1, model.code.shape[1])))[2][0]  # nothing speaks for any of them


def test_features_stay_inside_a_text():
    apart = features(pa.array(["ab", "cd"]))
    first, second = features(pa.array(["ab"])), features(pa.array(["cd"]))
    assert sorted(apart[1][apart[0] == 0]) == sorted(first[1]) and sorted(apart[1][apart[0] == 1]) == sorted(second[1])
    assert len(features(pa.array(["1 !", None, ""]))[0]) == 0
    assert features(pa.array(["ÀB"]))[1].tolist() == features(pa.array(["àb"]))[1].tolist()


def fold(word):
    return word.translate({c: c + 32 for c in range(65, 91)})


def test_base_scores(messy, rows, empty):
    tokens = [[*map(fold, words_of(r[1])), None] for r in rows]
    learnt = Counter(
        t for r, own in zip(rows, tokens) if r[0] is not None and not held(r[0], 7) for t in own
    )
    n, v = sum(learnt.values()), len(learnt)
    expected = [
        (
            r[0], held(r[0], 7), len(own), sum(learnt[t] > 0 for t in own), n,
            round(float(sum(np.log10((learnt[t] + 1) / (n + v + 1)) for t in own)), 5),
        )
        for r, own in zip(rows, tokens)
    ]
    got = [
        (*(r[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")), round(r["base_score"], 5))
        for r in score_texts(messy).collect()
    ]
    assert sorted(map(str, got)) == sorted(map(str, expected))
    assert score_texts(empty).collect() == []


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    rows = score_texts(df).collect()
    assert [(r["train_tokens"], r["base_score"]) for r in rows] == [(0, 0.0)] * 2
    assert all(abs(r["score"]) < 1e-6 for r in rows)


def test_probabilities_are_normalised_and_learnt():
    rng = np.random.default_rng(1)
    vocabulary = Vocabulary([(i * 7919, 1000 - i) for i in range(1, 30)], 40_000, 500)
    model = LogBilinear(vocabulary)
    # class i is mostly followed by class i + 1
    chain = [0]
    for _ in range(40_000):
        chain.append((chain[-1] + 1) % 30 if rng.random() < 0.7 else int(rng.integers(30)))
    classes = np.array(chain)
    one, two = np.roll(classes, 1), np.roll(classes, 2)
    before = model.log_probabilities(one, two, classes).mean()
    for turn in range(40):
        model.train(one, two, classes, turn)
    after = model.log_probabilities(one, two, classes).mean()
    assert after > before + 0.3
    for a, b in ((3, 4), (29, 30), (30, 30)):
        logs = model.log_probabilities(np.full(30, a), np.full(30, b), np.arange(30))
        assert np.exp(logs).sum() == pytest.approx(1, abs=1e-4)


def test_words_of_classes_sum_to_one():
    rng = np.random.default_rng(2)
    top = [(int(h), int(c)) for h, c in zip(rng.integers(-(1 << 62), 1 << 62, 700), rng.integers(3, 900, 700))]
    near = rng.poisson(2, (700, language_model.SINGLE)).astype(float)
    vocabulary = Vocabulary(top, 1_000_000, 9_000, near)
    assert sorted(vocabulary.order.tolist()) == list(range(700))
    sizes = np.diff(vocabulary.first)
    assert sizes.sum() == 701 and (sizes[: language_model.SINGLE] == 1).all() and sizes.max() <= 700**0.5
    by_hash = dict(top)
    hashes = np.array(list(by_hash), dtype=np.int64).view(np.uint64)
    words = vocabulary.classes(hashes)
    assert sorted(words.tolist()) == list(range(700))
    assert vocabulary.counts[words].tolist() == list(by_hash.values())
    assert vocabulary.classes(hashes + np.uint64(1)).tolist() == [vocabulary.other] * 700
    model = LogBilinear(vocabulary)
    model.train(*rng.integers(0, 701, (3, 5000)), seed=1)
    for one, two in ((0, 1), (vocabulary.start, vocabulary.start), (650, vocabulary.other)):
        every = np.arange(701)
        logs = model.log_probabilities(np.full(701, one), np.full(701, two), every)
        assert np.exp(logs).sum() == pytest.approx(1, abs=1e-4)


def test_neighbours_make_classes():
    # words of two kinds, each beside frequent words of its own
    near = np.zeros((264, language_model.SINGLE))
    near[64::2, :10] = 5
    near[65::2, 10:20] = 5
    vocabulary = Vocabulary([(i * 977, 5000 - i) for i in range(264)], 10**6, 264, near)
    for lo, hi in zip(vocabulary.first[64:-2], vocabulary.first[65:-1]):
        assert len({int(i) % 2 for i in vocabulary.order[lo:hi]}) == 1


def test_scores_by_brute_force(spark, messy, rows, monkeypatch):
    kept, real = {}, language_model._score

    def spy(vocabulary, values):
        kept.update(vocabulary=vocabulary, values=values)
        return real(vocabulary, values)

    monkeypatch.setattr(language_model, "_score", spy)
    got = sorted((str(r["doc_id"]), r["n_tokens"], round(r["score"], 2)) for r in score_texts(messy).collect())
    vocabulary, model = kept["vocabulary"], LogBilinear(kept["vocabulary"], kept["values"])
    tokens = [[*map(fold, words_of(r[1])), None] for r in rows]
    learnt = Counter(
        t for r, own in zip(rows, tokens) if r[0] is not None and not held(r[0], 7) for t in own
    )
    words = {t for own in tokens for t in own}
    number = {}
    for t in words:
        if t is None:
            hashed = np.array([language_model.END])
        else:
            hashed = Words(pa.array([t]), fold=True).hash
        number[t] = int(vocabulary.classes(hashed)[0])
    own_words = {t for t in words if number[t] != vocabulary.other}
    assert own_words == {t for t, c in learnt.items() if c >= language_model.LEAST}
    rest = sum(c for t, c in learnt.items() if t not in own_words)
    rest_distinct = sum(t not in own_words for t in learnt)
    softmax = lambda x: x - np.log(np.exp(x.astype(float)).sum())
    known, expected = {}, []
    for r, own in zip(rows, tokens):
        one = two = vocabulary.start
        score = 0.0
        for t in own:
            w = number[t]
            if (one, two, w) not in known:
                vector = model.r[one] @ model.c1 + model.r[two] @ model.c2
                c = int(vocabulary.class_of[w])
                lo, hi = vocabulary.first[c : c + 2]
                known[one, two, w] = (
                    softmax(model.u @ vector + model.class_bias)[c]
                    + softmax(model.q[lo:hi] @ vector + model.bias[lo:hi])[w - lo]
                ) / np.log(10)
            score += known[one, two, w]
            if w == vocabulary.other:
                score += np.log10((learnt[t] + 1) / (rest + rest_distinct + 1))
            one, two = w, one
        expected.append((str(r[0]), len(own), float(score)))
    expected.sort()
    assert [g[:2] for g in got] == [e[:2] for e in expected]
    assert [g[2] for g in got] == pytest.approx([e[2] for e in expected], rel=1e-4, abs=0.02)


def test_model_beats_counts_on_held_out_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [r for r in score_texts(docs).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_vocabulary_follows_the_corpus():
    rng = np.random.default_rng(3)
    kinds = []
    for n in (1_000, 10_000):
        counts = rng.integers(language_model.LEAST, 50, n)
        kinds.append(Vocabulary([(i * 31 + 1, int(c)) for i, c in enumerate(counts)], int(counts.sum()), n))
    assert [v.n for v in kinds] == [1_000, 10_000]
    assert len(kinds[0].first) < len(kinds[1].first) < 300
