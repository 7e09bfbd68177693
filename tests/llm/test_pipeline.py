"""Each stage on the output of the one before, against plain Python."""

import base64
import re

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from batchloom.llm.decontaminate import MATCH, THRESHOLD
from batchloom.llm.language_id import UNKNOWN, predict_language

from test_decontaminate import slow_align
from test_near_dedup import brute_force as brute_groups
from test_substring_dedup import brute_force as brute_repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """The table before and after each stage, written and read again."""
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [(10_000, None, "en", "x", None), (10_001, "", None, None, 0), (10_002, "1 2 3 !", "en", "x", 7)]
    out = [docs.unionByName(spark.createDataFrame(odd, SCHEMA))]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], sf).write.parquet(str(folder / name))
        out.append(spark.read.parquet(str(folder / name)))
    return out


def as_rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "near_dedup", "substring_dedup", "decontaminate", "byte_bpe"
    ]
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns


def test_languages(stages):
    before, after = dict(as_rows(stages[0])), dict(as_rows(stages[1]))
    judged = {r["doc_id"]: r for r in predict_language(stages[0]).collect()}
    assert set(after) == {
        i for i, r in judged.items() if r["lang_pred"] != UNKNOWN and not r["ambiguous"]
    }
    assert all(after[i] == before[i] for i in after)
    assert not {10_000, 10_001, 10_002} & set(after)
    clean = [i for i, t in before.items() if t and re.search(r"[^\W\d_]{2}", t)]
    assert len(set(clean) & set(after)) >= 0.99 * len(clean)


def test_near_copies(stages):
    expected = {eval(x)[0] for x in brute_groups(as_rows(stages[1]), 5) if eval(x)[3]}
    assert sorted(i for i, _ in as_rows(stages[2])) == sorted(expected)


def test_passages(stages):
    expected = {r[0]: r[1] for r in brute_repeats(as_rows(stages[2]), 35)}
    assert dict(as_rows(stages[3])) == expected
    assert all(r["n_chars"] == len(r["text"]) for r in stages[3].collect())


def test_benchmark(spark, sf, stages):
    split = lambda text: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
    items = [split(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = {i for i, _ in as_rows(stages[4])}
    for doc_id, text in as_rows(stages[3]):
        words = split(text)
        seeds = {tuple(words[i : i + 3]) for i in range(len(words) - 2)}
        hit = False
        for item in items:
            if sum(tuple(item[i : i + 3]) in seeds for i in range(len(item) - 2)) > 1:
                hit = hit or slow_align(item, words)[0] >= THRESHOLD * MATCH * len(item)
        assert (doc_id in left) == (not hit)


def test_ids(stages):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    tik = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    texts = dict(as_rows(stages[4]))
    rows = stages[5].collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        assert r["text"] == texts[r["doc_id"]] and r["token_ids"] == tik.encode_ordinary(r["text"])
        assert r["n_tokens"] == len(r["token_ids"])


def test_run(spark, sf, stages):
    expected = {r["doc_id"] for r in stages[5].collect()}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()} == expected
