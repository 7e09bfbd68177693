import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from batchloom.llm import token_files
from batchloom.llm.byte_bpe import decode_ids, encode_texts, encoder_of, ranks_of
from batchloom.llm.pretokens import code_points, cuts
from batchloom.llm.token_files import (
    TokenFile,
    bits_for,
    document_digests,
    hub_encoder,
    open_folder,
    pack,
    to_bytes,
    unpack,
    with_starts,
    write_tokens,
)

HUB = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def hub():
    return Tokenizer.from_file(HUB)


@pytest.fixture(scope="module")
def tik():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


ALPHABET = [*"ab A1'strevmld\n\t.,!  \x1c\x85é中१½\u200b😀", "'s", "'ll", "  ", " \n", "aaaa", "==", "<|endoftext|>"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.lists(st.sampled_from(ALPHABET)).map("".join), st.text(), st.none()), max_size=6))
def test_ids_are_those_of_the_libraries(texts):
    hub = Tokenizer.from_file(HUB) if not hasattr(test_ids_are_those_of_the_libraries, "hub") else None
    if hub is not None:
        test_ids_are_those_of_the_libraries.hub = hub
        with open(RANKS, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        test_ids_are_those_of_the_libraries.tik = tiktoken.Encoding(
            "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
    hub, tik = test_ids_are_those_of_the_libraries.hub, test_ids_are_those_of_the_libraries.tik
    array = pa.array(texts, pa.string())
    ids, ends = hub_encoder(HUB)(array)
    mine, mine_ends = encoder_of(RANKS)(array)
    decoded = ranks_of(RANKS).decode(mine, mine_ends).to_pylist()
    for i, text in enumerate(texts):
        text = text or ""
        assert ids[ends[i] : ends[i + 1]].tolist() == hub.encode(text, add_special_tokens=False).ids
        assert mine[mine_ends[i] : mine_ends[i + 1]].tolist() == tik.encode_ordinary(text)
        assert decoded[i] == text.encode()


def test_long_matches(tik):
    texts = ["a" * 5000, "ab" * 3000, "=" * 4000, "\n" * 3000, "é" * 2000]
    ids, ends = encoder_of(RANKS)(pa.array(texts))
    for text, b, e in zip(texts, ends, ends[1:]):
        assert ids[b:e].tolist() == tik.encode_ordinary(text)


def test_long_texts_in_sections(tik, hub, monkeypatch):
    from batchloom.llm import pretokens

    monkeypatch.setattr(pretokens, "CHUNK_BYTES", 64)
    rng = random.Random(4)
    texts = ["".join(rng.choice(ALPHABET[:-1]) for _ in range(3000)), "x" * 500, None, "", " \n" * 200]
    ids, ends = pretokens.Encoder(ranks_of(RANKS).encode)(pa.array(texts))
    mine, mine_ends = hub_encoder(HUB)(pa.array(texts))
    for i, text in enumerate(texts):
        assert ids[ends[i] : ends[i + 1]].tolist() == tik.encode_ordinary(text or "")
        whole = hub.encode(text or "", add_special_tokens=False).ids
        assert mine[mine_ends[i] : mine_ends[i + 1]].tolist() == whole


def test_fifty_megabytes():
    part = "the first word, again\n  and 1234 é "
    text = part * (50_000_000 // len(part.encode()))
    once, _ = encoder_of(RANKS)(pa.array([part * 2]))
    ids, ends = encoder_of(RANKS)(pa.array([text]))
    assert ends.tolist() == [0, len(ids)]
    assert ranks_of(RANKS).decode(ids, ends)[0].as_py() == text.encode()
    assert ids[: len(once) - 2].tolist() == once[:-2].tolist()


def test_a_full_table_of_matches_starts_again(monkeypatch, tik):
    from batchloom.llm import pretokens

    monkeypatch.setattr(pretokens, "KNOWN", 50)
    rng = random.Random(1)
    encoder = pretokens.Encoder(ranks_of(RANKS).encode)
    for _ in range(5):
        text = " ".join("".join(rng.choice("abcdef") for _ in range(4)) for _ in range(60))
        ids, ends = encoder(pa.array([text, None, ""]))
        assert ids.tolist() == tik.encode_ordinary(text) and ends.tolist() == [0, *[len(ids)] * 3]
        assert len(encoder.known) <= 120


@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=300))
def test_packing_round_trip(bits, values):
    ids = np.array([v % (1 << bits) for v in values], dtype=np.uint64)
    words = pack(ids, bits)
    assert len(words) == -(-len(ids) // 64) * bits
    assert unpack(words, bits, len(ids)).tolist() == ids.tolist()


def test_bits():
    assert [bits_for(n) for n in (1, 2, 3, 256, 257, 50_257, 65_536, 65_537)] == [1, 1, 2, 8, 9, 16, 16, 17]


def test_random_access_reads_a_few_blocks():
    rng = np.random.default_rng(0)
    sizes = [5, 0, 10_000, 1, 4096, 30_000]
    ids = rng.integers(0, 50_257, sum(sizes))
    ends = np.cumsum(sizes)
    content = to_bytes([10, 11, 12, 13, 14, 15], ends, ids, 16)
    reads = []

    class File:
        def read_at(self, n, at):
            reads.append(n)
            return content[at : at + n]

    file = TokenFile(File())
    for i, (size, end) in enumerate(zip(sizes, ends)):
        assert file.document(i).tolist() == ids[end - size : end].tolist()
    assert file.ids(4095, 4097).tolist() == ids[4095:4097].tolist()
    assert reads[-1] == 2 * 4096 * 2
    assert [(d, a, x.tolist()) for d, a, x in file.documents()] == [
        (10 + i, end - size, ids[end - size : end].tolist()) for i, (size, end) in enumerate(zip(sizes, ends))
    ]


def expected_digests(rows, hub):
    """In id order; rows of equal id in the order of the bytes of their ids."""
    coded = []
    for doc_id, text, *_ in rows:
        ids = np.array([*hub.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u2")
        coded.append((doc_id is not None, doc_id or 0, ids.tobytes(), ids))
    out, start = [], 0
    for known, doc_id, _, ids in sorted(coded, key=lambda r: r[:3]):
        out.append((doc_id if known else None, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("limit", [1 << 22, 50])
def test_files_in_id_order(messy, rows, hub, monkeypatch, limit):
    monkeypatch.setattr(token_files, "FILE_IDS", limit)
    files = write_tokens(messy, HUB, 50_257)
    got = [tuple(r) for r in document_digests(files).collect()]
    assert sorted(got, key=str) == sorted(expected_digests(rows, hub), key=str)
    listed = files.collect()
    system, _ = open_folder(listed[0]["folder"])
    with system.open_input_file(listed[0]["file"]) as file:
        assert TokenFile(file).bits == 16


def test_no_documents(empty):
    assert document_digests(write_tokens(empty, HUB, 50_257)).collect() == []


def test_starts_over_levels(spark, monkeypatch):
    monkeypatch.setattr(token_files, "FANOUT", 3)
    rng = random.Random(2)
    rows = [(b, s, rng.randrange(9)) for b in range(0, 60, 2) for s in range(1 + b % 3)]
    got = with_starts(spark.createDataFrame(rows, "bucket int, seq int, n_ids bigint"), 60)
    start, expected = 0, []
    for b, s, n in rows:
        expected.append((b, s, n, start))
        start += n
    assert sorted(tuple(r) for r in got.collect()) == expected


def test_encode_and_decode_frames(messy, rows, empty, tik):
    coded = decode_ids(encode_texts(messy, RANKS), RANKS)
    assert coded.columns == [*messy.columns, "token_ids", "decoded"]
    got = sorted((str(r["doc_id"]), r["token_ids"], bytes(r["decoded"])) for r in coded.collect())
    expected = sorted(
        (str(i), tik.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in rows
    )
    assert got == expected
    assert decode_ids(encode_texts(empty, RANKS), RANKS).collect() == []
    both = encode_texts(messy, RANKS, decode=True)
    assert both.columns == coded.columns
    assert sorted((str(r["doc_id"]), r["token_ids"], bytes(r["decoded"])) for r in both.collect()) == got


def test_query_digests(spark, sf, tik):
    from batchloom.llm.queries import QUERIES

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for row in QUERIES["op5_byte_bpe"](spark, sf).collect():
        text = texts[row["doc_id"]] or ""
        ids = tik.encode_ordinary(text)
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_cuts_leave_no_gaps():
    joined, points, first = code_points(pa.array(["a  b", None, "", "c'll d"]))
    begin = cuts(points, first).tolist()
    assert [joined[b:e] for b, e in zip(begin, [*begin[1:], len(joined)])] == ["a", " ", " b", "c", "'ll", " d"]
