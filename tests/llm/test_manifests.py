"""Shards, the Merkle manifest and fill-in-the-middle next to plain Python over whole small tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from batchloom.llm.fill_in_middle import output_digests, restored, transform_texts
from batchloom.llm.merkle import FIELDS, manifest
from batchloom.llm.shards import assign_shards, plan_of, plan_shards, write_shards


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- shards ---------------------------------------------------------------------------------


def least_capacity(sizes, shards):
    """The smallest largest sum when `sizes` is cut into at most `shards` stretches."""
    ends = [0]
    for size in sizes:
        ends.append(ends[-1] + size)
    best = ends[1:]
    for _ in range(shards - 1):
        best = [
            min([end] + [max(best[j - 1], end - ends[j]) for j in range(1, i + 1)])
            for i, end in enumerate(ends[1:])
        ]
    return best[-1]


def brute_plan(sizes, shards):
    """Keys that stand alone, the least capacity of the others, and how many shards those have."""
    left, alone = dict(sizes), []
    for key in sorted(sizes, key=lambda k: (-sizes[k], k))[: shards - 1]:
        if sizes[key] * (shards - len(alone)) < sum(left.values()):
            break
        alone.append(key)
        del left[key]
    return alone, left, shards - len(alone)


@pytest.mark.parametrize("seed, cells", [(1, 4), (2, 16), (3, 1 << 14)])
def test_capacity_is_the_least(spark, seed, cells):
    rng = random.Random(seed)
    sizes = {rng.randrange(1 << 60): rng.choice([1, 5, 40, 300]) for _ in range(120)}
    if seed > 1:
        sizes[rng.randrange(1 << 60)] = 20_000
    rows = spark.createDataFrame(
        [(key, 1) for key, size in sizes.items() for _ in range(size % 3)]
        + [(key, size - size % 3) for key, size in sizes.items()],
        "key long, size long",
    )
    plan = plan_of(rows, 6, cells)
    alone, left, shards = brute_plan(sizes, 6)
    assert list(plan.alone) == alone
    limit = least_capacity([left[key] for key in sorted(left)], shards)
    assert plan.capacity == max([limit, *[sizes[key] for key in alone]])
    begin, ordered = 0, sorted(left)
    for cut in plan.cuts:
        end = ordered.index(cut) + 1
        taken = sum(left[key] for key in ordered[begin:end])
        assert taken <= limit
        # as many as fit
        assert end == len(ordered) or taken + left[ordered[end]] > limit
        begin = end
    assert begin == len(ordered) and len(plan.cuts) <= shards


def test_rows_of_shards(messy, rows):
    got = assign_shards(messy, 5).collect()
    text = lambda t: (t or "").encode()
    expected = sorted(
        (-1 if r[0] is None else r[0], len(text(r[1])) + 1, zlib.crc32(text(r[1]))) for r in rows
    )
    key = lambda r: (-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["text_crc32"])
    assert sorted(map(key, got)) == expected
    shards, slots = defaultdict(set), defaultdict(list)
    for r in got:
        shards[r["text_crc32"], r["size"]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    assert all(len(found) == 1 for found in shards.values())
    assert all(sorted(found) == list(range(len(found))) for found in slots.values())
    assert set(slots) <= set(range(5))


def test_few_texts_and_none(spark, empty):
    assert assign_shards(empty, 4).collect() == []
    same = spark.createDataFrame([(i, None if i % 2 else "") for i in range(7)], "doc_id long, text string")
    got = assign_shards(same, 4).collect()
    assert sorted(r["slot"] for r in got) == list(range(7)) and len({r["shard"] for r in got}) == 1
    with pytest.raises(ValueError):
        plan_shards(same, 0)


def test_shards_as_files(spark, messy, tmp_path):
    plan = plan_shards(messy, 5)
    write_shards(messy, plan, str(tmp_path / "out"))
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.count() == messy.count()
    count = lambda df: sorted(map(tuple, df.groupBy("shard").count().collect()))
    assert count(found) == count(assign_shards(messy, 5))


# -- manifest -------------------------------------------------------------------------------


def coded(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climb(level, at):
    """Root over the nodes of a level, and the (left, right) siblings above each place in `at`."""
    paths = {place: [] for place in at}
    where = {place: place for place in at}
    while len(level) > 1:
        for place in at:
            own = where[place]
            begin = own - own % 3
            paths[place].append(("".join(level[begin:own]), "".join(level[own + 1 : begin + 3])))
            where[place] = own // 3
        level = [sha("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
    return level[0], paths


def brute_manifest(rows, claim):
    groups = defaultdict(list)
    for row in rows:
        leaf = sha("".join(map(coded, row)))
        text = claim(row)
        now = leaf if text is None else sha("".join(map(coded, (*row[:-1], text))))
        groups[row[1]].append((row[0] is not None, row[0] or 0, leaf, now, row[0]))
    names = sorted(groups, key=lambda name: (name is not None, (name or "").encode()))
    trees = []
    for name in names:
        groups[name].sort(key=lambda r: r[:3])
        leaves = [r[2] for r in groups[name]]
        trees.append(climb(leaves, range(len(leaves))))
    root, tops = climb([tree[0] for tree in trees], range(len(trees)))
    out = []
    for i, name in enumerate(names):
        for place, (*_, leaf, now, doc_id) in enumerate(groups[name]):
            steps = trees[i][1][place] + tops[i]
            node = now
            for left, right in steps:
                node = sha(left + node + right)
            proof = sha("".join(side for step in steps for side in step))
            out.append((doc_id, leaf, trees[i][0], root, proof, node, node == root))
    return out


def manifest_rows():
    rng = random.Random(8)
    rows = []
    for i in range(700):
        source = rng.choice(["web", "web", "web", "söurce", "", None, f"s{i % 9}"])
        text = rng.choice([None, "", f"line {i}\nline", f"one line {i}"])
        rows.append((rng.choice([i, -i, i * 1_000_003]), source, rng.choice(["en", None]), i, text))
    rows += [rows[3], rows[3], (rows[3][0], rows[3][1], "xx", None, "other")]  # ids that occur twice
    rows += [(None, "web", None, None, "no id"), (None, "web", "en", 3, "a\nb"), (-(2**63), "web", None, 1, "x")]
    return rows + [(5, "alone", "en", 4, "lone\nleaf")]


def test_manifest(spark):
    rows = manifest_rows()
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    docs = docs.withColumns({"n": F.lit(1), "place": F.lit("x"), "has": F.lit("y"), "leaf": F.lit(0)})
    claimed = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    # small blocks: several passes over the trees
    got = manifest(docs.repartition(7), claimed=claimed, levels=2)
    even = lambda row: row[0] is not None and row[0] % 2 == 0
    expected = brute_manifest(
        rows, lambda row: row[4].replace("\n", "") if even(row) and row[4] is not None else None
    )
    key = lambda row: tuple(map(str, row))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(expected, key=key)
    assert any(not row[-1] for row in expected) and any(row[-1] for row in expected)


def test_manifest_of_one_and_none(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    assert manifest(spark.createDataFrame([], schema)).collect() == []
    (row,) = manifest(spark.createDataFrame([(None,) * 5], schema)).collect()
    leaf = sha("-----")
    assert tuple(row) == (None, leaf, leaf, leaf, sha(""), leaf, True)
    assert FIELDS == ("doc_id", "source", "lang", "n_chars", "text")


# -- fill in the middle ---------------------------------------------------------------------


def brute_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = sha("1:" + ("" if doc_id is None else str(doc_id)))
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(units)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    parts = ["".join(p) for p in (units[:low], units[low:high], units[high:])]
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    head, middle, tail = parts
    if h4 % 100 < 20:
        return (doc_id, n, "spm", len(head), len(middle), f"<S>{tail}<P>{head}<M>{middle}")
    return (doc_id, n, "psm", len(head), len(middle), f"<P>{head}<S>{tail}<M>{middle}")


MARKED = ["a <P> b", "<S>", "x<M>", "<P", "x <", "<S <P <M", "é<\n\n>", "<<<>>>" * 30, "word\n" * 3000]


def test_fill_in_middle(spark, messy, rows):
    sizes = {"units": 50, "slice_bytes": 64}
    extra = spark.createDataFrame(
        [(1000 + i, text) for i, text in enumerate(MARKED * 4)], "doc_id long, text string"
    )
    docs = messy.unionByName(extra, allowMissingColumns=True)
    pairs = [(r[0], r[1]) for r in rows] + [(1000 + i, t) for i, t in enumerate(MARKED * 4)]
    brute = [brute_fim(*pair) for pair in pairs]
    expected = [
        (*found[:5], sha(found[5]), sha(text or "")) for found, (_, text) in zip(brute, pairs)
    ]
    key = lambda row: tuple(map(str, row))
    got = output_digests(docs, **sizes)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(expected, key=key)
    assert {row[2] for row in expected} == {"plain", "psm", "spm"}
    texts = transform_texts(docs, **sizes)
    assert sorted(map(tuple, texts.collect()), key=key) == sorted(
        [(f[0], f[2], f[5]) for f in brute], key=key
    )
    back = texts.select("doc_id", restored(F.col("form"), F.col("text")).alias("text"))
    assert sorted(map(tuple, back.collect()), key=key) == sorted(
        [(i, text or "") for i, text in pairs], key=key
    )


def test_fill_in_middle_of_nothing(empty):
    assert output_digests(empty).collect() == []


def test_long_text_streams(spark):
    """50 MB in one document: cut by slices, moved by pieces."""
    text = "word, " * 8_000_000 + "é"
    docs = spark.createDataFrame([(7, text), (8, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in output_digests(docs).collect()}
    assert got[7]["n"] == 24_000_001 and got[7]["restored_sha256"] == sha(text)
    assert got[8]["n"] == 0 and got[8]["restored_sha256"] == sha("")
