"""Merkle manifest of a dataset: a digest per row, per group and of the whole, and a proof for each row.

1. A row's leaf is the SHA-256 of its fields. Leaves of a group stand in the order of their ids.
2. Their places come from an index, not from sorting: ids of a group are bits of 64-bit words, merged
   from all tasks with `bit_or`; words without a bit are not stored. A directory holds how many rows lie before each word:
   first summed over 4,096 words of a block, then over the blocks. The place of a row is the
   directory's number for its word plus the bits below its own. Only words in which an id occurs twice have
   their rows numbered.
3. Leaves become arrays of 3^`LEVELS` slots, keyed by group and place, which are reduced `LEVELS` levels at
   a time, `ARITY` neighbours into one; what comes out are the leaves of the next pass. Groups are leaves of a last tree.
4. On the way back each block hands the path above it to its slots. At the rows, paths become a digest of all
   siblings, and the root that follows from the row as it is now.

No task holds more than the blocks of one Arrow batch, however large a group is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchloom.llm.stored import stored
from batchloom.operators.ordered import number_rows

ARITY, LEVELS = 3, 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_WORD_BITS, _BLOCK_BITS = 6, 12
# below the word of every id: rows without one
_NO_ID = -(1 << (63 - _WORD_BITS)) - 1
_TREE = ["has", "name"]


def _digest(hexes: Sequence[str]) -> str:
    return hashlib.sha256("".join(hexes).encode()).hexdigest()


def leaf_of(fields: Sequence[Column]) -> Column:
    """SHA-256 of the fields: `-` for null, else the number of UTF-8 bytes, a colon and the value."""

    def coded(field: Column) -> Column:
        text = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[coded(field) for field in fields]), 256)


def levels_of(n: int) -> int:
    """How often n nodes are reduced until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def places(leaves: DataFrame) -> DataFrame:
    """`leaves` (has, name, id, leaf, ..) with `place`, 0-based in each group, and `n`, the group's size.

    Rows without an id come first, then ids ascend; rows with one id are ordered by their leaf.
    """
    word = F.coalesce(F.shiftright("id", _WORD_BITS), F.lit(_NO_ID).cast("bigint"))
    bit = F.coalesce(F.col("id").bitwiseAND(F.lit((1 << _WORD_BITS) - 1)), F.lit(0)).cast("int")
    keyed = leaves.withColumns({"word": word, "bit": bit})
    key = [*_TREE, "word"]
    words = keyed.groupBy(*key).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit"))).alias("bits"),
        F.count("*").alias("rows"),
    )
    words = stored(words.withColumn("block", F.shiftright("word", _BLOCK_BITS)))
    blocks = words.groupBy(*_TREE, "block").agg(F.sum("rows").alias("all"))
    # one row for a quarter of a million ids
    of_group = Window.partitionBy(*_TREE)
    before = F.sum("all").over(of_group.orderBy("block")) - F.col("all")
    blocks = blocks.select(
        *_TREE, "block", before.alias("above"), F.sum("all").over(of_group).alias("n")
    )
    inside = F.sum("rows").over(Window.partitionBy(*_TREE, "block").orderBy("word")) - F.col("rows")
    index = stored(
        words.withColumn("inside", inside)
        .join(blocks, [*_TREE, "block"])
        .select(
            *key,
            "bits",
            (F.col("above") + F.col("inside")).alias("first"),
            (F.bit_count("bits") < F.col("rows")).alias("repeats"),
            "n",
        )
    )
    ranked = keyed.join(index, key)
    above = F.call_function("shiftleft", F.lit(-1).cast("bigint"), F.col("bit"))
    below = F.col("bits").bitwiseAND(F.bitwise_not(above))
    place = F.col("first") + F.bit_count(below)
    columns = [*leaves.columns, "place", "n"]
    clear = ranked.where("NOT repeats").withColumn("place", place.cast("bigint")).select(*columns)
    if index.where("repeats").isEmpty():
        return clear
    # rows that are equal in all columns may be many: the last column divides them between tasks
    again = ranked.where("repeats").withColumn("_tie", F.monotonically_increasing_id())
    again = number_rows(stored(again), key, ["id", "leaf", "_tie"], "place")
    again = again.withColumn("place", F.col("first") + F.col("place") - 1)
    return clear.unionByName(again.select(*columns))


def _slots(rows: DataFrame, levels: int, *carried: str) -> DataFrame:
    """Blocks of neighbouring nodes; `carried` columns go along as arrays in the order of the slots."""
    members = F.array_sort(F.collect_list(F.struct("place", "hash", *carried)))
    grouped = rows.withColumn("block", F.expr(f"place div {ARITY**levels}")).groupBy(*_TREE, "n", "block")
    blocks = grouped.agg(members.alias("m"))
    return blocks.select(
        *_TREE, "n", "block", *[F.col("m")[name].alias(name) for name in ("hash", *carried)]
    )


def _rows(batch: pa.RecordBatch):
    """Rows as dicts, one at a time: a row holds a block."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _levels(hashes: list[str], n: int, levels: int) -> list[list[str]]:
    """The nodes of a block, level by level, of a tree over n nodes."""
    nodes = [hashes]
    for _ in range(min(levels, levels_of(n))):
        last = nodes[-1]
        nodes.append([_digest(last[i : i + ARITY]) for i in range(0, len(last), ARITY)])
    return nodes


_TOPS = "has int, name string, n bigint, place bigint, hash string"


def _reduced(blocks: DataFrame, levels: int) -> DataFrame:
    """One node for each block."""
    block = ARITY**levels

    def run(batches):
        for batch in batches:
            rows = zip(batch.column("hash"), batch.column("n").to_pylist())
            tops = [_levels(hashes.as_py(), n, levels)[-1][0] for hashes, n in rows]
            left = [-(-n // block) for n in batch.column("n").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("has"), batch.column("name"), pa.array(left, pa.int64()),
                 batch.column("block"), pa.array(tops, pa.string())],
                names=["has", "name", "n", "place", "hash"],
            )

    return blocks.select("has", "name", "n", "block", "hash").mapInArrow(run, _TOPS)


def _paths(hashes: list[str], n: int, depth: int):
    """For each slot of a block its siblings up to the block's node, as (left of it, right of it)."""
    levels = _levels(hashes, n, depth)[:-1]
    for slot in range(len(hashes)):
        lefts, rights, at = [], [], slot
        for level in levels:
            begin = at - at % ARITY
            lefts.append("".join(level[begin:at]))
            rights.append("".join(level[at + 1 : begin + ARITY]))
            at //= ARITY
        yield lefts, rights


_PATH = (
    "has int, name string, place bigint, hash string, subroot string, "
    "lefts array<string>, rights array<string>"
)


def _handed_down(blocks: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """The path from each node of the blocks up to the root; `above` has those of the blocks' nodes."""
    names = ["has", "name", "place", "hash", "subroot", "lefts", "rights"]

    def run(batches):
        for batch in batches:
            for row in _rows(batch):
                paths = [
                    (lefts + row["lefts"], rights + row["rights"])
                    for lefts, rights in _paths(row["hash"], row["n"], levels)
                ]
                first = row["block"] * ARITY**levels
                yield pa.RecordBatch.from_pydict(
                    {
                        "has": pa.array([row["has"]] * len(paths), pa.int32()),
                        "name": pa.array([row["name"]] * len(paths), pa.string()),
                        "place": pa.array(range(first, first + len(paths)), pa.int64()),
                        "hash": pa.array(row["hash"], pa.string()),
                        "subroot": pa.array([row["subroot"]] * len(paths), pa.string()),
                        "lefts": pa.array([p[0] for p in paths], pa.list_(pa.string())),
                        "rights": pa.array([p[1] for p in paths], pa.list_(pa.string())),
                    }
                ).select(names)

    return _with_path(blocks, above).mapInArrow(run, _PATH)


def _with_path(blocks: DataFrame, above: DataFrame) -> DataFrame:
    paths = above.select(*_TREE, F.col("place").alias("block"), "subroot", "lefts", "rights")
    return blocks.join(paths, [*_TREE, "block"])


def _trees(nodes: DataFrame, n: int, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of every pass over the trees, the largest of n nodes, and one node for each tree."""
    passes = []
    while True:
        passes.append(stored(_slots(nodes, levels)))
        nodes = stored(_reduced(passes[-1], levels))
        n = -(-n // ARITY**levels)
        if n <= 1:
            return passes, nodes


def manifest(
    docs: DataFrame,
    id_col: str = "doc_id",
    group_col: str = "source",
    fields: Sequence[str] = FIELDS,
    claimed: Column | None = None,
    claimed_field: str = "text",
    levels: int = LEVELS,
) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) for each row of `docs`.

    A row's leaf is `leaf_of` its `fields`. `subroot` is the root of the leaves of its group, `root` that over the
    subroots of all groups, null first, then in the order of their UTF-8 bytes. The proof is the digest of
    all siblings from the leaf up to the root. `folded_root` follows from the siblings and from the row with
    `claimed` in place of `claimed_field` (where it is null, the row as it is), and `verified` says
    whether it is the root.

    Null ids come first in their group; rows with one id are ordered by their leaf, and each repeated row is a
    leaf. Null and empty texts have different leaves. An empty table has no rows. Columns besides the fields, id
    and group are not looked at.
    """
    column = lambda name: F.col(f"`{name}`")
    own = leaf_of([column(name) for name in fields])
    other = F.lit(None).cast("string")
    if claimed is not None:
        now = [claimed if name == claimed_field else column(name) for name in fields]
        other = F.when(claimed.isNotNull(), leaf_of(now))
    group = column(group_col).cast("string")
    leaves = stored(
        docs.select(
            group.isNotNull().cast("int").alias("has"),
            F.coalesce(group, F.lit("")).alias("name"),
            column(id_col).cast("bigint").alias("id"),
            own.alias("leaf"),
            other.alias("now"),
        )
    )
    placed = places(leaves).withColumnRenamed("leaf", "hash")
    rows = stored(_slots(placed, levels, "id", "now"))
    largest = rows.agg(F.max("n")).first()[0] or 0
    passes, subroots = [rows], stored(_reduced(rows, levels))
    block = ARITY**levels
    if largest > block:
        more, subroots = _trees(subroots, -(-largest // block), levels)
        passes += more
    # the groups are the leaves of one more tree
    tops = number_rows(subroots.select(*_TREE, "hash"), [], _TREE, "place")
    tops = stored(tops.withColumn("place", F.col("place") - 1))
    size = tops.count()
    named = tops.withColumnsRenamed({"has": "of_has", "name": "of_name"}).withColumns(
        {"has": F.lit(0), "name": F.lit(""), "n": F.lit(size).cast("bigint")}
    )
    top_passes, roots = _trees(named.drop("of_has", "of_name"), size, levels)
    none = F.array().cast("array<string>")
    paths = roots.select(
        *_TREE, "place", "hash", F.lit("").alias("subroot"), none.alias("lefts"), none.alias("rights")
    )
    for blocks in reversed(top_passes):
        paths = stored(_handed_down(blocks, paths, levels))
    first = F.lit(0).cast("bigint").alias("place")
    subroot = F.col("hash").alias("subroot")
    paths = tops.join(paths.select("place", "lefts", "rights"), "place").select(
        *_TREE, first, "hash", subroot, "lefts", "rights"
    )
    for blocks in reversed(passes[1:]):
        paths = stored(_handed_down(blocks, paths, levels))
    root = roots.select("hash").first()
    root = root["hash"] if root else None
    names = ["id", "leaf", "subroot", "proof_sha256", "folded_root"]

    def prove(batches):
        for batch in batches:
            for row in _rows(batch):
                proofs, folded = [], []
                above = list(zip(row["lefts"], row["rights"]))
                below = _paths(row["hash"], row["n"], levels)
                for leaf, now, (lefts, rights) in zip(row["hash"], row["now"], below):
                    steps = [*zip(lefts, rights), *above]
                    proofs.append(_digest([side for step in steps for side in step]))
                    node = now or leaf
                    for left, right in steps:
                        node = _digest((left, node, right))
                    folded.append(node)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["id"], pa.int64()),
                        pa.array(row["hash"], pa.string()),
                        pa.array([row["subroot"]] * len(folded), pa.string()),
                        pa.array(proofs, pa.string()),
                        pa.array(folded, pa.string()),
                    ],
                    names=names,
                )

    proved = _with_path(rows, paths).mapInArrow(
        prove, "id bigint, leaf string, subroot string, proof_sha256 string, folded_root string"
    )
    return proved.select(
        F.col("id").alias(id_col),
        "leaf",
        "subroot",
        F.lit(root).cast("string").alias("root"),
        "proof_sha256",
        "folded_root",
        (F.col("folded_root") == F.lit(root).cast("string")).alias("verified"),
    )
