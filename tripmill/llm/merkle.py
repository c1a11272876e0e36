"""A Merkle manifest of a dataset, its subtrees stored in van Emde Boas layout.

Every language has a tree over its documents in the order of their ids; a tree over the
roots of these trees has the root of the dataset. Inner nodes have up to ARITY children.

A tree is cut into aligned blocks of ARITY ** HEIGHT leaves. A block is one row: its nodes
lie in one buffer in van Emde Boas layout, that is, its upper half of levels first and
then each subtree below, each again halved in the same way. `address` computes the place of
a node from its depth and number; building a block and finding siblings both go by it, so
neighbours on a path lie close at every scale and no pointers are stored. The roots of the
blocks are the leaves of the next tier of blocks, until one block has the whole tree: a
million documents have two tiers, a hundred billion four.

Proofs come down the tiers: what a block's root needs is joined to the block, which adds
its own siblings. So every step handles blocks and not documents, and neither a task nor
the driver holds a level of a tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache, reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tripmill.llm import common

ARITY = 8
HEIGHT = 3
BLOCK = ARITY**HEIGHT
DIGEST = 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# Documents that an audit tampers with: one of so many, by a hash of the id.
TAMPERED = 3


# --- one block --------------------------------------------------------------


def slots(levels: int) -> int:
    """Nodes of a complete subtree of so many levels."""
    return (ARITY**levels - 1) // (ARITY - 1)


@lru_cache(maxsize=None)
def address(depth: int, number: int, levels: int) -> int:
    """The place in the layout of the node with this number at this depth (0 is the root)
    of a complete subtree of so many levels."""
    if levels == 1:
        return 0
    upper = levels // 2
    if depth < upper:
        return address(depth, number, upper)
    beneath = ARITY ** (depth - upper)
    lower = levels - upper
    return slots(upper) + number // beneath * slots(lower) + address(depth - upper, number % beneath, lower)


def levels_of(total: int) -> int:
    """Levels of the block of a tree of `total` leaves: all of them, or those of a whole block."""
    levels, leaves = 1, 1
    while leaves < min(total, BLOCK):
        levels, leaves = levels + 1, leaves * ARITY
    return levels


def _widths(count: int, levels: int) -> list[int]:
    """Nodes per depth of a block with `count` leaves."""
    widths = [count]
    for _ in range(levels - 1):
        widths.append(-(-widths[-1] // ARITY))
    return widths[::-1]


def node(nodes: bytes, place: int) -> str:
    return bytes(nodes[place * DIGEST : (place + 1) * DIGEST]).hex()


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def build(leaves: Sequence[bytes], total: int) -> bytes:
    """The nodes of a block of a tree of `total` leaves."""
    levels = levels_of(total)
    nodes = bytearray(slots(levels) * DIGEST)

    def put(depth: int, number: int, value: bytes) -> None:
        place = address(depth, number, levels) * DIGEST
        nodes[place : place + DIGEST] = value

    for number, leaf in enumerate(leaves):
        put(levels - 1, number, leaf)
    widths = _widths(len(leaves), levels)
    for depth in range(levels - 2, -1, -1):
        for number in range(widths[depth]):
            children = range(number * ARITY, min((number + 1) * ARITY, widths[depth + 1]))
            parts = (node(nodes, address(depth + 1, child, levels)) for child in children)
            put(depth, number, hashlib.sha256("".join(parts).encode()).digest())
    return bytes(nodes)


def siblings(nodes: bytes, count: int, total: int, number: int) -> str:
    """The digests beside the path from a leaf to the block's root, level by level."""
    levels = levels_of(total)
    widths = _widths(count, levels)
    found = []
    for depth in range(levels - 1, 0, -1):
        first = number // ARITY * ARITY
        run = range(first, min(first + ARITY, widths[depth]))
        found += [node(nodes, address(depth, other, levels)) for other in run if other != number]
        number //= ARITY
    return "".join(found)


def path(rank: int, total: int) -> Iterator[tuple[int, int]]:
    """(place in its run, size of the run) per level, from a leaf up to the root of its tree."""
    while total > 1:
        first = rank // ARITY * ARITY
        yield rank - first, min(ARITY, total - first)
        rank, total = rank // ARITY, -(-total // ARITY)


def fold(leaf: str, beside: str, steps: Sequence[tuple[int, int]]) -> str:
    """The root that a leaf and the digests beside its path lead to."""
    width, at = 2 * DIGEST, 0
    for place, size in steps:
        before = at + place * width
        after = at + (size - 1) * width
        leaf = digest(beside[at:before], leaf, beside[before:after])
        at = after
    return leaf


# --- trees in Spark ---------------------------------------------------------


def _added(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], [*batch.schema.names, *columns])


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes = [
            build([leaf.as_py() for leaf in leaves.values], total)
            for leaves, total in zip(batch.column("leaves"), batch.column("total").to_pylist())
        ]
        roots = [each[:DIGEST] for each in nodes]
        yield _added(
            batch.drop_columns(["leaves"]),
            count=pa.array([len(each) for each in batch.column("leaves")], pa.int32()),
            nodes=pa.array(nodes, pa.binary()),
            block_root=pa.array(roots, pa.binary()),
        )


class Forest(NamedTuple):
    """The tiers of all trees, from the blocks of their leaves up. Each tier has rows
    (tree, block, total, count, nodes, block_root), the lowest also (rows) of its leaves."""

    tiers: list[DataFrame]

    def roots(self) -> DataFrame:
        """(tree, subroot) of every tree."""
        tops = [tier.where(F.col("total") <= BLOCK).select("tree", F.col("block_root").alias("subroot")) for tier in self.tiers]
        return reduce(DataFrame.unionByName, tops)

    def save(self, folder: str) -> None:
        """The manifest as Parquet, a folder per tier."""
        for number, tier in enumerate(self.tiers):
            tier.write.parquet(f"{folder.rstrip('/')}/tier={number}")


def _tier(nodes: DataFrame, *others: str) -> DataFrame:
    """Blocks of nodes (tree, rank, total, leaf), with `others` of the nodes in (rows)."""
    blocks = (
        nodes.groupBy("tree", F.expr(f"rank div {BLOCK}").alias("block"))
        .agg(F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("rank", "leaf", *others))).alias("rows"))
        .withColumn("leaves", F.col("rows.leaf"))
    )
    kept = blocks if others else blocks.drop("rows")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema if f.name != "leaves")
    return common.cut(kept.mapInArrow(_build, f"{schema}, count int, nodes binary, block_root binary"))


def forest(nodes: DataFrame, *others: str) -> Forest:
    """The trees over nodes (tree, rank, total, leaf). The driver sees the size of the
    largest tree."""
    tiers = [_tier(nodes, *others)]
    while (tiers[-1].agg(F.max("total")).first()[0] or 0) > BLOCK:
        above = tiers[-1].where(F.col("total") > BLOCK).select(
            "tree", F.col("block").alias("rank"), F.expr(f"(total + {BLOCK - 1}) div {BLOCK}").alias("total"),
            F.col("block_root").alias("leaf"),
        )
        tiers.append(_tier(above))
    return Forest(tiers)


def _below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each leaf of a block, which is the root of a block of the tier below, with all that
    lies beside its path."""
    for batch in batches:
        counts, totals, beside = (batch.column(name).to_pylist() for name in ("count", "total", "beside"))
        rows, numbers, texts = [], [], []
        for at, (nodes, block) in enumerate(zip(batch.column("nodes"), batch.column("block").to_pylist())):
            nodes = nodes.as_buffer().to_pybytes()
            for number in range(counts[at]):
                rows.append(at)
                numbers.append(block * BLOCK + number)
                texts.append(siblings(nodes, counts[at], totals[at], number) + beside[at])
        same = batch.drop_columns(["block", "total", "count", "nodes", "beside"]).take(pa.array(rows, pa.int64()))
        yield _added(same, block=pa.array(numbers, pa.int64()), beside=pa.array(texts, pa.string()))


def descend(trees: Forest, crown: DataFrame) -> DataFrame:
    """The blocks of the leaves with `beside`, the digests beside the path from their roots up.

    crown has one row per tree, (tree, beside) and whatever else its leaves need. A tree
    meets its row of crown once, at its top block, so a large tree is no hot key.
    """
    opened = None
    for number in range(len(trees.tiers) - 1, -1, -1):
        tier = trees.tiers[number].drop("block_root")
        blocks = tier.where(F.col("total") <= BLOCK).join(crown, "tree")
        if opened is not None:
            blocks = blocks.unionByName(tier.where(F.col("total") > BLOCK).join(opened, ["tree", "block"]))
        if number == 0:
            return blocks
        more = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in crown.schema if f.name not in ("tree", "beside"))
        opened = common.cut(
            blocks.mapInArrow(_below, ", ".join(filter(None, ["tree string", more, "block long, beside string"])))
        )
    raise ValueError("no tier")


# --- documents --------------------------------------------------------------


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(text: Column) -> Column:
    others = [_field(F.col(name)) for name in FIELDS if name != "text"]
    return F.unhex(F.sha2(F.concat(*others, _field(text)), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, leaf, tampered): the digest of each document, and that of the
    tampered one where an audit tampers with it. A tree is a language; none comes first."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    return docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf_digest(F.col("text")).alias("leaf"),
        F.when(chosen, leaf_digest(common.ascii_lower(F.col("text")))).alias("tampered"),
    )


class Manifest(NamedTuple):
    languages: Forest
    top: Forest


def manifest(docs: DataFrame) -> Manifest:
    """The trees of all languages and the tree over their roots."""
    rows = common.ranked(common.cut(leaves(docs)), ["tree"], [F.col("doc_id"), F.col("leaf")])
    languages = forest(rows, "doc_id", "tampered")
    tops = common.ranked(languages.roots(), [], [F.col("tree")])
    top = forest(tops.select(F.lit("").alias("tree"), "rank", "total", F.col("subroot").alias("leaf"), F.col("tree").alias("name")), "name")
    return Manifest(languages, top)


_ROWS = (
    "doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
    "folded_root string, verified boolean"
)


def _crowns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per language what lies beside its root's path in the top tree."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            for each in row["rows"]:
                number = each["rank"] % BLOCK
                beside = siblings(row["nodes"], row["count"], row["total"], number) + row["beside"]
                out.append((each["name"], beside, each["leaf"].hex(), each["rank"]))
        columns = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(column, kind) for column, kind in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64()))],
            ["tree", "beside", "subroot", "place"],
        )


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            upper = list(path(row["place"], row["trees"]))
            out = []
            for each in row["rows"]:
                beside = siblings(row["nodes"], row["count"], row["total"], each["rank"] % BLOCK) + row["beside"]
                steps = [*path(each["rank"], row["size"]), *upper]
                leaf = each["leaf"].hex()
                folded = fold(each["tampered"].hex() if each["tampered"] else leaf, beside, steps)
                out.append((
                    each["doc_id"], leaf, row["subroot"], row["root"], digest(beside), folded, folded == row["root"],
                ))
            kinds = (pa.int64(), *[pa.string()] * 5, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(zip(*out), kinds)],
                [field.split()[0] for field in _ROWS.split(", ")],
            )


def audit(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256 of the manifest, then
    folded_root, what the proof leads to from the document as the audit finds it, and
    verified, whether that is the root.

    Nulls in any column are a digit of their own in the leaf; documents without lang have
    a tree of their own, those without id come first in theirs and are not tampered with.
    Rows that repeat are leaves like others. Empty texts and very long ones are hashed
    whole. Further columns are not read. No rows give none.
    """
    languages, top = manifest(docs)
    last = top.tiers[-1].select("block_root").first()
    if last is None:
        return docs.sparkSession.createDataFrame([], _ROWS)
    trees = top.tiers[0].agg(F.max("total")).first()[0]
    lone = docs.sparkSession.createDataFrame([("", "")], "tree string, beside string")
    crown = (
        descend(top, lone)
        .mapInArrow(_crowns, "tree string, beside string, subroot string, place long")
        .withColumns({"root": F.lit(bytes(last[0]).hex()), "trees": F.lit(trees)})
    )
    sizes = languages.tiers[0].where("block = 0").select("tree", F.col("total").alias("size"))
    return descend(languages, common.cut(crown.join(sizes, "tree"))).mapInArrow(_audit, _ROWS)
