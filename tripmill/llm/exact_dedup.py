"""Exact duplicates by sorting contents.

Equal rows of an Arrow batch are folded first, so a text that a third of all rows
repeat moves once per batch. The folded texts are dealt by range: Spark samples the
splitters, over a short beginning of the text and its hash, so the driver holds no
whole texts and a beginning that many texts share is split as well. Each partition
is sorted (Spark spills), equal texts are then adjacent, and each text is compared
in full with the one before it. Only ids and digests leave that pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tripmill.llm import common

# Characters of a text that a splitter holds at most.
SPLITTER_CHARS = 48

_FOLDED = "leader long, members array<long>, content binary"
_RUNS = "run long, first boolean, members array<long>, text_sha256 string, keep_id long"


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per different content of a batch, with the ids that have it, the
    largest first and missing ids last."""
    for batch in batches:
        contents = pc.ascii_lower(batch.column(1).cast(pa.large_string())).cast(pa.large_binary())
        groups: dict[bytes, list] = {}
        for doc_id, content in zip(batch.column(0).to_pylist(), contents):
            groups.setdefault(content.as_py(), []).append(doc_id)
        members = [
            sorted(ids, key=lambda i: (i is not None, i or 0), reverse=True) if len(ids) > 1 else ids
            for ids in groups.values()
        ]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([ids[0] for ids in members], pa.int64()),
                pa.array(members, pa.list_(pa.int64())),
                pa.array(list(groups), pa.binary()),
            ],
            ["leader", "members", "content"],
        )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the runs of equal neighbours of a sorted partition. Only the content
    before is held, not the run."""
    task = TaskContext.get()
    run = (task.partitionId() if task else 0) << 33
    before = keep_id = digest = None
    for batch in batches:
        out: list[tuple] = []
        for leader, members, content in zip(
            batch.column("leader").to_pylist(),
            batch.column("members").to_pylist(),
            batch.column("content"),
        ):
            content = content.as_buffer()
            first = before is None or not content.equals(before)
            if first:
                run, keep_id = run + 1, leader
                digest = hashlib.sha256(content).hexdigest()
                before = pa.py_buffer(bytes(content))
            out.append((run, first, members, digest, keep_id))
        columns = list(zip(*out)) or [()] * 5
        kinds = (pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(column, kind) for column, kind in zip(columns, kinds)],
            ["run", "first", "members", "text_sha256", "keep_id"],
        )


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text counts as
    empty, and empty texts equal each other. The largest doc_id stays; a document
    without an id only stays if no other has one, and of rows that repeat an id
    with the same text one is kept. Other columns are not read. No rows give none.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    start = F.substring("content", 1, SPLITTER_CHARS)
    ordered = (
        texts.mapInArrow(_fold, _FOLDED)
        .repartitionByRange(start, F.xxhash64("content"))
        .sortWithinPartitions(start, F.xxhash64("content"), "content", F.col("leader").desc_nulls_last())
    )
    # A small table, read twice: for the sizes and for the members.
    runs = common.cut(ordered.mapInArrow(_runs, _RUNS))
    sizes = runs.groupBy("run").agg(F.sum(F.size("members")).alias("group_size"))
    return (
        runs.join(sizes, "run")
        .select("*", F.posexplode("members").alias("__pos", "doc_id"))
        .select(
            "doc_id",
            "keep_id",
            F.col("group_size").cast("long"),
            (F.col("first") & (F.col("__pos") == 0)).alias("kept"),
            "text_sha256",
        )
    )


def drop_exact(docs: DataFrame) -> DataFrame:
    """The documents that stay, whole rows. Rows that repeat both id and text count
    once, with any one of their other columns' values.

    Rows are told by id and digest. Only those keys meet the texts whose rows go or
    repeat, which are few beside all rows."""
    keys = exact_groups(docs).groupBy("doc_id", "text_sha256").agg(
        F.count("*").alias("n"), F.bool_or("kept").alias("__stays")
    )
    odd = common.cut(
        keys.where("n > 1 OR NOT __stays").select(
            F.col("doc_id").alias("__odd_id"), F.col("text_sha256").alias("__odd_digest"), "__stays"
        )
    )
    digest = F.sha2(common.ascii_lower(F.coalesce("text", F.lit(""))), 256)
    keyed = docs.withColumn("__digest", digest)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__odd_id")) & (F.col("__digest") == F.col("__odd_digest"))
    stays = keyed.join(odd, same, "left_anti")
    repeated = odd.where("__stays")
    if not repeated.isEmpty():
        once = keyed.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "__digest"])
        stays = stays.unionByName(once)
    return stays.drop("__digest")
