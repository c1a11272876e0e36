"""Mixing sources to target weights by Pfair scheduling.

A source's documents come in a seeded random order and are dealt into blocks. Time runs in
slots of one block. While all sources last, the ideal gives each its weight's share of
every slot; from where one has had its last block, the others share its slots by their
weights. Block k of a source is released when the ideal has given the source k blocks, and
due when it has given k + 1; in each slot the released block that is due first runs. That
meets every deadline, so after each slot each source is less than one block away from
its share, by the weights as they are given.

Blocks have BLOCK_ROWS rows, or as many more as keep the schedule below BLOCKS blocks and
one per source; so the driver's part is bounded, and the rows look their slots up in it.
Sources beyond the SOURCES largest share lanes, whose blocks are dealt among them by the
same rule in Spark, a lane a task, and which the schedule treats as sources; one of these
is less than one block away from its share of its lane, which is that far from its own.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window, functions as F

from tripmill.llm import common

# Rows per block at least, and blocks in a schedule at most beside one per source.
BLOCK_ROWS = 64
BLOCKS = 200_000
# Sources that the schedule knows apart, and lanes that the others share.
SOURCES, LANES = 10_000, 1_000
# How strongly the target weights follow the sizes of the sources (1: fully).
EXPONENT = 0.7
SEED = 20
# Slots whose rows are counted together.
SLOTS = 4_096


def deal(weights: list[float], blocks: list[int]) -> list[list[int]]:
    """The slots of each source's blocks, earliest deadline first among those released.
    Work grows with the blocks and the logarithm of the sources."""
    lasts = sorted((n / w, n, w) for w, n in zip(weights, blocks))
    limits = [v for v, _, _ in lasts]
    done, live = [0], [math.fsum(weights)]
    for _, n, w in lasts:
        done.append(done[-1] + n)
        live.append(live[-1] - w)

    def given(source: int, k: int) -> float:
        """When the ideal has given the source k blocks."""
        v = k / weights[source]
        at = bisect_right(limits, v)
        return done[at] + (v * live[at] if at < len(lasts) else 0.0)

    places: list[list[int]] = [[] for _ in blocks]
    waiting = [(0, source) for source, n in enumerate(blocks) if n]
    ready: list[tuple[int, int]] = []
    for slot in range(sum(blocks)):
        while waiting and (waiting[0][0] <= slot or not ready):
            source = heapq.heappop(waiting)[1]
            due = math.ceil(given(source, len(places[source]) + 1) - 1e-6)
            heapq.heappush(ready, (due, source))
        source = heapq.heappop(ready)[1]
        places[source].append(slot)
        if len(places[source]) < blocks[source]:
            heapq.heappush(waiting, (math.floor(given(source, len(places[source])) + 1e-6), source))
    return places


_DEALT = "source string, n long, lane int, k long, turn long"


def _deal_lane(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The turns of the blocks of a lane's sources."""
    for batch in batches:
        for row in batch.to_pylist():
            members = sorted(row["members"], key=lambda each: each["source"] or "")
            places = deal([each["weight"] for each in members], [each["blocks"] for each in members])
            sizes = [len(own) for own in places]
            which = np.repeat(np.arange(len(members)), sizes)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([each["source"] for each in members], pa.string()).take(pa.array(which)),
                    pa.array([each["n"] for each in members], pa.int64()).take(pa.array(which)),
                    pa.array(np.full(len(which), row["lane"], np.int32)),
                    pa.array(np.concatenate([np.arange(size) for size in sizes])),
                    pa.array(np.concatenate([np.array(own, np.int64) for own in places])),
                ],
                ["source", "n", "lane", "k", "turn"],
            )


def _schedule(spark, weights: list[float], blocks: list[int]) -> DataFrame:
    """(owner, k, slot): BLOCKS rows and one per owner at most."""
    places = deal(weights, blocks)
    table = pa.table({
        "owner": np.repeat(np.arange(len(blocks), dtype=np.int32), blocks),
        "k": np.concatenate([np.arange(n, dtype=np.int64) for n in blocks]),
        "slot": np.concatenate([np.array(own, np.int64) for own in places]),
    })
    return spark.createDataFrame(table)


def place(docs: DataFrame, weights: dict[str | None, float] | None = None, block_rows: int | None = None) -> DataFrame:
    """(row, source, share, block, slot, position): each document as a struct, and where
    it comes in the mix. position is gapless from 0 over all documents; share is its
    source's part of all weights.

    Without weights, a source's target is its size to the power EXPONENT. Those without a
    given weight and null count as one source (with the smallest weight, or weights[None]).
    Weights of 0 or less are refused. Rows that repeat are rows like any other; no rows
    give none.
    """
    if weights is not None and any(weight <= 0 for weight in weights.values()):
        raise ValueError("target weights must be positive")
    spark = docs.sparkSession
    rows = docs.select(
        F.struct("*").alias("row"), F.col("source").cast("string").alias("named"), F.col("doc_id").cast("long").alias("id")
    ).withColumn("source", F.col("named"))
    if weights is not None:
        # As many rows as the caller's weights.
        given = spark.createDataFrame([(name,) for name in weights if name is not None] or [("",)], "given string")
        rows = rows.join(F.broadcast(given), F.col("named") == F.col("given"), "left").withColumn("source", F.col("given")).drop("given")
    sizes = common.cut(rows.groupBy("source").agg(F.count("*").alias("n")))
    total, sources = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    if block_rows is None:
        block_rows = max(BLOCK_ROWS, -(-total // BLOCKS))
    smallest = min((weights or {}).values(), default=1.0)
    if weights is None:
        weight = F.pow("n", F.lit(EXPONENT))
    else:
        weight = F.lit(float(weights.get(None, smallest)))
        if any(name is not None for name in weights):
            pairs = [F.lit(each) for name, value in weights.items() if name is not None for each in (name, float(value))]
            weight = F.coalesce(F.create_map(*pairs)[F.col("source")], weight)
    targets = sizes.withColumns({"weight": weight, "blocks": F.expr(f"(n + {block_rows - 1}) div {block_rows}")})
    largest = targets.orderBy(F.desc("n"), "source").limit(SOURCES).collect()
    known = spark.createDataFrame(
        [(row.source, owner, row.n, row.weight) for owner, row in enumerate(largest)],
        "known string, owner int, n long, weight double",
    )
    owners = [(row.weight, row.blocks) for row in largest]
    lanes = {}
    same = F.col("source").eqNullSafe(F.col("known"))
    if sources > SOURCES:
        others = common.cut(
            targets.join(F.broadcast(known.select("known")), same, "left_anti")
            .withColumn("lane", F.pmod(F.xxhash64("source"), F.lit(LANES)).cast("int"))
        )
        sums = others.groupBy("lane").agg(F.sum("weight").alias("weight"), F.sum("blocks").alias("blocks"))
        for row in sums.orderBy("lane").collect():
            lanes[row.lane] = len(owners)
            owners.append((row.weight, row.blocks))
    if not owners:
        return rows.select(
            "row", F.col("named").alias("source"), *(F.lit(None).cast(kind).alias(name) for name, kind in
            (("share", "double"), ("block", "long"), ("slot", "long"), ("position", "long"))),
        )
    every = math.fsum(weight for weight, _ in owners)
    schedule = _schedule(spark, [weight for weight, _ in owners], [blocks for _, blocks in owners])
    blocks = schedule.join(F.broadcast(known), "owner").select(F.col("known").alias("source"), "owner", "n", "weight", "k", "slot")
    if lanes:
        dealt = (
            others.groupBy("lane").agg(F.collect_list(F.struct("source", "n", "weight", "blocks")).alias("members"))
            .mapInArrow(_deal_lane, _DEALT)
        )
        of_lane = spark.createDataFrame(list(lanes.items()), "lane int, owner int")
        turns = schedule.withColumnRenamed("k", "turn").join(F.broadcast(of_lane), "owner")
        own = others.select(F.col("source").alias("of"), F.col("weight"))
        nested = dealt.join(turns, ["lane", "turn"]).join(own, F.col("source").eqNullSafe(F.col("of")))
        blocks = blocks.unionByName(
            nested.select("source", F.lit(None).cast("int").alias("owner"), "n", "weight", "k", "slot")
        )
    # Where each block's rows begin: the last block of a source may be short.
    blocks = common.running(
        blocks.withColumns({
            "rows": F.least(F.lit(block_rows), F.col("n") - F.col("k") * block_rows),
            "bucket": F.expr(f"slot div {SLOTS}"),
        }),
        [], ["bucket"], [F.col("slot")], begin=F.col("rows"),
    )
    blocks = common.cut(blocks.select("source", "owner", (F.col("weight") / every).alias("share"), "k", "slot", "begin"))

    # Every row's place in its source, whose rows come in the order of a hash.
    keyed = rows.join(F.broadcast(known.select("known", F.col("owner").alias("own"))), same, "left").drop("known")
    keyed = keyed.withColumn("shuffled", F.xxhash64(F.lit(SEED), "id")).withColumn(
        "bucket", F.shiftright("shuffled", 64 - max(1, common.bucket_bits(total)))
    )
    ranked = common.running(keyed, ["own", "source"], ["bucket"], [F.col("shuffled"), F.col("id")], rank=F.lit(1)).select(
        "row", "named", "source", "own", F.expr(f"rank div {block_rows}").alias("k"), (F.col("rank") % block_rows).alias("in_block")
    )
    found = ["row", F.col("named").alias("source"), "share", F.col("k").alias("block"), "slot", (F.col("begin") + F.col("in_block")).alias("position")]
    mine = blocks.where("owner IS NOT NULL").select(F.col("owner").alias("own"), "share", "k", "slot", "begin")
    # BLOCKS rows and one per source at most.
    placed = ranked.join(F.broadcast(mine), ["own", "k"]).select(*found)
    if lanes:
        theirs = blocks.where("owner IS NULL").select(F.col("source").alias("of"), "share", F.col("k").alias("of_k"), "slot", "begin")
        nested = ranked.where("own IS NULL").join(
            theirs, F.col("source").eqNullSafe(F.col("of")) & (F.col("k") == F.col("of_k"))
        )
        placed = placed.unionByName(nested.select(*found))
    return placed


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, block_rows: int | None = None) -> DataFrame:
    """The documents, all their columns and no other, in the order of the mix: the files
    written from it, read by name, are the mix from first to last."""
    return (
        place(docs, weights, block_rows)
        .repartitionByRange("position")
        .sortWithinPartitions("position")
        .select("row.*")
    )


def read_back(mix: DataFrame) -> DataFrame:
    """(row, position): each document of a mix that was written and is read again, as a
    struct, and where it comes in the mix, gapless from 0.

    Spark packs files by size when it reads them, so rows do not come in the order of the
    mix; that is the order of the files by name and of the rows in each, as `mixed` writes
    them. A frame that is not read from Parquet files comes in its own order, for which it
    is computed once. No rows give none.
    """
    row = F.struct("*").alias("row")
    try:
        file = mix.metadataColumn("_metadata")
        rows = mix.select(row, file["file_path"].alias("part"), file["row_index"].alias("place"))
    except AnalysisException:
        mark = F.monotonically_increasing_id()
        rows = common.cut(mix.select(row, F.shiftright(mark, 33).alias("part"), mark.bitwiseAND((1 << 33) - 1).alias("place")))
    # One row per file.
    sizes = rows.groupBy("part").agg((F.max("place") + 1).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    return rows.join(F.broadcast(begins), "part").select("row", (F.col("begin") + F.col("place")).alias("position"))
