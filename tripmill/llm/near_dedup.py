"""Near duplicates by an LSH forest.

A document's set is its distinct five-word shingles. Documents with equal sets form a
class, and only classes are compared. A class has a signature of 64 minima. The forest
sorts the signatures in 16 orders, each beginning at another position, so a region of
an order is a run of signatures with a common beginning:

* neighbours in an order have the longest common prefixes there, so each signature is
  paired with the next ones of its region. A small region is thereby paired whole; in a
  crowded one the neighbours share more positions, which is its adaptive depth;
* a crowded region, at every depth, also pairs its members with its pivots: the members
  nearest to the most common value of each position. Copies of one text are often
  similar to that text and not to each other, which no order shows. A region that lies
  in several partitions has its pivots chosen among those of all parts. There a member
  only offers the few neighbours and pivots that agree most.

So pairs grow with the rows and not with the square of a region. Pairs whose signatures
agree too little are left out. Links are confirmed on full sets: first each class with
its likeliest partner and pivot, then the pairs whose ends are not yet connected; a pair
within one component cannot change the result. Components come from alternating stars.

What neighbours and pivots of a crowded region leave out is found by an exact join of its
members that are in different components: rarest shingles first, two sets that are
similar enough have one in common near the front of both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tripmill.llm import common

SHINGLE = 5
POSITIONS = 64
ORDERS = 16
STEP = POSITIONS // ORDERS
# Positions that signatures of a region share at least: with a similarity of 0.75 a pair
# shares two in some order but for two in a million.
LEAST_DEPTH = 2
DEPTHS = (2, 3, 4, 6, 8)
NEXT = 12
PIVOTS = 8
# Similarity 0.75 puts the agreement of 64 positions below 0.5 three times in a million.
LEAST_AGREEMENT = 0.5
ROWS_PER_PARTITION = 60_000
# Of a crowded region each row offers only its likeliest neighbours and pivots.
OFFERED = 4
# Rows of pairs and links per task.
PAIRS_PER_PARTITION = 200_000
WORDS_HELD = 100_000
# The join of a shingle that more members have is split.
HOT_SHINGLE = 5_000
# A key with more than one of so many rows is joined apart from the others.
SHARE = 1_000

_MIX = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63],
    np.uint64,
)
_MULTIPLIERS = np.random.default_rng(6).integers(0, 2**63, POSITIONS, np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHashes(dict):
    """64-bit hashes of words, computed once as long as they are held."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_HELD:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str | None, hashes: dict[bytes, int]) -> np.ndarray:
    """The sorted set of a text's shingle hashes; fewer than five words are one shingle."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    value = np.full(len(words) - size + 1, size, np.uint64)
    for place in range(size):
        value += codes[place : len(words) - size + 1 + place] * _MIX[place]
        value ^= value >> np.uint64(29)
        value *= np.uint64(0xBF58476D1CE4E5B9)
    value ^= value >> np.uint64(32)
    return np.unique(value)


def signature(values: np.ndarray) -> np.ndarray:
    """The minimum of the set under each multiplier, as 16 bits."""
    least = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(values), 4096):
        part = values[start : start + 4096]
        np.minimum(least, (part[None, :] * _MULTIPLIERS[:, None]).min(axis=1), out=least)
    return ((least ^ (least >> np.uint64(31))) & np.uint64(0xFFFF)).astype(">u2")


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _WordHashes()
    for batch in batches:
        keys, sizes, marks = [], [], []
        for text in batch.column("text"):
            values = shingles(text.as_py(), hashes)
            sizes.append(len(values))
            keys.append(xxhash.xxh3_128_digest(values.tobytes()))
            marks.append(signature(values).tobytes() if len(values) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
             pa.array(marks, pa.binary())],
            ["doc_id", "n_shingles", "set_key", "mark"],
        )


def describe(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_key, mark) of every document."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _describe, "doc_id long, n_shingles long, set_key binary, mark binary"
    )


# --- candidates -------------------------------------------------------------


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=-1)


def _modal(marks: np.ndarray) -> np.ndarray:
    """The most common value of each position, over up to 512 evenly spaced rows."""
    some = np.sort(marks[:: max(1, len(marks) // 512)], axis=0)
    begins = np.vstack([np.ones((1, POSITIONS), bool), some[1:] != some[:-1]])
    at = np.maximum.accumulate(np.where(begins, np.arange(len(some))[:, None], 0), axis=0)
    longest = (np.arange(len(some))[:, None] - at).argmax(axis=0)
    return some[longest, np.arange(POSITIONS)]


def _runs(marks: np.ndarray, depth: int) -> Iterator[tuple[int, int]]:
    """The crowded regions of a sorted order at a depth: more rows than NEXT pairs whole."""
    changes = np.flatnonzero((marks[1:, :depth] != marks[:-1, :depth]).any(axis=1)) + 1
    edges = np.concatenate([[0], changes, [len(marks)]])
    for which in np.flatnonzero(np.diff(edges) > NEXT + 1):
        yield int(edges[which]), int(edges[which + 1])


def _pivot_rows(marks: np.ndarray, ids: np.ndarray) -> np.ndarray:
    near = _agreement(marks, _modal(marks))
    return np.lexsort((ids, -near))[:PIVOTS]


# What a sorted partition yields: pairs, the pivots it proposes for regions that may go on
# in others, and the members of crowded regions and of such, these with mark and part.
PAIR, PROPOSED, MEMBER = range(3)
_FOUND = "kind int, a long, b long, agreement double, to_pivot boolean, order int, region binary, mark binary, part int"
_PAIRS = "a long, b long, agreement double, to_pivot boolean"
_KINDS = (
    pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.int32(), pa.binary(), pa.binary(), pa.int32()
)


def _found(kind: int, a, **columns) -> pa.RecordBatch:
    n = len(a)
    given = {"kind": np.full(n, kind, np.int32), "a": a} | columns
    names = [field.split()[0] for field in _FOUND.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(given[name], type_) if name in given else pa.nulls(n, type_) for name, type_ in zip(names, _KINDS)], names
    )


def _as_rows(a, b, agreement, to_pivot) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(agreement), pa.array(np.full(len(a), to_pivot))],
        ["a", "b", "agreement", "to_pivot"],
    )


def _as_found(pairs: pa.RecordBatch) -> pa.RecordBatch:
    columns = {name: pairs.column(name) for name in ("b", "agreement", "to_pivot")}
    return _found(PAIR, pairs.column("a"), **columns)


def _against(marks: np.ndarray, ids: np.ndarray, pivot_marks: np.ndarray, pivot_ids: np.ndarray):
    """Pairs of each row with the pivots that agree most, and enough."""
    near = np.stack([_agreement(marks, mark) for mark in pivot_marks], axis=1)
    near[ids[:, None] == pivot_ids] = -1.0
    which = np.argsort(-near, axis=1, kind="stable")[:, :OFFERED]
    rows = np.repeat(np.arange(len(ids)), which.shape[1])
    which = which.ravel()
    hit = near[rows, which] >= LEAST_AGREEMENT
    rows, which = rows[hit], which[hit]
    yield _as_rows(ids[rows], pivot_ids[which], near[rows, which], True)


def _next_ones(marks: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pairs of neighbours of a sorted order that share LEAST_DEPTH positions: all within
    NEXT, in crowded regions the best few of each row."""
    begins = np.flatnonzero((marks[1:, :LEAST_DEPTH] != marks[:-1, :LEAST_DEPTH]).any(axis=1)) + 1
    edges = np.concatenate([[0], begins, [len(marks)]])
    region = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    crowded = np.diff(edges)[region] > NEXT + 1
    left, right, agreed = [], [], []
    for off in range(1, min(NEXT, len(marks) - 1) + 1):
        same = np.flatnonzero(region[off:] == region[:-off])
        near = _agreement(marks[same], marks[same + off])
        hit = (near >= LEAST_AGREEMENT) & (ids[same] != ids[same + off])
        left.append(same[hit])
        right.append(same[hit] + off)
        agreed.append(near[hit])
    if not left:
        return
    a, b, near = (np.concatenate(each) for each in (left, right, agreed))
    offered = ~crowded[a]
    for side in (a, b):
        order = np.lexsort((-near, side))
        place = np.arange(len(order)) - np.searchsorted(side[order], side[order])
        offered[order[place < OFFERED]] = True
    yield _as_rows(ids[a[offered]], ids[b[offered]], near[offered], False)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates of one sorted partition, the pivots of the regions at its two ends,
    which may go on in other partitions, and the members of these and of crowded regions. A
    partition has ROWS_PER_PARTITION rows or thereabouts, of about 150 bytes."""
    held = [batch for batch in batches if batch.num_rows]
    if not held:
        return
    task = TaskContext.get()
    own = task.partitionId() if task else 0
    rows = pa.Table.from_batches(held)
    ids, orders = (rows.column(name).to_numpy() for name in ("id", "order"))
    marks = np.frombuffer(b"".join(rows.column("mark").to_pylist()), ">u2").reshape(-1, POSITIONS)
    del rows, held
    for order in np.unique(orders):
        begin, end = np.searchsorted(orders, [order, order + 1])
        part, names = marks[begin:end], ids[begin:end]
        for pairs in _next_ones(part, names):
            yield _as_found(pairs)
        for depth in DEPTHS:
            for low, high in _runs(part, depth):
                chosen = low + _pivot_rows(part[low:high], names[low:high])
                for pairs in _against(part[low:high], names[low:high], part[chosen], names[chosen]):
                    yield _as_found(pairs)
        # The first and the last region, however small they are here.
        edge = {tuple(part[0, :LEAST_DEPTH]), tuple(part[-1, :LEAST_DEPTH])}
        for low, high in _runs(part, LEAST_DEPTH):
            if tuple(part[low, :LEAST_DEPTH]) not in edge:
                n = high - low
                yield _found(
                    MEMBER, names[low:high], order=np.full(n, order, np.int32), region=[part[low, :LEAST_DEPTH].tobytes()] * n
                )
        for prefix in edge:
            inside = np.flatnonzero((part[:, :LEAST_DEPTH] == prefix).all(axis=1))
            chosen = inside[_pivot_rows(part[inside], names[inside])]
            for kind, which in ((PROPOSED, chosen), (MEMBER, inside)):
                n = len(which)
                yield _found(
                    kind, names[which], order=np.full(n, order, np.int32),
                    region=[part[which[0], :LEAST_DEPTH].tobytes()] * n,
                    mark=[part[i].tobytes() for i in which], part=np.full(n, own, np.int32),
                )


def _common_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pivots of each region among those that its partitions propose."""
    for batch in batches:
        for row in batch.to_pylist():
            ids = np.array([each["a"] for each in row["proposed"]], np.int64)
            marks = np.frombuffer(b"".join(each["mark"] for each in row["proposed"]), ">u2").reshape(-1, POSITIONS)
            best = _pivot_rows(marks, ids)
            n = len(best)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["order"]] * n, pa.int32()), pa.array([row["region"]] * n, pa.binary()),
                 pa.array([row["places"]] * n, pa.list_(pa.int32())),
                 pa.array(ids[best]), pa.array([marks[i].tobytes() for i in best], pa.binary())],
                ["order", "region", "places", "pivot", "pivot_mark"],
            )


def _with_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            both = [
                np.frombuffer(b"".join(batch.column(name).to_pylist()), ">u2").reshape(-1, POSITIONS)
                for name in ("mark", "pivot_mark")
            ]
            a, b = (batch.column(name).to_numpy() for name in ("a", "pivot"))
            near = _agreement(*both)
            hit = (near >= LEAST_AGREEMENT) & (a != b)
            yield _as_rows(a[hit], b[hit], near[hit], True)


def candidates(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b, agreement, to_pivot), a < b, of pairs of classes (id, mark) worth a look, and
    (id, order, region) of the classes in regions that may hold other pairs."""
    turned = F.expr(f"concat(substring(mark, {2 * STEP} * order + 1), substring(mark, 1, {2 * STEP} * order))")
    rows = (
        classes.withColumn("order", F.explode(F.sequence(F.lit(0), F.lit(ORDERS - 1))))
        .select("id", "order", turned.alias("mark"))
    )
    parts = 1 + classes.count() * ORDERS // ROWS_PER_PARTITION
    found = common.cut(
        rows.repartitionByRange(max(parts, _least_partitions(classes)), "order", "mark", "id")
        .sortWithinPartitions("order", "mark", "id")
        .mapInArrow(_neighbours, _FOUND)
    )
    # Of a region, PIVOTS rows for each partition that it lies in.
    pivots = (
        found.where(F.col("kind") == PROPOSED)
        .groupBy("order", "region")
        .agg(F.collect_set(F.struct("a", "mark")).alias("proposed"), F.collect_set("part").alias("places"))
        .where(F.size("proposed") > PIVOTS)
        .mapInArrow(_common_pivots, "order int, region binary, places array<int>, pivot long, pivot_mark binary")
        .withColumn("part", F.explode("places"))
    )
    members = found.where(F.col("kind") == MEMBER)
    # The rows of a region meet its pivots partition by partition.
    again = (
        members.where("mark IS NOT NULL")
        .join(pivots, ["order", "region", "part"])
        .select("a", "mark", "pivot", "pivot_mark")
        .mapInArrow(_with_pivots, _PAIRS)
    )
    pairs = (
        found.where(F.col("kind") == PAIR)
        .select("a", "b", "agreement", "to_pivot")
        .unionByName(again)
        .groupBy("a", "b")
        .agg(F.max("agreement").alias("agreement"), F.bool_or("to_pivot").alias("to_pivot"))
    )
    return pairs, members.select(F.col("a").alias("id"), "order", "region")


def _least_partitions(frame: DataFrame) -> int:
    return int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))


# --- links and components ---------------------------------------------------


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _WordHashes()
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            values = [shingles(text.as_py(), hashes).tobytes() for text in part.column("text")]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(values, pa.binary())], ["id", "elements"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked = []
        for one, two in zip(batch.column("one"), batch.column("two")):
            x, y = (np.frombuffer(side.as_buffer(), np.uint64) for side in (one, two))
            common_part = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
            linked.append(100 * common_part >= 75 * (len(x) + len(y) - common_part))
        yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets (id, elements) are similar enough."""
    one = sets.select(F.col("id").alias("a"), F.col("elements").alias("one"))
    two = sets.select(F.col("id").alias("b"), F.col("elements").alias("two"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "one", "two").mapInArrow(_confirm, "a long, b long")


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, roots = (batch.column(name).to_numpy() for name in ("id", "root"))
        for start in range(0, batch.num_rows, 512):
            values = [
                np.frombuffer(each.as_buffer(), np.int64) for each in batch.column("elements").slice(start, 512)
            ]
            sizes = np.array([len(each) for each in values], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(values)), pa.array(np.repeat(ids[start : start + 512], sizes)),
                 pa.array(np.repeat(roots[start : start + 512], sizes)), pa.array(np.repeat(sizes, sizes))],
                ["shingle", "id", "root", "size"],
            )


def _meeting(rows: DataFrame, facts: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """rows joined with facts, which has one row per key and in `n` how many of all `total`
    rows have that key. Keys with more than one of SHARE rows, fewer than SHARE of them, are
    broadcast, so the rows of a hot key stay where they are; no other key has more."""
    often = F.col(n) * SHARE > total
    hot = common.cut(facts.where(often).repartition(1))
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(facts.where(~often), key)
    return rows.join(F.broadcast(hot), key).unionByName(others)


def _with_partners(members: DataFrame) -> DataFrame:
    """The members (id, root, elements) that can be similar enough to another one. Of a
    pair, each has three quarters of its shingles in common with the other, so a member
    with more than a quarter that nobody else has is in none. Texts that only share a
    passage go here, before their shingles meet others. A row with its text is counted
    apart from others of its id."""
    row = F.xxhash64("id", "elements")
    own = (
        members.select(row.alias("id"), "root", "elements")
        .mapInArrow(_elements, "shingle long, id long, root long, size long")
        .groupBy("shingle")
        .agg(F.count("*").alias("n"), F.min("id").alias("row"), F.min("size").alias("size"))
        .where("n = 1")
        .groupBy("row", "size")
        .agg(F.count("*").alias("own"))
    )
    alone = own.where("4 * own > size").select("row")
    return common.cut(members.join(alone, row == F.col("row"), "left_anti"))


def rare_pairs(members: DataFrame) -> DataFrame:
    """(a, b), a < b, of members (id, root, elements) with different roots: all that can
    be similar enough.

    Members that can have no partner are taken out first. Shingles are ordered: first those of one root only, which no pair has in common, then
    by the number of members that have them. Sets x and y, x the larger, that are similar
    enough have 3/7 of their sizes' sum in common, so a first common shingle within the
    first quarter of x and the first seventh of y, and enough left behind it in both.
    Members that are not as similar but share a text differ in rarer shingles, which fill
    these beginnings. Of two different roots one is not the most frequent one of a
    shingle, so members of a large component do not meet each other.
    """
    members = _with_partners(members)
    every = members.mapInArrow(_elements, "shingle long, id long, root long, size long")
    total = members.agg(F.sum(F.octet_length("elements") / 8)).first()[0] or 0
    shared = (
        every.groupBy("shingle")
        .agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
        .where("low <> high")
        .select("shingle", "n")
    )
    front = (
        _meeting(every, shared, "shingle", "n", int(total))
        .groupBy("id", "root", "size")
        .agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("rising"))
        .withColumn("before", F.col("size") - F.size("rising"))
        .withColumn("length", F.expr("cast(greatest(0, size - (3 * size + 3) div 4 + 1 - before) AS int)"))
        .where("length > 0")
        .select("id", "root", "size", "before", F.posexplode(F.slice("rising", F.lit(1), F.col("length"))))
        .select(
            "id", "root", "size", (F.col("before") + F.col("pos")).alias("place"),
            "col.shingle", (1 + F.expr(f"col.n div {HOT_SHINGLE}")).alias("splits"),
        )
    )
    front = common.cut(front)
    most = (
        front.groupBy("shingle", "root").agg(F.count("*").alias("n"))
        .groupBy("shingle")
        .agg(F.max(F.struct("n", "root"))["root"].alias("usual"), F.count("*").alias("roots"), F.sum("n").alias("uses"))
        .where("roots > 1")
        .select("shingle", "usual", "uses")
    )
    front = _meeting(front, most, "shingle", "uses", front.count()).withColumn("rare", F.col("root") != F.col("usual"))
    large = front.withColumn("split", F.expr("pmod(xxhash64(id), splits)"))
    small = front.where("place < size - (6 * size + 6) div 7 + 1").withColumn(
        "split", F.explode(F.expr("sequence(0L, splits - 1)"))
    )

    def meet(x: DataFrame, y: DataFrame) -> DataFrame:
        return (
            x.alias("x").join(y.alias("y"), ["shingle", "split"])
            .where("x.root <> y.root AND (y.size < x.size OR y.size = x.size AND y.id < x.id)")
            .where("7 * least(x.size - x.place, y.size - y.place) >= 3 * (x.size + y.size)")
            .select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
        )

    return meet(large.where("rare"), small).union(meet(large.where("NOT rare"), small.where("rare"))).distinct()


def _few(frame: DataFrame, rows: int) -> DataFrame:
    """A frame of about so many rows, in tasks of PAIRS_PER_PARTITION or thereabouts: a
    small one would else go through as many files as there are partitions, again and again."""
    return frame.coalesce(1 + rows // PAIRS_PER_PARTITION)


def _compact(frame: DataFrame) -> DataFrame:
    """The same of a frame that is kept."""
    return _few(frame, frame.count())


def components(links: DataFrame) -> DataFrame:
    """(id, root): of every linked id the smallest one it reaches. Large and small stars
    alternate until nothing changes; each is an aggregation and a join, so a node with
    very many links is no group in a task. The driver sees a count and a checksum."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = common.cut(edges.where("u <> v").distinct())
    n = edges.count()
    edges = _few(edges, n)
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _few(both.groupBy("u").agg(F.min("v").alias("m")), n).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = _few(large.where("u <> v").distinct(), n)
        least = _few(large.groupBy("u").agg(F.min("v").alias("m")), n)
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        before, edges = edges, common.cut(_few(small.where("u <> v").distinct(), n))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        del both, least, large, small, before
        common.tidy(edges.sparkSession)
        if now == state:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        state, n = now, now[0]


def _best(pairs: DataFrame) -> DataFrame:
    """Of every class the likeliest partner and the likeliest pivot."""
    sides = pairs.select("a", "b", "agreement", "to_pivot").unionByName(
        pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "agreement", "to_pivot")
    )
    rank = F.struct("agreement", "b")
    best = sides.groupBy("a").agg(
        F.max(rank).alias("partner"), F.max(F.when(F.col("to_pivot"), rank)).alias("pivot")
    )
    other = best.select("a", F.explode(F.array("partner.b", "pivot.b")).alias("b")).where("b IS NOT NULL")
    return other.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    A null text or one without words has no shingles and is linked with nothing; so is a
    row without doc_id, whose component_id is null and which is kept. Rows that share a
    doc_id count as one document. Columns but doc_id and text are not read.
    """
    described = common.cut(describe(docs))
    linkable = described.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = common.cut(
        linkable.groupBy("set_key").agg(F.min("doc_id").alias("id"), F.any_value("mark").alias("mark"))
    )
    pairs, crowded = candidates(classes.select("id", "mark"))
    pairs, crowded = _compact(common.cut(pairs)), _compact(common.cut(crowded))
    # Each side is made distinct before the two meet, so pairs are not doubled.
    ends = pairs.select(F.col("a").alias("id")).distinct().union(pairs.select("b").distinct())
    wanted = ends.union(crowded.select("id").distinct()).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    sets = common.cut(texts.join(wanted, "id", "left_semi").mapInArrow(_sets, "id long, elements binary"))
    links = _compact(common.cut(confirmed(_best(pairs), sets)))
    common.tidy(docs.sparkSession)
    first = components(links)
    ends = pairs.select("a", "b")
    for end in ("a", "b"):
        root = first.select(F.col("id").alias(end), F.col("root").alias(f"root_{end}"))
        ends = ends.join(root, end, "left").withColumn(f"root_{end}", F.coalesce(f"root_{end}", end))
    apart = _compact(common.cut(ends.where("root_a <> root_b").select("a", "b")))
    more = _compact(common.cut(confirmed(apart, sets)))
    roots = components(links.unionByName(more)) if more.count() else first
    del pairs, links, first, ends, apart, more
    common.tidy(docs.sparkSession)
    # Where all members of a region are connected already, no pair of it says more.
    placed = crowded.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    open_regions = placed.groupBy("order", "region").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    members = common.cut(placed.join(open_regions, ["order", "region"], "left_semi").select("id", "root").distinct())
    left = _compact(common.cut(rare_pairs(sets.join(members, "id").select("id", "root", "elements"))))
    of_crowds = _compact(common.cut(confirmed(left, sets)))
    if of_crowds.count():
        roots = components(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(of_crowds))
    del sets, members, left, placed, open_regions, crowded
    common.tidy(docs.sparkSession)
    of_class = classes.join(roots, "id", "left").select(
        "set_key", F.coalesce("root", "id").alias("component_id")
    )
    return (
        described.join(of_class, "set_key", "left")
        .withColumn(
            "component_id",
            F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(
                F.col("doc_id").isNotNull(), F.col("component_id")
            ),
        )
        .select(
            "doc_id", "n_shingles", "component_id",
            F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
        )
    )


def drop_near(docs: DataFrame) -> DataFrame:
    """The documents that are kept, whole rows; rows that share an id stay or go alike."""
    of_ids = near_groups(docs).groupBy(F.col("doc_id").alias("__gone_id")).agg(F.bool_or("kept").alias("__stays"))
    gone = of_ids.where("NOT __stays").select("__gone_id")
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("__gone_id"), "left_anti")
