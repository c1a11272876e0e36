"""Resharding by minimum-cost flow.

Old shards have sizes in bytes, new shards capacities that are as equal as whole bytes
allow. A minimum-cost flow from old to new shards tells how many bytes of each old shard
go where; a byte that stays costs nothing, so the fewest bytes move. The flow is solved on
the driver between shards (their number is bounded), never between rows.

A row is then placed by its running bytes within its old shard: the flow cuts the old
shard into stretches, one per new shard, and the stretch that holds the row's middle is its
place. Rows run from large to small and the first stretch is the one that stays, so cuts
to other shards fall between smaller rows. A new shard's size differs from its capacity by
less than the rows at its cuts. Only shards that give or take rows are written again.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, functions as F

from tripmill.llm import common

#: The most old and new shards together.
SHARDS = 2_000


def capacities(total: int, shards: int) -> list[int]:
    """The total in whole parts that differ by one at most, the larger ones first."""
    return [total // shards + (i < total % shards) for i in range(shards)]


def _cheapest(nodes: int, edges: list[tuple[int, int, int, int]], source: int, sink: int, amount: int) -> list[int]:
    """The flow on each edge (from, to, capacity, cost) that brings the amount from source
    to sink at least total cost: successive shortest paths with potentials."""
    graph: list[list[int]] = [[] for _ in range(nodes)]
    to, left, price = [], [], []
    for a, b, capacity, cost in edges:
        for at, other, room, paid in ((a, b, capacity, cost), (b, a, 0, -cost)):
            graph[at].append(len(to))
            to.append(other)
            left.append(room)
            price.append(paid)
    potential = [0] * nodes
    while amount:
        distance: list[float] = [float("inf")] * nodes
        distance[source] = 0
        came = [-1] * nodes
        queue = [(0, source)]
        while queue:
            far, at = heapq.heappop(queue)
            if far > distance[at]:
                continue
            for edge in graph[at]:
                longer = far + price[edge] + potential[at] - potential[to[edge]]
                if left[edge] and longer < distance[to[edge]]:
                    distance[to[edge]], came[to[edge]] = longer, edge
                    heapq.heappush(queue, (longer, to[edge]))
        for at, far in enumerate(distance):
            if far < float("inf"):
                potential[at] += far
        taken, at = [], sink
        while at != source:
            taken.append(came[at])
            at = to[came[at] ^ 1]
        moved = min(amount, *(left[edge] for edge in taken))
        for edge in taken:
            left[edge] -= moved
            left[edge ^ 1] += moved
        amount -= moved
    return left[1::2]


def least_moves(sizes: list[int], room: list[int], cost=None) -> list[list[int]]:
    """flow[old][new] in bytes, at least total cost. Sizes and room must sum to the same.

    Without prices a byte that stays costs nothing and one that moves costs 1; then all
    that moves passes one node, so the network has an edge per shard and not per pair."""
    if sum(sizes) != sum(room):
        raise ValueError("the new shards must hold exactly what the old ones have")
    n, m = len(sizes), len(room)
    source, sink, moving = n + m, n + m + 1, n + m + 2
    edges = [(source, i, size, 0) for i, size in enumerate(sizes)]
    edges += [(n + j, sink, size, 0) for j, size in enumerate(room)]
    if cost:
        pairs = [(i, j) for i in range(n) for j in range(m)]
        edges += [(i, n + j, sizes[i], cost(i, j)) for i, j in pairs]
    else:
        pairs = [(i, i) for i in range(min(n, m))]
        edges += [(i, n + i, sizes[i], 0) for i, _ in pairs]
        edges += [(i, moving, size, 1) for i, size in enumerate(sizes)]
        edges += [(moving, n + j, size, 0) for j, size in enumerate(room)]
    found = _cheapest(n + m + 3, edges, source, sink, sum(sizes))[n + m :]
    flow = [[0] * m for _ in sizes]
    for (i, j), amount in zip(pairs, found):
        flow[i][j] = amount
    if not cost:
        # What leaves the old shards goes to the new ones in their order.
        out, into = found[len(pairs) : len(pairs) + n], found[len(pairs) + n :]
        i = j = 0
        while i < n and j < m:
            amount = min(out[i], into[j])
            flow[i][j] += amount
            out[i] -= amount
            into[j] -= amount
            if not out[i]:
                i += 1
            else:
                j += 1
    return flow


def sized(docs: DataFrame, old_shard: Column) -> DataFrame:
    """(id, size, crc, key, old): a row's size is its text's UTF-8 bytes and one more. Rows
    with the same key have the same id, text and old shard; an old shard of null is 0."""
    content = F.coalesce("text", F.lit("")).cast("binary")
    old = F.coalesce(old_shard.cast("int"), F.lit(0))
    return docs.select(
        F.col("doc_id").cast("long").alias("id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(content).alias("crc"),
        _key(old).alias("key"),
        old.alias("old"),
    )


def _key(old: Column) -> Column:
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    parts = (F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("-")), digest, old.cast("string"))
    return F.concat_ws("/", *parts)


def assign(rows: DataFrame, shards: int) -> tuple[DataFrame, list[list[int]]]:
    """Rows (id, size, crc, key, old) with their new `shard` and `slot`, and the flow.

    `old` is 0 or more and may have gaps. The law is `bytes`: a group of equal texts is
    dealt out like other rows, as many shards must share a group that has a third of all
    bytes; rows that repeat are rows like any other. No rows leave every shard empty."""
    sums = {row.old: row.size for row in rows.groupBy("old").agg(F.sum("size").alias("size")).limit(SHARDS + 1).collect()}
    old = max(sums, default=0) + 1
    if old + shards > SHARDS:
        raise ValueError(f"more than {SHARDS} old and new shards")
    sizes = [sums.get(i, 0) for i in range(old)]
    flow = least_moves(sizes, capacities(sum(sizes), shards))
    # Stretches of an old shard, what stays first: (old, new, from, to) in bytes.
    stretches = []
    for i, moved in enumerate(flow):
        begin = 0
        for j in sorted(range(shards), key=lambda j: (j != i, j)):
            if moved[j]:
                stretches.append((i, j, begin, begin + moved[j]))
                begin += moved[j]
    spark = rows.sparkSession
    ends = {}
    for i, j, _, end in stretches:
        ends.setdefault(i, []).append((j, end))
    # Large rows first: size classes of a twelfth of a doubling, then a hash.
    keyed = rows.withColumn("mixed", F.xxhash64("id", "crc")).withColumns(
        {
            "class": -F.floor(F.log2("size") * 12).cast("int"),
            "bucket": F.shiftright("mixed", 64 - max(1, common.bucket_bits(rows.count()))),
        }
    )
    order = [F.col("mixed"), F.col("id"), F.col("crc")]
    ran = common.running(keyed, ["old"], ["class", "bucket"], order, begin=F.col("size"), rank=F.lit(1))
    table = spark.createDataFrame(
        [(i, [j for j, _ in each], [end for _, end in each]) for i, each in ends.items()],
        "old int, news array<int>, ends array<long>",
    )
    middle = F.expr("begin + size div 2")
    place = F.size(F.filter("ends", lambda end: end <= middle))
    # Kept, so that both uses below see the same rows at the same ranks. No texts in it.
    placed = common.cut(
        ran.join(F.broadcast(table), "old")
        .withColumn("shard", F.element_at("news", F.least(place, F.size("ends") - 1) + 1))
        .select("id", "size", "crc", "key", "old", "shard", "rank")
    )
    # A stretch has rows of consecutive ranks; its slots follow those of lower old shards.
    counted = placed.groupBy("shard", "old").agg(F.count("*").alias("n"), F.min("rank").alias("first")).collect()
    slots = []
    for shard in range(shards):
        begin = 0
        for row in sorted((row for row in counted if row.shard == shard), key=lambda row: row.old):
            slots.append((row.old, shard, begin - row["first"]))
            begin += row.n
    shift = spark.createDataFrame(slots, "old int, shard int, shift long")
    return (
        placed.join(F.broadcast(shift), ["old", "shard"])
        .select("id", "size", "crc", "key", "old", "shard", (F.col("rank") + F.col("shift")).alias("slot")),
        flow,
    )


def affected(flow: list[list[int]], shards: int) -> list[int]:
    """New shards whose files must be written: those that take rows from another shard or
    give some away. The files of the others stay as they are."""
    return [
        j
        for j in range(shards)
        if any(moved[j] for i, moved in enumerate(flow) if i != j)
        or j < len(flow) and any(moved for k, moved in enumerate(flow[j]) if k != j)
    ]


def rewrite(
    docs: DataFrame, old_shard: Column, placed: DataFrame, flow: list[list[int]], shards: int, path: str, files_per_shard: int = 8
) -> list[int]:
    """Brings the layout path/new_shard=<n> up to date and tells which shards it wrote: only
    affected ones, rows in slot order over several files. The others stay as they are, file
    by file. docs may be read from that layout: new files replace a shard's old ones when all
    are written; shards left without rows are removed after that.

    Every row goes where its own place is: rows are matched by id, full digest of the text
    and old shard, those that repeat all that by their rank, so repeats and rows without id
    keep a place each."""
    which = affected(flow, shards)
    gone = [i for i in range(len(flow)) if i >= shards and any(flow[i])]
    gone += [j for j in which if not any(moved[j] for moved in flow)]
    old = F.coalesce(old_shard.cast("int"), F.lit(0))
    touched = sorted({*which, *gone})
    rows = docs.where(old.isin(touched)).select(F.struct("*").alias("row"), _key(old).alias("key"))
    wanted = placed.where(F.col("shard").isin(which)).select("key", F.col("shard").alias("new_shard"), "slot")
    repeats = common.cut(wanted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    once = rows.join(repeats, "key", "left_anti").join(wanted.join(repeats, "key", "left_anti"), "key")
    several = [
        common.ranked(side.join(repeats, "key", "left_semi"), ["key"], order).drop("total")
        for side, order in ((rows, []), (wanted, [F.col("new_shard"), F.col("slot")]))
    ]
    (
        once.unionByName(several[0].join(several[1], ["key", "rank"]).drop("rank"))
        .repartitionByRange(max(1, len(which)) * files_per_shard, "new_shard", "slot")
        .sortWithinPartitions("new_shard", "slot")
        .select("row.*", "new_shard")
        .write.partitionBy("new_shard")
        .option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .parquet(path)
    )
    for shard in gone:
        common.remove_folder(docs.sparkSession, f"{path.rstrip('/')}/new_shard={shard}")
    return which
