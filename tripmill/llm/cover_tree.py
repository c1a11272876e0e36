"""Exact top-k by inner product: a dual-tree search over cover trees.

A bounded sample is ordered farthest first, and its first rows are the centres of the
cells: a level of a cover tree, each centre as far from the others as any row of the sample
is from its nearest. All rows, queries and candidates alike, go to the cell of the
nearest centre. A cell is split by a hash into blocks of candidates and groups of queries,
so a cell that holds a third of all rows is many blocks. Each block and each group is one
row with a cover tree of its own: nested sets of centres, farthest first, whose covering
radii shrink level by level; a node knows the radius that covers what is beneath.

No score between a node of queries and one of candidates exceeds <q, c> + rq |c| + rc |q|
+ rq rc, with centres q, c and radii rq, rc. A pair of nodes is dropped if that is less than
the worst k-th score so far of the node's queries; ties stay, for they go by id. First
each group meets a block of its own cell, which gives k-th scores to start with. Then
cells are dropped against cells, blocks against groups, and in the tasks nodes against
nodes. What is left is scored by integer products. Leaving out a pair needs the bound
alone, so the result is exact whatever the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tripmill.llm import common

SCALE = 1024
QUERY_EVERY = 100
TOP = 10
#: Rows that the cells are chosen from, and cells, at most.
SAMPLE, CELLS = 4_096, 256
#: Candidates of a block and queries of a group, about; a block of long vectors has fewer.
BLOCK_ROWS, GROUP_ROWS, BLOCK_BYTES = 1_024, 64, 1 << 20
#: Candidates of a leaf, rows that are scored at once before the bounds are looked at
#: again, and the factor by which radii shrink from level to level. A query is a leaf.
LEAF, PORTION, SHRINK = 12, 256, 1.3
#: Sums of products below this are exact in floating point.
EXACT = 2.0**53

NODE = np.dtype([("row", "<i4"), ("radius", "<f8"), ("begin", "<i4"), ("end", "<i4"), ("low", "<i4"), ("high", "<i4")])


# --- cover trees ------------------------------------------------------------


def farthest_first(points: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows so that each is the farthest from those before it, and how far: the rows up to
    any place are a net of that radius. Ends early where all are covered at radius 0."""
    norms = np.einsum("ij,ij->i", points, points)
    chosen, radii, at = [], [], 0
    left = np.full(len(points), np.inf)
    while len(chosen) < min(count, len(points)):
        if chosen and left[at] <= 0:
            break
        radii.append(left[at])
        chosen.append(at)
        away = np.maximum(norms + norms[at] - 2 * (points @ points[at]), 0)
        away[at] = 0
        np.minimum(left, away, out=left)
        at = int(left.argmax())
    return np.array(chosen), np.sqrt(np.array(radii))


def _distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    squares = np.einsum("ij,ij->i", points, points)[:, None] + np.einsum("ij,ij->i", centres, centres)
    return np.sqrt(np.maximum(squares - 2 * (points @ centres.T), 0))


class Tree(NamedTuple):
    """Nodes, level by level, and the order of the rows; a node has the rows from low to
    high of that order, its centre among them, and the children from begin to end."""

    nodes: np.ndarray
    order: np.ndarray


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """The tree of points, with `leaf` rows a leaf on average. Levels are prefixes of the farthest-first order, so each holds the one above. A
    centre hangs on the nearest of the level above, itself if it is there, and a row on the
    nearest of the last level."""
    n = len(points)
    centres, radii = farthest_first(points, -(-n // leaf))
    widths = [1]
    while widths[-1] < len(centres):
        widths.append(int(np.count_nonzero(radii > radii[widths[-1]] / SHRINK)))
    owner = _distances(points, points[centres]).argmin(axis=1)
    owner[centres] = np.arange(len(centres))
    owners = [owner]
    for width in widths[-2::-1]:
        parent = _distances(points[centres], points[centres[:width]]).argmin(axis=1)
        parent[:width] = np.arange(width)
        owners.append(parent[owners[-1]])
    # From the last level to the first: lexsort takes the last key first.
    order = np.lexsort(owners)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    starts = [np.flatnonzero(np.concatenate([[True], np.diff(each[order]) != 0])) for each in owners[::-1]]
    offsets = np.cumsum([0, *map(len, starts)])
    nodes = np.zeros(offsets[-1], NODE)
    for depth, (low, each) in enumerate(zip(starts, owners[::-1])):
        level = nodes[offsets[depth] : offsets[depth + 1]]
        level["low"], level["high"] = low, [*low[1:], n]
        rows = centres[each[order]]
        level["row"] = place[rows[low]]
        level["radius"] = np.maximum.reduceat(np.linalg.norm(points[order] - points[rows], axis=1), low)
        if depth + 1 < len(starts):
            for name, edge in (("begin", "low"), ("end", "high")):
                level[name] = offsets[depth + 1] + np.searchsorted(starts[depth + 1], level[edge])
    return Tree(nodes, order)


# --- dual-tree search -------------------------------------------------------

NONE = np.iinfo(np.int64).min


class Side(NamedTuple):
    """The rows of a block or a group in the order of its tree."""

    nodes: np.ndarray
    marks: np.ndarray
    ids: np.ndarray
    points: np.ndarray
    norms: np.ndarray


def side(row: dict) -> Side:
    marks, ids = (np.frombuffer(row[name], "<i8") for name in ("marks", "ids"))
    points = np.frombuffer(row["points"], "<i4").reshape(len(marks), -1).astype(np.float64)
    return Side(np.frombuffer(row["nodes"], NODE), marks, ids, points, np.linalg.norm(points, axis=1))


class Best:
    """The k best of each query so far, by falling score and rising id."""

    def __init__(self, queries: int, k: int):
        self.scores = np.full((queries, k), NONE, np.int64)
        self.ids = np.zeros((queries, k), np.int64)

    def kth(self) -> np.ndarray:
        return self.scores[:, -1]

    def offer(self, query: int, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Takes the best of these; which of them are among the k best now."""
        all_scores = np.concatenate([self.scores[query], scores])
        all_ids = np.concatenate([self.ids[query], ids])
        k = self.scores.shape[1]
        taken = np.lexsort((all_ids, -all_scores.astype(np.float64), all_scores == NONE))[:k]
        if len(all_scores) and np.abs(all_scores[taken]).max() >= EXACT:
            taken = np.array(sorted(range(len(all_scores)), key=lambda i: (-int(all_scores[i]), int(all_ids[i])))[:k])
        self.scores[query], self.ids[query] = all_scores[taken], all_ids[taken]
        return taken[taken >= k] - k


def _products(queries: Side, low: int, high: int, block: Side, rows: np.ndarray) -> np.ndarray:
    largest = queries.norms[low:high].max() * block.norms[rows].max()
    if largest < EXACT:
        return (queries.points[low:high] @ block.points[rows].T).astype(np.int64)
    if largest >= 2.0**62:
        raise OverflowError("a score does not fit a long")
    return queries.points[low:high].astype(np.int64) @ block.points[rows].astype(np.int64).T


def _bounds(queries: Side, a: np.ndarray, block: Side, b: np.ndarray) -> np.ndarray:
    """What no score of these pairs of nodes exceeds, rounding included."""
    q, c = queries.nodes[a], block.nodes[b]
    dots = np.einsum("ij,ij->i", queries.points[q["row"]], block.points[c["row"]])
    spread = q["radius"] * block.norms[c["row"]] + c["radius"] * queries.norms[q["row"]] + q["radius"] * c["radius"]
    return dots + spread + 1 + 1e-9 * (np.abs(dots) + spread)


def _children(nodes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The children of nodes, a leaf standing for itself, and whose they are by place."""
    leaf = nodes["begin"][which] == nodes["end"][which]
    begin = np.where(leaf, which, nodes["begin"][which])
    sizes = np.where(leaf, 1, nodes["end"][which] - nodes["begin"][which])
    owner = np.repeat(np.arange(len(which)), sizes)
    return begin[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes), owner


def search(queries: Side, block: Side, best: Best) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Improves best by the rows of the block; yields (query, scores, ids) of what is taken
    in, some of which a later one may push out again."""
    def worst(nodes: np.ndarray) -> np.ndarray:
        kth = best.kth()
        return np.array([kth[low:high].min() for low, high in zip(queries.nodes["low"][nodes], queries.nodes["high"][nodes])])

    a = b = np.zeros(1, np.int64)
    while True:
        distinct, where = np.unique(a, return_inverse=True)
        bounds = _bounds(queries, a, block, b)
        stay = bounds >= worst(distinct)[where]
        a, b, bounds = a[stay], b[stay], bounds[stay]
        if not len(a):
            return
        below, owner = _children(queries.nodes, a)
        a_next, b_next = below, b[owner]
        below, owner = _children(block.nodes, b_next)
        a_next, b_next = a_next[owner], below
        if len(a_next) == len(a) and (a_next == a).all() and (b_next == b).all():
            break
        a, b = a_next, b_next
    for leaf in np.unique(a):
        low, high = queries.nodes[leaf]["low"], queries.nodes[leaf]["high"]
        mine = np.flatnonzero(a == leaf)
        mine = mine[np.argsort(-bounds[mine], kind="stable")]
        sizes = block.nodes["high"][b[mine]] - block.nodes["low"][b[mine]]
        # The likeliest leaves first; after each portion the rest may be out of reach.
        portions = np.cumsum(sizes) // PORTION
        for portion in np.unique(portions):
            chosen = mine[portions == portion]
            chosen = chosen[bounds[chosen] >= best.kth()[low:high].min()]
            if not len(chosen):
                break
            rows = np.concatenate([np.arange(x["low"], x["high"]) for x in block.nodes[b[chosen]]])
            scores = _products(queries, low, high, block, rows)
            for query in range(low, high):
                mine_too = scores[query - low]
                good = np.flatnonzero((mine_too >= best.kth()[query]) & (block.marks[rows] != queries.marks[query]))
                if len(good):
                    offered, ids = mine_too[good], block.ids[rows[good]]
                    taken = best.offer(query, offered, ids)
                    if len(taken):
                        yield query, offered[taken], ids[taken]


# --- in Spark ---------------------------------------------------------------

_VECTORS = "mark long, vec_id long, cell int, point binary"
_SIDES = "cell int, part long, marks binary, ids binary, points binary, nodes binary"


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")
    ).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)


def integers(column: pa.Array, width: int) -> np.ndarray:
    """A row of `width` whole numbers per vector, shorter vectors filled with zeros."""
    sizes = np.array([len(each) for each in column], np.int64)
    out = np.zeros((len(column), width))
    if len(column) and width:
        filled = np.arange(width) < sizes[:, None]
        out[filled] = np.floor(column.flatten().to_numpy(zero_copy_only=False) * SCALE)
    if np.abs(out).max(initial=0) >= 2**31:
        raise OverflowError("a component is beyond 32 bits")
    return out


def _assign(centres: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        points = integers(batch.column("embedding"), centres.shape[1])
        cells = _distances(points, centres).argmin(axis=1) if len(points) else np.zeros(0)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("mark"), batch.column("vec_id"), pa.array(cells.astype(np.int32)),
                pa.array([row.tobytes() for row in points.astype("<i4")], pa.binary()),
            ],
            ["mark", "vec_id", "cell", "point"],
        )


def _plant(leaf: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block or group, with its cover tree."""
    for batch in batches:
        for row in batch.to_pylist():
            rows = row["rows"]
            marks = np.array([each["mark"] for each in rows], "<i8")
            ids = np.array([each["vec_id"] for each in rows], "<i8")
            points = np.frombuffer(b"".join(each["point"] for each in rows), "<i4").reshape(len(rows), -1)
            tree = cover_tree(points.astype(np.float64), leaf)
            arrays = (marks[tree.order], ids[tree.order], points[tree.order], tree.nodes)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["cell"]], pa.int32()), pa.array([row["part"]], pa.int64())]
                + [pa.array([each.tobytes()], pa.binary()) for each in arrays],
                ["cell", "part", "marks", "ids", "points", "nodes"],
            )


def _planted(rows: DataFrame, parts: DataFrame, name: str, leaf: int) -> DataFrame:
    """Rows in as many parts of their cell as `parts` says, each with its cover tree."""
    part = F.pmod(F.xxhash64("mark"), F.col(name))
    # Number of cells, CELLS at most.
    return common.cut(
        rows.join(F.broadcast(parts.select("cell", name)), "cell")
        .groupBy("cell", part.alias("part"))
        .agg(F.collect_list(F.struct("mark", "vec_id", "point")).alias("rows"))
        .mapInArrow(partial(_plant, leaf), _SIDES)
    )


_VISITS = "g_cell int, g_part long, marks binary, ids binary, points binary, nodes binary, top_scores binary, top_ids binary"
_TAKEN = "mark long, query_id long, vec_id long, score long"
#: Groups whose best a task remembers from block to block.
REMEMBERED = 2_000


def _visit(k: int, taken: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks, each followed by the groups that visit it. One block is held at a time.
    Yields what a visit takes in, or each group with its best."""
    block, remembered = None, {}
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            if row["g_cell"] is None:
                block = side(row)
                continue
            group = (row["g_cell"], row["g_part"])
            queries = side(row)
            best = remembered.get(group)
            if best is None:
                best = Best(len(queries.marks), k)
                if row["top_scores"] is not None:
                    best.scores = np.frombuffer(row["top_scores"], "<i8").reshape(-1, k).copy()
                    best.ids = np.frombuffer(row["top_ids"], "<i8").reshape(-1, k).copy()
                if len(remembered) >= REMEMBERED:
                    remembered.clear()
                remembered[group] = best
            found = list(search(queries, block, best))
            if taken:
                sizes = [len(scores) for _, scores, _ in found]
                which = np.repeat(np.array([query for query, _, _ in found], np.int64), sizes)
                if len(which):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(queries.marks[which]), pa.array(queries.ids[which]),
                            pa.array(np.concatenate([ids for _, _, ids in found])),
                            pa.array(np.concatenate([scores for _, scores, _ in found])),
                        ],
                        ["mark", "query_id", "vec_id", "score"],
                    )
            else:
                row |= {"top_scores": best.scores.astype("<i8").tobytes(), "top_ids": best.ids.astype("<i8").tobytes()}
                names = [field.split()[0] for field in _VISITS.split(", ")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row[name]], kind) for name, kind in zip(names, [pa.int32(), pa.int64(), *[pa.binary()] * 6])], names
                )


def _meet(blocks: DataFrame, visits: DataFrame, k: int, taken: bool) -> DataFrame:
    """Every visit (a group with the cell and part of the block it goes to) meets its block."""
    none = F.lit(None)
    hosts = blocks.withColumns(
        {"g_cell": none.cast("int"), "g_part": none.cast("long"), "top_scores": none.cast("binary"), "top_ids": none.cast("binary")}
    )
    return (
        hosts.unionByName(visits)
        .repartition("cell", "part")
        .sortWithinPartitions("cell", "part", F.col("g_cell").asc_nulls_first(), "g_part")
        .mapInArrow(partial(_visit, k, taken), _TAKEN if taken else _VISITS)
    )


def _bests(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            marks, ids = (np.frombuffer(row[name], "<i8") for name in ("marks", "ids"))
            scores, others = (np.frombuffer(row[name], "<i8") for name in ("top_scores", "top_ids"))
            some = scores != NONE
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(marks, k)[some]), pa.array(np.repeat(ids, k)[some]), pa.array(others[some]), pa.array(scores[some])],
                ["mark", "query_id", "vec_id", "score"],
            )


def _reaches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the cell's bound needs of each block or group: the farthest row from the
    cell's centre, and the worst k-th score."""
    for batch in batches:
        for row in batch.to_pylist():
            points = np.frombuffer(row["points"], "<i4").reshape(len(row["marks"]) // 8, -1).astype(np.float64)
            centre = np.frombuffer(row["centre"], "<f8")
            far = float(np.linalg.norm(points - centre, axis=1).max())
            tops = row["top_scores"]
            worst = int(np.frombuffer(tops, "<i8").reshape(len(points), -1)[:, -1].min()) if tops else NONE
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["cell"]], pa.int32()), pa.array([far]), pa.array([worst], pa.int64())], ["cell", "far", "worst"]
            )


def _reach(sides: DataFrame, centres: DataFrame) -> dict[int, tuple[float, int]]:
    """(radius, worst k-th score) of each cell, CELLS at most."""
    found = sides.join(F.broadcast(centres), "cell").mapInArrow(_reaches, "cell int, far double, worst long")
    return {row.cell: (row.far, row.worst) for row in found.groupBy("cell").agg(F.max("far").alias("far"), F.min("worst").alias("worst")).collect()}


def nearest(embeddings: DataFrame, k: int = TOP, query_every: int = QUERY_EVERY) -> DataFrame:
    """The k highest inner products of every query: query_id, rank (from 1), vec_id, score.

    Components become floor(SCALE * x). Queries are the rows whose vec_id is divisible by
    query_every; candidates are all rows but the query's own, fewer than k if there are
    fewer. Ties go to the smaller vec_id. Rows without vec_id, without a vector or with a
    null or non-finite component take no part; a shorter vector counts as filled with zeros,
    an empty one scores 0. Rows that repeat a vec_id are rows like others: each is a
    candidate of the other, and a query of its own if it is one. Components of 2 ** 31 or more
    after scaling and scores of 2 ** 62 or more are errors. Further columns are not read.
    """
    spark = embeddings.sparkSession
    rows = usable(embeddings)
    count, width = rows.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(SAMPLE).toArrow()
    points = integers(sample.column("embedding").combine_chunks(), width)
    chosen, _ = farthest_first(points, min(CELLS, -(-count // BLOCK_ROWS)))
    centres = points[chosen]
    marked = rows.withColumn("mark", F.monotonically_increasing_id())
    assigned = common.cut(marked.mapInArrow(partial(_assign, centres), _VECTORS))
    asks = F.col("vec_id") % query_every == 0
    per_block = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (4 * max(1, width))))
    per_group = max(1, min(GROUP_ROWS, per_block))
    parts = common.cut(
        assigned.groupBy("cell").agg(F.count("*").alias("n"), F.count_if(asks).alias("q")).select(
            "cell", F.ceil(F.col("n") / per_block).alias("blocks"), F.greatest(F.ceil(F.col("q") / per_group), F.lit(1)).alias("groups")
        )
    )
    blocks = _planted(assigned, parts, "blocks", LEAF)
    groups = _planted(assigned.where(asks), parts, "groups", 1).withColumnsRenamed({"cell": "g_cell", "part": "g_part"})
    groups = groups.withColumns({"top_scores": F.lit(None).cast("binary"), "top_ids": F.lit(None).cast("binary")})
    home = (
        groups.join(F.broadcast(parts), F.col("g_cell") == F.col("cell"))
        .withColumn("part", F.pmod("g_part", "blocks"))
        .drop("blocks", "groups")
    )
    started = common.cut(_meet(blocks, home, k, taken=False))
    # The cells against each other: at most CELLS of them, and CELLS ** 2 pairs.
    middles = spark.createDataFrame([(i, row.tobytes()) for i, row in enumerate(centres)], "cell int, centre binary")
    held = _reach(blocks.withColumn("top_scores", F.lit(None).cast("binary")), middles)
    asked = _reach(started.withColumnRenamed("g_cell", "cell"), middles)
    norms = np.linalg.norm(centres, axis=1)
    pairs = []
    for mine, (radius, worst) in asked.items():
        others = np.array(sorted(held))
        far = np.array([held[i][0] for i in others])
        dots = centres[others] @ centres[mine]
        spread = radius * norms[others] + far * norms[mine] + radius * far
        bound = dots + spread + 1 + 1e-9 * (np.abs(dots) + spread)
        pairs += [(mine, int(other)) for other in others[bound >= worst]]
    pairs = spark.createDataFrame(pairs, "g_cell int, cell int")
    visits = (
        started.join(F.broadcast(pairs), "g_cell")
        .join(F.broadcast(parts), "cell")
        .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .where("NOT (cell = g_cell AND part = pmod(g_part, blocks))")
        .drop("blocks", "groups")
    )
    found = started.mapInArrow(partial(_bests, k), _TAKEN).unionByName(_meet(blocks, visits, k, taken=True))
    rank = F.row_number().over(common.Window.partitionBy("mark").orderBy(F.desc("score"), "vec_id"))
    return (
        found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
    )
