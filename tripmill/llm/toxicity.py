"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are words and their beginnings, and the same once more where a text has them
twice. Of a bounded sample of labelled documents all those are taken that toxic ones have
surely and far more often than others (over all words, the nearest texts are those on
the same matter, toxic or not); how many documents have each is counted over the whole
corpus. Every document becomes a TF-IDF vector over the terms.

The labelled vectors lie in an inverted index in blocks of examples. For each term a block
knows its largest weight, so the sum over a query's terms bounds every cosine of a block.
Blocks are visited by falling bound until the k-th best cosine beats the next bound: the k
nearest are exact. They vote with their cosine, and held-apart votes of the examples
themselves calibrate the share of toxic votes into a score. The nearest examples are the
evidence.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tripmill.llm import common
from tripmill.llm.pieces import HELD

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BEGINNINGS = (4, 5, 6, 7, 8)
AGAIN = "+"
#: Labelled documents that are learned from at most.
TOXIC_EXAMPLES, OTHER_EXAMPLES = 4_000, 8_000
#: A term is chosen from so many toxic examples, such a lift and such a G-statistic on.
LEAST_EXAMPLES, LEAST_LIFT, LEAST_G = 3, 3.0, 15.0
NEIGHBOURS = 15
BLOCK = 64
#: Weight of the prior among the votes.
PRIOR_VOTE = 0.5
BINS = 20
DECISION = 0.3


def terms(word: str) -> list[str]:
    return [word, *("^" + word[:n] for n in BEGINNINGS if len(word) > n)]


def words(text: str | None) -> Counter:
    return Counter(WORD.findall(text.lower())) if text else Counter()


class Vectors:
    """Finds the chosen terms of texts; the terms of up to HELD words are held."""

    def __init__(self, chosen: dict[str, int]):
        self.chosen = chosen
        self.again = {i: chosen[term + AGAIN] for term, i in chosen.items() if term + AGAIN in chosen}
        self.known: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str | None) -> dict[int, int]:
        found: dict[int, int] = {}
        for word, n in words(text).items():
            ids = self.known.get(word)
            if ids is None:
                if len(self.known) >= HELD:
                    self.known.clear()
                ids = tuple(self.chosen[term] for term in terms(word) if term in self.chosen)
                self.known[word] = ids
            for term in ids:
                found[term] = found.get(term, 0) + n
        found |= {self.again[term]: 1 for term, n in found.items() if n > 1 and term in self.again}
        return found


class Index:
    """Unit vectors of examples in blocks of an inverted index, with the largest weight of
    each term per block. Examples are ordered by their heaviest terms, so a block's examples are alike."""

    def __init__(self, vectors: list[dict[int, float]], toxic: list[int], ids: list[int]):
        heaviest = [sorted(vector, key=lambda t: (-vector[t], t)) for vector in vectors]
        order = sorted(range(len(vectors)), key=lambda i: (heaviest[i][:3], ids[i]))
        self.toxic = np.array([toxic[i] for i in order], float)
        self.ids = [ids[i] for i in order]
        self.position = {i: place for place, i in enumerate(order)}
        width = 1 + max((t for vector in vectors for t in vector), default=-1)
        count = -(-len(order) // BLOCK)
        # Per block the places of the terms it has, and their weights as a small table.
        self.place = np.full((count, width), -1, np.int16)
        self.blocks: list[np.ndarray] = []
        self.bounds = np.zeros((width, count))
        for number in range(count):
            members = order[number * BLOCK : (number + 1) * BLOCK]
            own = sorted({t for i in members for t in vectors[i]})
            self.place[number, own] = np.arange(len(own))
            weights = np.zeros((len(own), BLOCK))
            for column, i in enumerate(members):
                for term, weight in vectors[i].items():
                    weights[self.place[number, term], column] = weight
            self.blocks.append(weights)
            self.bounds[own, number] = weights.max(axis=1)

    def nearest(self, query: dict[int, float], k: int = NEIGHBOURS, without: int = -1) -> list[tuple[float, int]]:
        """The k largest (cosine, -place) with positive cosine, falling; of equal cosines
        the smaller places."""
        known = [t for t in query if t < len(self.bounds)]
        terms_ = np.array(known, np.int64)
        weights = np.array([query[t] for t in known])
        bound = weights @ self.bounds[terms_] if known else np.zeros(len(self.blocks))
        best: list[tuple[float, int]] = []
        for number in np.argsort(-bound, kind="stable").tolist():
            limit = bound[number] + 1e-9
            if limit <= 1e-9 or (len(best) == k and best[0][0] > limit):
                break
            rows = self.place[number, terms_]
            has = rows >= 0
            cosine = np.round(weights[has] @ self.blocks[number][rows[has]], 9)
            floor = best[0][0] if len(best) == k else 0.0
            for place in np.flatnonzero((cosine > 0) & (cosine >= floor)).tolist():
                at = number * BLOCK + place
                if at != without:
                    entry = (float(cosine[place]), -at)
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
        return sorted(best, reverse=True)


class Model(NamedTuple):
    idf: np.ndarray
    index: Index
    prior: float
    calibrated: np.ndarray
    #: What an example that is not toxic, and a toxic one, count among the votes.
    weights: tuple[float, float] = (1.0, 1.0)

    def weigh(self, counts: dict[int, int]) -> dict[int, float]:
        """The unit TF-IDF vector of term counts."""
        vector = {t: (1 + np.log(n)) * self.idf[t] for t, n in counts.items()}
        norm = np.sqrt(sum(w * w for w in vector.values()))
        return {t: float(w / norm) for t, w in vector.items()}

    def votes(self, found: list[tuple[float, int]]) -> float:
        toxic = self.weights[1] * sum(cosine * self.index.toxic[-place] for cosine, place in found)
        total = toxic + self.weights[0] * sum(cosine * (1 - self.index.toxic[-place]) for cosine, place in found)
        return (toxic + PRIOR_VOTE * self.prior) / (total + PRIOR_VOTE)

    def score(self, share: float | None) -> float:
        """The calibrated score of a share of toxic votes; None for a text without terms."""
        if share is None:
            return float(self.calibrated[0])
        centres = (np.arange(BINS) + 0.5) / BINS
        return float(np.interp(share, centres, self.calibrated[1:]))


def calibrate(shares: list[float | None], toxic: list[int], weight: list[float], prior: float) -> np.ndarray:
    """The rate of toxic examples without terms, and per bin of the share of votes, made
    rising by pooling neighbours. A bin holds one imaginary example at its share (without
    terms: at the prior), so an empty one passes the votes on as they are."""
    sums, totals = np.append(prior, (np.arange(BINS) + 0.5) / BINS), np.ones(BINS + 1)
    for share, label, w in zip(shares, toxic, weight):
        at = 0 if share is None else 1 + min(BINS - 1, int(share * BINS))
        sums[at] += label * w
        totals[at] += w
    pools: list[list[float]] = []
    for s, n in zip(sums[1:], totals[1:]):
        pools.append([s, n, 1])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    rising = [s / n for s, n, count in pools for _ in range(int(count))]
    return np.array([sums[0] / totals[0], *rising])


def _g_statistic(a: Column, b: Column, n_a: int, n_b: int) -> Column:
    """How surely a of n_a and b of n_b differ, from their presences alone."""
    share = n_a / (n_a + n_b)
    both = a + b
    part_a = F.when(a > 0, a * F.log(a / (both * share))).otherwise(0.0)
    part_b = F.when(b > 0, b * F.log(b / (both * (1 - share)))).otherwise(0.0)
    return 2 * (part_a + part_b)


def _examples(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic, weight): the bounded sample; weight is how many labelled documents
    of its class an example stands for."""
    usable = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where(
        F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~common.held_out(F.col("doc_id"))
    )
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {row.toxic: row["count"] for row in usable.groupBy("toxic").count().collect()}
    parts = [
        usable.where(F.col("toxic") == label)
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
        .withColumn("weight", F.lit(max(1.0, sizes.get(label, 0) / most)))
        for label, most in ((1, TOXIC_EXAMPLES), (0, OTHER_EXAMPLES))
    ]
    return parts[0].unionByName(parts[1])


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = (Counter(), Counter())
        for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist()):
            present: Counter = Counter()
            for word, n in words(text.as_py()).items():
                for term in terms(word):
                    present[term] += n
            seen[toxic].update(present.keys())
            seen[toxic].update([term + AGAIN for term, n in present.items() if n > 1])
        every = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(every, pa.string()), pa.array([seen[1][t] for t in every], pa.int64()), pa.array([seen[0][t] for t in every], pa.int64())],
            ["term", "toxic", "other"],
        )


def choose_terms(examples: DataFrame) -> list[str]:
    """The terms of labelled texts (text, toxic) that tell toxic ones, those that tell most
    first; the texts are a bounded sample, so the terms are no more than it has. A text that
    repeats counts once under each label."""
    examples = common.cut(examples.select("text", "toxic").distinct())
    sizes = {row.toxic: row["count"] for row in examples.groupBy("toxic").count().collect()}
    n_toxic, n_other = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_other:
        return []
    counted = (
        examples.mapInArrow(_term_counts, "term string, toxic long, other long")
        .groupBy("term")
        .agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
        .where(F.col("toxic") >= LEAST_EXAMPLES)
        .withColumn("lift", (F.col("toxic") / n_toxic) / ((F.col("other") + 0.5) / n_other))
        .withColumn("g", _g_statistic(F.col("toxic"), F.col("other"), n_toxic, n_other))
        .where((F.col("lift") >= LEAST_LIFT) & (F.col("g") >= LEAST_G))
        .orderBy(F.desc("g"), "term")
    )
    best = [row.term for row in counted.collect()]
    # A doubled term is found by its single one.
    return list(dict.fromkeys(best + [term.removesuffix(AGAIN) for term in best]))


def vectors(docs: DataFrame, chosen: list[str]) -> DataFrame:
    """(doc_id, held_out, terms, counts) of every whole text, terms ascending."""
    shared = docs.sparkSession.sparkContext.broadcast({term: i for i, term in enumerate(chosen)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Vectors(shared.value)
        for batch in batches:
            found = [sorted(of(text.as_py()).items()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"),
                 pa.array([[t for t, _ in each] for each in found], pa.list_(pa.int32())),
                 pa.array([[n for _, n in each] for each in found], pa.list_(pa.int64()))],
                ["doc_id", "held_out", "terms", "counts"],
            )

    return docs.select(
        F.col("doc_id").cast("long"), common.held_out(F.col("doc_id")).alias("held_out"), "text"
    ).mapInArrow(run, "doc_id long, held_out boolean, terms array<int>, counts array<long>")


def fit(vectors_: DataFrame, examples: DataFrame, n_terms: int) -> Model:
    """Indexes and calibrates on the examples' vectors; document counts per term are those
    of all vectors. Of examples that repeat an id each row is one."""
    counts = vectors_.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()
    total = vectors_.count()
    frequency = np.zeros(max(n_terms, 1))
    for row in counts:
        frequency[row.term] = row.n
    idf = np.log((total + 1) / (frequency + 1)) + 1
    rows = (
        vectors_.join(F.broadcast(examples.select("doc_id", "toxic")), "doc_id")
        .select("doc_id", "toxic", "terms", "counts")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "terms")
        .limit(TOXIC_EXAMPLES + OTHER_EXAMPLES)
        .collect()
    )
    of_class = examples.groupBy("toxic").agg(F.sum("weight").alias("size"), F.max("weight").alias("weight")).collect()
    sizes = {row.toxic: row["size"] for row in of_class}
    weight = {row.toxic: row["weight"] for row in of_class}
    prior = (sizes.get(1, 0) + 0.5) / (sum(sizes.values()) + 1)
    empty = Model(
        idf, Index([], [], []), prior, np.append(prior, (np.arange(BINS) + 0.5) / BINS),
        (weight.get(0, 1.0), weight.get(1, 1.0)),
    )
    with_terms = [row for row in rows if row.terms]
    weighed = [empty.weigh(dict(zip(row.terms, row.counts))) for row in with_terms]
    model = empty._replace(
        index=Index(weighed, [row.toxic for row in with_terms], [row.doc_id for row in with_terms])
    )
    shares: list[float | None] = [
        model.votes(model.index.nearest(vector, without=model.index.position[i])) for i, vector in enumerate(weighed)
    ]
    labels = [row.toxic for row in with_terms]
    bare = [row.toxic for row in rows if not row.terms]
    labels += bare
    return model._replace(
        calibrated=calibrate(shares + [None] * len(bare), labels, [weight[label] for label in labels], prior)
    )


def score(vectors_: DataFrame, model: Model, evidence: int = 3) -> DataFrame:
    """(doc_id, held_out, score, predicted, nearest, cosines) of each vector."""
    shared = vectors_.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple] = {}
        model = shared.value
        for batch in batches:
            out = []
            for ids, counts in zip(batch.column("terms").to_pylist(), batch.column("counts").to_pylist()):
                key = (tuple(ids), tuple(counts))
                if key not in known:
                    if len(known) >= HELD // 4:
                        known.clear()
                    found = model.index.nearest(model.weigh(dict(zip(ids, counts)))) if ids else []
                    value = model.score(model.votes(found) if found else None)
                    known[key] = (
                        value, [model.index.ids[-at] for _, at in found[:evidence]], [c for c, _ in found[:evidence]],
                    )
                out.append(known[key])
            scores, nearest, cosines = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()),
                 pa.array([int(s >= DECISION) for s in scores], pa.int32()),
                 pa.array(nearest, pa.list_(pa.int64())), pa.array(cosines, pa.list_(pa.float64()))],
                ["doc_id", "held_out", "score", "predicted", "nearest", "cosines"],
            )

    return vectors_.mapInArrow(
        run,
        "doc_id long, held_out boolean, score double, predicted int, nearest array<long>, cosines array<double>",
    )


def detect(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, nearest, cosines.

    A null or empty text, and one with none of the terms, has the score of such examples
    and no evidence. Labels without an id or other than 0 and 1 are not learned from; an
    id labelled both ways counts as toxic; without labels of both kinds every score is
    the prior. Repeated rows are scored alike; no rows give none. Of documents only
    doc_id (for held_out and to find the examples) and text are read.
    """
    examples = common.cut(_examples(labels))
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(examples), "doc_id")
    chosen = choose_terms(texts.select("text", "toxic"))
    found = common.cut(vectors(docs, chosen))
    return score(found, fit(found, examples, len(chosen)))
