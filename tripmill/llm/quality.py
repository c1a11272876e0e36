"""Quality rules judged by an isolation forest.

Each whole text gives rule statistics. Two base rules reject outright. Six further
statistics say by how much of its tolerance each rule is exceeded, so that a clean
text is near the origin. An isolation forest over labelled documents turns them into
an anomaly score: the shorter the mean path to a document over random splits, the
more unlike the bulk it is. The score from which a document is rejected is the one
that best tells the labelled classes apart.

The forest is fitted on a bounded sample of labelled rows; every document is judged,
in one pass without a shuffle.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
REPEAT_PERCENT = 20
# Where a rule's statistic begins to count and where it counts in full.
TOLERANCES = {
    "symbol_share": (0.02, 0.10),
    "exclamations": (0.10, 0.50),
    "capital_words": (0.15, 0.50),
    "symbol_words": (0.10, 0.30),
    "echoed_words": (0.10, 0.30),
    "dup_line_share": (0.35, 0.70),
}

_BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_BASE_FIELDS = [
    pa.field(name, pa.int64())
    for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
]


class Forest(NamedTuple):
    """Trees one after the other; a leaf's children are itself and its `depth` is
    the path length it stands for."""

    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    low: np.ndarray
    high: np.ndarray
    depth: np.ndarray
    levels: int
    usual: float


class Model(NamedTuple):
    forest: Forest | None
    threshold: float


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of five that the text has twice or more."""
    windows = list(zip(*(words[i:] for i in range(WINDOW))))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    covered = end = 0
    for start, window in enumerate(windows):
        if seen[window] > 1:
            covered += start + WINDOW - max(start, end)
            end = start + WINDOW
    return covered


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The base counts and the rules' excesses, each 0 to 1. No text has no words."""
    text = text or ""
    content = text.encode("utf-8", "replace")
    words = content.split()
    lines = [line for line in content.split(b"\n") if line.strip()]
    n_words = len(words)
    word_chars = len(text) - sum(map(text.count, SPACES))
    n_symbols = sum(map(text.count, SYMBOLS))
    n_dup_lines = len(lines) - len(set(lines))
    per_word, per_char, per_line = max(n_words, 1), max(word_chars, 1), max(len(lines), 1)
    shares = {
        "symbol_share": n_symbols / per_char,
        "exclamations": text.count("!") / per_word,
        "capital_words": sum(len(word) > 2 and word.isupper() for word in words) / per_word,
        "symbol_words": sum(word[-1:] in b"#*$%&|<>" for word in words) / per_word,
        "echoed_words": sum(a == b for a, b in zip(words, words[1:])) / per_word,
        "dup_line_share": n_dup_lines / per_line,
    }
    excess = [
        min(1.0, max(0.0, (shares[rule] - begin) / (full - begin)))
        for rule, (begin, full) in TOLERANCES.items()
    ]
    return [n_words, word_chars, n_symbols, n_dup_lines, repeated_words(words)], excess


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > REPEAT_PERCENT * counts[:, 0])


def _measured(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    both = [statistics(text.as_py()) for text in texts]
    counts = np.array([counts for counts, _ in both], np.int64).reshape(-1, 5)
    excess = np.array([excess for _, excess in both], float).reshape(-1, len(TOLERANCES))
    return counts, excess


# --- the forest -------------------------------------------------------------


def usual_path(rows: int) -> float:
    """Mean path of an unsuccessful search in a random binary tree of so many rows."""
    if rows < 2:
        return 0.0
    return 2 * (math.log(rows - 1) + np.euler_gamma) - 2 * (rows - 1) / rows


def grow(rows: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 17) -> Forest:
    """A tree splits its sample at random values of random features that vary, until
    rows are alone, alike or at the depth limit."""
    random = np.random.default_rng(seed)
    sample = min(sample, len(rows))
    levels = max(1, math.ceil(math.log2(max(sample, 2))) + 4)
    nodes: list[list[float]] = []

    def add(part: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append([0, 0.0, at, at, depth + usual_path(len(part))])
        low, high = part.min(axis=0), part.max(axis=0)
        varying = np.flatnonzero(high > low)
        if depth < levels and len(varying):
            feature = random.choice(varying)
            cut = random.uniform(low[feature], high[feature])
            left = part[:, feature] <= cut
            nodes[at][:4] = feature, cut, add(part[left], depth + 1), add(part[~left], depth + 1)
        return at

    roots = [add(rows[random.choice(len(rows), sample, replace=False)], 0) for _ in range(trees)]
    feature, cut, low, high, depth = (np.array(column) for column in zip(*nodes))
    whole = lambda column: column.astype(np.int32)
    return Forest(
        np.array(roots, np.int32), whole(feature), cut, whole(low), whole(high), depth,
        levels, max(usual_path(sample), 1e-9),
    )


def anomaly(forest: Forest, rows: np.ndarray) -> np.ndarray:
    """0 to 1: about 0.5 and less is usual, near 1 is isolated at once."""
    total = np.zeros(len(rows))
    every = np.arange(len(rows))
    for root in forest.roots:
        at = np.full(len(rows), root, np.int32)
        for _ in range(forest.levels + 1):
            at = np.where(rows[every, forest.feature[at]] <= forest.cut[at], forest.low[at], forest.high[at])
        total += forest.depth[at]
    return 2.0 ** (-total / len(forest.roots) / forest.usual)


def best_threshold(scores: np.ndarray, good: np.ndarray) -> float:
    """Between the two scores where most bad rows are above and most good ones not;
    of equal choices the one that rejects fewest."""
    if good.all() or not good.any():
        return 1.0
    levels = np.unique(scores)
    between = np.append((levels[1:] + levels[:-1]) / 2, 1.0)
    caught = np.searchsorted(np.sort(scores[~good]), between, "right") / (~good).sum()
    kept = np.searchsorted(np.sort(scores[good]), between, "right") / good.sum()
    gain = np.round(kept - caught, 12)
    return float(between[np.flatnonzero(gain == gain.max())[-1]])


# --- over documents ---------------------------------------------------------


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> Model:
    """Fits forest and threshold on labelled documents, at most `max_rows` of them,
    chosen by a hash of their ids. Labels without an id or other than 0 and 1 are not
    used. With no labelled row or only one class, nothing but the base rules rejects."""
    chosen = (
        labels.where("doc_id IS NOT NULL AND quality IN (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, excess = _measured(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("quality"), pa.array(base_failed(counts)),
                 pa.array(list(excess), pa.list_(pa.float64()))],
                ["doc_id", "quality", "failed", "excess"],
            )

    # At most max_rows ids and labels are broadcast, so the texts are not shuffled.
    labelled = (
        docs.select(F.col("doc_id").cast("long"), "text")
        .join(F.broadcast(chosen.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"))), "doc_id")
        .mapInArrow(measure, "doc_id long, quality int, failed boolean, excess array<double>")
        .where("NOT failed")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "excess")
        .limit(max_rows)
        .collect()
    )
    if not labelled:
        return Model(None, 1.0)
    rows = np.array([row.excess for row in labelled])
    forest = grow(rows)
    return Model(forest, best_threshold(anomaly(forest, rows), np.array([row.quality == 1 for row in labelled])))


def _verdict(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    counts, excess = _measured(texts)
    failed = base_failed(counts)
    score = anomaly(model.forest, excess) if model.forest else np.zeros(len(excess))
    return counts, failed, ~failed & (score <= model.threshold), score


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, the base counts, base_failed, kept, anomaly. A null or
    empty text has no words and fails; repeated rows are judged alike, one row each;
    columns but doc_id and text are not read; no rows give none."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, failed, kept, score = _verdict(shared.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, counts.T), *map(pa.array, (failed, kept, score))],
                ["doc_id", *(field.name for field in _BASE_FIELDS), "base_failed", "kept", "anomaly"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, f"doc_id long, {_BASE}, base_failed boolean, kept boolean, anomaly double"
    )


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are kept, whole rows with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = _verdict(shared.value, batch.column(batch.schema.get_field_index("text")))[2]
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
