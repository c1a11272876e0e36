"""Language by unigram pieces, summed over all segmentations.

Every language has a probability for each piece of a fixed public vocabulary. A text's
words are its runs of letters in lower case, each with a leading marker; the probability
of a word is the sum over all its segmentations of the product of its pieces, which a
forward pass over the word gives. Words are independent, so a text's log-likelihood is
the sum over its words, and the language with the highest one is predicted.

The piece probabilities are learned by expectation maximisation: the expected uses of
each piece over all segmentations, counted with forward and backward passes by Spark
over (language, word, count) rows, in a bounded sample of documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tripmill.llm import common, pieces as trie_pieces
from tripmill.llm.pieces import HELD, TOGETHER, Vocabulary, Walker

LETTERS = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"
#: Documents per language that are learned from, about; languages that are learned and
#: scored together, and those that a model can hold: more are an error.
SAMPLE = 2_000
GROUP, LANGUAGES = 100, 500
ROUNDS = 4
#: The share of every probability that is dealt evenly, so that no piece has none.
SMOOTHING = 0.01
#: Each character's probabilities are scaled up by this, so that no product vanishes.
SCALE = 8.0


class Model(NamedTuple):
    """probabilities[id, language]; the last row is that of a character without piece."""

    languages: list[str]
    probabilities: np.ndarray
    vocabulary: Vocabulary


def words(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def _units(some: list[str]) -> list[str]:
    return [" " + word for word in some]


def log_likelihoods(walker: Walker, probabilities: np.ndarray, some: list[str]) -> np.ndarray:
    """log P(word) per word and language, summed over all segmentations."""
    units = _units(some)
    languages = probabilities.shape[1]
    result = np.zeros((len(units), languages))
    longest = 1 + max(map(len, units), default=0)
    for members in trie_pieces.groups(units):
        table, lengths = walker.table([units[i] for i in members])
        forward = np.zeros((table.shape[1] + 1, len(members), languages))
        forward[0] = 1.0
        for start, length, at, ids in walker.arcs(table, lengths):
            forward[start + length, at] += forward[start, at] * (probabilities[ids] * SCALE**length)
        result[members] = np.log(forward[lengths, np.arange(len(members))]) - lengths[:, None] * np.log(SCALE)
    if longest > TOGETHER:
        logs = np.log(probabilities)
        for i, unit in enumerate(units):
            if len(unit) > TOGETHER:
                total = np.full((len(unit) + 1, languages), -np.inf)
                total[0] = 0.0
                for start, length, piece in walker.arcs_of(unit):
                    end = start + length
                    total[end] = np.logaddexp(total[end], total[start] + logs[piece])
                result[i] = total[-1]
    return result


def expected_uses(walker: Walker, probabilities: np.ndarray, some: list[str], language: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How often each piece is used, per language, over all segmentations of the words
    (each of one language, seen so often). Words too long to be walked together are walked
    one by one, in logs."""
    uses = np.zeros(probabilities.size)
    languages = probabilities.shape[1]
    units = _units(some)
    for members in trie_pieces.groups(units):
        table, lengths = walker.table([units[i] for i in members])
        own, n = language[members], len(members)
        arcs = [
            (start, length, at, ids, probabilities[ids, own[at]] * SCALE**length)
            for start, length, at, ids in walker.arcs(table, lengths)
        ]
        forward, backward = np.zeros((2, table.shape[1] + 1, n))
        forward[0] = 1.0
        backward[lengths, np.arange(n)] = 1.0
        for start, length, at, _, p in arcs:
            forward[start + length, at] += forward[start, at] * p
        for start, length, at, _, p in reversed(arcs):
            backward[start, at] += backward[start + length, at] * p
        weight = counts[members] / backward[0]
        for start, length, at, ids, p in arcs:
            share = forward[start, at] * p * backward[start + length, at] * weight[at]
            np.add.at(uses, (ids % len(probabilities)) * languages + own[at], share)
    uses = uses.reshape(probabilities.shape)
    for i, unit in enumerate(units):
        if len(unit) > trie_pieces.TOGETHER:
            logs = np.log(probabilities[:, language[i]])
            arcs = [(start, start + length, piece, logs[piece]) for start, length, piece in walker.arcs_of(unit)]
            forward, backward = np.full((2, len(unit) + 1), -np.inf)
            forward[0] = backward[-1] = 0.0
            for start, end, _, p in arcs:
                forward[end] = np.logaddexp(forward[end], forward[start] + p)
            for start, end, _, p in reversed(arcs):
                backward[start] = np.logaddexp(backward[start], backward[end] + p)
            for start, end, piece, p in arcs:
                uses[piece, language[i]] += counts[i] * np.exp(forward[start] + p + backward[end] - forward[-1])
    return uses


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: dict[str, Counter] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            seen.setdefault(lang, Counter()).update(words(text.as_py()))
        rows = [(lang, word, n) for lang, counter in seen.items() for word, n in counter.items()]
        columns = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())],
            ["lang", "word", "n"],
        )


def fit(docs: DataFrame, vocabulary: Vocabulary, sample: int = SAMPLE) -> Model:
    """Learns from documents that are not held out and have a language, about `sample`
    per language, chosen by a hash of their ids (all of a language that has fewer). With
    no such document there is no language and every text is undetermined. Every language
    is learned; more than LANGUAGES are refused, as the driver and each task hold the
    probabilities of all."""
    usable = docs.select(F.col("doc_id").cast("long"), "text", F.col("lang").cast("string")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~common.held_out(F.col("doc_id"))
    )
    sizes = usable.groupBy("lang").agg(F.count("*").alias("size")).limit(LANGUAGES + 1).collect()
    languages = sorted(row.lang for row in sizes)
    if len(languages) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages: fit several models")
    if not languages:
        return Model([], np.ones((len(vocabulary.pieces) + 1, 0)), vocabulary)
    spark = docs.sparkSession
    shares = spark.createDataFrame([(row.lang, sample / row.size) for row in sizes], "lang string, share double")
    draw = (F.xxhash64(F.lit(3), "doc_id") % 1_000_000 + 1_000_000) % 1_000_000
    counted = common.cut(
        usable.join(F.broadcast(shares), "lang")
        .where(draw < F.col("share") * 1_000_000)
        .select("lang", "text")
        .mapInArrow(_word_counts, "lang string, word string, n long")
        .groupBy("lang", "word")
        .agg(F.sum("n").alias("n"))
    )
    # Languages are independent of each other; a group of them goes through the rounds.
    groups_ = [languages[first : first + GROUP] for first in range(0, len(languages), GROUP)]
    parts = [_learn(counted.where(F.col("lang").isin(some)), some, vocabulary) for some in groups_]
    return Model(languages, np.concatenate(parts, axis=1), vocabulary)


def _learn(counted: DataFrame, languages: list[str], vocabulary: Vocabulary) -> np.ndarray:
    """The pieces' probabilities per language, from (lang, word, n)."""
    spark = counted.sparkSession
    number = {lang: i for i, lang in enumerate(languages)}
    probabilities = np.full((len(vocabulary.pieces) + 1, len(languages)), 1 / len(vocabulary.pieces))
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast((vocabulary.trie, probabilities, number))

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            trie, now, number = shared.value
            walker, uses = Walker(trie), np.zeros(now.shape)
            for batch in batches:
                own = np.array([number[lang] for lang in batch.column("lang").to_pylist()], np.int64)
                uses += expected_uses(walker, now, batch.column("word").to_pylist(), own, batch.column("n").to_numpy())
            piece, lang = np.nonzero(uses)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(lang), pa.array(uses[piece, lang])], ["piece", "lang", "uses"])

        # A row per piece and language at most.
        total = (
            counted.mapInArrow(expect, "piece long, lang long, uses double")
            .groupBy("piece", "lang")
            .agg(F.sum("uses").alias("uses"))
            .toPandas()
        )
        uses = np.zeros(probabilities.shape)
        uses[total["piece"], total["lang"]] = total["uses"]
        known = np.maximum(uses.sum(axis=0), 1e-9)
        probabilities = (1 - SMOOTHING) * uses / known + SMOOTHING / len(uses)
        shared.unpersist()
    return probabilities


class Scorer:
    """Scores texts; the log-likelihoods of up to HELD words are held, of fewer if there are
    many languages."""

    def __init__(self, model: Model):
        self.model = model
        self.walker = Walker(model.vocabulary.trie)
        self.index: dict[str, int] = {}
        self.logs = np.zeros((0, len(model.languages)))
        self.held = HELD * GROUP // max(GROUP, len(model.languages))

    def _logs(self, some: list[str]) -> np.ndarray:
        of_groups = [
            log_likelihoods(self.walker, self.model.probabilities[:, first : first + GROUP], some)
            for first in range(0, len(self.model.languages), GROUP)
        ]
        return np.concatenate(of_groups, axis=1) if of_groups else np.zeros((len(some), 0))

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language and its probability among the learned ones, per text."""
        counters = [Counter(words(text)) for text in texts]
        flat = [word for counter in counters for word in counter]
        new = list(dict.fromkeys(word for word in flat if word not in self.index))
        if len(self.index) + len(new) > self.held:
            self.index, self.logs = {}, self.logs[:0]
            new = list(dict.fromkeys(flat))
        if new:
            known = len(self.index)
            self.logs = np.concatenate([self.logs, self._logs(new)])
            self.index.update((word, known + i) for i, word in enumerate(new))
        counts = np.fromiter((n for counter in counters for n in counter.values()), np.int64, len(flat))
        text_of = np.repeat(np.arange(len(texts)), [len(counter) for counter in counters])
        each = self.logs[np.fromiter(map(self.index.__getitem__, flat), np.int64, len(flat))] * counts[:, None]
        sums = np.stack(
            [np.bincount(text_of, each[:, i], len(texts)) for i in range(each.shape[1])], axis=1
        ) if each.shape[1] else np.zeros((len(texts), 0))
        names, scores = [], []
        for counter, total in zip(counters, sums):
            if not counter or not len(total):
                names.append(UNDETERMINED)
                scores.append(0.0)
            else:
                best = int(total.argmax())
                names.append(self.model.languages[best])
                scores.append(float(1 / np.exp(total - total[best]).sum()))
        return names, scores


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every whole text.

    A null text, one without a letter, and any text when nothing was learned is `und`
    with score 0. Of equally likely languages the first by name is given. Repeated rows
    are scored alike; only doc_id (for held_out) and text are read; no rows give none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for first, texts in trie_pieces.slices(batch.column("text")):
                names, scores = scorer.score(texts)
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    return docs.select(
        F.col("doc_id").cast("long"), common.held_out(F.col("doc_id")).alias("held_out"), "text"
    ).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
