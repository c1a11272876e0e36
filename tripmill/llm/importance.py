"""Importance resampling towards a target corpus, over deduplicated lines.

Features are words and pairs of consecutive words, hashed into buckets. A bucket's gain is
the logarithm of how much likelier it is in the target; a document's weight is the floored
mean of its features' gains, and with Gumbel noise from its id the highest scores are a
sample without replacement.

Texts are cut at line ends into lines, as their words in a row. Many lines occur again
and again (notices, menus, quoted passages, whole copies), so every distinct line's
features are hashed once: their counts times the line's occurrences, and the pairs that
span two lines apart, make up the corpus. For the weights each distinct line's gains are
summed once and meet the documents by the line's key; only pairs across lines are hashed
per document. A line that more than one of HOT_SHARE occurrences has (at most HOT_SHARE
lines) is added in the scan; so no key of the join has more rows than that share.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tripmill.llm import common

BUCKETS = 10_000
LEAST_WORDS = 20
DRAWN_PERCENT = 25
SEED = 7
HOT_SHARE = 1_000

# ASCII letters in lower case, all other bytes of ASCII as blanks but for line ends; bytes
# of other characters stay.
_PLAIN = bytes(
    byte if byte >= 0x80 or chr(byte).islower() or byte == 0x0A else byte + 32 if chr(byte).isupper()
    else byte if chr(byte).isdigit() else 0x20
    for byte in range(256)
)
_LINES = "key binary, line binary, n long"
_KEPT = "key binary, n long, buckets binary"


def lines(text: pa.Scalar) -> Iterator[list[bytes]]:
    """The words of each line that has any."""
    if text.is_valid:
        for line in bytes(text.as_buffer()).translate(_PLAIN).split(b"\n"):
            words = line.split()
            if words:
                yield words


def hashed(words: list[bytes]) -> np.ndarray:
    """The buckets of a line's words and of its pairs."""
    codes = [zlib.crc32(word) for word in words]
    codes += [zlib.crc32(b" " + second, first) for first, second in zip(codes, words[1:])]
    return (np.array(codes, np.uint32) % BUCKETS).astype("<u2")


def across(last: bytes, first: bytes) -> int:
    """The bucket of the pair that spans two lines."""
    return zlib.crc32(b" " + first, zlib.crc32(last)) % BUCKETS


def key_of(line: bytes) -> bytes:
    return xxhash.xxh3_128_digest(line)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct lines of a batch and how often it has them; buckets of pairs across lines
    in rows without a line."""
    for batch in batches:
        found: Counter = Counter()
        spanning: Counter = Counter()
        for text in batch.column("text"):
            last = None
            for words in lines(text):
                if last is not None:
                    spanning[across(last, words[0])] += 1
                last = words[-1]
                found[b" ".join(words)] += 1
        keys = [key_of(line) for line in found] + [bucket.to_bytes(2, "little") for bucket in spanning]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(keys, pa.binary()),
                pa.array([*found, *[None] * len(spanning)], pa.binary()),
                pa.array([*found.values(), *spanning.values()], pa.int64()),
            ],
            ["key", "line", "n"],
        )


def _hash_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key one per key, with its buckets and occurrences."""
    key, n, buckets = None, 0, b""
    for batch in batches:
        out = []
        for now, line, times in zip(batch.column("key").to_pylist(), batch.column("line"), batch.column("n").to_pylist()):
            if now != key:
                if key is not None:
                    out.append((key, n, buckets))
                key, n = now, 0
                buckets = hashed(line.as_py().split()).tobytes() if line.is_valid else now
            n += times
        yield _kept(out)
    if key is not None:
        yield _kept([(key, n, buckets)])


def _kept(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 3
    kinds = (pa.binary(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "n", "buckets"])


def distinct_lines(texts: DataFrame) -> DataFrame:
    """(key, n, buckets) of every distinct line of (text), n its occurrences; pairs across
    lines are rows with a key of two bytes, their bucket."""
    return common.cut(
        texts.select("text").mapInArrow(_cut, _LINES)
        .repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(_hash_once, _KEPT)
    )


def _buckets(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all rows in a row, and how many each has."""
    parts = batch.column("buckets").to_pylist()
    return np.frombuffer(b"".join(parts), "<u2"), np.array([len(part) // 2 for part in parts], np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        buckets, sizes = _buckets(batch)
        np.add.at(total, buckets, np.repeat(batch.column("n").to_numpy(), sizes))
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])


def feature_counts(distinct: DataFrame) -> np.ndarray:
    """How many features each bucket has: BUCKETS numbers, summed in Spark."""
    counts = np.zeros(BUCKETS, np.int64)
    summed = distinct.select("n", "buckets").mapInArrow(_counts, "bucket int, n long").groupBy("bucket").agg(F.sum("n"))
    for bucket, n in summed.collect():
        counts[bucket] = n
    return counts


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    all_target, all_corpus = float(target.sum() + BUCKETS), float(corpus.sum() + BUCKETS)
    ratios = (target + 1.0) * all_corpus / ((corpus + 1.0) * all_target)
    return np.array([math.floor(1000 * math.log(ratio)) for ratio in ratios], np.int64)


def _line_gains(gain: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            buckets, sizes = _buckets(batch)
            begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            sums = np.add.reduceat(gain[buckets], begins)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(sums)], ["key", "gain"])


def _weigh(gain: np.ndarray, hot: dict[bytes, int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document its words, the gain of pairs across lines and of hot lines, and its
    other lines by their keys."""
    for batch in batches:
        n_words, own, keys, times = [], [], [], []
        for text in batch.column("text"):
            count, total, last, others = 0, 0, None, Counter()
            for words in lines(text):
                if last is not None:
                    total += int(gain[across(last, words[0])])
                last = words[-1]
                count += len(words)
                key = key_of(b" ".join(words))
                if key in hot:
                    total += hot[key]
                else:
                    others[key] += 1
            n_words.append(count)
            own.append(total)
            keys.append(list(others))
            times.append(list(others.values()))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("mark"), batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(own, pa.int64()),
                pa.array(keys, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64())),
            ],
            ["mark", "doc_id", "n_words", "own", "keys", "times"],
        )


def weights(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every document."""
    distinct = distinct_lines(docs)
    gain = gains(feature_counts(distinct_lines(target)), feature_counts(distinct))
    of_lines = distinct.where(F.octet_length("key") > 2)
    summed = of_lines.select("key", "buckets").mapInArrow(partial(_line_gains, gain), "key binary, gain long")
    occurrences = of_lines.agg(F.sum("n")).first()[0] or 0
    often = of_lines.where(F.col("n") * HOT_SHARE > occurrences)
    # Fewer than HOT_SHARE lines can have that share of the occurrences.
    hot = often.select("key", "buckets").mapInArrow(partial(_line_gains, gain), "key binary, gain long").collect()
    marked = docs.select(
        F.monotonically_increasing_id().alias("mark"), F.col("doc_id").cast("long").alias("doc_id"), "text"
    )
    weighed = marked.mapInArrow(
        partial(_weigh, gain, {bytes(row.key): row.gain for row in hot}),
        "mark long, doc_id long, n_words long, own long, keys array<binary>, times array<long>",
    )
    uses = weighed.select(
        "mark", "doc_id", "n_words", "own", F.explode_outer(F.arrays_zip("keys", "times")).alias("use")
    ).select("mark", "doc_id", "n_words", "own", F.col("use.keys").alias("key"), F.col("use.times").alias("times"))
    total = F.max("own") + F.coalesce(F.sum(F.col("times") * F.col("gain")), F.lit(0))
    return (
        uses.join(summed, "key", "left")
        .groupBy("mark", "doc_id", "n_words")
        .agg(total.alias("total"))
        .withColumn("n_features", F.greatest(2 * F.col("n_words") - 1, F.lit(0)))
        .select(
            "doc_id", "n_words", "n_features",
            F.expr("if(n_features = 0, 0, (total - pmod(total, n_features)) div n_features)").alias("weight"),
        )
    )


def resample(docs: DataFrame, target: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank, and n_words.

    Of documents with LEAST_WORDS words at least, DRAWN_PERCENT percent are drawn: the
    highest scores, ties to the smaller id; the others have no rank. A null text counts as
    empty: no features, weight 0. A row without an id has the noise of an empty one and
    comes after others it ties with; repeated rows are documents like others and may all be
    drawn. Texts are read whole; columns but doc_id and text are not. No rows give none, and
    an empty target leaves the corpus's own counts to decide.
    """
    noise = F.conv(
        F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10
    ).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296.0)))
    scored = common.cut(weights(docs, target).withColumn("score", F.col("weight") + gumbel))
    long_enough = F.col("n_words") >= LEAST_WORDS
    drawn = DRAWN_PERCENT * scored.where(long_enough).count() // 100
    order = [long_enough.desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    placed = common.ranked(scored, [], order)
    return placed.select(
        "doc_id", "n_features", "weight", "score",
        F.when(long_enough & (F.col("rank") < drawn), (F.col("rank") + 1).cast("long")).alias("rank"),
        "n_words",
    )
