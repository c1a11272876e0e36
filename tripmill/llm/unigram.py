"""Unigram encoding and decoding over a fixed vocabulary of pieces.

A text gets a leading space, spaces become markers, and the segmentation into pieces with
the highest sum of log scores is found by Viterbi over a double-array trie; of equal sums
the longer last piece wins. A character that no piece covers is written as the pieces of
its UTF-8 bytes, a marker in the text itself too, so decoding gives back every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tripmill.llm import pieces as trie_pieces
from tripmill.llm.pieces import HELD, MARKER, TOGETHER, Vocabulary, Walker

# How far below the lowest score a character without a piece is.
UNKNOWN_BELOW = 10.0


class Encoder:
    """Encodes texts; the ids of up to HELD units are held and looked up."""

    def __init__(self, vocabulary: Vocabulary):
        if vocabulary.bytes_ is None:
            raise ValueError("the vocabulary has no byte pieces")
        self.vocabulary = vocabulary
        self.walker = Walker(vocabulary.trie)
        self.pattern = trie_pieces.unit_pattern(vocabulary)
        usable = vocabulary.scores[vocabulary.trie.value[vocabulary.trie.value >= 0]]
        # The last score is that of id -1.
        self.scores = np.append(vocabulary.scores, usable.min() - UNKNOWN_BELOW)
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.starts = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)

    def _bytes(self, letter: str) -> list[int]:
        return self.vocabulary.bytes_[list(letter.encode("utf-8", "surrogatepass"))].tolist()

    def best(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all units in one array, and where each unit's begin and how many."""
        starts, counts = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        parts: list[np.ndarray] = []
        done = 0
        for members in trie_pieces.groups(units):
            table, lengths = self.walker.table([units[i] for i in members])
            rows, width = table.shape
            best = np.full((rows, width + 1), -np.inf)
            best[:, 0] = 0.0
            begin = np.zeros((rows, width + 1), np.int32)
            piece = np.zeros((rows, width + 1), np.int32)
            for start, length, at, ids in self.walker.arcs(table, lengths):
                value = best[at, start] + self.scores[ids]
                better = value > best[at, start + length]
                at, ids = at[better], ids[better]
                best[at, start + length] = value[better]
                begin[at, start + length] = start
                piece[at, start + length] = ids
            # Back from the ends: one column for each step, then the columns reversed.
            end, live = lengths.copy(), np.arange(rows)
            back = []
            while len(live):
                column = np.full((rows, 2), -2, np.int32)
                column[live, 0] = piece[live, end[live]]
                column[live, 1] = end[live] = begin[live, end[live]]
                back.append(column)
                live = live[end[live] > 0]
            path = np.stack(back[::-1], axis=1)
            used = path[:, :, 0] > -2
            number = used.sum(axis=1)
            flat = path[:, :, 0][used]
            if (flat == -1).any():
                where = path[:, :, 1][used]
                unit_of = np.repeat(members, number).tolist()
                spread = [
                    [i] if i >= 0 else self._bytes(units[unit][start])
                    for i, unit, start in zip(flat.tolist(), unit_of, where.tolist())
                ]
                row_of = np.repeat(np.repeat(np.arange(rows), number), [len(each) for each in spread])
                flat = np.array([i for each in spread for i in each], np.int32)
                number = np.bincount(row_of, minlength=rows)
            starts[members] = done + np.cumsum(number) - number
            counts[members] = number
            parts.append(flat)
            done += len(flat)
        for i, unit in enumerate(units):
            if len(unit) > TOGETHER:
                ids = []
                for start, _, piece_id in self._long(unit):
                    ids += [piece_id] if piece_id >= 0 else self._bytes(unit[start])
                starts[i], counts[i] = done, len(ids)
                parts.append(np.array(ids, np.int32))
                done += len(ids)
        return np.concatenate(parts or [np.zeros(0, np.int32)]), starts, counts

    def _long(self, unit: str) -> list[tuple[int, int, int]]:
        scores = self.scores.tolist()
        best = [0.0] + [-np.inf] * len(unit)
        back: list[tuple[int, int, int]] = [(0, 0, 0)] * (len(unit) + 1)
        for start, length, piece in self.walker.arcs_of(unit):
            value = best[start] + scores[piece]
            if value > best[start + length]:
                best[start + length], back[start + length] = value, (start, length, piece)
        spans, end = [], len(unit)
        while end:
            spans.append(back[end])
            end = back[end][0]
        return spans[::-1]

    def _learn(self, units: list[str]) -> None:
        new = list(dict.fromkeys(unit for unit in units if unit not in self.index))
        if len(self.index) + len(new) > HELD:
            self._forget()
            new = list(dict.fromkeys(units))
        if not new:
            return
        flat, starts, counts = self.best(new)
        self.starts = np.concatenate([self.starts, len(self.flat) + starts])
        self.counts = np.concatenate([self.counts, counts])
        self.flat = np.concatenate([self.flat, flat])
        known = len(self.index)
        self.index.update((unit, known + i) for i, unit in enumerate(new))

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        """Ids of each text; none for a null or empty one."""
        units: list[str] = []
        ends = []
        for text in texts:
            if text:
                units += self.pattern.findall(" " + text)
            ends.append(len(units))
        self._learn(units)
        at = np.fromiter(map(self.index.__getitem__, units), np.int64, len(units))
        counts = self.counts[at]
        total = np.concatenate([[0], np.cumsum(counts)])
        ids = self.flat[np.arange(total[-1]) + np.repeat(self.starts[at] - total[:-1], counts)]
        offsets = total[np.array([0, *ends])].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))


class Decoder:
    """Joins pieces: byte pieces are bytes, markers spaces, and the first space goes."""

    def __init__(self, vocabulary: Vocabulary):
        content = [name.replace(MARKER, " ").encode() for name in vocabulary.pieces]
        if vocabulary.bytes_ is not None:
            for byte, number in enumerate(vocabulary.bytes_.tolist()):
                content[number] = bytes([byte])
        self.sizes = np.array([len(each) for each in content])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.content = np.frombuffer(b"".join(content), np.uint8)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts whose ids lie between consecutive offsets."""
        sizes = self.sizes[ids]
        total = np.concatenate([[0], np.cumsum(sizes)])
        content = self.content[np.arange(total[-1]) + np.repeat(self.starts[ids] - total[:-1], sizes)].tobytes()
        ends = total[offsets].tolist()
        texts = (content[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:]))
        return [text[1:] if text.startswith(" ") else text for text in texts]


def encode(docs: DataFrame, vocabulary: Vocabulary, *carried: str) -> DataFrame:
    """(doc_id, n_pieces, n_byte_pieces, n_words, ids, round_trip) of every whole text, and
    the columns named in `carried` as they are.

    Words are runs of characters other than space and line end. A null or empty text has
    no ids; round_trip says that decoding the ids gives the text back (null: as empty).
    Repeated rows are encoded alike; columns but doc_id, text and `carried` are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(shared.value), Decoder(shared.value)
        is_byte = np.zeros(len(shared.value.pieces) + 1, np.int64)
        is_byte[shared.value.bytes_] = 1
        word = re.compile(r"[^ \n]+")
        for batch in batches:
            for first, texts in trie_pieces.slices(batch.column("text")):
                ids = encoder.encode(texts)
                flat, offsets = ids.values.to_numpy(), ids.offsets.to_numpy()
                counts = np.diff(offsets)
                running = np.concatenate([[0], np.cumsum(is_byte[flat])])
                same = [back == (text or "") for back, text in zip(decoder.decode(flat, offsets), texts)]
                words = [len(word.findall(text)) if text else 0 for text in texts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, len(texts)), pa.array(counts.astype(np.int64)),
                     pa.array(running[offsets[1:]] - running[offsets[:-1]]), pa.array(words, pa.int64()),
                     ids, pa.array(same), *(batch.column(name).slice(first, len(texts)) for name in carried)],
                    ["doc_id", "n_pieces", "n_byte_pieces", "n_words", "ids", "round_trip", *carried],
                )

    fields = "doc_id long, n_pieces long, n_byte_pieces long, n_words long, ids array<int>, round_trip boolean"
    more = (f", {name} {docs.schema[name].dataType.simpleString()}" for name in carried)
    return docs.select(F.col("doc_id").cast("long"), "text", *carried).mapInArrow(run, fields + "".join(more))


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give a null text, none an empty one."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            ids = batch.column("ids")
            flat = ids.flatten().to_numpy()
            sizes = ids.value_lengths().fill_null(0).to_numpy()
            texts = decoder.decode(flat, np.concatenate([[0], np.cumsum(sizes)]))
            back = pa.array(texts, pa.string(), mask=ids.is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), back], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
