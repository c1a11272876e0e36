"""A fixed vocabulary of pieces in a double-array trie, and its walks over many units.

A unit is a stretch of text that no piece goes beyond. Pieces carry the whitespace
marker only at their beginning, so a unit is a run of spaces with what follows them, up
to the next space or line end; texts share most units, and each is worked out once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

MARKER = "▁"
#: Units up to this length are walked together; longer ones one by one.
TOGETHER = 48
#: Units whose results are held at once.
HELD = 150_000
#: Characters of text that are worked on at once.
CHARS_AT_ONCE = 1_500_000


class Trie(NamedTuple):
    """From state s a character with code c leads to base[s] + c, if check is s there.
    value is the piece's id that ends in a state, or -1. Code 0 leads nowhere."""

    points: np.ndarray
    codes: np.ndarray
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray


def build(pieces: dict[str, int]) -> Trie:
    """The trie of non-empty pieces, placed breadth first at the first offsets that fit."""
    letters: dict[str, int] = {}
    for piece in pieces:
        for letter in piece:
            letters[letter] = letters.get(letter, 0) + 1
    code = {letter: i + 1 for i, letter in enumerate(sorted(letters, key=lambda x: (-letters[x], x)))}
    root: dict = {}
    for piece, number in pieces.items():
        node = root
        for letter in piece:
            node = node.setdefault(code[letter], {})
        node[0] = number
    room = 4 * (sum(map(len, pieces)) + len(code) + 64)
    base, check, value = (np.full(room, fill, np.int32) for fill in (0, -1, -1))
    check[0] = -2
    lowest = 1
    level = [(0, root)]
    while level:
        below = []
        for state, node in level:
            value[state] = node.get(0, -1)
            children = np.array(sorted(key for key in node if key), np.int64)
            if not len(children):
                continue
            while check[lowest] != -1:
                lowest += 1
            start, width = max(0, lowest - int(children[0])), 64
            while True:
                tried = np.arange(start, start + width)
                fits = (check[tried[:, None] + children] == -1).all(axis=1)
                if fits.any():
                    offset = int(tried[fits.argmax()])
                    break
                start, width = start + width, min(4096, width * 4)
            base[state] = offset
            check[offset + children] = state
            below += [(offset + int(key), node[int(key)]) for key in children]
        level = below
    used = int(np.flatnonzero(check != -1).max()) + len(code) + 2
    points = np.array([ord(letter) for letter in code], np.int64)
    return Trie(points, np.array(list(code.values()), np.int32), base[:used], check[:used], value[:used])


class Vocabulary(NamedTuple):
    pieces: list[str]
    scores: np.ndarray
    trie: Trie
    #: Ids of the 256 byte pieces, or None.
    bytes_: np.ndarray | None
    unit: str


def load(path: str, scores: str = "rank") -> Vocabulary:
    """Reads a piece model on the driver; its size bounds what the executors are sent.

    Models of merges store ranks instead of log scores. "rank" therefore takes the log
    scores of a Zipf law over the order of the pieces, "stored" those of the file.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    byte_ids = {names[i]: i for i in range(len(names)) if model.is_byte(i)}
    plain = {
        name: i
        for i, name in enumerate(names)
        if name and not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
    }
    log_scores = np.zeros(len(names))
    if scores == "stored":
        log_scores[:] = [model.get_score(i) for i in range(len(names))]
    else:
        order = sorted(plain.values(), key=lambda i: (-model.get_score(i), i))
        log_scores[order] = -np.log(np.arange(len(order)) + 2.0)
    return vocabulary(names, log_scores, plain, byte_ids)


def vocabulary(names: list[str], scores: np.ndarray, plain: dict[str, int], byte_ids: dict[str, int]) -> Vocabulary:
    every = [byte_ids.get(f"<0x{byte:02X}>") for byte in range(256)]
    closed = not any(MARKER in name.lstrip(MARKER) for name in plain)
    lines = any("\n" in name for name in plain)
    if not closed:
        unit = r"(?s:.+)"
    else:
        unit = r" *[^ ]+| +" if lines else r" *[^ \n]+| +|\n"
    return Vocabulary(names, scores, build(plain), None if None in every else np.array(every, np.int32), unit)


class Walker:
    """Finds the pieces of units. `spaces` makes a space the marker; a marker that the
    text itself has is then no piece, so that it stays what it is."""

    def __init__(self, trie: Trie, spaces: bool = True):
        self.trie = trie
        self.code = np.zeros(0x110000, np.int32)
        self.code[trie.points] = trie.codes
        if spaces:
            self.code[ord(" ")], self.code[ord(MARKER)] = self.code[ord(MARKER)], 0

    def codes(self, text: str) -> np.ndarray:
        return self.code[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]

    def table(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the units, one row each, and their lengths."""
        lengths = np.array([len(unit) for unit in units])
        table = np.zeros((len(units), int(lengths.max(initial=0))), np.int32)
        row = np.repeat(np.arange(len(units)), lengths)
        column = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        table[row, column] = self.codes("".join(units))
        return table, lengths

    def arcs(self, table: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, length, rows, piece ids), by start and then length. A character that
        is no piece of its own has id -1."""
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for start in range(table.shape[1]):
            rows = np.flatnonzero(lengths > start)
            state = np.zeros(len(rows), np.int32)
            for length in range(1, table.shape[1] - start + 1):
                column = table[rows, start + length - 1]
                step = base[state] + column
                found = (check[step] == state) & (column > 0)
                if length == 1:
                    single = np.where(found, value[step], -1)
                    yield start, 1, rows, single
                    rows, state = rows[found], step[found]
                else:
                    rows, state = rows[found], step[found]
                    ends = value[state] >= 0
                    if ends.any():
                        yield start, length, rows[ends], value[state[ends]]
                inside = lengths[rows] > start + length
                rows, state = rows[inside], state[inside]
                if not len(rows):
                    break

    def arcs_of(self, unit: str) -> Iterator[tuple[int, int, int]]:
        """The same of a single unit: (start, length, piece id)."""
        codes = self.codes(unit).tolist()
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for start in range(len(codes)):
            state = 0
            for end in range(start, len(codes)):
                step = int(base[state]) + codes[end]
                found = codes[end] > 0 and check[step] == state
                if end == start:
                    yield start, 1, int(value[step]) if found else -1
                elif found and value[step] >= 0:
                    yield start, end - start + 1, int(value[step])
                if not found:
                    break
                state = step


def groups(units: list[str]) -> Iterator[list[int]]:
    """Places of short units, some thousand of about equal length at a time."""
    short = sorted((i for i, unit in enumerate(units) if len(unit) <= TOGETHER), key=lambda i: len(units[i]))
    for start in range(0, len(short), 4096):
        yield short[start : start + 4096]


def slices(texts) -> Iterator[tuple[int, list[str | None]]]:
    """(place of the first, texts) in portions of about CHARS_AT_ONCE characters."""
    portion: list[str | None] = []
    chars = first = 0
    for i, text in enumerate(texts):
        text = text.as_py()
        portion.append(text)
        chars += len(text or "")
        if chars >= CHARS_AT_ONCE:
            yield first, portion
            portion, chars, first = [], 0, i + 1
    if portion:
        yield first, portion


def unit_pattern(vocabulary_: Vocabulary) -> re.Pattern:
    return re.compile(vocabulary_.unit)
