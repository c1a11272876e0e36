import zlib
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from made_words import words
from tripmill.llm import catalog, language, pieces

NAMES = ["<unk>", "▁", "a", "b", "ab", "▁a", "ba", "aba", "▁ab"]


@pytest.fixture(scope="module")
def small():
    return pieces.vocabulary(NAMES, np.zeros(len(NAMES)), {n: i for i, n in enumerate(NAMES) if i}, {})


def by_hand(probabilities, word, lang):
    """The sum over all segmentations, by recursion."""
    unit = "▁" + word

    @lru_cache
    def total(start):
        if start == len(unit):
            return 1.0
        out = 0.0
        for end in range(start + 1, len(unit) + 1):
            part = unit[start:end]
            if part in NAMES[1:]:
                out += probabilities[NAMES.index(part), lang] * total(end)
            elif end == start + 1:
                out += probabilities[-1, lang] * total(end)
        return out

    return total(0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("abc"), min_size=1, max_size=60), min_size=1, max_size=6))
def test_forward_sums_all_segmentations(small, some):
    probabilities = np.random.default_rng(1).random((len(NAMES) + 1, 2)) / 5
    logs = language.log_likelihoods(pieces.Walker(small.trie), probabilities, some)
    for word, row in zip(some, logs):
        assert row == pytest.approx([np.log(by_hand(probabilities, word, lang)) for lang in (0, 1)])


def test_long_words_are_learned_from_like_short_ones(small, monkeypatch):
    probabilities = np.random.default_rng(3).random((len(NAMES) + 1, 2)) / 5
    some, own, counts = ["abacab" * 7, "ba", "cabba" * 9], np.array([0, 1, 1]), np.array([2, 5, 3])
    walked = []
    for together in (48, 4):
        monkeypatch.setattr(pieces, "TOGETHER", together)
        walked.append(language.expected_uses(pieces.Walker(small.trie), probabilities, some, own, counts))
    assert walked[1] == pytest.approx(walked[0]) and walked[0].any(axis=0).all()


def test_expected_uses_are_those_of_the_segmentations(small):
    probabilities = np.random.default_rng(2).random((len(NAMES) + 1, 1)) / 5
    uses = language.expected_uses(pieces.Walker(small.trie), probabilities, ["ab"], np.array([0]), np.array([3]))
    ways = [["▁", "a", "b"], ["▁", "ab"], ["▁a", "b"], ["▁ab"]]
    weight = [np.prod([probabilities[NAMES.index(p), 0] for p in way]) for way in ways]
    for piece in NAMES[1:]:
        wanted = 3 * sum(w * way.count(piece) for w, way in zip(weight, ways)) / sum(weight)
        assert uses[NAMES.index(piece), 0] == pytest.approx(wanted)


def learnable(i):
    return zlib.crc32(str(i).encode()) % 4 != 2


def test_learns_and_predicts(documents, odd_rows):
    rows = []
    for i in range(100, 260):
        lang = ("xx", "yy")[i % 2]
        rows.append((i, " ".join(words(30, i, "abcde" if lang == "xx" else "defgh")), lang))
    frame = documents(rows + [(999, "123 ... 456", "xx"), (998, None, "yy")])
    model = language.fit(frame, pieces.load(catalog.PIECES))
    assert model.languages == ["xx", "yy"]
    found = {row.doc_id: row for row in language.predict(frame, model).collect()}
    for i, _, lang in rows:
        assert found[i].lang_pred == lang and 0.5 < found[i].score <= 1
        assert found[i].held_out != learnable(i)
    for i in (998, 999):
        assert (found[i].lang_pred, found[i].score) == ("und", 0.0)
    odd = language.predict(documents(odd_rows), model).collect()
    assert len(odd) == len(odd_rows)
    assert {row.lang_pred for row in odd if row.doc_id in (1, 2, 3)} == {"und"}


def test_nothing_to_learn_from(documents):
    rows = [(i, "some text", None) for i in range(5)]
    model = language.fit(documents(rows), pieces.load(catalog.PIECES))
    assert {row.lang_pred for row in language.predict(documents(rows), model).collect()} == {"und"}
    assert language.predict(documents([]), model).count() == 0


def test_languages_are_learned_in_groups_without_a_difference(documents, monkeypatch):
    letters = ("abcde", "defgh", "ghijk", "klmno", "nopqr")
    rows = [(i, " ".join(words(12, i, letters[i % 5])), f"l{i % 5}") for i in range(100, 200)]
    vocabulary = pieces.load(catalog.PIECES)
    whole = language.fit(documents(rows), vocabulary)
    monkeypatch.setattr(language, "GROUP", 2)
    parted = language.fit(documents(rows), vocabulary)
    assert parted.languages == whole.languages == [f"l{k}" for k in range(5)]
    assert np.allclose(parted.probabilities, whole.probabilities, rtol=1e-9)
    texts = [text for _, text, _ in rows[:20]] + [None, "1"]
    names, scores = language.Scorer(whole).score(texts)
    assert language.Scorer(parted).score(texts)[0] == names == [f"l{i % 5}" for i in range(100, 120)] + ["und"] * 2


def test_more_languages_than_a_model_holds_are_refused(documents, monkeypatch):
    monkeypatch.setattr(language, "LANGUAGES", 3)
    rows = [(i, "some text", f"l{i % 4}") for i in range(100, 140)]
    with pytest.raises(ValueError, match="languages"):
        language.fit(documents(rows), pieces.load(catalog.PIECES))
