import re

import numpy as np
import pytest
from hypothesis import given, strategies as st

from made_words import words
from tripmill.llm import quality

WORD = re.compile("[^\x20\x09-\x0D]+")


def expected(text):
    """The base counts, by their definitions."""
    text = text or ""
    tokens = WORD.findall(text)
    windows = [tuple(tokens[i : i + 5]) for i in range(len(tokens) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines = text.split("\n")
    dup = sum(bool(WORD.search(line)) and line in lines[:i] for i, line in enumerate(lines))
    return [len(tokens), sum(map(len, tokens)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)]


@given(st.text(st.sampled_from("ab #*\n\té \x0b"), max_size=60))
def test_base_counts(text):
    counts, excess = quality.statistics(text)
    assert counts == expected(text)
    assert all(0 <= value <= 1 for value in excess)


def clean(i):
    return " ".join(words(30 + i % 50, i)) + "."


@pytest.fixture(scope="module")
def corpus():
    rows, labels = [], []
    for i in range(240):
        junk = i % 8 == 0
        text = clean(i)
        if junk:
            text = "!! ".join(text.upper().split()) if i % 16 else "### ".join(text.split())
        rows.append((i, text))
        labels.append((i, int(not junk), 0))
    return rows, labels


def test_junk_goes_and_clean_stays(spark, documents, corpus):
    rows, labels = corpus
    frame = documents(rows)
    model = quality.fit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    judged = {row.doc_id: row for row in quality.judge(frame, model).collect()}
    assert {i for i, row in judged.items() if not row.kept} == {i for i, good, _ in labels if not good}
    for i, text in rows:
        row = judged[i]
        assert [row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words] == expected(text)
    kept = quality.keep_good(frame, model)
    assert kept.columns == frame.columns
    assert sorted(row.doc_id for row in kept.collect()) == [i for i, good, _ in labels if good]


def test_paths_equal_a_walk_down_each_tree(corpus):
    rng = np.random.default_rng(0)
    rows = rng.random((60, 3))
    forest = quality.grow(rows, trees=7, sample=32)
    scores = quality.anomaly(forest, rows)
    for row, score in zip(rows, scores):
        total = 0.0
        for node in forest.roots:
            while forest.low[node] != node:
                node = (forest.low if row[forest.feature[node]] <= forest.cut[node] else forest.high)[node]
            total += forest.depth[node]
        assert score == pytest.approx(2 ** (-total / 7 / forest.usual))


def test_threshold_tells_the_classes_apart():
    scores, good = np.array([0.2, 0.3, 0.4, 0.6, 0.7]), np.array([True, True, True, False, False])
    assert quality.best_threshold(scores, good) == pytest.approx(0.5)
    assert quality.best_threshold(scores, np.ones(5, bool)) == 1.0


def test_odd_rows_and_missing_labels(spark, documents, odd_rows):
    frame = documents(odd_rows)
    labels = spark.createDataFrame([(None, 1, 0), (4, None, 0), (5, 7, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(frame, labels)
    assert model == quality.Model(None, 1.0)
    judged = quality.judge(frame, model).collect()
    assert len(judged) == len(odd_rows)
    for row in judged:
        assert row.kept == (not row.base_failed)
    assert {row.doc_id for row in judged if row.kept} == {None, 4}
    assert quality.judge(documents([]), model).count() == 0
    assert quality.fit(documents([]), labels) == model
