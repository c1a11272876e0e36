import math
import random
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st

from made_words import words
from tripmill.llm import toxicity

VECTORS = st.dictionaries(st.integers(0, 12), st.floats(0.05, 3), min_size=1, max_size=5)


def unit(vector):
    norm = sum(w * w for w in vector.values()) ** 0.5
    return {t: w / norm for t, w in vector.items()}


@settings(max_examples=80, deadline=None)
@given(examples=st.lists(VECTORS, max_size=150), query=VECTORS, k=st.integers(1, 20))
def test_nearest_are_exact(examples, query, k):
    examples, query = [unit(v) for v in examples], unit(query)
    index = toxicity.Index(examples, [0] * len(examples), list(range(len(examples))))
    every = []
    for i, vector in enumerate(examples):
        cosine = round(sum(w * vector.get(t, 0) for t, w in query.items()), 9)
        if cosine > 0:
            every.append((cosine, -index.position[i]))
    found = index.nearest(query, k)
    assert [cosine for cosine, _ in found] == pytest.approx([c for c, _ in sorted(every, reverse=True)[:k]], abs=2e-9)
    truth = dict((place, cosine) for cosine, place in every)
    assert all(truth[place] == pytest.approx(cosine, abs=2e-9) for cosine, place in found)
    assert len({place for _, place in found}) == len(found)


@given(st.lists(st.tuples(st.one_of(st.none(), st.floats(0, 1)), st.integers(0, 1)), max_size=40))
def test_calibrated_scores_rise_with_the_votes(shares):
    rates = toxicity.calibrate([s for s, _ in shares], [y for _, y in shares], [1.0] * len(shares), 0.1)
    assert len(rates) == toxicity.BINS + 1
    assert all(0 <= rate <= 1 for rate in rates)
    assert all(a <= b + 1e-12 for a, b in zip(rates[1:], rates[2:]))


def learnable(i):
    return zlib.crc32(str(i).encode()) % 4 != 2


@pytest.fixture(scope="module")
def corpus():
    rows, labels = [], []
    for i in range(240):
        text = words(40, i)
        toxic = int(i % 6 == 0)
        if toxic:
            text[5], text[20] = "nastyword" + text[1], ("vileness", "Horridly")[i % 2]
        rows.append((i, " ".join(text)))
        labels.append((i, 1, toxic))
    return rows, labels


def test_finds_toxic_texts_and_their_evidence(spark, documents, corpus):
    rows, labels = corpus
    found = {
        row.doc_id: row
        for row in toxicity.detect(
            documents(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        ).collect()
    }
    assert {i for i, row in found.items() if row.predicted} == {i for i, _, toxic in labels if toxic}
    for i, row in found.items():
        assert row.held_out != learnable(i) and 0 <= row.score <= 1
        assert row.predicted == int(row.score >= 0.3)
        assert all(learnable(j) for j in row.nearest)
        assert sorted(row.cosines, reverse=True) == row.cosines
        assert bool(row.nearest) >= bool(row.predicted)


def test_held_out_labels_change_nothing(spark, documents, corpus):
    rows, labels = corpus
    schema = "doc_id long, quality int, toxic int"
    turned = [(i, q, toxic if learnable(i) else 1 - toxic) for i, q, toxic in labels]
    results = [
        sorted(map(repr, toxicity.detect(documents(rows), spark.createDataFrame(each, schema)).collect()))
        for each in (labels, turned)
    ]
    assert results[0] == results[1]


def test_vectors_count_words_beginnings_and_doubles():
    chosen = {"mean": 0, "^mean": 1, "^mean+": 2, "other": 3}
    assert toxicity.Vectors(chosen)("Mean, meanest MEANING!") == {0: 1, 1: 2, 2: 1}
    assert toxicity.Vectors(chosen)(None) == toxicity.Vectors(chosen)("") == {}


def test_terms_are_those_of_distinct_texts(spark):
    toxic = [(f"nastyword{chr(97 + i)} vileness", 1) for i in range(8)] + [("copied rubbish", 1)] * 8
    other = [(" ".join(words(8, i)), 0) for i in range(60)]
    chosen = toxicity.choose_terms(spark.createDataFrame(toxic + other, "text string, toxic int"))
    assert "vileness" in chosen and not {"copied", "rubbish", "^copi"} & set(chosen)
    assert {"^nast", "^nasty", "^nastyw", "^nastywo", "^nastywor"} <= set(chosen)


def test_a_capped_class_moves_no_scores(spark, documents, monkeypatch):
    """Labelled texts of four kinds, toxic at different rates; the clean ones are capped."""
    rows, labels = [], []
    for i in range(800):
        toxic = int(i % 10 == 0)
        marked = toxic or i % 5 == 1
        rows.append((i, "vileness horridly" if marked else "plain quiet words"))
        labels.append((i, 1, toxic))
    docs, labels = documents(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    scores = []
    for most in (8_000, 60):
        monkeypatch.setattr(toxicity, "OTHER_EXAMPLES", most)
        monkeypatch.setattr(toxicity, "LEAST_LIFT", 1.0)
        examples = toxicity._examples(labels)
        counts = toxicity.vectors(docs, ["vileness", "horridly"])
        model = toxicity.fit(counts, examples, 2)
        scores.append((model.prior, model.score(None), model.votes([(1.0, -model.index.toxic.argmax()), (1.0, -model.index.toxic.argmin())])))
    whole, capped = scores
    assert abs(whole[0] - capped[0]) < 0.005 and abs(whole[1] - capped[1]) < 0.01
    assert capped[2] < 0.3 < whole[2]


def test_strong_terms_stand_before_rare_ones(spark):
    """Many words of a few toxic texts only, and one of most toxic and some other texts."""
    rare = [" ".join(f"{chr(97 + j)}{chr(97 + k)}x" for j in range(5) for k in range(8)) + f" {i}" for i in range(6)]
    toxic = [(text, 1) for text in rare] + [(f"vile {i}", 1) for i in range(60)]
    other = [(f"vile {i}" if i < 8 else f"calm {i}", 0) for i in range(100)]
    chosen = toxicity.choose_terms(spark.createDataFrame(toxic + other, "text string, toxic int"))
    assert chosen[0] == "vile" and "aax" not in chosen


def brute_force(rows, labels):
    """(doc_id, score) by all cosines of every document with every example."""
    toxic = {i: y for i, _, y in labels if learnable(i)}
    count = {i: toxicity.words(text) for i, text in rows}
    every = {}
    for i, of_text in count.items():
        every[i] = Counter()
        for word, n in of_text.items():
            every[i].update({term: n for term in toxicity.terms(word)})
        every[i] |= {term + "+": 1 for term, n in every[i].items() if n > 1}
    distinct = {(text, toxic[i]): i for i, text in rows if i in toxic}
    seen = (Counter(), Counter())
    for (_, y), i in distinct.items():
        seen[y].update(every[i].keys())
    n_other, n_toxic = (sum(y == label for _, y in distinct) for label in (0, 1))

    def g(a, b):
        share = n_toxic / (n_toxic + n_other)
        return 2 * sum(x * math.log(x / ((a + b) * part)) for x, part in ((a, share), (b, 1 - share)) if x)

    strength = {
        term: g(a, seen[0][term]) for term, a in seen[1].items()
        if a >= 3 and (a / n_toxic) / ((seen[0][term] + 0.5) / n_other) >= 3 and g(a, seen[0][term]) >= 15
    }
    best = sorted(strength, key=lambda term: (-strength[term], term))
    chosen = list(dict.fromkeys(best + [term.removesuffix("+") for term in best]))
    vectors = {i: {t: every[i][t] for t in chosen if t in every[i]} for i in every}
    df = Counter(t for vector in vectors.values() for t in vector)
    idf = {t: math.log((len(rows) + 1) / (df[t] + 1)) + 1 for t in chosen}
    weighed = {i: unit({t: (1 + math.log(n)) * idf[t] for t, n in v.items()}) if v else {} for i, v in vectors.items()}

    def heaviest(i):
        return sorted((chosen.index(t) for t in weighed[i]), key=lambda t: (-weighed[i][chosen[t]], t))[:3]

    examples = sorted((i for i in toxic if weighed[i]), key=lambda i: (heaviest(i), i))
    prior = (sum(toxic.values()) + 0.5) / (len(toxic) + 1)

    def share(i, without=None):
        near = []
        for place, j in enumerate(examples):
            cosine = round(sum(w * weighed[j].get(t, 0) for t, w in weighed[i].items()), 9)
            if cosine > 0 and j != without:
                near.append((-cosine, place, toxic[j]))
        near = sorted(near)[: toxicity.NEIGHBOURS]
        if not near and without is None:
            return None
        voted, total = (sum(-c * w for c, _, y in near for w in [y if k else 1]) for k in (1, 0))
        return (voted + toxicity.PRIOR_VOTE * prior) / (total + toxicity.PRIOR_VOTE)

    shares = [share(i, without=i) for i in examples] + [None for i in toxic if not weighed[i]]
    truth = [toxic[i] for i in examples] + [toxic[i] for i in toxic if not weighed[i]]
    rates = toxicity.calibrate(shares, truth, [1.0] * len(truth), prior)
    model = toxicity.Model(None, None, prior, rates)
    return {i: model.score(share(i)) for i in every}


def test_scores_equal_brute_force(spark, documents):
    rng = random.Random(11)
    rows, labels = [], []
    nasty = ["vileness", "horridly", "nastyword", "wretchedest", "scummy"]
    for i in range(260):
        text = words(rng.randint(5, 40), i)
        toxic = int(rng.random() < 0.3)
        for _ in range(rng.randint(1, 3) if rng.random() < (0.75 if toxic else 0.1) else 0):
            text.insert(rng.randrange(len(text)), rng.choice(nasty) + rng.choice(("", "", "s", "like")))
        rows.append((i, " ".join(text)))
        if rng.random() < 0.8:
            labels.append((i, 1, toxic))
    found = toxicity.detect(documents(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    wanted = brute_force(rows, labels)
    assert len({row.score for row in found}) >= 3
    for row in found:
        assert row.score == pytest.approx(wanted[row.doc_id], abs=1e-6), row


def test_odd_rows_and_missing_labels(spark, documents, odd_rows):
    schema = "doc_id long, quality int, toxic int"
    labels = spark.createDataFrame([(None, 1, 1), (4, 0, None), (5, 0, 3), (7, 0, 0)], schema)
    found = toxicity.detect(documents(odd_rows), labels).collect()
    assert len(found) == len(odd_rows)
    assert len({row.score for row in found}) == 1 and not any(row.nearest for row in found)
    assert toxicity.detect(documents([]), labels).count() == 0
    assert toxicity.detect(documents([]), labels.limit(0)).count() == 0
