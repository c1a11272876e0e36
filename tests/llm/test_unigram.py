import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from tripmill.llm import catalog, pieces, unigram


@pytest.fixture(scope="module")
def small():
    names = ["<unk>", *(f"<0x{b:02X}>" for b in range(256)), "▁", "a", "b", "ab", "▁a", "ba", "aba", "▁▁", "é", "▁ab"]
    plain = {name: i for i, name in enumerate(names) if i > 256}
    scores = np.zeros(len(names))
    scores[257:] = [-3.0, -2.1, -2.3, -3.05, -3.7, -3.9, -5.2, -4.4, -6.0, -4.0]
    return pieces.vocabulary(names, scores, plain, {f"<0x{b:02X}>": b + 1 for b in range(256)})


def best_score(vocabulary, text):
    """The highest sum of scores over all segmentations."""
    plain = {n: i for i, n in enumerate(vocabulary.pieces) if not n.startswith("<")}
    lowest = min(vocabulary.scores[i] for i in plain.values()) - unigram.UNKNOWN_BELOW
    text = " " + text
    best = [0.0] + [-np.inf] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - 16), end):
            part = text[start:end]
            known = None if "▁" in part else plain.get(part.replace(" ", "▁"))
            if known is not None:
                best[end] = max(best[end], best[start] + vocabulary.scores[known])
            elif end - start == 1:
                best[end] = max(best[end], best[start] + lowest)
    return best[-1]


def score_of(vocabulary, ids):
    """The sum of the ids' scores; the bytes of a character count once."""
    lowest = vocabulary.scores[257:].min() - unigram.UNKNOWN_BELOW
    content = bytes(i - 1 for i in ids if 1 <= i <= 256)
    return sum(vocabulary.scores[i] for i in ids if i > 256) + lowest * len(content.decode())


@settings(max_examples=150, deadline=None)
@given(text=st.text(st.sampled_from("aaabbb  é▁\n😀"), min_size=1, max_size=70))
def test_best_segmentation_and_round_trip(small, text):
    encoder, decoder = unigram.Encoder(small), unigram.Decoder(small)
    ids = encoder.encode([text]).values.to_numpy()
    assert score_of(small, ids.tolist()) == pytest.approx(best_score(small, text))
    assert decoder.decode(ids, np.array([0, len(ids)])) == [text]


@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.one_of(st.none(), st.text(max_size=200)), max_size=5))
def test_public_vocabulary_round_trip(public, texts):
    encoder, decoder = public
    ids = encoder.encode(texts)
    back = decoder.decode(ids.values.to_numpy(), ids.offsets.to_numpy())
    assert back == [text or "" for text in texts]


@pytest.fixture(scope="module")
def public():
    vocabulary = pieces.load(catalog.PIECES)
    return unigram.Encoder(vocabulary), unigram.Decoder(vocabulary)


def test_trie_finds_exactly_the_pieces(public):
    encoder, _ = public
    walker = pieces.Walker(encoder.vocabulary.trie, spaces=False)
    number = {}
    for i, name in enumerate(encoder.vocabulary.pieces):
        number.setdefault(name, i)
    for name in encoder.vocabulary.pieces[300::97]:
        found = {(start, length): piece for start, length, piece in walker.arcs_of(name)}
        for (start, length), piece in found.items():
            assert piece == number.get(name[start : start + length], -1)
        table, lengths = walker.table([name])
        together = {(s, n): int(ids[0]) for s, n, _, ids in walker.arcs(table, lengths)}
        assert together == found


def test_forgetting_changes_nothing(small, monkeypatch):
    texts = ["ab ba aba b", "a b a", "bb aab", "é a"]
    whole = unigram.Encoder(small).encode(texts).to_pylist()
    monkeypatch.setattr(unigram, "HELD", 3)
    encoder = unigram.Encoder(small)
    assert [encoder.encode([text]).to_pylist()[0] for text in texts] == whole


def test_encode_and_decode_documents(documents, odd_rows):
    vocabulary = pieces.load(catalog.PIECES)
    encoded = unigram.encode(documents(odd_rows), vocabulary)
    rows = encoded.collect()
    assert len(rows) == len(odd_rows) and all(row.round_trip for row in rows)
    for row in rows:
        assert row.n_pieces == len(row.ids)
    back = unigram.decode(encoded, vocabulary)
    assert sorted(map(repr, ((r.doc_id, r.text) for r in back.collect()))) == sorted(
        repr((i, text or "")) for i, text, *_ in odd_rows
    )
    assert unigram.encode(documents([]), vocabulary).count() == 0


def test_slices_keep_order():
    texts = pa.array(["x" * 10, None, "y"])
    assert [text for _, part in pieces.slices(texts) for text in part] == ["x" * 10, None, "y"]
