from collections import Counter
from fractions import Fraction

from hypothesis import given, settings, strategies as st

from tripmill.llm import mixing


def ideal(parts, blocks, time):
    """Blocks of each lane that the ideal has given after so much time: all lanes by their
    parts, those that have run out left aside."""
    given_, left = [Fraction(0)] * len(parts), Fraction(time)
    while left > 0:
        live = [i for i, n in enumerate(blocks) if given_[i] < n]
        if not live:
            break
        total = sum(parts[i] for i in live)
        step = min([left, *((blocks[i] - given_[i]) * total / parts[i] for i in live)])
        for i in live:
            given_[i] += step * parts[i] / total
        left -= step
    return given_


def rows_of(n):
    return [(i, f"text {i}", "en", ("a" if i % 2 else "bcd"[i % 3]) if i % 11 else None) for i in range(n)]


def test_every_row_has_one_place_and_blocks_stay_together(documents):
    placed = mixing.place(documents(rows_of(700)), block_rows=8).select("row.doc_id", "source", "block", "slot", "position").collect()
    assert sorted(row.doc_id for row in placed) == list(range(700))
    assert sorted(row.position for row in placed) == list(range(700))
    by_position = sorted(placed, key=lambda row: row.position)
    assert [row.slot for row in by_position] == sorted(row.slot for row in placed)
    owners = {(row.source, row.block): row.slot for row in placed}
    assert len(set(owners.values())) == len(owners)
    assert max(Counter(row.slot for row in placed).values()) <= 8


def test_given_weights_hold_while_all_sources_last(documents):
    placed = mixing.place(documents(rows_of(700)), {"a": 1, "b": 1, "c": 2, None: 1}, block_rows=4).collect()
    early = Counter(row.source for row in placed if row.slot < 25)
    assert abs(early["c"] - 40) <= 4 and abs(early["a"] - 20) <= 4 and abs(early["b"] - 20) <= 4
    # d has no weight of its own and shares the lane of null.
    assert abs(early["d"] + early[None] - 20) <= 4


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(1, 40)), min_size=1, max_size=6))
def test_less_than_one_block_from_the_ideal_after_every_slot(sources):
    parts, blocks = [p for p, _ in sources], [n for _, n in sources]
    places = mixing.deal([float(p) for p in parts], blocks)
    owner = {slot: i for i, own in enumerate(places) for slot in own}
    assert sorted(owner) == list(range(sum(blocks)))
    got = [0] * len(parts)
    for slot in range(sum(blocks)):
        got[owner[slot]] += 1
        for have, wanted in zip(got, ideal(parts, blocks, slot + 1)):
            assert abs(have - wanted) < 1 + 1e-6


def followed(placed, block_rows):
    """Blocks in the order of their slots, and how many each source has."""
    order = sorted({(row.slot, row.source, row.block) for row in placed})
    assert [slot for slot, _, _ in order] == list(range(len(order)))
    return [source for _, source, _ in order], Counter(source for _, source, _ in order)


def test_skewed_weights_hold_as_they_are_given(documents):
    """One source of 0.930 and 150 of 0.000465 each, none rounded."""
    rows = [(i, "t", "en", f"s{i % 150}" if i >= 6000 else "big") for i in range(9000)]
    weights = {"big": 0.930} | {f"s{i}": 0.000465 for i in range(150)}
    order, blocks = followed(mixing.place(documents(rows), weights, block_rows=4).collect(), 4)
    total, got = sum(weights.values()), Counter()
    names = list(weights)
    parts = [Fraction(weights[name]) for name in names]
    lasting = min(blocks[name] / weights[name] for name in names) * total
    for slot, source in enumerate(order, 1):
        got[source] += 1
        if slot <= lasting:
            assert all(abs(got[name] - weights[name] / total * slot) < 1 + 1e-6 for name in names)
        elif slot % 97 == 0:
            given_ = ideal(parts, [blocks[name] for name in names], slot)
            assert all(abs(got[name] - wanted) < 1 + 1e-6 for name, wanted in zip(names, given_))


def test_five_thousand_sources(documents):
    rows = [(i, "t", "en", f"s{i % 5000}" if i % 3 else "hot") for i in range(30000)]
    placed = mixing.place(documents(rows), block_rows=2).collect()
    assert sorted(row.position for row in placed) == list(range(30000))
    order, blocks = followed(placed, 2)
    sizes = Counter(row.source for row in placed)
    weights = {name: n**mixing.EXPONENT for name, n in sizes.items()}
    total, got = sum(weights.values()), Counter()
    lasting = min(blocks[name] / weights[name] for name in weights) * total
    for slot, source in enumerate(order, 1):
        got[source] += 1
        if slot <= lasting and (slot % 500 == 0 or slot < 50):
            assert all(abs(got[name] - weights[name] / total * slot) < 1 + 1e-6 for name in weights)


def test_sources_beyond_the_schedule_keep_their_targets(documents, monkeypatch):
    monkeypatch.setattr(mixing, "SOURCES", 2)
    monkeypatch.setattr(mixing, "LANES", 2)
    rows = [(i, "t", "en", f"s{i % 8}" if i % 9 else None) for i in range(900)]
    weights = {f"s{i}": 3 if i == 7 else 1 for i in range(8)}
    placed = mixing.place(documents(rows), weights, block_rows=4).select("row.doc_id", "source", "position").collect()
    assert sorted(row.doc_id for row in placed) == list(range(900))
    assert sorted(row.position for row in placed) == list(range(900))
    early = Counter(row.source for row in placed if row.position < 220)
    for name, weight in [*weights.items(), (None, 1)]:
        assert abs(early[name] - 20 * weight) < 2 * 4 + 4


def test_blocks_grow_so_that_the_schedule_stays_bounded(documents, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCKS", 5)
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 1)
    placed = mixing.place(documents(rows_of(700))).collect()
    assert sorted(row.position for row in placed) == list(range(700))
    assert len({row.slot for row in placed}) <= 5 + 5


def test_mixed_gives_whole_rows_in_order(documents):
    frame = documents(rows_of(300))
    mixed = mixing.mixed(frame)
    assert mixed.columns == frame.columns
    order = [row.doc_id for row in mixed.collect()]
    place = mixing.place(frame).select("row.doc_id", "position").collect()
    assert order == [row.doc_id for row in sorted(place, key=lambda row: row.position)]


def test_odd_rows(documents, odd_rows):
    placed = mixing.place(documents(odd_rows)).collect()
    assert sorted(row.position for row in placed) == list(range(len(odd_rows)))
    assert mixing.place(documents([])).count() == 0
    assert mixing.mixed(documents([])).columns == documents([]).columns
