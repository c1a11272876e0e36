import hashlib

from tripmill.llm import exact_dedup

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def expected(rows):
    groups = {}
    for row in rows:
        groups.setdefault((row[1] or "").translate(UPPER), []).append(row[0])
    out = []
    for text, ids in groups.items():
        ids.sort(key=lambda i: (i is not None, i or 0), reverse=True)
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, ids[0], len(ids), place == 0, digest) for place, i in enumerate(ids)]
    return sorted(out, key=repr)


def got(frame):
    return sorted(map(tuple, exact_dedup.exact_groups(frame).collect()), key=repr)


def test_odd_rows(documents, odd_rows):
    assert got(documents(odd_rows)) == expected(odd_rows)


def test_hot_groups_and_shared_beginnings(documents):
    rows = [(i, "HOT text" if i % 3 == 0 else "a common beginning " * 5 + str(i % 97)) for i in range(3000)]
    frame = documents(rows).repartition(7)
    assert got(frame) == expected(rows)


def test_letters_other_than_a_to_z_keep_their_case(documents):
    rows = [(1, "É"), (2, "é"), (3, "\u212a"), (4, "k")]
    assert got(documents(rows)) == expected(rows)
    assert len({digest for *_, digest in expected(rows)}) == 4


def test_drop_exact_keeps_whole_rows_once(documents, odd_rows):
    frame = documents(odd_rows)
    kept = exact_dedup.drop_exact(frame)
    assert kept.columns == frame.columns
    groups = {(row[1] or "").translate(UPPER) for row in odd_rows}
    rows = kept.collect()
    assert len(rows) == len(groups)
    assert {row.doc_id for row in rows} == {i for i, _, _, stays, _ in expected(odd_rows) if stays}


def test_no_rows(documents):
    assert got(documents([])) == []
    assert exact_dedup.drop_exact(documents([])).count() == 0
