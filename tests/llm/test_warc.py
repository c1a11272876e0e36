import hashlib
import os
import random

import pyarrow as pa
from hypothesis import given, settings, strategies as st

from tripmill.llm import warc

SCHEMA = "page_id long, url string, html string, chunk string, kept string, digest string"


def pages_of(spark, rows):
    return spark.createDataFrame([(i, url, html, "x", "y", "z") for i, url, html in rows], SCHEMA)


def expected(rows):
    first = {}
    for i, _, html in rows:
        if html and len(html.encode()) >= 100 and i is not None:
            first[html] = min(first.get(html, i), i)
    out = []
    for i, _, html in rows:
        content = (html or "").encode()
        refers = first.get(html)
        refers = None if refers == i else refers
        kind = "response" if refers is None else "revisit"
        out.append((i, len(content), hashlib.sha256(content).hexdigest(), kind, refers))
    return sorted(out, key=repr)


def odd_pages():
    rng = random.Random(3)
    big = "".join(rng.choices("abc é😀\r\n", k=6000))
    tricky = "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 20
    rows = [
        (1, "http://a/", big), (2, None, big), (3, "http://b/\r\nEvil: yes", tricky), (4, "u", tricky + "\r\n"),
        (5, "u", "\r\n\r\n"), (6, "u", "x\r\n"), (7, "u", None), (8, "u", ""), (9, "u", "short"), (10, "u", "short"),
        (None, "u", big), (None, None, None), (11, "u", "\r" * 300), (12, "u", "\r\n\r\r\n\r\n" * 50),
        (13, "u", "same" * 40), (13, "u", "same" * 40), (14, "u", "same" * 40), (15, "u", "﻿" + "é" * 99 + "\n\r\n"),
    ]
    return rows


def test_round_trip_in_chunks(spark, tmp_path):
    rows = odd_pages()
    for size in (37, 1 << 20):
        path = str(tmp_path / f"archive-{size}")
        warc.write(pages_of(spark, rows), path, chunk_bytes=size)
        records = warc.read_records(spark, path).drop("chunks").collect()
        assert sorted(map(tuple, records), key=repr) == expected(rows)
        content = {}
        chunks = warc.read_chunks(spark, path).collect()
        assert len({(row.record_id, row.chunk) for row in chunks}) == len(chunks)
        for row in sorted(chunks, key=lambda row: row.chunk):
            content.setdefault(row.page_id, []).append(row.content)
        texts = {i: html for i, _, html in rows if i is not None}
        revisits = {i for i, _, _, kind, _ in expected(rows) if kind == "revisit"}
        for i, html in texts.items():
            if i != 13:
                assert b"".join(content[i]) == (b"" if i in revisits else (html or "").encode())
        if size == 37:
            assert max(len(each) for parts in content.values() for each in parts) <= 37


def test_operator_and_empty_table(spark):
    rows = odd_pages()
    got = warc.round_trip(pages_of(spark, rows)).drop("chunks").collect()
    assert sorted(map(tuple, got), key=repr) == expected(rows)
    assert warc.round_trip(pages_of(spark, rows).limit(0)).count() == 0


@given(text=st.text(max_size=60), size=st.integers(4, 30))
def test_segments_end_between_characters(text, size):
    parts = [part.to_pybytes() for part in warc.segments(pa.py_buffer(text.encode()), size)]
    assert "".join(part.decode() for part in parts) == text
    assert all(len(part) <= size for part in parts) and len(parts) <= 1 + len(text.encode()) // (size - 3)


def test_a_batch_moves_equal_payloads_once():
    same = "payload that many pages have " * 10
    batch = pa.table({"page_id": [5, None, 3, 3, 9, 8], "url": ["u"] * 6, "html": [same, same, same, same, "short", None]})
    (lean,) = warc._lean(iter(batch.to_batches()))
    kept = [(value or b"").decode() for value in lean.column("payload").to_pylist()]
    assert kept == ["", "", same, same, "short", ""]
    assert lean.column("payload").null_count == 2


def test_archives_are_removed(spark):
    folder = warc.common.shared_folder(spark).removeprefix("file:")
    assert warc.round_trip(pages_of(spark, odd_pages())).count() == len(odd_pages())
    assert not [name for name in os.listdir(folder) if name.startswith("warc-")]


@settings(max_examples=100, deadline=None)
@given(contents=st.lists(st.binary(max_size=40).map(lambda b: b.replace(b"\x00", b"\r\n")), max_size=5))
def test_parser_counts_bytes(contents):
    blank = b"\r\n\r\n"
    stream = b"".join(
        b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <%d>\r\nContent-Length: %d" % (i, len(c)) + blank + c + blank
        for i, c in enumerate(contents)
    )
    blocks = stream.split(blank)
    if blocks[-1] == b"":
        blocks.pop()
    got = {}
    for piece in warc.parse(iter(blocks)):
        got.setdefault(piece.fields["WARC-Record-ID"], []).append(piece.content)
    assert [b"".join(parts) for parts in got.values()] == contents


def test_damage_is_noticed(spark, tmp_path):
    path = str(tmp_path / "archive")
    warc.write(pages_of(spark, [(1, "u", "content of a page")]), path)
    lines = [row.value for row in spark.read.option("lineSep", warc.BLANK).text(path).collect()]
    broken = [line.replace("content", "contents"[:6] + "x") for line in lines]
    spark.createDataFrame([(line,) for line in broken], "value string").coalesce(1).write.option(
        "lineSep", warc.BLANK
    ).text(str(tmp_path / "broken"))
    try:
        warc.read_records(spark, str(tmp_path / "broken")).collect()
    except Exception as error:
        assert "damaged" in str(error)
    else:
        raise AssertionError("a wrong digest must be an error")
