import os
import random
import time
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from made_words import words
from tripmill.llm import resharding


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=6), st.integers(1, 6))
def test_flow_is_whole_and_moves_least(sizes, shards):
    room = resharding.capacities(sum(sizes), shards)
    flow = resharding.least_moves(sizes, room)
    assert [sum(row) for row in flow] == sizes
    assert [sum(column) for column in zip(*flow)] == room
    assert all(amount >= 0 for row in flow for amount in row)
    stays = sum(flow[i][i] for i in range(min(len(sizes), shards)))
    assert stays == sum(min(a, b) for a, b in zip(sizes, room))


@settings(max_examples=40, deadline=None)
@given(st.data())
def test_flow_is_cheapest_under_any_prices(data):
    sizes = data.draw(st.lists(st.integers(0, 4), min_size=2, max_size=3))
    room = resharding.capacities(sum(sizes), 2)
    prices = data.draw(st.lists(st.lists(st.integers(0, 5), min_size=2, max_size=2), min_size=3, max_size=3))
    flow = resharding.least_moves(sizes, room, lambda old, new: prices[old][new])
    paid = sum(flow[i][j] * prices[i][j] for i in range(len(sizes)) for j in range(2))

    def cheapest(i, left):
        if i == len(sizes):
            return 0 if left == 0 else float("inf")
        return min(
            k * prices[i][0] + (sizes[i] - k) * prices[i][1] + cheapest(i + 1, left - k)
            for k in range(min(sizes[i], left) + 1)
        )

    assert paid == cheapest(0, room[0])


def corpus():
    rng = random.Random(2)
    return [(i, " ".join(words(rng.choice((1, 5, 60)), i)), "en", "a" if i % 3 else f"s{i % 7}") for i in range(600)]


def test_rows_are_placed_near_their_capacity(documents):
    rows = corpus()
    frame = documents(rows)
    old = F.crc32(F.col("source").cast("binary")) % 5
    placed, flow = resharding.assign(resharding.sized(frame, old), 4)
    got = placed.collect()
    assert sorted(row.id for row in got) == [i for i, *_ in rows]
    for row in got:
        text = rows[row.id][1].encode()
        assert (row.size, row.crc) == (len(text) + 1, zlib.crc32(text))
    sizes = Counter()
    for row in got:
        sizes[row.shard] += row.size
    largest = max(row.size for row in got)
    room = resharding.capacities(sum(sizes.values()), 4)
    assert all(abs(sizes[j] - room[j]) <= 2 * largest for j in range(4))
    slots = Counter(row.shard for row in got)
    assert sorted((row.shard, row.slot) for row in got) == [(j, k) for j in range(4) for k in range(slots[j])]
    moved = sum(row.size for row in got if row.old != row.shard)
    least = sum(sum(each) for each in flow) - sum(flow[i][i] for i in range(4))
    assert abs(moved - least) <= 8 * largest


def layout(path):
    return {name: sorted((f, os.stat(f"{path}/{name}/{f}").st_mtime_ns) for f in os.listdir(f"{path}/{name}"))
            for name in os.listdir(path) if name.startswith("new_shard=")}


def test_a_layout_is_brought_up_to_date_in_place(spark, documents, tmp_path):
    rows = [(i, "x" * 9) for i in range(90)] + [(7, "x" * 9)] * 3 + [(None, "none")] * 4 + [(None, None)] * 2
    path = str(tmp_path / "layout")
    # Shard 0 is too large and 1 too small.
    frame = spark.createDataFrame(
        [(i, t, k, [0] * 55 + [1] * 12 + [2] * 32) for k, (i, t) in enumerate(rows)], "doc_id long, text string, n_chars long, s array<int>"
    ).selectExpr("doc_id", "text", "n_chars", "s[CAST(n_chars AS INT)] AS new_shard")
    frame.write.partitionBy("new_shard").parquet(path)
    before = layout(path)
    docs = spark.read.parquet(path)
    placed, flow = resharding.assign(resharding.sized(docs, F.col("new_shard")), 3)
    want = Counter((row.id, row.crc, row.shard) for row in placed.collect())
    slots = Counter(row.shard for row in placed.collect())
    which = resharding.rewrite(
        docs.withColumnRenamed("new_shard", "old"), F.col("old"), placed, flow, 3, path
    )
    after = layout(path)
    assert set(after) == {"new_shard=0", "new_shard=1", "new_shard=2"} and set(which) <= {0, 1, 2}
    for shard in {0, 1, 2} - set(which):
        assert after[f"new_shard={shard}"] == before[f"new_shard={shard}"]
    back = spark.read.parquet(path).collect()
    assert Counter((row.doc_id, zlib.crc32((row.text or "").encode()), row.new_shard) for row in back) == want
    assert sorted(row.n_chars for row in back) == list(range(len(rows)))
    assert Counter(row.new_shard for row in back) == slots


def test_an_unaffected_shard_keeps_its_files(spark, documents, tmp_path):
    path = str(tmp_path / "layout")
    rows = [(i, "x" * 9, 0 if i < 50 else 1 if i < 60 else 2) for i in range(90)]
    spark.createDataFrame(rows, "doc_id long, text string, new_shard int").write.partitionBy("new_shard").parquet(path)
    before = layout(path)
    docs = spark.read.parquet(path).withColumnRenamed("new_shard", "old")
    placed, flow = resharding.assign(resharding.sized(docs, F.col("old")), 3)
    assert resharding.rewrite(docs, F.col("old"), placed, flow, 3, path) == [0, 1]
    after = layout(path)
    assert after["new_shard=2"] == before["new_shard=2"]
    assert all(not set(after[name]) & set(before[name]) for name in ("new_shard=0", "new_shard=1"))
    back = spark.read.parquet(path)
    assert Counter(row.new_shard for row in back.collect()) == {0: 30, 1: 30, 2: 30}
    assert sorted(row.doc_id for row in back.collect()) == list(range(90))


def test_fewer_shards_leave_none_behind(spark, tmp_path):
    path = str(tmp_path / "layout")
    rows = [(i, "x" * 9, i % 4) for i in range(80)]
    spark.createDataFrame(rows, "doc_id long, text string, new_shard int").write.partitionBy("new_shard").parquet(path)
    docs = spark.read.parquet(path).withColumnRenamed("new_shard", "old")
    placed, flow = resharding.assign(resharding.sized(docs, F.col("old")), 2)
    assert resharding.rewrite(docs, F.col("old"), placed, flow, 2, path) == [0, 1]
    back = spark.read.parquet(path).collect()
    assert sorted(row.doc_id for row in back) == list(range(80)) and {row.new_shard for row in back} == {0, 1}


def test_a_thousand_shards_to_a_thousand_are_quick():
    rng = random.Random(1)
    sizes = [rng.randint(0, 10**9) for _ in range(1000)]
    room = resharding.capacities(sum(sizes), 1000)
    start = time.perf_counter()
    flow = resharding.least_moves(sizes, room)
    assert time.perf_counter() - start < 120
    assert sum(flow[i][i] for i in range(1000)) == sum(min(a, b) for a, b in zip(sizes, room))


def test_odd_rows(documents, odd_rows):
    frame = documents(odd_rows)
    placed, _ = resharding.assign(resharding.sized(frame, F.lit(None)), 3)
    got = placed.collect()
    assert len(got) == len(odd_rows)
    assert sorted(row.size for row in got) == sorted(len((t or "").encode()) + 1 for _, t, *_ in odd_rows)
    slots = Counter(row.shard for row in got)
    assert sorted((row.shard, row.slot) for row in got) == sorted((j, k) for j, n in slots.items() for k in range(n))
    empty, flow = resharding.assign(resharding.sized(documents([]), F.lit(0)), 3)
    assert empty.count() == 0 and resharding.affected(flow, 3) == []


def test_too_many_shards_are_refused(documents):
    with pytest.raises(ValueError):
        resharding.assign(resharding.sized(documents([(1, "a")]), F.lit(5000)), 3)
