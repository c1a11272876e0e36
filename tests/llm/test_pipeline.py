"""Each stage on its own input, against a plain version."""

import os

import pytest

import corpus_pipeline
from test_exact_dedup import expected as exact_groups
from test_near_dedup import expected as near_groups
from test_quality import expected as base_counts
from tripmill.llm import catalog, mixing, pieces, quality, unigram
from tripmill.llm.common import cut, shared_folder, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = table(spark, SF, "documents")
    results = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, SF))
        results.append((name, docs))
    return results


def rows_of(frame):
    return [(row.doc_id, row.text) for row in frame.collect()]


def test_names_and_columns(stages):
    names = [name for name, _ in stages[1:]]
    assert names == ["quality_rules", "exact_dedup", "near_dedup", "mix_sources", "sentencepiece"]
    for _, frame in stages[:-1]:
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    counts = [frame.count() for _, frame in stages]
    assert counts[0] > counts[1] > counts[2] >= counts[3] == counts[4] == counts[5]


def test_quality(spark, stages):
    before, after = (dict(rows_of(frame)) for _, frame in stages[:2])
    labels = {row.doc_id: row.quality for row in table(spark, SF, "labels").collect()}
    model = quality.fit(stages[0][1], table(spark, SF, "labels"))
    for i, text in before.items():
        n_words, _, _, _, n_repeat = base_counts(text)
        failed = n_words < 10 or 100 * n_repeat > 20 * n_words
        score = quality.anomaly(model.forest, quality.np.array([quality.statistics(text)[1]]))[0]
        assert (i in after) == (not failed and score <= model.threshold)
        if labels.get(i) == 1 and not failed:
            assert i in after


def test_exact_duplicates(stages):
    before, after = rows_of(stages[1][1]), rows_of(stages[2][1])
    wanted = [i for i, _, _, kept, _ in exact_groups(before) if kept]
    assert sorted(i for i, _ in after) == sorted(wanted)
    assert set(after) <= set(before)


def test_near_duplicates(stages):
    before, after = rows_of(stages[2][1]), rows_of(stages[3][1])
    assert sorted(i for i, _ in after) == [i for i, _, _, kept in near_groups(before) if kept]
    assert set(after) <= set(before)


def test_mix(stages):
    before, after = stages[3][1], stages[4][1]
    position = {row.doc_id: row.position for row in mixing.place(before).select("row.doc_id", "position").collect()}
    assert [i for i, _ in rows_of(after)] == sorted(position, key=position.get)
    assert sorted(rows_of(before)) == sorted(rows_of(after))


def test_encoded(stages):
    texts = dict(rows_of(stages[4][1]))
    rows = stages[5][1].collect()
    assert sorted(row.doc_id for row in rows) == sorted(texts)
    assert all(row.round_trip and row.n_pieces == len(row.ids) > 0 for row in rows)


def test_empty_documents(spark):
    docs = table(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF)
        assert after.count() == 0
        if name != "sentencepiece":
            assert after.columns == docs.columns


def test_run_gives_the_last_stage_and_leaves_no_files(spark, stages):
    result = corpus_pipeline.run(spark, SF)
    assert sorted(row.doc_id for row in result.collect()) == sorted(row.doc_id for row in stages[5][1].collect())
    folder = shared_folder(spark).removeprefix("file:")
    assert not [name for name in os.listdir(folder) if name.startswith("pipeline-")]


def test_encoded_rows_have_their_place_in_the_mix(spark, stages, tmp_path):
    placed = mixing.place(stages[3][1])
    position = {row.doc_id: row.position for row in placed.select("row.doc_id", "position").collect()}
    assert sorted(position.values()) == list(range(len(position)))
    assert {row.doc_id: row.position for row in stages[5][1].collect()} == position
    # As the stages hand on their rows: files of several sizes, which Spark reads in another order.
    edges = [0, 3, 10, 12, 40, len(position)]
    for name, (low, high) in enumerate(zip(edges, edges[1:])):
        part = placed.where(f"position >= {low} AND position < {high}").orderBy("position").select("row.*")
        part.coalesce(1).write.option("compression", "none").parquet(f"{tmp_path}/{name}")
    read = spark.read.parquet(*(f"{tmp_path}/{name}" for name in range(len(edges) - 1)))
    assert [row.doc_id for row in read.select("doc_id").collect()] != sorted(position, key=position.get)
    encoded = corpus_pipeline.encode(spark, read, SF)
    assert {row.doc_id: row.position for row in encoded.collect()} == position
    assert encoded.drop("position").columns == unigram.encode(read, pieces.load(catalog.PIECES)).columns


def test_every_row_of_a_read_mix_has_one_place(documents, odd_rows, tmp_path):
    frame = documents(odd_rows)
    frame.repartition(4).write.parquet(f"{tmp_path}/mix")
    for mix in (frame, frame.sparkSession.read.parquet(f"{tmp_path}/mix"), frame.limit(0)):
        rows = mixing.read_back(mix).collect()
        assert sorted(row.position for row in rows) == list(range(mix.count()))
        assert sorted(map(str, (row.row for row in rows))) == sorted(map(str, mix.collect()))
