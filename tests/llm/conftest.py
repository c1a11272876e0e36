import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from made_words import words  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use inside or return.
CLASHING = ("kept", "slot", "shard", "row", "id", "rank", "terms", "position", "score", "n_words", "mark")


@pytest.fixture(scope="session")
def documents(spark):
    """A function from (doc_id, text, lang, source) rows to a documents table with more
    columns of clashing names."""

    def make(rows):
        full = [(*row, *(None, "src0")[len(row) - 2 :])[:4] for row in rows]
        frame = spark.createDataFrame(
            [(i, text, lang, source, len(text or "")) for i, text, lang, source in full], SCHEMA
        )
        for name in CLASHING:
            frame = frame.withColumn(name, F.lit("x"))
        return frame

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, blank and very long texts, ties, rows that repeat."""
    long = " ".join(words(20_000, 1)) + " " + "q" * 5_000
    return [
        (1, None, None, None),
        (2, "", "en", "src1"),
        (3, " \n\t ", "en", None),
        (None, "no id here but ten words or so of text in it", "en", "src1"),
        (None, None, "en", "src1"),
        (4, long, "en", "src0"),
        (5, "same text twice", "en", "src0"),
        (5, "same text twice", "en", "src0"),
        (6, "Same TEXT twice", "de", "src0"),
        (7, "é ▁ 😀 \x00 ünï code\r\n\r\nWARC/1.1", "fr", "src2"),
    ]
