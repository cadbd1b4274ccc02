import sys
from pathlib import Path

import pytest
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

#: Texts that every operator must take: null, empty, blank, short, long, repeated, other scripts.
TEXTS = [
    None, "", " \n\t ", "one", "The cat sat on the mat and looked at the moon tonight.", "The cat sat on the mat and looked at the moon tonight.",
    "x" * 5000, "word " * 3000, "Größe und Maß — 漢字 кошка\nzweite Zeile mit vielen Wörtern hier", "a\n\nb\nThe same line of some length here\nThe same line of some length here",
]
SCHEMA = T.StructType([T.StructField(n, T.StringType() if n != "doc_id" else T.LongType()) for n in ("doc_id", "text", "lang", "source", "key", "score", "ids", "n")])


@pytest.fixture(scope="session")
def frame(spark):
    """Documents with extra columns whose names clash with the operators' own."""
    def make(rows):
        full = [(i, t, "en", None if i is None or i % 3 == 0 else "s", "k", "9", "z", "7") for i, t in rows]
        return spark.createDataFrame(full, SCHEMA)
    return make


@pytest.fixture(scope="session")
def odd(frame):
    """Each odd text, a repeated row, and a null id."""
    return frame([*enumerate(TEXTS), (4, TEXTS[4]), (None, "no id here")])


@pytest.fixture(scope="session")
def labels(spark):
    def make(rows):
        return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int, text string")
    return make
