from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent), str(Path(__file__).resolve().parents[1])]

TABLE = "doc_id long, text string, lang string, source string, n_chars long, n_words long, spans string, comp string"


@pytest.fixture
def docs(spark):
    """(id, text) pairs as documents with extra columns of clashing names."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 7, "x", "y") for i, t in rows], TABLE).repartition(3)

    return make
