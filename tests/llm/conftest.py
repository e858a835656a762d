from __future__ import annotations

import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small(spark):
    return lambda name: spark.read.parquet(f"{SMALL}/{name}.parquet")


@pytest.fixture
def docs(spark):
    """Rows with every awkward case, and a column whose name operators use inside."""

    def make(texts, ids=None):
        rows = [(i, t, "en", "s", 0, "x") for i, t in zip(ids or range(len(texts)), texts)]
        return spark.createDataFrame(
            rows, "doc_id long, text string, lang string, source string, n_chars long, key string"
        )

    return make
