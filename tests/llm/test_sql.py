"""Queries that SQL can express, against SQL, on the smallest tables; the others have rows."""

from __future__ import annotations

import pytest

from tests.llm.conftest import SMALL
from tests.oracle import connect, differences
from textlens.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    found = differences(QUERIES[name](spark, SMALL), connect(SMALL), ORACLES[name])
    assert not [p for p in found if "within rounding" not in p]


def test_every_operator():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 14))
