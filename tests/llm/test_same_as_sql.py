"""Registered queries against their SQL twins, and their schemas."""

from __future__ import annotations

import pytest

from demandry.llm.queries import ORACLE, QUERIES
from suite import check


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, sf, name, monkeypatch):
    monkeypatch.setattr(check, "QUERIES", QUERIES)
    monkeypatch.setattr(check, "ORACLE", ORACLE)
    result = check.compare(spark, check.duck(sf), name, sf)
    assert result.startswith("ok") and "TYPES" not in result, result


def test_every_operator_has_one_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14))
