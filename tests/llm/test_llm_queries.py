"""Queries of the llm subpackage against their SQL, or for rows where there is none."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from flowsieve.llm import queries  # noqa: E402
from flowsieve.llm.queries import QUERIES, SQL  # noqa: E402
from oracle import connect, same  # noqa: E402


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, name):
    same(QUERIES[name](spark, sf), SQL[name], connect(sf))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_p8_found_packs(spark, tmp_path, monkeypatch):
    docs = [(i, "w " * n) for i, n in enumerate([0, 4, 8, 9, 16, 17, 30])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 8), (2, 16)], "capacity_no int, capacity_tokens int").write.parquet(f"{tmp_path}/capacities.parquet")
    pack, calls = queries.pack, []
    monkeypatch.setattr(queries, "pack", lambda *a, **k: calls.append(1) or pack(*a, **k))
    got = sorted((r.capacity_no, r.doc_id) for r in queries.p8_found(spark, str(tmp_path)).collect())
    assert got == [(1, 3), (1, 4), (1, 5), (1, 6), (2, 5), (2, 6)] and calls == [1]
