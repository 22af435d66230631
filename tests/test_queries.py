"""Every query with SQL gives the same rows as the SQL, on the smallest tables."""

from __future__ import annotations

import os
from pathlib import Path

import pytest

from docmill.plans import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in Path(FOLDER).iterdir():
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


def rows(values, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda v: "" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v.replace(tzinfo=None)) if hasattr(v, "tzinfo") else str(v)
    return sorted(tuple(text(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, FOLDER)
    got = [tuple(r) for r in df.collect()]
    sql = registry.oracle_sql().get(name)
    if sql:
        want = duck.execute(sql)
        columns = [d[0] for d in want.description]
        assert sorted(df.columns) == sorted(columns)
        assert rows(got, df.columns) == rows(want.fetchall(), columns)


def test_plans_push_down(spark):
    """Scans read the columns they need; retrieval and graph plans hold no Python."""
    plan = lambda name: registry.queries()[name](spark, FOLDER)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan("bm25_idf")
    for name in ("bm25_topk", "heading_tree", "chunk_windows", "entity_pairs", "graph_nodes", "node_scores"):
        assert "Python" not in plan(name) and "Pandas" not in plan(name)
