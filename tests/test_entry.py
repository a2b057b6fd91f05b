import duckdb
import pytest

import __spark_entry__ as entry
from shelfwright.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
FAST = sorted(ORACLE)


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", FAST)
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in ("files", "snippets", "plan_moves", "plan_deletes", "graph_nodes", "cluster_results", "documents", "orders", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = con.execute(ORACLE[name])
    names = [d[0] for d in got.description]
    want = [tuple(plain(dict(zip(names, r))[c]) for c in cols) for r in got.fetchall()]
    assert sorted(map(repr, want)) == sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())


def test_registry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(ORACLE) <= set(QUERIES)
    assert entry.entry(spark).columns == ["id", "path", "reason", "confidence"]


def test_core_imports_nothing_of_the_subpackage():
    import pathlib

    root = pathlib.Path(entry.__file__).parent / "shelfwright"
    used = [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts and ("shelfwright.llm" in p.read_text() or "from .llm" in p.read_text())]
    assert used == []
