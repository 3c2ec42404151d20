"""The driver's contract, and registered SQL against DuckDB on the smallest tables."""

import math
import os

import pytest

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str(v)


@needs_data
def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())


@needs_data
@pytest.mark.parametrize("name", ["a2_nodes_by_ids", "b5_dead_code_candidates", "c16_coupling", "e1_bfs", "f1_pagerank", "g6_bm25", "j2_debounce", "analyze_role"])
def test_against_sql(spark, name):
    import duckdb

    from quiltgraph import catalog

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.queries()[name](spark, SF)
    rel = con.sql(catalog.oracle_sql()[name])
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    mine = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    theirs = sorted(tuple(norm(r[rel.columns.index(c)]) for c in cols) for r in rel.fetchall())
    assert mine == theirs
