"""Registered queries against the SQL of an independent engine, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from skerry.plans.registry import QUERIES, SQL

SOME = [
    "src3_accepted", "src7_read_lines", "src10_repo_parse", "flt1_ignored", "prj2_scan_blocks", "prj3_import_edges", "prj4_call_edges", "prj6_summary", "prj8_concern", "prj10_explain", "prj11_point_id",
    "sco1_tokens", "sco2_bm25", "sco4_dense", "sco10_diversify", "flt10_find_fuzzy", "gdb8_callers", "joi5_resolve", "joi1_exact", "set3_containment", "gra1_blast", "gra2_trace", "gra3_call_paths", "gra5_expand", "agg6_token_metrics", "str2_sync", "set6_federated_dense", "prj14_flow", "gra4_affected_tests", "sco9_fallback", "sco6_rrf", "sco7_hybrid_text", "sco5_vector_text",
]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return c


def plain(v):
    if v is None or v is pd.NA or v != v:
        return "-"
    if isinstance(v, bool) or not isinstance(v, (int, float)) and not hasattr(v, "dtype"):
        return str(v)
    return f"{float(v):.6g}"


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, sf, con, name):
    got, want = QUERIES[name](spark, sf).toPandas(), con.execute(SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda d: sorted(tuple(plain(v) for v in r) for r in d[cols].itertuples(index=False))
    assert rows(got) == rows(want)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert len(__spark_entry__.queries()) > 70 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
