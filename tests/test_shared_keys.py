"""Queries against DuckDB where records share a key: equal texts of one agent and task, under different canonical identifiers."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "events documents embeddings labels".split()
SHIFT = 1820  # of doc_id: keeps agent and index, but not the family that canonical identifiers and rules go by
NAMES = [
    "archive_memory",
    "current_state",
    "expand_walk",
    "hydrate_keys",
    "purge_memory",
    "stored_state",
    "version_chain",
    "view_kept_up",
    "list_by_canonical",
]  # NAMES


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """The smallest tables with every document three times, and DuckDB over them."""
    duckdb = pytest.importorskip("duckdb")
    path, con = tmp_path_factory.mktemp("copies"), duckdb.connect()
    for t in TABLES:
        con.execute(f"COPY (FROM '{SF}/{t}.parquet') TO '{path}/{t}.parquet'")
    con.execute(f"COPY (SELECT doc_id + k * {SHIFT} AS doc_id, * EXCLUDE (doc_id) FROM '{SF}/documents.parquet', range(3) t(k) ORDER BY doc_id) TO '{path}/documents.parquet'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    return str(path), con


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql_where_keys_are_shared(spark, made, name):
    path, con = made
    df = entry.queries()[name](spark, path)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    result = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted((tuple(r[i] for i in at) for r in result.fetchall()), key=repr)
