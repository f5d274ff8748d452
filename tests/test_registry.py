"""The registered queries against their check SQL at the smallest scale.

All of them with RANKLOOM_ALL=1, else a few of each kind.
"""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SOME = ["substring_join", "idf_floor", "dense_lookup", "late_search_wide", "mrr", "bm25_negative", "pareto", "chunk_upsert", "rejects"]
NAMES = list(entry.oracle_sql()) if os.environ.get("RANKLOOM_ALL") else SOME

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


def test_every_query_has_a_check():
    assert entry.oracle_sql().keys() <= entry.queries().keys()
    assert entry.queries().keys() <= entry.oracle_sql().keys() | entry.TESTED.keys()


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        tuple(repr(row[i] + 0.0) if isinstance(row[i], float) else str(row[i]) for i in order) for row in rows
    )


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    df = entry.queries()[name](spark, SF)
    result = con.execute(entry.oracle_sql()[name])
    assert canonical(df.columns, df.collect()) == canonical([d[0] for d in result.description], result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
