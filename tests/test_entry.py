import os

import pytest

import __spark_entry__ as entry
import verify

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(f"{SF}/nodes.parquet"), reason="no test data here")


def test_contract(spark):
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 70
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["cql_two_hops", "cypher_hop", "snapshot_diff_nodes", "coupling", "impact_upstream", "todo_markers", "resolve_calls", "p3_found", "p2_found"])
def test_against_sql(spark, name):
    df = entry.queries()[name](spark, SF)
    got = verify.rows_of(df.columns, df.collect())
    r = verify.duck(SF).execute(entry.oracle_sql()[name])
    assert got == verify.rows_of([d[0] for d in r.description], r.fetchall())
