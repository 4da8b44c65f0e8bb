"""Every query with SQL gives what DuckDB gives; the others give rows of the expected form."""

import pytest

from auditloom.plans import registry
from tests.compare import rows, sql_rows

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf, name):
    assert rows(registry.queries()[name](spark, sf)) == sql_rows(SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_without_sql(spark, sf, name):
    df = registry.queries()[name](spark, sf)
    assert df.count() > 0 and len(df.columns) > 1


def test_feature_widths(spark, sf):
    found = registry.queries()["feature_width_check"](spark, sf).collect()
    assert len(found) == 4 and all(r["as_expected"] for r in found)


def test_corpus_sums(spark, sf):
    r = registry.queries()["corpus_summary"](spark, sf).first()
    assert r["total_nodes_sum"] == r["sum_n_subject"] + r["sum_n_fileobject"] + r["sum_n_netflow"]
    assert r["total_edges_sum"] == sum(r[c] for c in r.asDict() if c.startswith("sum_E_"))


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
