import expected_rows
import pytest
from comparing import of_sql, rows

from spindrift.plans import catalog, kept, registry, texts, trees  # noqa: F401  these add their queries to the catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, sf_dir, name):
    got = catalog.QUERIES[name](spark, sf_dir).toPandas()
    assert len(got)
    if name in catalog.ORACLES:
        want = of_sql(catalog.ORACLES[name], sf_dir)
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(expected_rows.QUERIES))
def test_written_out_rows(spark, sf_dir, name):
    got, want = expected_rows.QUERIES[name](spark, sf_dir).toPandas(), of_sql(expected_rows.EXPECTED[name], sf_dir)
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
