"""Every bound query against its DuckDB statement over whole tables."""

import pytest
from compare import rows_of_duck, rows_of_spark

from plumbline.plans import bindings

ORACLE = bindings.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_duckdb(name, spark, duck, sf_dir):
    names, rows = rows_of_spark(bindings.queries()[name](spark, sf_dir))
    want_names, want = rows_of_duck(duck, ORACLE[name])
    assert names == want_names
    assert len(rows) == len(want) and rows
    assert rows == want


def test_every_query_but_html_has_an_oracle():
    assert set(bindings.queries()) - set(ORACLE) == {"html_blocks"}


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns[:2] == ["event_id", "user_id"] and df.count() > 0
