"""Each registered query against its SQL in DuckDB."""

import pytest

import __spark_entry__ as entry
from strandlake.plans import registry

from .compare import SF, duck, rows_of


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    df = registry.QUERIES[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    assert got
    if name in registry.ORACLE:
        cur = duck().execute(registry.ORACLE[name])
        columns = [c[0] for c in cur.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == rows_of(columns, cur.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["lang", "n", "with_cds", "codons", "tokens", "gc"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
