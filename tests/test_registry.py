"""Every registered query against its SQL at the smallest scale; those without SQL must at least give rows."""

from pathlib import Path

import duckdb
import pytest
from check import compare

from ringfield.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    connection = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf, name):
    result = compare(spark, con, name, sf)
    assert result.startswith("ok" if name in ORACLES else "rows"), result
    assert "TYPES" not in result, result


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 65
    assert set(entry.oracle_sql()) <= set(entry.queries())
