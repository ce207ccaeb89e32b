"""Each core query against its SQL in DuckDB, at the smallest scale."""

import decimal
import os

import duckdb
import pyarrow as pa
import pytest

from chronoweave import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def value(x):
    """One form for what either engine says: whole numbers of any type alike, floats to six digits."""
    if isinstance(x, decimal.Decimal):
        return int(x) if x == x.to_integral_value() else round(float(x), 6)
    return round(x, 6) if isinstance(x, float) else x


def plain(table):
    """Sorted rows of an Arrow table, its columns by name; a column of floats is one on both sides."""
    rows = [tuple(value(r[c]) for c in sorted(table.column_names)) for r in table.to_pylist()]
    return sorted(rows, key=lambda r: [(x is not None, str(x)) for x in r])


def family(kind):
    return "float" if pa.types.is_floating(kind) or pa.types.is_decimal(kind) and kind.scale else "whole" if pa.types.is_integer(kind) or pa.types.is_decimal(kind) else "other"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = core.queries()[name](spark, SF).toArrow(), con.execute(core.oracle_sql()[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert {f.name: family(f.type) for f in got.schema} == {f.name: family(f.type) for f in want.schema}
    assert plain(got) == plain(want)
