import math
from pathlib import Path

import duckdb
import pytest

from fragmill.plans import catalogue

DATA = Path("/root/testdata/sf0.001")


def plain(rows):
    norm = lambda v: round(v, 9) if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(map(norm, r)) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        con.execute(f"create view {file.stem} as select * from '{file}'")
    df = catalogue.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    result = con.execute(catalogue.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert plain(tuple(r[c] for c in columns) for r in df.collect()) == plain(tuple(r[i] for i in at) for r in result.fetchall())


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_whole_coordinate_sort(spark):
    rows = catalogue.QUERIES["coordinate_sort"](spark, str(DATA)).collect()
    order = [r.coord for r in rows]
    assert len(rows) > 100 and order == sorted(order)
