import os

import duckdb
import numpy as np
import pytest

from corpusweft import queries

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        name = f.removesuffix(".parquet")
        path = f"{SF}/{f}/*.parquet" if os.path.isdir(f"{SF}/{f}") else f"{SF}/{f}"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_rows_equal_those_of_sql(spark, duck, name):
    found = queries.queries()[name](spark, SF)
    columns = sorted(found.columns)
    answer = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    want = sorted(repr([plain(dict(zip(names, r))[c]) for c in columns]) for r in answer.fetchall())
    assert sorted(repr([plain(r[c]) for c in columns]) for r in found.collect()) == want
