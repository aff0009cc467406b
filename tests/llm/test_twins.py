import glob
import os

import duckdb
import pytest

from fotoloom.llm import queries


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_twin(spark, data, name):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    df = queries.queries()[name](spark, data)
    want = c.execute(queries.oracle_sql()[name])
    assert df.columns == [x[0] for x in want.description]
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())
