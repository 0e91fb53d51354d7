"""Every query against its SQL in DuckDB, over the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from quillon import workload

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{source}'")
    return con


def plain(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    tidy = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else float(v) if isinstance(v, (int, float)) else v
    return [names[i] for i in order], sorted((tuple(tidy(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(workload.QUERIES))
def test_query(spark, duck, name):
    df = workload.QUERIES[name](spark, DATA)
    got = plain(df.columns, [tuple(r) for r in df.collect()])
    assert got[1]
    if name in workload.ORACLES:
        result = duck.execute(workload.ORACLES[name])
        names = [d[0] for d in result.description]
        assert got == plain(names, result.fetchall())


def test_wide_hashing_ties(spark, tmp_path):
    """Numbers that end at half a millionth, of norm 20, are rounded as in SQL; beside them no text and texts without words."""
    spark.createDataFrame([(1, "i " * 7 + "t " * 3 + "u " * 3 + "h " * 9 + "z " * 3), (2, None), (3, ""), (4, " \n")], "doc_id long, text string").write.parquet(path := f"{tmp_path}/documents.parquet")
    df = workload.QUERIES["text_hashing_wide"](spark, str(tmp_path))
    own = duckdb.connect()
    own.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    result = own.execute(workload.ORACLES["text_hashing_wide"])
    got = plain(df.columns, [tuple(r) for r in df.collect()])
    assert got == plain([d[0] for d in result.description], result.fetchall())
    assert {r["doc_id"]: r["a_1"] for r in df.collect()} == {1: -70312, 2: -250000, 3: -250000, 4: -250000}
