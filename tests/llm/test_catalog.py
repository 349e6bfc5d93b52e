"""The registered corpus queries on the smallest tables, against SQL where there is some."""

import os

import duckdb
import pytest

from lapidary.llm import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query(spark, name):
    frame = catalog.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted(tuple(str(r[c]) for c in columns) for r in frame.collect())
    table = {"op2": "pages", "op10": "conversations"}.get(name.split("_")[0], "documents")
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    if name != "op12_search":
        assert len(got) == con.sql(f"SELECT count(*) FROM {table}").fetchall()[0][0]
    if name in catalog.SQL:
        result = con.sql(catalog.SQL[name])
        at = [result.columns.index(c) for c in columns]
        assert got == sorted(tuple(str(r[i]) for i in at) for r in result.fetchall())
