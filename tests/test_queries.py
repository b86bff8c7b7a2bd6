"""Every query with SQL, on the smallest tables, against the SQL."""

import os

import duckdb
import pytest

from spanforge import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for file in os.listdir(SF):
        connection.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    return connection


def _rows(frame):
    frame = frame[sorted(frame.columns)]
    text = lambda v: "null" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(text, r)) for r in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, tables, name):
    found = registry.QUERIES[name](spark, SF)
    if name not in registry.ORACLE_SQL:
        assert found.count() > 0
        return
    expected = tables.sql(registry.ORACLE_SQL[name]).df()
    found = found.toPandas()
    assert sorted(found.columns) == sorted(expected.columns)
    assert _rows(found) == _rows(expected)


def test_mails_before_signs(spark, tmp_path):
    """What follows a mail: every sign of the tables' junk and those that only a local part may hold."""
    texts = [f"ab cd.{k}@mail.example.com{sign} ef 10.0.0.{k}" for k, sign in enumerate(["%%%", "&&&", "###", "_", "+1", ".", "-", "!!", "%", "%%%\n", "@"])] + [None, "", "%%%x@y.org%%%"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    with duckdb.connect() as own:
        own.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        expected = {name: own.sql(registry.ORACLE_SQL[name]).df() for name in ("det_eml", "fast_path")}
    assert len(expected["det_eml"]) == 9 and expected["fast_path"].mails.sum() == 9
    for name, rows in expected.items():
        assert _rows(registry.QUERIES[name](spark, str(tmp_path)).toPandas()) == _rows(rows)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
