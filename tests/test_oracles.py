"""Every query against its SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(frame):
    def one(v):
        if v is None or v != v:
            return "null"
        return repr(round(v, 9)) if isinstance(v, float) else str(v).removesuffix(" 00:00:00")

    return sorted(tuple(map(one, r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    expected, got = db.sql(entry.oracle_sql()[name]).df(), entry.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(expected.columns)
    assert shown(got) == shown(expected)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["pcap_payloads", "extract_dispatch"])
def test_rows(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0
