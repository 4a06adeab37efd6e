"""Every core query with SQL against DuckDB on the smallest tables; the others must run."""

import datetime
import decimal
import math
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lexmill.plans import registry as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], Counter(repr(tuple(plain(r[k]) for k in order)) for r in data)


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, duck, name):
    df = core.QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    if name in core.SQL:
        cur = duck.execute(core.SQL[name])
        assert got == rows([c[0] for c in cur.description], cur.fetchall())


@pytest.fixture(scope="module")
def tied(spark, tmp_path_factory):
    """Documents of two strata whose remainders of 0.8 are equal, but not in doubles: 18 and 23 rows."""
    d = str(tmp_path_factory.mktemp("tied"))
    columns = ["id as doc_id", "cast(id % 18 as string) as text", "'en' as lang", "if(id < 18, 'src0', 'src1') as source", "2L as n_chars"]
    spark.range(41).selectExpr(*columns).write.parquet(f"{d}/documents.parquet")
    return d


@pytest.mark.parametrize("name", ["split_conformance", "split_leakage", "stratified_split", "split_fingerprint", "split_quota_table"])
def test_equal_remainders(spark, tied, name):
    cur = duckdb.connect()
    cur.execute(f"create view documents as select * from '{tied}/documents.parquet/*.parquet'")
    cur.execute(core.SQL[name])
    df = core.QUERIES[name](spark, tied)
    assert rows(df.columns, df.collect()) == rows([c[0] for c in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", ["stratified_split", "split_conformance", "split_fingerprint"])
def test_split_keeps_rows_without_an_id(spark, tmp_path, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("doc_id", F.expr("if(doc_id % 9 = 0, null, doc_id)"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    cur = duckdb.connect()
    cur.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    cur.execute(core.SQL[name])
    df = core.QUERIES[name](spark, str(tmp_path))
    assert rows(df.columns, df.collect()) == rows([c[0] for c in cur.description], cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
