"""Kinds of statements that begin with a WITH list."""

from pyspark.sql import functions as F

from tidemill.operators.audit_sql import statement_kind

CASES = {
    "WITH a AS (SELECT 1) SELECT * FROM a": "SELECT",
    "with moved as (delete from t returning *) insert into u select * from moved": "INSERT",
    "WITH a AS (SELECT (1 + (2)) FROM (SELECT 3) x), b AS (INSERT INTO t VALUES (1)) UPDATE t SET x = 1": "UPDATE",
    "/* SELECT ( */ WITH a AS (SELECT ') SELECT (' AS s) -- INSERT\nDELETE FROM t WHERE x IN (SELECT s FROM a)": "DELETE",
    'WITH "select (" AS (SELECT 1) MERGE INTO t USING "select (" ON 1 = 1': "MERGE",
    "WITH a AS (SELECT 1)": "SELECT",
    "WITHOUT x": "UNKNOWN",
    "insert into t select 1": "INSERT",
    "WITH updated_at AS (SELECT 1) SELECT * FROM updated_at": "SELECT",
}


def test_kinds(spark):
    rows = spark.createDataFrame([(s,) for s in CASES], "s string").select("s", statement_kind(F.col("s")).alias("kind")).collect()
    assert {r.s: r.kind for r in rows} == CASES
