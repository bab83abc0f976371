"""Tables kept in buckets of their key: a batch reads and rewrites the buckets its keys fall in, no others.

A keyed table is a catalog table partitioned by ``key_bucket``, the hash of its key modulo the number of
buckets, both kept as table properties. A batch of few keys costs a few buckets, however large the table is; a batch of
all keys costs a rewrite. Choose so many buckets that one is a few hundred megabytes. Every change is a commit
(``commits``), so all buckets of a batch move or none, and a numbered batch is taken once.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tidemill.operators import commits, history, loads
from tidemill.operators.commits import Batch, Change
from tidemill.operators.loads import Expectations, LoadReport
from tidemill.session import materialize

BUCKET = "key_bucket"
_KEYS, _BUCKETS = "tidemill.keys", "tidemill.buckets"


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{key}`") for key in keys]), F.lit(buckets)).cast("int")


def create(spark: SparkSession, table: str, schema: StructType, keys: Sequence[str], buckets: int) -> None:
    """An empty keyed table with the columns of ``schema``."""
    names = {f.name.lower() for f in schema}
    if buckets < 1 or not keys or not {key.lower() for key in keys} <= names or BUCKET in names:
        raise ValueError(f"{table}: needs keys among its columns, at least one bucket and no column {BUCKET}")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(
        f"CREATE TABLE {table} ({columns}, {BUCKET} INT) USING parquet PARTITIONED BY ({BUCKET}) "
        f"TBLPROPERTIES ('{_KEYS}' = '{json.dumps(list(keys))}', '{_BUCKETS}' = '{buckets}')"
    )


def layout(spark: SparkSession, table: str) -> tuple[list[str], int]:
    """(keys, number of buckets) of a keyed table."""
    found = {row["key"]: row["value"] for row in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}
    if _KEYS not in found:
        raise ValueError(f"{table} is not a keyed table")
    return json.loads(found[_KEYS]), int(found[_BUCKETS])


def is_keyed(spark: SparkSession, table: str) -> bool:
    return not spark.sql(f"SHOW TBLPROPERTIES {table}").filter(F.col("key") == _KEYS).isEmpty()


def rows_of(spark: SparkSession, table: str) -> DataFrame:
    """The rows, without the bucket."""
    return spark.table(table).drop(BUCKET)


def in_buckets(rows: DataFrame, buckets: Sequence[int]) -> DataFrame:
    """Rows of these buckets; the filter is on a partition column, so no other folder is listed or read."""
    return rows.filter(F.col(BUCKET).isin(list(buckets)))


def touched(batch: DataFrame) -> list[int]:
    """The buckets of a batch: numbers below the number of buckets, whatever the size of the batch."""
    return sorted(row[0] for row in batch.select(BUCKET).distinct().collect())


def _rebuilt(rows: DataFrame) -> DataFrame:
    """Files of one bucket come from few tasks; adaptive execution merges small buckets and splits a large one."""
    return rows.hint("rebalance", F.col(BUCKET))


def _commit(spark: SparkSession, table: str, rows: DataFrame | None, expect: Expectations, batch_id: Batch | None) -> LoadReport:
    name = ".".join(loads.split_name(spark, table))
    if rows is None:
        if batch_id:
            commits.commit(spark, [], batch_id, [table])
        return LoadReport(name, 0, True, loads.table_location(spark, table))
    return commits.commit(spark, [Change(_rebuilt(rows), table, "partitions", expect)], batch_id)[0]


def _taken(spark: SparkSession, table: str, batch_id: Batch | None) -> bool:
    return batch_id is not None and commits.applied(spark, table, batch_id.stream) >= batch_id.number


def upsert(
    batch: DataFrame,
    table: str,
    order_by: Sequence[str],
    expect: Expectations = Expectations(),
    batch_id: Batch | None = None,
) -> LoadReport | None:
    """Upsert into a keyed table; running the same batch again changes nothing. None: ``batch_id`` was taken before.

    Of several rows of a key the greatest by ``order_by`` counts. Rows without a complete key are set aside in ``<table>_rejects``.
    ``rows`` of the report and ``expect`` are about the buckets rewritten. The batch is evaluated once.
    """
    spark = batch.sparkSession
    commits.recover_table(spark, table)
    if _taken(spark, table, batch_id):
        return None
    keys, buckets = layout(spark, table)
    placed = loads.conform(batch.withColumn(BUCKET, F.lit(0)), table).withColumn(BUCKET, bucket_of(keys, buckets))
    fixed = materialize(placed, "batch")
    try:
        usable, rejects = loads.split_null_keys(fixed.rows, keys)
        numbers = touched(usable)
        rows = loads.upserted(in_buckets(spark.table(table), numbers), usable, keys, order_by) if numbers else None
        # Rejects first: a batch that is taken has its rejects set aside, and setting them aside twice adds nothing.
        counted = loads.with_rejects(LoadReport(table, 0, True, ""), rejects.drop(BUCKET), table)
        done = _commit(spark, table, rows, expect, batch_id)
        return replace(counted, table=done.table, rows=done.rows, location=done.location)
    finally:
        fixed.drop()


def create_history(
    spark: SparkSession, table: str, changes: StructType, key: Sequence[str], ts: str, change_id: str,
    attributes: Sequence[str], buckets: int,
) -> None:
    """An empty keyed table for the versions that ``load_history`` makes of rows like ``changes``."""
    versions = history.build_history(spark.createDataFrame([], changes), key, ts, change_id, attributes, hot_limit=1)
    create(spark, table, versions.schema, key, buckets)


def load_history(
    batch: DataFrame,
    table: str,
    ts: str,
    change_id: str,
    attributes: Sequence[str],
    hot_limit: int | None = None,
    batch_id: Batch | None = None,
) -> LoadReport | None:
    """Merge changes into the keyed history ``table``; versions of keys in other buckets are neither read nor written.

    As ``history.load_history`` otherwise: late rows, several versions of a key and a batch that is run again are covered, rows
    without key or time are set aside. None: ``batch_id`` was taken before.
    """
    spark = batch.sparkSession
    commits.recover_table(spark, table)
    if _taken(spark, table, batch_id):
        return None
    key, buckets = layout(spark, table)
    kinds = {f.name: f.dataType for f in spark.table(table).schema}
    # The key as the table has it: another type would hash to another bucket.
    placed = batch.withColumns({k: F.col(k).cast(kinds[k]) for k in key}).withColumn(BUCKET, bucket_of(key, buckets))
    fixed = materialize(placed, "changes")
    try:
        usable, rejects = loads.split_null_keys(fixed.rows, [*key, ts])
        numbers = touched(usable)
        rows = None
        if numbers:
            held = in_buckets(spark.table(table), numbers).drop(BUCKET)
            merged = history.merge_history(held, usable.drop(BUCKET), key, ts, change_id, attributes, hot_limit)
            rows = merged.withColumn(BUCKET, bucket_of(key, buckets))
        counted = loads.with_rejects(LoadReport(table, 0, True, ""), rejects.drop(BUCKET), table, "key or time")
        done = _commit(spark, table, rows, Expectations(), batch_id)
        return replace(counted, table=done.table, rows=done.rows, location=done.location)
    finally:
        fixed.drop()
