"""The incremental pattern as a stream: what arrived since the last run is taken once.

The checkpoint of the stream stands in for the high-water mark. The number of a micro-batch is part of the commit that
takes it (``operators.commits``), so a batch that is replayed after a failure, also one between the
change of the table and that of the checkpoint, is known and changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidemill.operators import commits, keyed, loads
from tidemill.operators.commits import Batch, Change
from tidemill.session import materialize


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id Spark gives the query of a checkpoint: a new checkpoint counts its batches anew and has another id."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def _run(stream: DataFrame, table: str, load: Callable[[DataFrame, Batch], object], checkpoint: str) -> StreamingQuery:
    session = stream.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        load(batch, Batch(_stream_id(session, checkpoint), number))
        # Batches run in a session of their own; the one that started the stream must look again.
        session.catalog.refreshTable(table)

    return (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def append_once(batch: DataFrame, table: str, mark_col: str, keys: Sequence[str], batch_id: Batch) -> None:
    """``loads.insert_only`` as a commit. A partitioned table takes the batch by ``insert_only`` itself, without its number:

    a replay then adds no key of the newest mark a second time, as before.
    """
    spark = batch.sparkSession
    commits.recover_table(spark, table)
    if loads.partition_columns(spark, table):
        loads.insert_only(batch, table, mark_col, keys)
    elif commits.applied(spark, table, batch_id.stream) < batch_id.number:
        new = loads.newer_rows(batch, spark.table(table), mark_col, keys)
        commits.commit(spark, [Change(new, table, "append")], batch_id)


def upsert_once(batch: DataFrame, table: str, keys: Sequence[str], order_by: Sequence[str], batch_id: Batch) -> None:
    """Upsert as a commit; of a keyed table only the buckets of the batch are rewritten."""
    spark = batch.sparkSession
    commits.recover_table(spark, table)
    if keyed.is_keyed(spark, table):
        if list(keys) != keyed.layout(spark, table)[0]:
            raise ValueError(f"{table} has other keys")
        keyed.upsert(batch, table, order_by, batch_id=batch_id)
    elif commits.applied(spark, table, batch_id.stream) < batch_id.number:
        fixed = materialize(loads.conform(batch, table), "batch")
        try:
            usable, rejects = loads.split_null_keys(fixed.rows, keys)
            loads.set_aside(rejects, table)
            rows = loads.upserted(spark.table(table), usable, keys, order_by)
            commits.commit(spark, [Change(rows, table)], batch_id)
        finally:
            fixed.drop()


def append_new(stream: DataFrame, table: str, mark_col: str, keys: Sequence[str], checkpoint: str) -> StreamingQuery:
    """Append what is available now; rows must arrive in the order of ``mark_col`` (those before the mark are old)."""
    return _run(stream, table, lambda batch, batch_id: append_once(batch, table, mark_col, keys, batch_id), checkpoint)


def upsert_new(stream: DataFrame, table: str, keys: Sequence[str], order_by: Sequence[str], checkpoint: str) -> StreamingQuery:
    """Upsert what is available now, whatever its order."""
    return _run(stream, table, lambda batch, batch_id: upsert_once(batch, table, keys, order_by, batch_id), checkpoint)
