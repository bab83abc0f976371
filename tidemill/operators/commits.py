"""Changes of several tables as one commit, and batches that are applied once.

Everything is staged and checked first. Then one rename puts the record of the commit in its place: a
small file that names the tables and their staged folders. Before it nothing has happened, after it everything
will: each step that follows can be repeated, so whoever finds a record finishes it (:func:`recover`).
The number of a batch is part of its commit, so a batch that comes again is known.

One writer works on a database at a time; a commit is refused while an unfinished one is there. Readers that come between
the steps of one commit see some tables before and some after it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidemill.operators import loads
from tidemill.operators.loads import Expectations, LoadReport
from tidemill.session import delete_folder


class Unfinished(RuntimeError):
    """A commit of this database did not come to its end; ``recover`` first, then read and write."""


@dataclass(frozen=True)
class Batch:
    """A numbered batch of a stream; numbers of one stream grow."""

    stream: str
    number: int


@dataclass(frozen=True)
class Change:
    """What becomes of one table.

    ``how``: ``replace`` (these are its rows, its columns stay), ``partitions`` (these are the rows of the partitions
    they fall in, others stay), ``append`` (these are added; not for partitioned tables) or ``anew`` (a table of
    these columns takes its place; it forgets its batches).
    """

    rows: DataFrame
    table: str
    how: str = "replace"
    expect: Expectations = Expectations()


def _reached(step: str) -> None:
    """Called before every step of a commit; tests let it fail."""


# -- records -----------------------------------------------------------------


def _path(spark: SparkSession, place: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _records_folder(spark: SparkSession, database: str) -> str:
    return f"{spark.catalog.getDatabase(database).locationUri.rstrip('/')}/commits"


def _records(spark: SparkSession, database: str) -> list[str]:
    fs, folder = _path(spark, _records_folder(spark, database))
    found = [status.getPath().toString() for status in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(place for place in found if place.endswith(".json"))


def _put_record(spark: SparkSession, database: str, commit_id: str, record: dict) -> str:
    place = f"{_records_folder(spark, database)}/{commit_id}.json"
    fs, path = _path(spark, place)
    draft = _path(spark, f"{_records_folder(spark, database)}/{commit_id}.draft")[1]
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(record).encode()))
    out.close()
    _reached("record")
    if not fs.rename(draft, path):
        raise OSError(f"{place} could not be written")
    return place


# -- batches -----------------------------------------------------------------


def _batch_key(stream: str) -> str:
    return f"tidemill.batch.{stream}"


def applied(spark: SparkSession, table: str, stream: str) -> int:
    """Number of the last batch of ``stream`` that ``table`` took, -1 if none."""
    rows = {row["key"]: row["value"] for row in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}
    return int(rows.get(_batch_key(stream), -1))


# -- moves: each may be run again --------------------------------------------


def _exists(spark: SparkSession, table: str) -> bool:
    return spark.catalog.tableExists(table)


def _replace(spark: SparkSession, move: dict, commit_id: str) -> None:
    table = move["table"]
    parts = loads.partition_columns(spark, table) if _exists(spark, table) else []
    if parts and not move["rows"]:
        loads.drop_partitions(spark, table)
    else:
        loads.swap(spark, table, move["path"])


def _partitions(spark: SparkSession, move: dict, commit_id: str) -> None:
    if move["rows"]:
        loads.swap_partitions(spark, move["table"], move["path"], loads.partition_columns(spark, move["table"]))


def _append(spark: SparkSession, move: dict, commit_id: str) -> None:
    """Staged files are renamed into the folder of the table; their names are unique, those that went before stay."""
    fs, staged = _path(spark, move["path"])
    if fs.exists(staged):
        for status in fs.listStatus(staged):
            name = status.getPath().getName()
            if name.startswith("part-"):
                _reached("file")
                target = _path(spark, f"{move['into']}/{name}")[1]
                if not fs.rename(status.getPath(), target):
                    raise OSError(f"{target.toString()} could not be written")
        delete_folder(spark, move["path"])
    spark.catalog.refreshTable(move["table"])


def _anew(spark: SparkSession, move: dict, commit_id: str) -> None:
    table = move["table"]
    incoming, outgoing = f"{table}__new_{commit_id}", f"{table}__old_{commit_id}"
    here = _exists(spark, table)
    if not (here and loads.table_location(spark, table).rstrip("/").endswith(move["path"].rsplit("/", 1)[-1])):
        if not _exists(spark, incoming):
            spark.catalog.createTable(incoming, path=move["path"], source="parquet")
        if here:
            _reached("old name")
            spark.sql(f"ALTER TABLE {table} RENAME TO {outgoing}")
        _reached("new name")
        spark.sql(f"ALTER TABLE {incoming} RENAME TO {table}")
    _reached("drop")
    spark.sql(f"DROP TABLE IF EXISTS {outgoing}")
    spark.catalog.refreshTable(table)


_MOVES = {"replace": _replace, "partitions": _partitions, "append": _append, "anew": _anew}


def _finish(spark: SparkSession, place: str, record: dict) -> None:
    for move in record["moves"]:
        _reached("move")
        _MOVES[move["how"]](spark, move, record["id"])
    if record["batch"]:
        for table in record["tables"]:
            _reached("batch")
            spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{_batch_key(record['batch'][0])}' = '{record['batch'][1]}')")
    _reached("done")
    delete_folder(spark, place)


def recover(spark: SparkSession, database: str | None = None) -> int:
    """Finish what commits of ``database`` began; returns how many there were. Staged folders without a record are left to ``purge_snapshots``."""
    places = _records(spark, database or spark.catalog.currentDatabase())
    for place in places:
        _finish(spark, place, json.loads(spark.read.text(place, wholetext=True).first()[0]))
    return len(places)


def recover_table(spark: SparkSession, table: str) -> int:
    return recover(spark, loads.split_name(spark, table)[0])


# -- commits -----------------------------------------------------------------


def _staged(spark: SparkSession, change: Change, table: str) -> tuple[dict, LoadReport]:
    if change.how not in _MOVES:
        raise ValueError(f"no such change: {change.how}")
    known = _exists(spark, table)
    rows, parts = change.rows, []
    if change.how != "anew" and known:
        rows, parts = loads.conform(rows, table), loads.partition_columns(spark, table)
    if change.how in ("append", "partitions") and (not known or bool(parts) != (change.how == "partitions")):
        raise ValueError(f"{table}: {change.how} needs a table with{'out' if change.how == 'append' else ''} partitions")
    path, count = loads.stage(rows, table, change.expect, partition_by=parts)
    into = loads.table_location(spark, table) if change.how == "append" else None
    move = {"table": table, "path": path, "how": change.how, "rows": count, "into": into}
    return move, LoadReport(table, count, known, path)


def commit(
    spark: SparkSession, changes: Sequence[Change], batch: Batch | None = None, tables: Sequence[str] = ()
) -> list[LoadReport]:
    """Make all ``changes`` or none; returns a report for each (``rows``: those staged).

    A ``batch`` its tables have already taken changes nothing and returns no report. ``tables`` names further tables
    that took the batch, though it has no change for them. All tables are of one database and each is named once. If an error
    comes before the record is in place, all tables are as they were; if later, ``recover`` makes all of them new.
    """
    split = [loads.split_name(spark, name) for name in [*(change.table for change in changes), *tables]]
    names = [f"{database}.{name}" for database, name in split]
    if not names or len({database for database, _ in split}) > 1 or len(set(names)) < len(names):
        raise ValueError("a commit is about different tables of one database")
    database = split[0][0]
    if _records(spark, database):
        raise Unfinished(f"{database} has an unfinished commit")
    if batch and all(_exists(spark, name) and applied(spark, name, batch.stream) >= batch.number for name in names):
        return []
    moves: list[dict] = []
    reports = []
    try:
        for change, name in zip(changes, names):
            move, report = _staged(spark, change, name)
            moves.append(move)
            reports.append(report)
        commit_id = uuid.uuid4().hex
        record = {"id": commit_id, "moves": moves, "tables": names, "batch": [batch.stream, batch.number] if batch else None}
        place = _put_record(spark, database, commit_id, record)
    except Exception:
        for move in moves:
            delete_folder(spark, move["path"])
        raise
    _finish(spark, place, record)
    return reports


def delete_cascade(tasks: str, artifacts: str, runs: str, doomed: DataFrame) -> list[LoadReport]:
    """The tasks in ``doomed(id)`` leave the three tables, with their artifacts and runs, in one commit."""
    spark = doomed.sparkSession
    recover_table(spark, tasks)
    names = (tasks, artifacts, runs)
    kept = loads.delete_cascade(*(spark.table(name) for name in names), doomed)
    return commit(spark, [Change(rows, name) for rows, name in zip(kept, names)])
