"""Load strategies on plain Parquet tables: stage, check, swap.

Every full rewrite goes to a new snapshot folder.  The checks of the load run
on that folder, and only then one ``ALTER TABLE … SET LOCATION`` moves the
table to it.  Readers therefore see the old rows or the new ones, a failed load
leaves the table alone, and a plan may read the table it is about to replace.
"""

from __future__ import annotations

import hashlib
import re
import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from itertools import product
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from tidemill.functions.scalars import scalar_literal
from tidemill.session import delete_folder, materialize


class StageRejected(ValueError):
    """The staged rows failed a check; the target table was not touched."""


@dataclass(frozen=True)
class Expectations:
    """What staged rows must satisfy before they are published."""

    min_rows: int = 0
    not_null: Sequence[str] = ()
    unique: Sequence[str] = ()


@dataclass(frozen=True)
class ReportedColumn:
    name: str
    type: str
    nullable: bool


@dataclass(frozen=True)
class LoadReport:
    """``columns`` is filled by loads that choose the columns themselves."""

    table: str
    rows: int
    replaced_existing: bool
    location: str
    warnings: list[str] = field(default_factory=list)
    rejected: int = 0
    rejects_table: str | None = None
    columns: list[ReportedColumn] = field(default_factory=list)


# -- snapshots ---------------------------------------------------------------


def split_name(spark: SparkSession, table: str) -> tuple[str, str]:
    database, _, name = table.rpartition(".")
    return database or spark.catalog.currentDatabase(), name


def _snapshot_root(spark: SparkSession, table: str) -> str:
    database, name = split_name(spark, table)
    return f"{spark.catalog.getDatabase(database).locationUri.rstrip('/')}/snapshots/{name}"


def described(spark: SparkSession, table: str, what: str) -> str | None:
    """A property of the table itself; columns of that name come earlier in the description."""
    rows = spark.sql(f"DESCRIBE EXTENDED {table}").filter(F.col("col_name") == what).select("data_type").collect()
    return rows[-1][0] if rows else None


def table_location(spark: SparkSession, table: str) -> str:
    return described(spark, table, "Location")


def purge_snapshots(spark: SparkSession, table: str, older_than: float = 0) -> int:
    """Delete the snapshots of ``table`` nothing points to any more; returns how many went in whole.

    A reader that began before the last swap still uses an older folder, and a load that is being staged has one as
    well: run it in a quiet hour, or with ``older_than`` seconds, which spares what was written since. The
    partitions of a table may live in any number of snapshots: of each, the partitions that were replaced go, one after the
    other, and the snapshot with its last one. Finish interrupted commits (``commits.recover``) first: a database
    that has one is refused.
    """
    database, _ = split_name(spark, table)
    root = spark._jvm.org.apache.hadoop.fs.Path(_snapshot_root(spark, table))
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return 0
    records = spark._jvm.org.apache.hadoop.fs.Path(f"{spark.catalog.getDatabase(database).locationUri.rstrip('/')}/commits")
    if fs.exists(records) and any(s.getPath().getName().endswith(".json") for s in fs.listStatus(records)):
        raise ValueError(f"{database} has an unfinished commit")
    live: set[tuple[str, ...]] = set()
    for place in live_locations(spark, table):
        # The catalog may show a place with or without escapes; one that is found neither way is no licence to delete.
        forms = [form for form in dict.fromkeys((place, unquote(place))) if _is_there(spark, form)]
        if not forms:
            raise ValueError(f"{table}: {place} is not there, nothing was deleted")
        live.update(_below(root, form) for form in forms)
    before = (time.time() - older_than) * 1000
    gone = 0
    for snapshot in fs.listStatus(root):
        inside = {place for place in live if place[:1] == (snapshot.getPath().getName(),)}
        if snapshot.getModificationTime() > before:
            continue
        if not inside:
            fs.delete(snapshot.getPath(), True)
            gone += 1
        elif (snapshot.getPath().getName(),) not in inside:
            _sweep(fs, snapshot, root, inside)
    return gone


def _is_there(spark: SparkSession, place: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _below(root, place: str) -> tuple[str, ...]:
    """The folders from ``root`` down to ``place``; empty where it lies elsewhere."""
    at, top = (re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", name).rstrip("/") for name in (place, root.toString()))
    return tuple(at[len(top) + 1 :].split("/")) if at.startswith(top + "/") else ()


def _sweep(fs, folder, root, live: set[tuple[str, ...]]) -> None:
    """Delete the folders of partitions below ``folder`` that lead to no live one."""
    for child in fs.listStatus(folder.getPath()):
        here = _below(root, child.getPath().toString())
        if not child.isDirectory() or here in live:
            continue
        if any(place[: len(here)] == here for place in live):
            _sweep(fs, child, root, live)
        else:
            fs.delete(child.getPath(), True)


def live_locations(spark: SparkSession, table: str) -> list[str]:
    """Where ``table`` has its rows: its own folder, or that of each partition."""
    if not partition_columns(spark, table):
        return [table_location(spark, table)]
    places = []
    for spec in _listed_partitions(spark, table):
        try:
            rows = spark.sql(f"DESCRIBE EXTENDED {table} PARTITION ({_spec_sql(spec)})").filter("col_name = 'Location'").collect()
        except AnalysisException as error:
            # Of a null partition and that of the text null, one may be absent.
            if "PARTITION" not in (error.getCondition() or "") or "NOT_FOUND" not in error.getCondition():
                raise
            continue
        places += [row["data_type"] for row in rows]
    return places


def stage(
    df: DataFrame,
    table: str,
    expect: Expectations = Expectations(),
    rows_per_file: int | None = None,
    partition_by: Sequence[str] = (),
) -> tuple[str, int]:
    """Write ``df`` to a new snapshot of ``table`` and check it; returns (path, rows).

    Row count and null counts are observed while the rows are written; only the
    uniqueness check reads the snapshot again (key columns alone, pre-aggregated
    before its shuffle).
    """
    spark = df.sparkSession
    path = f"{_snapshot_root(spark, table)}/{uuid.uuid4().hex}"
    seen = Observation(f"stage_{uuid.uuid4().hex}")
    measures = [F.count(F.lit(1)).alias("rows")]
    measures += [F.count_if(F.col(c).isNull()).alias(f"null_{i}") for i, c in enumerate(expect.not_null)]
    writer = df.observe(seen, *measures).write
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    found = seen.get
    problems = []
    if found["rows"] < expect.min_rows:
        problems.append(f"{found['rows']} rows, at least {expect.min_rows} expected")
    for i, name in enumerate(expect.not_null):
        if found[f"null_{i}"]:
            problems.append(f"{found[f'null_{i}']} null values in {name}")
    if expect.unique and not problems:
        repeated = spark.read.parquet(path).groupBy(*expect.unique).count().filter("count > 1")
        if not repeated.isEmpty():
            problems.append(f"repeated keys in ({', '.join(expect.unique)})")
    if problems:
        delete_folder(spark, path)
        raise StageRejected(f"{table}: " + "; ".join(problems))
    return path, found["rows"]


# The table property that names the columns all files of a table have, in this order.
UNIFORM = "tidemill.uniform_columns"


def _columns_mark(spark: SparkSession, table: str) -> str:
    """A table whose columns changed since its files were written has another mark than it was given."""
    return hashlib.sha256(spark.table(table).schema.json().encode()).hexdigest()


def _mark_uniform(spark: SparkSession, table: str) -> None:
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{UNIFORM}' = '{_columns_mark(spark, table)}')")


def is_uniform(spark: SparkSession, table: str) -> bool:
    """Whether every file of ``table`` is known to hold its columns in their order."""
    rows = spark.sql(f"SHOW TBLPROPERTIES {table}").filter(F.col("key") == UNIFORM).collect()
    return bool(rows) and rows[0]["value"] == _columns_mark(spark, table)


def partition_columns(spark: SparkSession, table: str) -> list[str]:
    return [c.name for c in spark.catalog.listColumns(table) if c.isPartition]


def swap(spark: SparkSession, table: str, path: str) -> bool:
    """Point ``table`` at a staged snapshot; True when it existed before.

    A partitioned table is moved partition by partition, and loses the
    partitions the snapshot does not have.
    """
    if spark.catalog.tableExists(table):
        parts = partition_columns(spark, table)
        if parts:
            kept = swap_partitions(spark, table, path, parts)
            drop_partitions(spark, table, kept)
            return True
        spark.sql(f"ALTER TABLE {table} SET LOCATION '{path}'")
        spark.catalog.refreshTable(table)
        _mark_uniform(spark, table)
        return True
    spark.catalog.createTable(table, path=path, source="parquet")
    _mark_uniform(spark, table)
    return False


def conform(df: DataFrame, table: str, evolve: bool = False) -> DataFrame:
    """``df`` with the columns of ``table``, matched by name and cast to its types.

    Extra or missing columns are an error; with ``evolve`` extra columns are
    added to the table and missing ones are filled with nulls.
    """
    spark = df.sparkSession
    if evolve:
        add_missing_columns(df, table)
    target = spark.table(table).schema
    have = {c.lower() for c in df.columns}
    missing = [f.name for f in target if f.name.lower() not in have]
    extra = sorted(have - {f.name.lower() for f in target})
    if extra or (missing and not evolve):
        raise ValueError(f"{table}: missing columns {missing}, unknown columns {extra}")
    absent = set(missing)
    return df.select(
        *[
            (F.lit(None) if f.name in absent else F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name)
            for f in target
        ]
    )


def add_missing_columns(df: DataFrame, table: str) -> list[str]:
    """Additive schema evolution: columns of ``df`` that ``table`` lacks are added to it."""
    spark = df.sparkSession
    known = {f.name.lower() for f in spark.table(table).schema}
    new = [f for f in df.schema if f.name.lower() not in known]
    if new:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new)
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({columns})")
        spark.catalog.refreshTable(table)
    return [f.name for f in new]


def ensure_table(spark: SparkSession, table: str, schema: str | StructType) -> list[str]:
    """Make ``table`` with the columns of ``schema`` (DDL or a type), or add those it lacks; returns the added ones."""
    empty = spark.createDataFrame([], schema)
    if spark.catalog.tableExists(table):
        return add_missing_columns(empty, table)
    publish(empty, table)
    return list(empty.columns)


def publish(
    df: DataFrame,
    table: str,
    expect: Expectations = Expectations(),
    evolve: bool = False,
    rows_per_file: int | None = None,
) -> LoadReport:
    """Replace all rows of ``table`` (made if absent) with ``df``: stage, check, swap."""
    spark = df.sparkSession
    parts: list[str] = []
    if spark.catalog.tableExists(table):
        df = conform(df, table, evolve)
        parts = partition_columns(spark, table)
    path, rows = stage(df, table, expect, rows_per_file, parts)
    return LoadReport(table, rows, swap(spark, table, path), path)


def content_id(rows: DataFrame) -> str:
    """What these rows are, whatever their order: their number, and the sum and exclusive or of their hashes."""
    mark = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"}))
    found = rows.agg(F.count(F.lit(1)), F.sum(mark.cast("decimal(38,0)")), F.bit_xor(mark)).first()
    return ":".join(str(part or 0) for part in found)


def set_aside(rows: DataFrame, table: str) -> tuple[int, str | None]:
    """Keep rows that ``table`` cannot take in ``<table>_rejects``; returns their number and that table's name.

    Every row is kept, repeated ones as often as they come, so the table holds as many rows as the loads
    reported. Rows are appended, the table is never rewritten. ``<table>_reject_loads`` lists what was set aside by the
    content of the load (:func:`content_id`), so that a load that is run again adds nothing; one that died between
    the two appends adds its rows a second time, none is lost. Without such rows no table is made.
    """
    spark = rows.sparkSession
    kept = materialize(rows, "rejects")
    try:
        if not kept.count:
            return 0, None
        name, loads = f"{table}_rejects", f"{table}_reject_loads"
        load_id = content_id(kept.rows)
        ensure_table(spark, name, kept.rows.schema)
        ensure_table(spark, loads, "load_id string, row_count bigint")
        if spark.table(loads).filter(F.col("load_id") == load_id).isEmpty():
            append(kept.rows, name, evolve=True)
            append(spark.createDataFrame([(load_id, kept.count)], "load_id string, row_count bigint"), loads)
        return kept.count, name
    finally:
        kept.drop()


# -- the four strategies -----------------------------------------------------


def truncate_insert(df: DataFrame, table: str, expect: Expectations = Expectations()) -> LoadReport:
    """Keep the table and its columns, replace all rows."""
    if not df.sparkSession.catalog.tableExists(table):
        raise ValueError(f"{table} does not exist")
    return publish(df, table, expect)


def create_replace(df: DataFrame, table: str, expect: Expectations = Expectations()) -> LoadReport:
    """Make the table anew; columns may differ from before.

    With the columns it had, a table without partitions is moved to the staged rows at once. Else its new
    catalog entry is made under another name first, and then the two change names: what
    can go wrong with the new one does so while the old one stands, and a failed change of names is taken back.
    """
    spark = df.sparkSession
    path, rows = stage(df, table, expect)
    if not spark.catalog.tableExists(table):
        return LoadReport(table, rows, swap(spark, table, path), path)
    staged = spark.read.parquet(path).schema
    same = [(f.name, f.dataType) for f in staged] == [(f.name, f.dataType) for f in spark.table(table).schema]
    if same and described(spark, table, "Provider") == "parquet" and not partition_columns(spark, table):
        swap(spark, table, path)
        return LoadReport(table, rows, True, path)
    database, name = split_name(spark, table)
    mark = uuid.uuid4().hex[:12]
    incoming, outgoing = f"{database}.{name}__new_{mark}", f"{database}.{name}__old_{mark}"
    try:
        spark.catalog.createTable(incoming, path=path, source="parquet")
        spark.sql(f"ALTER TABLE {table} RENAME TO {outgoing}")
        try:
            spark.sql(f"ALTER TABLE {incoming} RENAME TO {database}.{name}")
        except Exception:
            spark.sql(f"ALTER TABLE {outgoing} RENAME TO {database}.{name}")
            raise
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {incoming}")
        delete_folder(spark, path)
        raise
    spark.sql(f"DROP TABLE {outgoing}")
    _mark_uniform(spark, table)
    return LoadReport(table, rows, True, path)


def newer_rows(batch: DataFrame, target: DataFrame, mark_col: str, keys: Sequence[str]) -> DataFrame:
    """Rows of ``batch`` beyond the high-water mark of ``target``.

    Rows at the mark itself, and rows without a mark, count as new when their keys are
    not in the target yet with just that mark.  Both sides are cut to such rows before the
    anti-join, so it compares only the newest slice; rows beyond the mark pass through.
    """
    mark = scalar_literal(target, F.max(mark_col))
    value = F.col(mark_col)
    unmarked = value.isNull()
    held = target.filter(unmarked if mark is None else unmarked | (value == mark)).select(
        *[F.col(key).alias(f"_held_{i}") for i, key in enumerate(keys)], value.alias("_held_mark")
    )
    same = value.eqNullSafe(F.col("_held_mark"))
    for i, key in enumerate(keys):
        same = same & (F.col(key) == F.col(f"_held_{i}"))
    new = batch if mark is None else batch.filter(unmarked | (value >= mark))
    return new.join(held, same, "left_anti")


def append(df: DataFrame, table: str, evolve: bool = False) -> None:
    """Add rows; columns are matched by name."""
    conform(df, table, evolve).write.insertInto(table)


def insert_only(batch: DataFrame, table: str, mark_col: str, keys: Sequence[str]) -> None:
    """Append the rows of ``batch`` that are newer than what ``table`` holds.

    The batch is written as it is read; the target is only scanned for its mark
    (a column statistic), the rows at the mark and those without one.
    """
    append(newer_rows(batch, batch.sparkSession.table(table), mark_col, keys), table)


def latest_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """One row per key: the greatest by ``order_by``, then by all other columns.

    The order is total, so the choice never depends on the partitioning.  The
    ``row_number = 1`` filter is pushed below the shuffle by the optimiser: each
    map task sends on one row per key at most, however hot the key is.
    """
    others = [c for c in df.columns if c not in set(keys) | set(order_by)]
    order = [F.desc_nulls_last(c) for c in [*order_by, *others]]
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", number).filter("_rn = 1").drop("_rn")


def split_null_keys(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose keys are all set, rows to reject)."""
    complete = F.lit(True)
    for key in keys:
        complete = complete & F.col(key).isNotNull()
    return df.filter(complete), df.filter(~complete)


def upserted(target: DataFrame, batch: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The rows of ``target`` after ``batch`` updated the keys it knows and added the others."""
    usable, _ = split_null_keys(batch, keys)
    last = latest_per_key(usable, keys, order_by)
    untouched = target.join(last.select(*keys), list(keys), "left_anti")
    return untouched.select(*target.columns).unionByName(last.select(*target.columns))


def upsert(
    batch: DataFrame, table: str, keys: Sequence[str], order_by: Sequence[str], expect: Expectations = Expectations()
) -> LoadReport:
    """Upsert into ``table``; running the same batch again changes nothing.

    Rows without a complete key are set aside in ``<table>_rejects`` and counted in the report. The batch is
    evaluated once, before the table changes: it may read the table, or a clock.
    """
    target = batch.sparkSession.table(table)
    fixed = materialize(conform(batch, table), "batch")
    try:
        report = publish(upserted(target, fixed.rows, keys, order_by), table, expect)
        return with_rejects(report, split_null_keys(fixed.rows, keys)[1], table)
    finally:
        fixed.drop()


def with_rejects(report: LoadReport, rejects: DataFrame, table: str, lacking: str = "a complete key") -> LoadReport:
    """``report`` after ``rejects`` were set aside."""
    count, name = set_aside(rejects, table)
    if not count:
        return report
    warnings = [*report.warnings, f"{count} rows without {lacking} are in {name}"]
    return replace(report, rejected=count, rejects_table=name, warnings=warnings)


def upsert_partitions(
    batch: DataFrame,
    table: str,
    keys: Sequence[str],
    order_by: Sequence[str],
    partition_by: Sequence[str],
    expect: Expectations = Expectations(),
) -> LoadReport:
    """Upsert that rewrites only the partitions the batch falls in.

    Rows without a complete key are set aside in ``<table>_rejects`` and counted in the report.

    The partition columns must be part of the key: a key can then not move from
    one partition to another, and the cost follows the batch instead of the
    table.  The new partitions are staged like any snapshot, then the table's
    partitions are moved to them one by one (catalog entries only).
    """
    if not set(partition_by) <= set(keys):
        raise ValueError("partition columns must be part of the key")
    spark = batch.sparkSession
    target = spark.table(table)
    fixed = materialize(conform(batch, table), "batch")
    try:
        usable, rejects = split_null_keys(fixed.rows, keys)
        affected = target.filter(_in_partitions(usable, partition_by)).select(*target.columns)
        path, rows = stage(upserted(affected, usable, keys, order_by), table, expect, partition_by=partition_by)
        swap_partitions(spark, table, path, partition_by)
        return with_rejects(LoadReport(table, rows, True, path), rejects, table)
    finally:
        fixed.drop()


def _in_partitions(batch: DataFrame, partition_by: Sequence[str]) -> Column:
    """True in the partitions ``batch`` falls in: literals, so that the other ones are not even listed."""
    kinds = {f.name: f.dataType for f in batch.schema}
    touched = F.lit(False)
    for row in batch.select(*[F.col(c).cast("string").alias(c) for c in partition_by]).distinct().collect():
        same = F.lit(True)
        for c in partition_by:
            same = same & (F.col(c) == F.lit(row[c]).cast(kinds[c]))
        touched = touched | same
    return touched


Spec = tuple[tuple[str, str | None], ...]
# How Spark names the folder of a null partition.
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"


def _literal(text: str | None) -> str:
    if text is None:
        return "NULL"
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spec_sql(spec: Spec) -> str:
    return ", ".join(f"`{column}` = {_literal(value)}" for column, value in spec)


def _listed_partitions(spark: SparkSession, table: str) -> set[Spec]:
    """The partitions of a table. A listing spells the null partition and that of the text ``null`` alike;

    where one of them is listed, both are named, as dropping a partition that is absent does nothing.
    """
    specs: set[Spec] = set()
    for (name,) in spark.sql(f"SHOW PARTITIONS {table}").collect():
        cells = [(c, v) for c, _, v in (part.partition("=") for part in name.split("/"))]
        choices = [[(c, None), (c, "null")] if v in (NULL_PARTITION, "null") else [(c, unquote(v))] for c, v in cells]
        specs.update(product(*choices))
    return specs


def swap_partitions(spark: SparkSession, table: str, path: str, partition_by: Sequence[str]) -> set[Spec]:
    """Point the partitions found below ``path`` to it, new ones are added to the table; returns them.

    Only names of partitions are looked at.
    """
    kinds = {f.name: f.dataType for f in spark.table(table).schema}
    folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("folder")
    staged = spark.read.parquet(path).select(
        *[F.col(c).cast(kinds[c]).cast("string").alias(c) for c in partition_by], folder
    )
    moved = set()
    for row in staged.distinct().collect():
        spec = tuple((c, row[c]) for c in partition_by)
        where, place = f"PARTITION ({_spec_sql(spec)})", unquote(row["folder"])
        spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS {where} LOCATION {_literal(place)}")
        spark.sql(f"ALTER TABLE {table} {where} SET LOCATION {_literal(place)}")
        moved.add(spec)
    spark.catalog.refreshTable(table)
    return moved


def drop_partitions(spark: SparkSession, table: str, but: set[Spec] = frozenset()) -> None:
    for spec in _listed_partitions(spark, table) - but:
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({_spec_sql(spec)})")
    spark.catalog.refreshTable(table)


# -- patterns on top ---------------------------------------------------------


def archive_move(table: str, archive: str, condition: Column, keys: Sequence[str]) -> None:
    """Move the rows of ``table`` that meet ``condition`` to ``archive``.

    Rows where the condition is null stay.  The condition is evaluated once, for both tables,
    so one that moves with the clock loses nothing.  The archive is filled before the
    table is trimmed: after a crash between the two a repeat run completes the
    move without repeating a row.
    """
    spark = SparkSession.active()
    judged = materialize(spark.table(table).withColumn("_moves", F.coalesce(condition, F.lit(False))), "archive")
    old = judged.rows.filter("_moves").drop("_moves")
    append(old.join(spark.table(archive).select(*keys), list(keys), "left_anti"), archive)
    publish(judged.rows.filter(~F.col("_moves")).drop("_moves"), table)
    judged.drop()


def updated(df: DataFrame, column: str, value: Column, condition: Column) -> DataFrame:
    """``column`` set to ``value`` where ``condition`` is true; other rows as they are."""
    return df.withColumn(column, F.when(condition, value).otherwise(F.col(column)))


def delete_cascade(
    tasks: DataFrame, artifacts: DataFrame, runs: DataFrame, doomed: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tasks, artifacts and runs left after the tasks in ``doomed(id)`` are deleted."""
    lost_tasks = doomed.select(F.col("id").alias("task_id"))
    lost_artifacts = artifacts.join(lost_tasks, "task_id", "left_semi").select(F.col("id").alias("artifact_id"))
    return (
        tasks.join(doomed.select("id"), "id", "left_anti"),
        artifacts.join(lost_tasks, "task_id", "left_anti").select(*artifacts.columns),
        runs.join(lost_artifacts, "artifact_id", "left_anti").select(*runs.columns),
    )


# -- multi-step scripts ------------------------------------------------------


@dataclass(frozen=True)
class Step:
    """One SELECT of a script; ``{name}`` in it stands for a source or an earlier step.

    With ``target`` set its rows are published to that table at the end.
    """

    name: str
    sql: str
    target: str | None = None
    expect: Expectations = Expectations()


@dataclass(frozen=True)
class StepLog:
    step: int
    name: str
    status: str
    message: str | None


class ScriptFailed(RuntimeError):
    def __init__(self, log: list[StepLog]):
        super().__init__(f"Statement #{log[-1].step} ({log[-1].name}): {log[-1].message}")
        self.log = log


def run_steps(spark: SparkSession, steps: Sequence[Step], sources: dict[str, DataFrame]) -> tuple[DataFrame, list[StepLog]]:
    """Run a script; returns the last result and the log.

    Steps that feed a table are staged and checked as they are reached; the
    tables are moved only after the last step, so an error before leaves all
    of them as they were.  If a move fails, tables without partitions that were moved already go back
    to their old rows; moved partitions stay.
    """
    frames = dict(sources)
    staged: list[tuple[str, str]] = []
    log: list[StepLog] = []
    for number, step in enumerate(steps, start=1):
        try:
            used = {name: df for name, df in frames.items() if "{" + name + "}" in step.sql}
            result = spark.sql(step.sql, **used)
            if step.target:
                parts: list[str] = []
                if spark.catalog.tableExists(step.target):
                    result = conform(result, step.target)
                    parts = partition_columns(spark, step.target)
                path, _ = stage(result, step.target, step.expect, partition_by=parts)
                staged.append((step.target, path))
                result = spark.read.parquet(path)
        except Exception as error:
            for _, path in staged:
                delete_folder(spark, path)
            log.append(StepLog(number, step.name, "error", str(error)))
            raise ScriptFailed(log) from error
        frames[step.name] = result
        log.append(StepLog(number, step.name, "success", None))
    moved: list[tuple[str, str | None]] = []
    for table, path in staged:
        try:
            plain = not spark.catalog.tableExists(table) or not partition_columns(spark, table)
            before = table_location(spark, table) if spark.catalog.tableExists(table) else None
            swap(spark, table, path)
            if plain:
                moved.append((table, before))
        except Exception as error:
            for done, location in reversed(moved):
                if location:
                    swap(spark, done, location)
                    # Files of before need not be alike.
                    spark.sql(f"ALTER TABLE {done} UNSET TBLPROPERTIES IF EXISTS ('{UNIFORM}')")
                else:
                    spark.sql(f"DROP TABLE IF EXISTS {done}")
            log.append(StepLog(len(steps) + 1, f"publish {table}", "error", str(error)))
            raise ScriptFailed(log) from error
    return frames[steps[-1].name], log


def step_report(step_log: DataFrame) -> DataFrame:
    """Per script: steps run, and number, kind and message of the first failed one.

    ``step_log`` has script_id, step, kind, status, message.
    """
    failed = F.col("status") == "error"
    first = F.min(F.when(failed, F.struct("step", "kind", "message")))
    return step_log.groupBy("script_id").agg(
        F.count(F.lit(1)).alias("steps"),
        F.count_if(failed).alias("failed_steps"),
        first.getField("step").alias("first_failed_step"),
        F.concat(
            F.lit("Statement #"), first.getField("step").cast("string"),
            F.lit(" ("), first.getField("kind"), F.lit("): "), first.getField("message"),
        ).alias("error"),
    )
