"""Versioned history of attributes (type 2 dimensions)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidemill.operators.loads import LoadReport, latest_per_key, publish, split_null_keys, with_rejects
from tidemill.operators.ordered import HotKeys, hot_keys, with_neighbour, with_time_slice
from tidemill.session import materialize


def build_history(
    changes: DataFrame,
    key: Sequence[str],
    ts: str,
    change_id: str,
    attributes: Sequence[str],
    hot_limit: int | None = None,
) -> DataFrame:
    """Versions of each key: key, attributes, change_id, valid_from, valid_to, is_current.

    A row opens a version if any attribute differs (nulls compare equal) from
    the row before it; the version lasts until the next one opens (half-open).
    Of several rows of a key at one moment the greatest ``change_id`` counts.
    Rows without key or time have no place in a history: ``history_rejects`` has them,
    ``load_history`` keeps and counts them.

    Keys with more than ``1 / hot_limit`` of the rows are worked on in time
    slices.
    """
    key = list(key)
    usable, _ = split_null_keys(changes, [*key, ts])
    return _build(usable, key, ts, change_id, list(attributes), hot_keys(usable, key, ts, hot_limit))


def _build(
    usable: DataFrame, key: list[str], ts: str, change_id: str, attributes: list[str], hot: HotKeys | None
) -> DataFrame:
    columns = (key, ts, change_id, attributes)
    if hot is None:
        return _versions(usable, *columns, hot=None)
    named = F.broadcast(hot.frame(usable.sparkSession))
    cold_part = _versions(usable.join(named, key, "left_anti"), *columns, hot=None)
    hot_part = _versions(usable.join(named, key, "left_semi"), *columns, hot=hot)
    return cold_part.unionByName(hot_part)


def _versions(
    usable: DataFrame, key: list[str], ts: str, change_id: str, attributes: list[str], hot: HotKeys | None
) -> DataFrame:
    sliced = hot is not None
    rows = latest_per_key(usable.select(*key, ts, change_id, *attributes), [*key, ts], [change_id])
    if sliced:
        rows = with_time_slice(rows, ts, hot)
    rows = with_neighbour(rows, key, [ts], attributes, "_before", sliced=sliced)
    opens = F.col("_before").isNull()
    for name in attributes:
        opens = opens | ~F.col(name).eqNullSafe(F.col(f"_before.{name}"))
    versions = rows.filter(opens).drop("_before")
    versions = with_neighbour(versions, key, [ts], [ts], "_after", ahead=True, sliced=sliced)
    valid_to = F.col("_after").getField(ts)
    return versions.select(
        *key,
        *attributes,
        change_id,
        F.col(ts).alias("valid_from"),
        valid_to.alias("valid_to"),
        valid_to.isNull().alias("is_current"),
    )


def history_rejects(changes: DataFrame, key: Sequence[str], ts: str) -> DataFrame:
    """The rows of ``changes`` that no history can hold: those without a complete key or without a time."""
    return split_null_keys(changes, [*key, ts])[1]


def load_history(
    batch: DataFrame,
    table: str,
    key: Sequence[str],
    ts: str,
    change_id: str,
    attributes: Sequence[str],
    hot_limit: int | None = None,
) -> LoadReport:
    """Make the history ``table`` from ``batch``, or merge the batch into it; running it again changes nothing.

    Rows without key or time are set aside in ``<table>_rejects`` and counted in the report, whose ``rows`` are the
    versions the table then has. The batch is evaluated once.
    """
    spark = batch.sparkSession
    fixed = materialize(batch, "changes")
    columns = (key, ts, change_id, attributes, hot_limit)
    try:
        if spark.catalog.tableExists(table):
            versions = merge_history(spark.table(table), fixed.rows, *columns)
        else:
            versions = build_history(fixed.rows, *columns)
        report = publish(versions, table)
        return with_rejects(report, history_rejects(fixed.rows, key, ts), table, "key or time")
    finally:
        fixed.drop()


def merge_history(
    history: DataFrame,
    batch: DataFrame,
    key: Sequence[str],
    ts: str,
    change_id: str,
    attributes: Sequence[str],
    hot_limit: int | None = None,
) -> DataFrame:
    """``history`` after ``batch`` of changes.

    Keys the batch does not name pass through; the versions of the others are
    rebuilt together with the batch, which covers several versions of a key in
    one batch, unchanged rows, late rows and a batch that is run again.  A late
    row lasts until the next version the history knows.
    """
    key, attributes = list(key), list(attributes)
    batch, _ = split_null_keys(batch.select(*key, ts, change_id, *attributes), [*key, ts])
    named = batch.select(*key).distinct()
    passed = history.join(named, key, "left_anti").select(*history.columns)
    reopened = history.join(named, key, "left_semi").select(
        *key, F.col("valid_from").alias(ts), change_id, *attributes
    )
    touched = reopened.unionByName(batch)
    rebuilt = _build(touched, key, ts, change_id, attributes, hot_keys(touched, key, ts, hot_limit))
    return passed.unionByName(rebuilt)
