"""The common shape of audit results and their roll-up.

A finding is (id, check_no, check_name, item, stage, severity, message): ``id``
is what was audited, checks are numbered in the order in which they speak, and
``item`` orders the findings of one check.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# check name -> number; the first error of the lowest number explains a verdict.
CHECKS = {
    name: number
    for number, name in enumerate(
        [
            "empty", "placeholders", "select_only", "not_materializing", "data_reads", "dag_marker", "task_marker",
            "forbidden", "secrets", "deprecated_imports", "duplicate_tasks", "cross_task_temp", "schema_qualified",
            "conn_id", "schedule", "cycles", "no_deps",
        ]
    )
}

COLUMNS = ["id", "check_no", "check_name", "item", "stage", "severity", "message"]


def finding(id_col: Column, check: str, stage: str | None, message: Column, item: Column | int = 0, severity="error") -> list[Column]:
    """The columns of one finding."""
    severity = F.lit(severity) if isinstance(severity, str) else severity
    item = F.lit(item) if isinstance(item, int) else item
    return [
        id_col.alias("id"),
        F.lit(CHECKS[check]).alias("check_no"),
        F.lit(check).alias("check_name"),
        item.cast("string").alias("item"),
        F.lit(stage).cast("string").alias("stage"),
        severity.alias("severity"),
        message.alias("message"),
    ]


@dataclass(frozen=True)
class Test:
    """What one column condition says about a row."""

    check: str
    stage: str | None
    condition: Column
    message: str | Column
    item: str = "0"
    severity: str | Column = "error"


def tests(check: str, stage: str, conditions: Sequence[tuple[Column, str]]) -> list[Test]:
    """Tests of one check; the order of ``conditions`` becomes that of the findings."""
    return [Test(check, stage, condition, message, f"{n:02d}") for n, (condition, message) in enumerate(conditions)]


def evaluate(df: DataFrame, id_col: str, *groups: Sequence[Test]) -> DataFrame:
    """One finding per row and test that holds, in one scan of ``df`` for all tests.

    The conditions are evaluated in one compiled projection, which shares what
    they have in common; only their outcome is turned into rows, so texts are
    read once and carried no further.
    """

    every = [test for group in groups for test in group]
    outcome = [t.condition.alias(f"_hit{n}") for n, t in enumerate(every)]
    outcome += [t.message.alias(f"_message{n}") for n, t in enumerate(every) if isinstance(t.message, Column)]
    outcome += [t.severity.alias(f"_severity{n}") for n, t in enumerate(every) if isinstance(t.severity, Column)]
    judged = df.select(F.col(id_col).alias("id"), *outcome)
    entries = []
    for n, t in enumerate(every):
        message = F.col(f"_message{n}") if isinstance(t.message, Column) else F.lit(t.message)
        severity = F.col(f"_severity{n}") if isinstance(t.severity, Column) else F.lit(t.severity)
        fields = finding(F.col("id"), t.check, t.stage, message, F.lit(t.item), severity)[1:]
        entries.append(F.struct(F.col(f"_hit{n}").alias("hit"), *fields))
    return judged.select("id", F.inline(F.array(*entries))).filter("hit").select(*COLUMNS)


def union(*parts: DataFrame) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def roll_up(subjects: DataFrame, found: DataFrame) -> DataFrame:
    """(id, valid, stage, error, error_count, warning_count, warnings) for every row of ``subjects(id)``.

    The first error counts; where the DAG or task marker is missing, the other
    errors are not looked at.  All measures are partial aggregates: a subject
    with very many findings still sends one row per task through the shuffle.
    ``warnings`` holds the warnings of all checks, in their order, each text once however often it is said.
    """
    is_error = F.col("severity") == "error"
    structural = F.col("stage") == "structure"
    first = F.min(F.when(is_error, F.struct("check_no", "item", "message", "stage")))
    warned = F.array_sort(F.collect_set(F.when(~is_error, F.struct("check_no", "message"))))
    per_id = found.groupBy("id").agg(
        first.alias("first"),
        F.count_if(is_error).alias("errors"),
        F.count_if(is_error & structural).alias("structural"),
        F.count_if(~is_error).alias("warning_count"),
        F.array_join(F.transform(warned, lambda warning: warning["message"]), " ").alias("warnings"),
    )
    unsound = F.col("structural") > 0
    zero = F.lit(0).cast("bigint")
    return subjects.select("id").join(per_id, "id", "left").select(
        "id",
        F.col("first").isNull().alias("valid"),
        F.col("first.stage").alias("stage"),
        F.col("first.message").alias("error"),
        F.coalesce(F.when(unsound, F.col("structural")).otherwise(F.col("errors")), zero).alias("error_count"),
        F.when(unsound, zero).otherwise(F.coalesce("warning_count", zero)).alias("warning_count"),
        F.when(unsound, F.lit("")).otherwise(F.coalesce("warnings", F.lit(""))).alias("warnings"),
    )
