"""Audit of DAG files and task graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemill.functions import fixed
from tidemill.operators.components import shuffled, strong_components
from tidemill.operators.findings import Test, evaluate, finding, tests

# -- texts of DAG files: tests on the column ``code`` ---------------------------


def forbidden_tests(code: Column) -> list[Test]:
    return tests("forbidden", "security", [(code.contains(p), m) for p, m in fixed.FORBIDDEN])


def secret_tests(code: Column) -> list[Test]:
    return tests("secrets", "security", [(code.rlike("(?id)" + p), fixed.SECRET_ERROR) for p in fixed.SECRETS])


def _any(code: Column, patterns: list[str]) -> Column:
    return code.rlike("|".join(patterns))


def looks_like_dag(code: Column) -> Column:
    return _any(code, fixed.DAG_MARKERS) & _any(code, fixed.TASK_MARKERS)


def marker_tests(code: Column) -> list[Test]:
    return tests("dag_marker", "structure", [(~_any(code, fixed.DAG_MARKERS), fixed.NO_DAG)]) + tests(
        "task_marker", "structure", [(~_any(code, fixed.TASK_MARKERS), fixed.NO_TASK)]
    )


def connection_tests(code: Column) -> list[Test]:
    given = F.lit(False)
    for text in fixed.CONNECTION_IDS:
        given = given | code.contains(text)
    return tests("conn_id", "logic", [(code.contains("PostgresOperator") & ~given, fixed.CONNECTION_ERROR)])


def deprecated_tests(code: Column) -> list[Test]:
    imports = {m: rf"(?md)^\s*from\s+{m.replace('.', chr(92) + '.')}\s+import\b" for m in fixed.DEPRECATED_IMPORTS}
    return tests(
        "deprecated_imports",
        "compatibility",
        [(code.rlike(imports[m]), f"Deprecated import '{m}'. {advice}") for m, advice in fixed.DEPRECATED_IMPORTS.items()],
    )


def schedule_tests(schedule: Column) -> list[Test]:
    """A cron text has 5 or 6 fields, presets must be known, ``@once`` and none warn."""
    fields = F.size(F.filter(F.split(schedule, r"\s+"), lambda f: f != ""))
    preset = schedule.startswith("@")
    bad_cron = F.coalesce(~preset & ~fields.isin(5, 6), F.lit(False))
    message = (
        F.when(schedule.isNull(), fixed.NO_SCHEDULE)
        .when(schedule == "@once", fixed.RUNS_ONCE)
        .when(bad_cron, F.concat(F.lit("Invalid cron expression: "), schedule))
        .when(
            preset & ~schedule.isin(*fixed.SCHEDULE_PRESETS),
            F.concat(F.lit("Unknown Airflow preset schedule: "), schedule),
        )
    )
    severity = F.when(bad_cron, "error").otherwise("warning")
    return [Test("schedule", "logic", message.isNotNull(), message, severity=severity)]


def forbidden(files: DataFrame, id_col: str) -> DataFrame:
    """One finding per forbidden call in a file."""
    return evaluate(files, id_col, forbidden_tests(F.col("code")))


def secrets(files: DataFrame, id_col: str) -> DataFrame:
    """One finding per kind of secret written into a file."""
    return evaluate(files, id_col, secret_tests(F.col("code")))


def dag_markers(files: DataFrame, id_col: str) -> DataFrame:
    """Findings for files without a DAG or without a task."""
    return evaluate(files, id_col, marker_tests(F.col("code")))


def connection_ids(files: DataFrame, id_col: str) -> DataFrame:
    """Findings for files that use the database operator without the standard connection."""
    return evaluate(files, id_col, connection_tests(F.col("code")))


def deprecated_imports(files: DataFrame, id_col: str) -> DataFrame:
    """One finding per file and deprecated module it imports from."""
    return evaluate(files, id_col, deprecated_tests(F.col("code")))


def schedules(dags: DataFrame, id_col: str = "dag_id") -> DataFrame:
    return evaluate(dags, id_col, schedule_tests(F.col("schedule")))


def file_findings(files: DataFrame, id_col: str) -> DataFrame:
    """All tests on ``code`` and ``schedule`` of DAG files in one scan."""
    code = F.col("code")
    return evaluate(
        files, id_col, marker_tests(code), forbidden_tests(code), secret_tests(code), deprecated_tests(code),
        connection_tests(code), schedule_tests(F.col("schedule")),
    )


# -- tasks and edges: dag_tasks(dag_id, task_id, …), dag_edges(dag_id, src, dst) ----


def duplicate_tasks(tasks: DataFrame) -> DataFrame:
    """One finding per task id used more than once in a DAG."""
    repeated = tasks.groupBy("dag_id", "task_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    message = F.concat(F.lit("Duplicate task_id values detected: ['"), F.col("task_id"), F.lit("']"))
    return repeated.select(*finding(F.col("dag_id"), "duplicate_tasks", "logic", message, F.col("task_id")))


def no_dependencies(dags: DataFrame, edges: DataFrame) -> DataFrame:
    """Warnings for DAGs without any edge."""
    alone = dags.select("dag_id").join(edges.select("dag_id").distinct(), "dag_id", "left_anti")
    return alone.select(
        *finding(F.col("dag_id"), "no_deps", None, F.lit(fixed.NO_DEPENDENCIES), severity="warning")
    )


def cyclic_core(edges: DataFrame) -> DataFrame:
    """The edges that lie on a circle: those inside a strongly connected component, each once."""
    named = edges.select("dag_id", "src", "dst").dropna().distinct()
    inside = strong_components(named).rows.select(F.col("graph").alias("dag_id"), "node", "component")
    for end in ("src", "dst"):
        named = named.join(shuffled(inside.withColumnsRenamed({"node": end, "component": f"{end}_component"})), ["dag_id", end])
    return named.where("src_component = dst_component").select("dag_id", "src", "dst")


def cycle_components(edges: DataFrame) -> DataFrame:
    """(dag_id, task_id, component): tasks that wait for themselves, with the smallest task they share a circle with."""
    return strong_components(edges).rows.select(F.col("graph").alias("dag_id"), F.col("node").alias("task_id"), "component")


def cycles(edges: DataFrame) -> DataFrame:
    """One finding per DAG whose tasks wait for each other in a circle."""
    found = strong_components(edges, members=False).rows.select(F.col("graph").alias("dag_id")).distinct()
    return found.select(*finding(F.col("dag_id"), "cycles", "logic", F.lit(fixed.CYCLE_ERROR)))
