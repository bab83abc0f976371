"""Statistics and listings over tasks, their artifacts and the runs of these."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def overview(tasks: DataFrame, artifacts: DataFrame) -> DataFrame:
    """One row: counts per state, success rate, mean attempts and mean generation time.

    Both tables go through one conditional aggregate.  Rates are rounded half
    to even.
    """
    nothing = F.lit(None)
    rows = tasks.select(
        F.lit(True).alias("is_task"), "status", "generation_time_ms", nothing.cast("bigint").alias("attempts")
    ).unionAll(
        artifacts.select(
            F.lit(False), nothing.cast("string"), nothing.cast("bigint"), F.col("attempts").cast("bigint")
        )
    )
    state = F.col("status")
    total, done = F.count_if("is_task"), F.count_if(state == "done")
    time = F.sum("generation_time_ms") / F.count("generation_time_ms")
    tries = F.sum("attempts") / F.count("attempts")
    return rows.agg(
        total.alias("total_tasks"),
        done.alias("done_tasks"),
        F.count_if(state == "error").alias("error_tasks"),
        F.count_if(state.isin("pending", "processing")).alias("pending_tasks"),
        F.when(total > 0, F.bround(done / total * 100, 1)).otherwise(F.lit(0.0)).alias("success_rate"),
        F.when(F.count("attempts") > 0, F.bround(tries, 2)).otherwise(F.lit(0.0)).alias("avg_attempts"),
        F.when(F.count("generation_time_ms") > 0, F.nullif(F.bround(time, 1), F.lit(0.0))).alias("avg_generation_time_ms"),
    )


def per_pattern(tasks: DataFrame) -> DataFrame:
    return tasks.filter(F.col("etl_pattern").isNotNull()).groupBy("etl_pattern").agg(F.count(F.lit(1)).alias("tasks"))


def per_format(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("output_format").agg(F.count(F.lit(1)).alias("tasks"))


def as_map(counts: DataFrame, key: str) -> DataFrame:
    """One row with a name → count map; for the few distinct names of ``per_pattern`` and ``per_format``."""
    entries = F.collect_list(F.struct(F.coalesce(key, F.lit("null")), "tasks"))
    return counts.agg(F.map_from_entries(entries).alias("counts"))


def _with_artifacts(few_tasks: DataFrame, artifacts: DataFrame) -> DataFrame:
    """A bounded number of tasks with their artifacts, one row per artifact.

    Rows instead of a nested list: a task may have any number of artifacts.
    The tasks are fetched once and broadcast, so the artifacts are filtered
    where they lie; tasks without any are added with nulls.
    """
    few_tasks = few_tasks.sparkSession.createDataFrame(few_tasks.collect(), few_tasks.schema)
    few = F.broadcast(few_tasks)
    detail = artifacts.select(
        "task_id", F.col("id").alias("artifact_id"), "artifact_type", "attempts", "is_valid",
        F.col("created_at").alias("artifact_created_at"),
    )
    matched = detail.join(few, detail["task_id"] == few["id"]).drop("task_id")
    bare = few_tasks.join(matched.select("id").distinct(), "id", "left_anti")
    return matched.unionByName(bare, allowMissingColumns=True).select(
        *few_tasks.columns, *[c for c in detail.columns if c != "task_id"]
    )


def recent_tasks(tasks: DataFrame, artifacts: DataFrame, n: int = 50) -> DataFrame:
    """The newest ``n`` tasks and their artifacts, newest first."""
    newest = tasks.orderBy(F.desc("created_at"), F.desc("id")).limit(n)
    return _with_artifacts(newest, artifacts).orderBy(
        F.desc("created_at"), F.desc("id"), F.desc("artifact_created_at"), F.desc("artifact_id")
    )


def task_detail(tasks: DataFrame, artifacts: DataFrame, task_id: Column | int) -> DataFrame:
    """One task with its artifacts, newest first; no rows if there is no such task."""
    wanted = F.lit(task_id) if isinstance(task_id, int) else task_id
    one = tasks.filter(F.col("id") == wanted).limit(1)
    return _with_artifacts(one, artifacts.filter(F.col("task_id") == wanted)).orderBy(
        F.desc("artifact_created_at"), F.desc("artifact_id")
    )


def with_run_state(runs: DataFrame) -> DataFrame:
    """Adds the log status of a run and its duration.

    ``success`` counts as success and anything else as error, a missing state included.
    """
    return runs.withColumn("status", F.when(F.col("state") == "success", "success").otherwise("error")).withColumn(
        "duration_ms", F.timestamp_diff("MILLISECOND", "started_at", "finished_at")
    )


def run_log(runs: DataFrame, artifact_id: int | None = None) -> DataFrame:
    """Runs of one artifact, newest first; without an artifact all runs, in no order."""
    if artifact_id is None:
        return with_run_state(runs)
    return with_run_state(runs.filter(F.col("artifact_id") == artifact_id)).orderBy(F.desc("started_at"), F.desc("id"))


def validation_message(error: Column, stage: Column, errors: Column) -> Column:
    """The message of a failed validation, or null.

    Without a message of its own the first entry of ``errors`` (array of
    structs stage, error) speaks; the stage is named when known.
    """
    first = F.get(errors, F.lit(0))
    own = F.nullif(error, F.lit(""))
    message = F.coalesce(own, F.nullif(first.getField("error"), F.lit("")))
    where = F.nullif(F.when(own.isNotNull(), stage).otherwise(F.coalesce(F.nullif(stage, F.lit("")), first.getField("stage"))), F.lit(""))
    return F.when(
        message.isNotNull(),
        F.when(where.isNotNull(), F.concat(F.lit("Validation failed at stage '"), where, F.lit("': "), message)).otherwise(
            F.concat(F.lit("Validation failed: "), message)
        ),
    )


def task_outcome(results: DataFrame) -> DataFrame:
    """(task_id, status, error_message) from generation and validation results.

    ``results`` has task_id, generated, generation_error, valid, error, stage,
    errors.  A task is done only if it was generated and found valid; else the
    first message that is not empty explains it.
    """
    done = F.coalesce(F.col("generated") & F.col("valid"), F.lit(False))
    why = F.coalesce(
        F.nullif("generation_error", F.lit("")),
        validation_message(F.col("error"), F.col("stage"), F.col("errors")),
        F.lit("Generation failed"),
    )
    return results.select(
        "task_id", F.when(done, "done").otherwise("error").alias("status"), F.when(~done, why).alias("error_message")
    )
