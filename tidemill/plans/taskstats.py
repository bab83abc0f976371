"""Named queries on the task catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions.scalars import scalar_literal
from tidemill.operators import taskstats
from tidemill.plans.derived import VIEWS, view, with_views
from tidemill.plans.registry import query

# Results of generation and validation, one per order line.
VIEWS["results"] = """
SELECT l_orderkey * 8 + l_linenumber AS task_id,
       CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN FALSE ELSE TRUE END AS generated,
       CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' AND l_discount > 0.05 THEN 'No code in the answer'
            WHEN l_returnflag = 'R' THEN '' END AS generation_error,
       CASE WHEN l_returnflag = 'N' THEN TRUE ELSE FALSE END AS valid,
       CASE WHEN l_tax > 0.06 THEN 'column ' || CAST(l_partkey AS STRING) || ' is unknown' WHEN l_tax > 0.03 THEN '' END AS error,
       CASE WHEN l_quantity > 25 THEN 'logic' WHEN l_quantity > 10 THEN '' END AS stage,
       CASE WHEN l_discount > 0.02 THEN 'table ' || CAST(l_suppkey AS STRING) || ' is missing' END AS first_error,
       CASE WHEN l_discount > 0.07 THEN 'security' END AS first_stage
FROM {lineitem}
"""


@query(
    "stats_overview",
    with_views("tasks", "artifacts")
    + """
    SELECT t.*, a.avg_attempts FROM (
        SELECT count(*) AS total_tasks, count(*) FILTER (WHERE status = 'done') AS done_tasks,
               count(*) FILTER (WHERE status = 'error') AS error_tasks,
               count(*) FILTER (WHERE status IN ('pending', 'processing')) AS pending_tasks,
               round_even(count(*) FILTER (WHERE status = 'done') / count(*) * 100, 1) AS success_rate,
               round_even(CAST(sum(generation_time_ms) AS DOUBLE) / count(generation_time_ms), 1) AS avg_generation_time_ms
        FROM tasks) t,
        (SELECT round_even(CAST(sum(attempts) AS DOUBLE) / count(attempts), 2) AS avg_attempts FROM artifacts) a
    """,
)
def stats_overview(t):
    return taskstats.overview(view(t, "tasks"), view(t, "artifacts"))


@query(
    "stats_patterns",
    with_views("tasks") + "SELECT etl_pattern, count(*) AS tasks FROM tasks WHERE etl_pattern IS NOT NULL GROUP BY 1",
)
def stats_patterns(t):
    return taskstats.per_pattern(view(t, "tasks"))


@query("stats_formats", with_views("tasks") + "SELECT output_format, count(*) AS tasks FROM tasks GROUP BY 1")
def stats_formats(t):
    return taskstats.per_format(view(t, "tasks"))


_DETAIL = """
    SELECT t.id, t.created_at, t.status, t.output_format, t.etl_pattern, t.generation_time_ms, t.weight,
           a.id AS artifact_id, a.artifact_type, a.attempts, a.is_valid, a.created_at AS artifact_created_at
"""


@query(
    "tasks_recent",
    with_views("tasks", "artifacts")
    + _DETAIL
    + "FROM (SELECT * FROM tasks ORDER BY created_at DESC, id DESC LIMIT 50) t LEFT JOIN artifacts a ON a.task_id = t.id",
)
def tasks_recent(t):
    return taskstats.recent_tasks(view(t, "tasks"), view(t, "artifacts"))


@query(
    "task_detail",
    with_views("tasks", "artifacts")
    + _DETAIL
    + """FROM tasks t LEFT JOIN artifacts a ON a.task_id = t.id
         WHERE t.id = (SELECT max(id) FROM tasks WHERE status = 'done' AND weight > 50)""",
)
def task_detail(t):
    """The last finished task that has two artifacts."""
    tasks = view(t, "tasks")
    last = scalar_literal(tasks.filter("status = 'done' AND weight > 50"), F.max("id"))
    return taskstats.task_detail(tasks, view(t, "artifacts"), last)


_RUN_STATE = """
    SELECT id, artifact_id, started_at, finished_at, state,
           CASE WHEN state = 'success' THEN 'success' ELSE 'error' END AS status,
           date_diff('millisecond', started_at, finished_at) AS duration_ms
    FROM runs
"""


@query("run_log", with_views("runs") + _RUN_STATE)
def run_log(t):
    return taskstats.run_log(view(t, "runs"))


@query(
    "run_log_of_artifact",
    with_views("runs")
    + _RUN_STATE
    + " WHERE artifact_id = (SELECT artifact_id FROM runs ORDER BY started_at DESC, id DESC LIMIT 1)",
)
def run_log_of_artifact(t):
    """Runs of the artifact that ran last."""
    runs = view(t, "runs")
    last = runs.orderBy(F.desc("started_at"), F.desc("id")).select("artifact_id").first()
    return taskstats.run_log(runs, last["artifact_id"])


@query(
    "run_state",
    with_views("runs")
    + f"""
    SELECT status, count(*) AS runs, count(duration_ms) AS ended, sum(duration_ms)::BIGINT AS total_ms, max(duration_ms) AS longest_ms
    FROM ({_RUN_STATE}) GROUP BY status
    """,
)
def run_state(t):
    """Runs per log status with their times."""
    return taskstats.with_run_state(view(t, "runs")).groupBy("status").agg(
        F.count(F.lit(1)).alias("runs"),
        F.count("duration_ms").alias("ended"),
        F.sum("duration_ms").alias("total_ms"),
        F.max("duration_ms").alias("longest_ms"),
    )


@query(
    "task_outcome",
    with_views("results")
    + """
    , told AS (
        SELECT *, CASE WHEN nullif(error, '') IS NOT NULL THEN error ELSE first_error END AS message,
               CASE WHEN nullif(error, '') IS NOT NULL THEN nullif(stage, '')
                    ELSE coalesce(nullif(stage, ''), CASE WHEN first_error IS NOT NULL THEN first_stage END) END AS place
        FROM results)
    SELECT task_id, CASE WHEN generated AND valid THEN 'done' ELSE 'error' END AS status,
           CASE WHEN generated AND valid THEN NULL
                WHEN nullif(generation_error, '') IS NOT NULL THEN generation_error
                WHEN message IS NULL THEN 'Generation failed'
                WHEN place IS NULL THEN 'Validation failed: ' || message
                ELSE 'Validation failed at stage ' || chr(39) || place || chr(39) || ': ' || message END AS error_message
    FROM told
    """,
)
def task_outcome(t):
    first = F.struct(F.col("first_stage").alias("stage"), F.col("first_error").alias("error"))
    errors = F.when(F.col("first_error").isNotNull(), F.array(first)).otherwise(F.array().cast("array<struct<stage:string,error:string>>"))
    return taskstats.task_outcome(view(t, "results").withColumn("errors", errors))
