"""Input views derived from the given tables.

Each is one SELECT in the dialect both engines share; ``{name}`` stands for a
table or another view.
"""

from __future__ import annotations

import re
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame

from tidemill.sources.tables import Tables

VIEWS: dict[str, str] = {}

# Tasks of an ETL service, one per event.
VIEWS["tasks"] = """
SELECT event_id AS id,
       ts AS created_at,
       CASE event_type WHEN 'purchase' THEN 'done' WHEN 'signup' THEN 'done' WHEN 'error' THEN 'error'
                       WHEN 'click' THEN 'pending' ELSE 'processing' END AS status,
       CASE event_id % 3 WHEN 0 THEN 'sql' WHEN 1 THEN 'python' ELSE 'airflow_dag' END AS output_format,
       CASE event_id % 8 WHEN 0 THEN 'scd2' WHEN 1 THEN 'deduplication' WHEN 2 THEN 'incremental'
                         WHEN 3 THEN 'merge' WHEN 4 THEN 'aggregation' WHEN 5 THEN 'archive'
                         WHEN 6 THEN 'full_refresh' END AS etl_pattern,
       CASE WHEN event_type = 'click' THEN NULL ELSE CAST(floor(value * 100) AS BIGINT) END AS generation_time_ms,
       CAST(value AS DECIMAL(18,2)) AS weight
FROM {events}
"""

# One artifact per finished task, two where the event was worth more than 50.
VIEWS["artifacts"] = """
SELECT id * 2 AS id, id AS task_id, output_format AS artifact_type,
       CAST(id % 3 + 1 AS BIGINT) AS attempts, status = 'done' AS is_valid,
       created_at + INTERVAL 1 MINUTE AS created_at
FROM {tasks} WHERE status IN ('done', 'error')
UNION ALL
SELECT id * 2 + 1 AS id, id AS task_id, output_format AS artifact_type,
       CAST(1 AS BIGINT) AS attempts, status = 'done' AS is_valid,
       created_at + INTERVAL 2 MINUTE AS created_at
FROM {tasks} WHERE status IN ('done', 'error') AND weight > 50
"""

# One run per valid artifact.
VIEWS["runs"] = """
SELECT id * 10 AS id, id AS artifact_id, created_at AS started_at,
       CASE WHEN id % 4 = 3 THEN NULL ELSE created_at + INTERVAL 1 SECOND * (id % 600) END AS finished_at,
       CASE id % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'failed' WHEN 2 THEN 'success' END AS state
FROM {artifacts} WHERE is_valid
"""


def _uses(text: str) -> set[str]:
    return set(re.findall(r"\{(\w+)\}", text))


def view(t: Tables, name: str) -> DataFrame:
    """A derived view (or a given table) as a lazy frame."""
    if name not in VIEWS:
        return getattr(t, name)
    parts = {used: view(t, used) for used in _uses(VIEWS[name])}
    return t.spark.sql(VIEWS[name], **parts)


def with_views(*names: str) -> str:
    """The ``WITH`` clause that defines the views ``names`` for the comparison SQL."""
    graph: dict[str, set[str]] = {}

    def visit(name: str) -> None:
        if name in VIEWS and name not in graph:
            graph[name] = {u for u in _uses(VIEWS[name]) if u in VIEWS}
            for used in graph[name]:
                visit(used)

    for name in names:
        visit(name)
    parts = []
    for name in TopologicalSorter(graph).static_order():
        body = VIEWS[name].format(**{u: u for u in _uses(VIEWS[name])})
        parts.append(f"{name} AS ({body})")
    return "WITH " + ",\n".join(parts) + "\n"
