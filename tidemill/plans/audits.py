"""Named audit queries over statements, DAG files, tasks and edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import fixed
from tidemill.operators import audit_dag, audit_sql, findings
from tidemill.plans.derived import VIEWS, view, with_views
from tidemill.plans.registry import query
from tidemill.plans.textjobs import sql_text

SCHEMA = "ws"

# Statements of SQL scripts, one per order line; a script is an order.
VIEWS["script_steps"] = """
SELECT l_orderkey AS script_id, l_linenumber AS step,
       CASE l_partkey % 11
            WHEN 0 THEN 'CREATE TABLE ws.t' || CAST(l_suppkey AS STRING) || ' AS SELECT * FROM ws.s'
            WHEN 1 THEN 'insert into ws.t SELECT * FROM ws.s WHERE d >= :start_date AND k = $1'
            WHEN 2 THEN 'SELECT count(*) FROM ws.t' || CAST(l_suppkey AS STRING)
            WHEN 3 THEN 'WITH a AS (SELECT 1 AS x) SELECT * FROM a'
            WHEN 4 THEN 'UPDATE ws.t SET note = ' || chr(39) || '50%sale at 10:30?' || chr(39)
            WHEN 5 THEN '-- remove old rows' || chr(10) || '/* all' || chr(10) || 'of them */ DELETE FROM ws.t'
            WHEN 6 THEN 'SELECT created_at::DATE FROM ws.t'
            WHEN 7 THEN '   ' || chr(10)
            WHEN 8 THEN 'GRANT SELECT ON ws.t TO reader'
            WHEN 9 THEN '  select * from ws.t where d between %s and %(till)s'
            ELSE 'select ' || CAST(l_quantity AS STRING) END AS statement
FROM {lineitem}
"""

VIEWS["sql_scripts"] = "SELECT o_orderkey AS script_id FROM {orders}"

# Twenty orders make a DAG; each is a task of it.
VIEWS["dag_tasks"] = """
SELECT CAST(floor(o_orderkey / 20) AS BIGINT) AS dag_id,
       't' || CAST(CASE WHEN o_totalprice < 30000 THEN 0 ELSE o_orderkey % 20 END AS STRING) AS task_id,
       CASE o_orderstatus WHEN 'P' THEN 'PythonOperator' ELSE 'PostgresOperator' END AS operator,
       CASE o_custkey % 11
            WHEN 0 THEN 'CREATE TEMPORARY TABLE temp_sums AS SELECT user_id, sum(x) FROM ws.orders GROUP BY user_id'
            WHEN 1 THEN 'INSERT INTO ws.users_agg SELECT * FROM Temp_Sums t JOIN ws.users u ON u.id = t.user_id'
            WHEN 2 THEN 'create temp table if not exists stage_a as select * from public.src; insert into ws.b select * from stage_a'
            WHEN 3 THEN 'WITH recent AS (SELECT * FROM ws.orders), big AS (SELECT * FROM recent) INSERT INTO ws.t1 SELECT * FROM big JOIN recent ON TRUE'
            WHEN 4 THEN 'UPDATE orders SET status = 1'
            WHEN 5 THEN 'INSERT INTO ws.t2 SELECT 1 ON CONFLICT (id) DO UPDATE SET x = excluded.x'
            WHEN 6 THEN 'CREATE TABLE IF NOT EXISTS Daily_' || CAST(o_custkey AS STRING) || ' AS SELECT * FROM stage_a'
            WHEN 7 THEN 'INSERT INTO dwh.t4 SELECT * FROM ws.src' || CAST(o_orderkey AS STRING)
            WHEN 8 THEN 'SELECT 1'
            WHEN 9 THEN ''
            ELSE 'DELETE FROM tmp_x; UPDATE WS.T5 SET y = 2' END AS sql_text
FROM {orders}
"""

# Edges of a DAG: forward only in even DAGs, one permutation of the tasks in odd ones.
VIEWS["dag_edges"] = """
SELECT dag_id, 't' || CAST(i AS STRING) AS src,
       't' || CAST(CASE dag_id % 2 WHEN 0 THEN i + 1 + (i * 7 + dag_id) % 3 ELSE (7 * i + 3 + dag_id) % 20 END AS STRING) AS dst
FROM (SELECT CAST(floor(o_orderkey / 20) AS BIGINT) AS dag_id, o_orderkey % 20 AS i FROM {orders}) AS k
"""

# DAG files: one per DAG of the tasks above and one per part (these have no tasks).
VIEWS["dag_files"] = """
SELECT dag_id,
       CASE dag_id % 9 WHEN 0 THEN NULL WHEN 1 THEN '@daily' WHEN 2 THEN '0 5 * * *' WHEN 3 THEN '@once' WHEN 4 THEN '@fortnightly'
                       WHEN 5 THEN '0 5 *' WHEN 6 THEN '  */5 0 5 * * 1 ' WHEN 7 THEN '@weekly' ELSE 'daily' END AS schedule,
       'import os' || chr(10)
       || CASE dag_id % 5 WHEN 0 THEN 'from airflow.operators.postgres_operator import PostgresOperator' || chr(10)
                          WHEN 1 THEN 'from airflow.operators.python_operator import PythonOperator' || chr(10)
                          ELSE 'from airflow.operators.python import PythonOperator' || chr(10) END
       || CASE dag_id % 7 WHEN 0 THEN 'BaseHook.get_connection(' || chr(34) || 'connection_string' || chr(34) || ')' || chr(10)
                          WHEN 1 THEN 'Password = ' || chr(39) || name || chr(39) || chr(10)
                          WHEN 2 THEN 'url = ' || chr(34) || 'postgresql://u:p@host/db' || chr(34) || '; API_KEY=' || chr(39) || 'k' || chr(39) || chr(10)
                          WHEN 3 THEN 'eval(code); pickle.loads(x)' || chr(10) ELSE '' END
       || CASE dag_id % 6 WHEN 0 THEN '@dag' || chr(10) || 'def flow():' || chr(10)
                          WHEN 1 THEN 'with DAG (dag_id=1) as dag:' || chr(10)
                          WHEN 2 THEN 'MYDAG(1)' || chr(10) ELSE 'dag = DAG(dag_id=1)' || chr(10) END
       || CASE dag_id % 4 WHEN 0 THEN 't = PostgresOperator(task_id=1, postgres_conn_id=' || chr(39) || 'postgres_default' || chr(39) || ')'
                          WHEN 1 THEN 't = PostgresOperator(task_id=1, postgres_conn_id=' || chr(39) || 'other' || chr(39) || ')'
                          WHEN 2 THEN '@task' || chr(10) || 'def load(): pass' ELSE 'pass  # ' || name END AS code
FROM (
    SELECT CAST(floor(o_orderkey / 20) AS BIGINT) AS dag_id, min(o_orderpriority) AS name FROM {orders}
    GROUP BY CAST(floor(o_orderkey / 20) AS BIGINT)
    UNION ALL
    SELECT p_partkey + 1000000000 AS dag_id, p_name AS name FROM {part}
) AS d
"""


def _finding(id_col, check, stage, message, item="'0'", severity="'error'") -> str:
    stage = "CAST(NULL AS VARCHAR)" if stage is None else f"'{stage}'"
    return (
        f"SELECT {id_col} AS id, {findings.CHECKS[check]} AS check_no, '{check}' AS check_name, {item} AS item, "
        f"{stage} AS stage, {severity} AS severity, {message} AS message"
    )


def _flags(source, id_col, check, stage, tests) -> str:
    return " UNION ALL ".join(
        _finding(id_col, check, stage, sql_text(message), f"'{n:02d}'") + f" FROM {source} WHERE {condition}"
        for n, (condition, message) in enumerate(tests)
    )


def _contains_any(expr, tokens) -> str:
    return "(" + " OR ".join(f"contains({expr}, {sql_text(t)})" for t in tokens) + ")"


def _matches_any(expr, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({expr}, {sql_text(p)})" for p in patterns) + ")"


_BARE = "replace(regexp_replace(statement, '''[^'']*''', '''''', 'g'), '::', ' ')"


@query(
    "audit_placeholders",
    with_views("script_steps")
    + f"""
    SELECT script_id, bool_or({_matches_any('statement', fixed.PLACEHOLDERS)}) AS literal_hit,
           bool_or({_matches_any(_BARE, fixed.PLACEHOLDERS)}) AS hit
    FROM script_steps GROUP BY script_id
    """,
)
def audit_placeholders(t):
    """Scripts with placeholders: anywhere in the text, and outside quoted strings and casts."""
    steps = view(t, "script_steps")
    statement = F.col("statement")
    return steps.groupBy("script_id").agg(
        F.bool_or(audit_sql.has_placeholder(statement, literal=True)).alias("literal_hit"),
        F.bool_or(audit_sql.has_placeholder(statement)).alias("hit"),
    )


_KINDS = (
    with_views("script_steps", "sql_scripts")
    + rf"""
    , worded AS (SELECT *, upper(regexp_extract(statement, '^\s*(?:--[^\n]*\n\s*|/\*.*?\*/\s*)*([A-Za-z]+)', 1, 's')) AS word FROM script_steps)
    , kinds AS (
        SELECT script_id, step, statement, CASE WHEN word = 'WITH' THEN 'SELECT'
               WHEN word IN ({', '.join(f"'{k}'" for k in fixed.STATEMENT_KINDS)}) THEN word ELSE 'UNKNOWN' END AS kind FROM worded)
    """
)


@query("audit_statement_kinds", _KINDS + "SELECT script_id, step, kind FROM kinds")
def audit_statement_kinds(t):
    return audit_sql.statement_kinds(view(t, "script_steps"))


@query(
    "audit_materializing",
    _KINDS
    + f"""
    , judged AS (
        SELECT s.script_id, k.only_select, k.changes FROM sql_scripts s LEFT JOIN (
            SELECT script_id, bool_and(kind = 'SELECT') AS only_select,
                   bool_or(kind IN ({', '.join(f"'{k}'" for k in fixed.MATERIALIZING)})) AS changes
            FROM kinds WHERE regexp_matches(statement, '\\S') GROUP BY script_id) k USING (script_id))
    {_finding('script_id', 'empty', 'syntax', sql_text(fixed.EMPTY_SCRIPT))} FROM judged WHERE changes IS NULL
    UNION ALL {_finding('script_id', 'select_only', 'logic', sql_text(fixed.SELECT_ONLY))} FROM judged WHERE only_select
    UNION ALL {_finding('script_id', 'not_materializing', 'logic', sql_text(fixed.NOT_MATERIALIZING))} FROM judged
    WHERE NOT only_select AND NOT changes
    """,
)
def audit_materializing(t):
    return audit_sql.materializing(view(t, "sql_scripts"), view(t, "script_steps"))


@query(
    "audit_script_verdicts",
    _KINDS
    + f"""
    , judged AS (
        SELECT s.script_id, k.filled, k.held, k.only_select, k.changes FROM sql_scripts s LEFT JOIN (
            SELECT script_id, count(*) FILTER (regexp_matches(statement, '\\S')) AS filled,
                   bool_or({_matches_any(_BARE, fixed.PLACEHOLDERS)}) AS held,
                   bool_and(kind = 'SELECT') FILTER (regexp_matches(statement, '\\S')) AS only_select,
                   bool_or(kind IN ({', '.join(f"'{k}'" for k in fixed.MATERIALIZING)})) AS changes
            FROM kinds GROUP BY script_id) k USING (script_id))
    , decided AS (
        SELECT script_id, CASE WHEN coalesce(filled, 0) = 0 THEN {sql_text(fixed.EMPTY_SCRIPT)}
               WHEN held THEN {sql_text(fixed.PLACEHOLDER_ERROR)}
               WHEN only_select THEN {sql_text(fixed.SELECT_ONLY)}
               WHEN NOT changes THEN {sql_text(fixed.NOT_MATERIALIZING)} END AS error FROM judged)
    SELECT script_id, error IS NULL AS valid,
           CASE WHEN error = {sql_text(fixed.EMPTY_SCRIPT)} THEN 'syntax' WHEN error IS NOT NULL THEN 'logic' END AS stage,
           error FROM decided
    """,
)
def audit_script_verdicts(t):
    """One verdict per script: the first check it fails, or that it is valid."""
    return audit_sql.script_verdicts(view(t, "sql_scripts"), view(t, "script_steps"))


@query(
    "audit_data_reads",
    with_views("scripts")
    + _flags("scripts", "script_id", "data_reads", "logic",
             [(f"NOT {_contains_any('lower(code)', [p.lower() for p in fixed.DATA_READS])}", fixed.NO_DATA_READ)]),
)
def audit_data_reads(t):
    return audit_sql.data_reads(view(t, "scripts"))


def _forbidden(source, id_col):
    return _flags(source, id_col, "forbidden", "security", [(f"contains(code, {sql_text(p)})", m) for p, m in fixed.FORBIDDEN])


def _secrets(source, id_col):
    tests = [(f"regexp_matches(code, {sql_text(p)}, 'i')", fixed.SECRET_ERROR) for p in fixed.SECRETS]
    return _flags(source, id_col, "secrets", "security", tests)


def _deprecated(source, id_col):
    tests = [
        (rf"list_contains(regexp_extract_all(code, '(?m)^\s*from\s+(\S+)\s+import\b', 1), '{module}')",
         f"Deprecated import '{module}'. {advice}")
        for module, advice in fixed.DEPRECATED_IMPORTS.items()
    ]
    return _flags(source, id_col, "deprecated_imports", "compatibility", tests)


@query("audit_forbidden", with_views("scripts") + _forbidden("scripts", "script_id"))
def audit_forbidden(t):
    return audit_dag.forbidden(view(t, "scripts"), "script_id")


@query("audit_secrets", with_views("scripts") + _secrets("scripts", "script_id"))
def audit_secrets(t):
    return audit_dag.secrets(view(t, "scripts"), "script_id")


@query("audit_deprecated_imports", with_views("scripts") + _deprecated("scripts", "script_id"))
def audit_deprecated_imports(t):
    return audit_dag.deprecated_imports(view(t, "scripts"), "script_id")


_MARKERS = (
    _flags("dag_files", "dag_id", "dag_marker", "structure", [(f"NOT {_matches_any('code', fixed.DAG_MARKERS)}", fixed.NO_DAG)])
    + " UNION ALL "
    + _flags("dag_files", "dag_id", "task_marker", "structure", [(f"NOT {_matches_any('code', fixed.TASK_MARKERS)}", fixed.NO_TASK)])
)


@query("audit_dag_markers", with_views("dag_files") + _MARKERS)
def audit_dag_markers(t):
    return audit_dag.dag_markers(view(t, "dag_files"), "dag_id")


_CONN_ID = _flags(
    "dag_files", "dag_id", "conn_id", "logic",
    [(f"contains(code, 'PostgresOperator') AND NOT {_contains_any('code', fixed.CONNECTION_IDS)}", fixed.CONNECTION_ERROR)],
)


@query("audit_conn_id", with_views("dag_files") + _CONN_ID)
def audit_conn_id(t):
    return audit_dag.connection_ids(view(t, "dag_files"), "dag_id")


_PRESETS = ", ".join(f"'{p}'" for p in fixed.SCHEDULE_PRESETS)
_FIELDS = r"len(list_filter(regexp_split_to_array(schedule, '\s+'), lambda f: f <> ''))"
_SCHEDULES = (
    _finding(
        "dag_id", "schedule", "logic", "message",
        severity="CASE WHEN message LIKE 'Invalid cron%' THEN 'error' ELSE 'warning' END",
    )
    + f"""
    FROM (SELECT dag_id, CASE WHEN schedule IS NULL THEN '{fixed.NO_SCHEDULE}' WHEN schedule = '@once' THEN '{fixed.RUNS_ONCE}'
                 WHEN schedule NOT LIKE '@%' AND {_FIELDS} NOT IN (5, 6) THEN 'Invalid cron expression: ' || schedule
                 WHEN schedule LIKE '@%' AND schedule NOT IN ({_PRESETS}) THEN 'Unknown Airflow preset schedule: ' || schedule
                 END AS message FROM dag_files) WHERE message IS NOT NULL
    """
)


@query("audit_schedules", with_views("dag_files") + _SCHEDULES)
def audit_schedules(t):
    return audit_dag.schedules(view(t, "dag_files"))


_DUPLICATES = (
    _finding("dag_id", "duplicate_tasks", "logic", "'Duplicate task_id values detected: [''' || task_id || ''']'", "task_id")
    + " FROM (SELECT dag_id, task_id FROM dag_tasks GROUP BY dag_id, task_id HAVING count(*) > 1)"
)


@query("audit_duplicate_tasks", with_views("dag_tasks") + _DUPLICATES)
def audit_duplicate_tasks(t):
    return audit_dag.duplicate_tasks(view(t, "dag_tasks"))


_NO_DEPS = (
    _finding("dag_id", "no_deps", None, sql_text(fixed.NO_DEPENDENCIES), severity="'warning'")
    + " FROM dag_files WHERE dag_id NOT IN (SELECT dag_id FROM dag_edges)"
)


@query("audit_no_deps", with_views("dag_files", "dag_edges") + _NO_DEPS)
def audit_no_deps(t):
    return audit_dag.no_dependencies(view(t, "dag_files"), view(t, "dag_edges"))


# A node on a cycle reaches itself.
_CYCLES = (
    "SELECT * FROM (WITH RECURSIVE reach(dag_id, src, dst) AS (SELECT dag_id, src, dst FROM dag_edges UNION "
    "SELECT r.dag_id, r.src, e.dst FROM reach r JOIN dag_edges e ON e.dag_id = r.dag_id AND e.src = r.dst) "
    + _finding("dag_id", "cycles", "logic", f"'{fixed.CYCLE_ERROR}'")
    + " FROM (SELECT DISTINCT dag_id FROM reach WHERE src = dst))"
)


@query("audit_cycles", with_views("dag_edges") + _CYCLES)
def audit_cycles(t):
    return audit_dag.cycles(view(t, "dag_edges"))


@query(
    "audit_cycle_components",
    with_views("dag_edges").replace("WITH ", "WITH RECURSIVE ", 1)
    + """
    , reach AS (
        SELECT dag_id, src, dst FROM dag_edges UNION SELECT r.dag_id, r.src, e.dst FROM reach r JOIN dag_edges e ON r.dag_id = e.dag_id AND r.dst = e.src)
    SELECT a.dag_id, a.src AS task_id, min(a.dst) AS component
    FROM reach a JOIN reach b ON a.dag_id = b.dag_id AND a.src = b.dst AND a.dst = b.src GROUP BY a.dag_id, a.src
    """,
)
def audit_cycle_components(t):
    """Tasks on a circle, and the smallest task of the component they form."""
    return audit_dag.cycle_components(view(t, "dag_edges"))


_SQL_TASKS = "(SELECT * FROM dag_tasks WHERE operator = 'PostgresOperator' AND task_id <> '' AND sql_text <> '')"


def _names(pattern) -> str:
    return f"SELECT DISTINCT dag_id, task_id, lower(unnest(regexp_extract_all(sql_text, {sql_text(pattern)}, 1, 'i'))) AS table_name FROM {_SQL_TASKS}"


@query("sql_table_refs", with_views("dag_tasks") + _names(fixed.TABLE_USE))
def sql_table_refs(t):
    return audit_sql.table_refs(view(t, "dag_tasks"))


@query("sql_temp_tables", with_views("dag_tasks") + _names(fixed.TEMP_TABLE))
def sql_temp_tables(t):
    return audit_sql.temp_tables(view(t, "dag_tasks"))


_CROSS = f"""
    SELECT r.dag_id, r.task_id AS consumer, r.table_name, count(*) AS producers,
           CASE WHEN bool_or(m.task_id = w.first_maker) THEN w.first_maker ELSE w.last_maker END AS producer
    FROM ({_names(fixed.TABLE_USE)}) r
    JOIN ({_names(fixed.TEMP_TABLE)}) m ON m.dag_id = r.dag_id AND m.table_name = r.table_name AND m.task_id <> r.task_id
    JOIN (SELECT dag_id, table_name, min(task_id) AS first_maker, max(task_id) AS last_maker
          FROM ({_names(fixed.TEMP_TABLE)}) GROUP BY 1, 2) w ON w.dag_id = r.dag_id AND w.table_name = r.table_name
    GROUP BY r.dag_id, r.task_id, r.table_name, w.first_maker, w.last_maker
"""
_CROSS_FINDINGS = (
    _finding(
        "dag_id", "cross_task_temp", "runtime",
        "'Task ''' || consumer || ''' reads temporary table(s) [''' || table_name || '''] created in task ''' || producer || "
        "'''. Temporary tables are session-scoped and cannot be shared across separate Airflow tasks.'",
        "concat_ws(' ', producer, consumer, table_name)",
    )
    + f" FROM ({_CROSS})"
)


@query("audit_cross_task_temp", with_views("dag_tasks") + _CROSS)
def audit_cross_task_temp(t):
    return audit_sql.cross_task_temp(view(t, "dag_tasks"))


_PRODUCERS = f"""
    SELECT DISTINCT m.dag_id, m.table_name, m.task_id AS producer
    FROM ({_names(fixed.TEMP_TABLE)}) m
    JOIN ({_names(fixed.TABLE_USE)}) r ON r.dag_id = m.dag_id AND r.table_name = m.table_name AND r.task_id <> m.task_id
"""


@query("audit_shared_temp_producers", with_views("dag_tasks") + _PRODUCERS)
def audit_shared_temp_producers(t):
    """All producers of the tables in ``audit_cross_task_temp``, which counts them and names one."""
    return audit_sql.shared_temp_producers(view(t, "dag_tasks"))


_REFS = f"""
    SELECT dag_id, task_id, unnest(range(len(ops))) AS position, lower(unnest(ops)) AS operation, unnest(ids) AS identifier, ctes
    FROM (SELECT dag_id, task_id, regexp_extract_all(sql_text, {sql_text(fixed.TABLE_REFERENCE)}, 1, 'i') AS ops,
                 regexp_extract_all(sql_text, {sql_text(fixed.TABLE_REFERENCE)}, 2, 'i') AS ids,
                 list_concat(regexp_extract_all(lower(sql_text), '\\bwith\\s+([a-z_][a-z0-9_]*)\\s+as\\b', 1),
                             regexp_extract_all(lower(sql_text), ',\\s*([a-z_][a-z0-9_]*)\\s+as\\s*\\(', 1)) AS ctes
          FROM {_SQL_TASKS})
"""
_QUALIFIED = (
    _finding(
        "dag_id", "schema_qualified", "logic",
        "'Task ''' || task_id || ''' uses table ''' || identifier || ''' in ' || operation || CASE WHEN contains(identifier, '.') "
        f"THEN ' with schema ''' || lower(split_part(identifier, '.', 1)) || '''. Expected schema ''{SCHEMA}''.' "
        f"ELSE ' without schema qualification. Use explicit names like ''{SCHEMA}.' || identifier || '''.' END",
        "task_id || ' ' || lpad(CAST(position AS VARCHAR), 6, '0')",
    )
    + f"""
    FROM ({_REFS}) WHERE CASE WHEN contains(identifier, '.') THEN lower(split_part(identifier, '.', 1)) <> '{SCHEMA}'
        ELSE NOT list_contains(ctes, lower(identifier)) AND lower(identifier) <> 'excluded'
             AND NOT starts_with(lower(identifier), 'temp_') AND NOT starts_with(lower(identifier), 'tmp_') END
    """
)


@query("audit_schema_qualified", with_views("dag_tasks") + _QUALIFIED)
def audit_schema_qualified(t):
    return audit_sql.schema_findings(view(t, "dag_tasks"), SCHEMA)


_ALL = " UNION ALL ".join(
    f"(SELECT * FROM ({part}))"
    for part in (
        _MARKERS, _forbidden("dag_files", "dag_id"), _secrets("dag_files", "dag_id"), _deprecated("dag_files", "dag_id"),
        _DUPLICATES, _CROSS_FINDINGS, _QUALIFIED, _CONN_ID, _SCHEDULES, _CYCLES, _NO_DEPS,
    )
)


@query(
    "audit_summary",
    with_views("dag_files", "dag_tasks", "dag_edges")
    + f"""
    , found AS ({_ALL})
    , ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY check_no, item, message) AS rn FROM found WHERE severity = 'error')
    , counted AS (
        SELECT id, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warns,
               count(*) FILTER (WHERE stage = 'structure') AS structural
        FROM found GROUP BY id)
    , said AS (SELECT id, string_agg(message, ' ' ORDER BY check_no, message) AS warnings
        FROM (SELECT DISTINCT id, check_no, message FROM found WHERE severity = 'warning') GROUP BY id)
    SELECT dag_id AS id, r.id IS NULL AS valid, r.stage, r.message AS error,
           coalesce(CASE WHEN structural > 0 THEN structural ELSE errors END, 0) AS error_count,
           CASE WHEN structural > 0 THEN 0 ELSE coalesce(warns, 0) END AS warning_count,
           CASE WHEN structural > 0 THEN '' ELSE coalesce(warnings, '') END AS warnings
    FROM dag_files d LEFT JOIN counted c ON c.id = d.dag_id LEFT JOIN said w ON w.id = d.dag_id LEFT JOIN ranked r ON r.id = d.dag_id AND r.rn = 1
    """,
)
def audit_summary(t):
    """All checks of a DAG: files, tasks and edges together."""
    files, tasks, edges = view(t, "dag_files"), view(t, "dag_tasks"), view(t, "dag_edges")
    found = findings.union(
        audit_dag.file_findings(files, "dag_id"),
        audit_dag.duplicate_tasks(tasks),
        audit_sql.cross_task_temp_findings(tasks),
        audit_sql.schema_findings(tasks, SCHEMA),
        audit_dag.cycles(edges),
        audit_dag.no_dependencies(files, edges),
    )
    return findings.roll_up(files.select(F.col("dag_id").alias("id")), found)
