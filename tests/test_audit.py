import random

import pytest
from pyspark.sql import functions as F

from tidemill.functions import fixed
from tidemill.operators import audit_dag, audit_sql, findings

EDGES = "dag_id long, src string, dst string"


def cyclic_by_hand(edges):
    after = {}
    for dag, src, dst in edges:
        after.setdefault((dag, src), set()).add((dag, dst))
    out = set()
    for start in after:
        seen, todo = set(), list(after[start])
        while todo:
            node = todo.pop()
            if node == start:
                out.add(start[0])
                break
            if node not in seen:
                seen.add(node)
                todo.extend(after.get(node, ()))
    return out


def found_cycles(spark, edges):
    return {r["id"] for r in audit_dag.cycles(spark.createDataFrame(edges, EDGES)).collect()}


def test_cycles_in_random_graphs(spark):
    rng = random.Random(7)
    edges = [
        (dag, f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for dag in range(40) for _ in range(rng.randrange(2, 14))
    ]
    assert found_cycles(spark, edges) == cyclic_by_hand(edges)


def test_long_chains_are_shortened(spark):
    chain = [(1, f"c{i}", f"c{i + 1}") for i in range(400)]
    ring = [(2, f"r{i}", f"r{(i + 1) % 60}") for i in range(60)]
    tail = [(3, f"t{i}", f"t{i + 1}") for i in range(50)] + [(3, "t50", "t48")]
    assert found_cycles(spark, chain + ring + tail) == {2, 3}


def test_self_loops_repeats_and_nothing(spark):
    assert found_cycles(spark, [(1, "a", "a"), (2, "a", "b"), (2, "a", "b")]) == {1}
    assert found_cycles(spark, [(1, "a", "b")]) == set()
    assert audit_dag.cycles(spark.createDataFrame([], EDGES)).count() == 0


def test_no_dependencies(spark):
    dags = spark.createDataFrame([(1,), (2,)], "dag_id long")
    edges = spark.createDataFrame([(1, "a", "b")], EDGES)
    got = audit_dag.no_dependencies(dags, edges).collect()
    assert [(r["id"], r["severity"], r["message"]) for r in got] == [(2, "warning", "No task dependencies detected.")]


@pytest.mark.parametrize(
    "sql,literal,default",
    [
        ("SELECT 1 WHERE d BETWEEN %s AND %s", True, True),
        ("SELECT :start_date", True, True),
        ("SELECT %(name)s", True, True),
        ("SELECT $1", True, True),
        ("SELECT ?", True, True),
        ("SELECT x::DATE", True, False),
        ("SELECT '50%sale' AS a, 'a:b' AS b", True, False),
        ("SELECT 1", False, False),
    ],
)
def test_placeholders(spark, sql, literal, default):
    df = spark.createDataFrame([(sql,)], "s string")
    got = df.select(audit_sql.has_placeholder(F.col("s"), True), audit_sql.has_placeholder(F.col("s"))).first()
    assert tuple(got) == (literal, default)


def test_statement_kinds(spark):
    cases = {
        "select 1": "SELECT", "  WITH a AS (SELECT 1) SELECT 1": "SELECT", "-- x\n/* y\n */ Delete from t": "DELETE",
        "CREATE OR REPLACE TABLE t": "CREATE", "GRANT x": "UNKNOWN", "": "UNKNOWN", "truncate t": "TRUNCATE",
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "s string, want string")
    assert df.filter(audit_sql.statement_kind(F.col("s")) != F.col("want")).count() == 0


def test_scripts_must_materialize(spark):
    scripts = spark.createDataFrame([(i,) for i in range(1, 6)], "script_id long")
    steps = spark.createDataFrame(
        [(1, 1, "CREATE TABLE t AS SELECT 1"), (1, 2, "SELECT * FROM t"), (2, 1, "SELECT 1"), (3, 1, "GRANT x TO y"),
         (3, 2, "SELECT 1"), (4, 1, "  \n ")],
        "script_id long, step int, statement string",
    )
    got = {r["id"]: (r["check_name"], r["stage"]) for r in audit_sql.materializing(scripts, steps).collect()}
    assert got == {
        2: ("select_only", "logic"), 3: ("not_materializing", "logic"), 4: ("empty", "syntax"), 5: ("empty", "syntax"),
    }


TASKS = "dag_id long, task_id string, operator string, sql_text string"


def test_temporary_tables_of_other_tasks(spark):
    tasks = spark.createDataFrame(
        [
            (1, "make", "PostgresOperator", "CREATE TEMPORARY TABLE temp_sums AS SELECT 1 FROM orders"),
            (1, "use", "PostgresOperator", "INSERT INTO agg SELECT * FROM Temp_Sums t"),
            (1, "note", "PythonOperator", "SELECT * FROM temp_sums"),
            (2, "use", "PostgresOperator", "SELECT * FROM temp_sums"),
            (3, "a", "PostgresOperator", "create temp table if not exists x as select 1; select * from x"),
            (3, "b", "PostgresOperator", "create temp table x as select 1; select * from x"),
        ],
        TASKS,
    )
    got = sorted(tuple(r) for r in audit_sql.cross_task_temp(tasks).collect())
    assert got == [(1, "use", "temp_sums", 1, "make"), (3, "a", "x", 1, "b"), (3, "b", "x", 1, "a")]
    message = audit_sql.cross_task_temp_findings(tasks.filter("dag_id = 1")).first()["message"]
    assert "'use' reads temporary table(s) ['temp_sums'] created in task 'make'" in message


def test_a_temporary_table_all_tasks_share_gives_one_row_per_task(spark):
    tasks = spark.range(300).selectExpr(
        "1L AS dag_id", "concat('t', id) AS task_id", "'PostgresOperator' AS operator",
        "'create temp table shared as select 1; select * from shared' AS sql_text",
    )
    got = audit_sql.cross_task_temp(tasks).collect()
    assert len(got) == 300 and all(r["producers"] == 299 and r["producer"] != r["consumer"] for r in got)


def test_schema_qualification(spark):
    sql = (
        "WITH a AS (SELECT * FROM raw.x), b AS (SELECT * FROM a) INSERT INTO ws.t SELECT * FROM b JOIN orders ON TRUE "
        "JOIN tmp_z ON TRUE"
    )
    tasks = spark.createDataFrame([(1, "t", "PostgresOperator", sql)], TASKS)
    got = [(r["operation"], r["identifier"], r["problem"]) for r in audit_sql.schema_references(tasks, "ws").collect()]
    assert got == [("from", "raw.x", "other schema"), ("join", "orders", "no schema")]
    first_only = audit_sql.schema_references(tasks, "ws", extra_ctes=False).count()
    assert first_only == 3
    messages = [r["message"] for r in audit_sql.schema_findings(tasks, "ws").orderBy("item").collect()]
    assert messages == [
        "Task 't' uses table 'raw.x' in from with schema 'raw'. Expected schema 'ws'.",
        "Task 't' uses table 'orders' in join without schema qualification. Use explicit names like 'ws.orders'.",
    ]


def test_texts_of_dag_files(spark):
    files = spark.createDataFrame(
        [
            (1, "with DAG(x) as dag:\n  PostgresOperator(postgres_conn_id='custom')\nVariable.get('connection_string')"),
            (2, "dag = DAG(x)\n@task\ndef f(): pass\npassword = 'p'\nAPI_KEY=\"k\""),
            (3, "print(1)"),
            (4, "from airflow.operators.postgres_operator import PostgresOperator\nDAG()\nEmptyOperator()"),
        ],
        "dag_id long, code string",
    )
    forbidden = audit_dag.forbidden(files, "dag_id").collect()
    assert [(r["id"], r["stage"]) for r in forbidden] == [(1, "security")]
    assert audit_dag.secrets(files, "dag_id").filter("id = 2").count() == 2
    markers = {(r["id"], r["check_name"]) for r in audit_dag.dag_markers(files, "dag_id").collect()}
    assert markers == {(3, "dag_marker"), (3, "task_marker")}
    assert [r["id"] for r in audit_dag.connection_ids(files, "dag_id").orderBy("id").collect()] == [1, 4]
    deprecated = audit_dag.deprecated_imports(files, "dag_id").collect()
    assert [(r["id"], r["stage"]) for r in deprecated] == [(4, "compatibility")]
    assert "Deprecated import" in deprecated[0]["message"]


def test_duplicate_tasks(spark):
    tasks = spark.createDataFrame([(1, "a", "", ""), (1, "a", "", ""), (1, "b", "", ""), (2, "a", "", "")], TASKS)
    got = audit_dag.duplicate_tasks(tasks).collect()
    assert [(r["id"], r["message"]) for r in got] == [(1, "Duplicate task_id values detected: ['a']")]


@pytest.mark.parametrize(
    "schedule,outcome",
    [
        ("@daily", None), ("0 5 * * *", None), (" 0 5 * * * 1 ", None),
        ("0 5 *", ("error", "Invalid cron expression: 0 5 *")),
        ("@once", ("warning", "DAG runs only once.")),
        (None, ("warning", "DAG has no schedule defined.")),
        ("@never", ("warning", "Unknown Airflow preset schedule: @never")),
    ],
)
def test_schedules(spark, schedule, outcome):
    dags = spark.createDataFrame([(1, schedule)], "dag_id long, schedule string")
    got = audit_dag.schedules(dags).collect()
    assert [(r["severity"], r["message"]) for r in got] == ([] if outcome is None else [outcome])


def test_roll_up(spark):
    def one(i, check, stage, message, severity="error", item="0"):
        return (i, findings.CHECKS[check], check, item, stage, severity, message)

    found = spark.createDataFrame(
        [
            one(1, "conn_id", "logic", "c"), one(1, "forbidden", "security", "f2", item="02"),
            one(1, "forbidden", "security", "f1", item="01"), one(1, "no_deps", None, "w", "warning"),
            one(2, "schedule", "logic", "s", "warning"), one(2, "no_deps", None, "w", "warning"),
            one(3, "dag_marker", "structure", "d"), one(3, "secrets", "security", "x"),
        ],
        "id long, check_no int, check_name string, item string, stage string, severity string, message string",
    )
    subjects = spark.range(1, 5).toDF("id")
    got = {r["id"]: tuple(r)[1:] for r in findings.roll_up(subjects, found).collect()}
    assert got == {
        1: (False, "security", "f1", 3, 1, "w"),
        2: (True, None, None, 0, 2, "s w"),
        3: (False, "structure", "d", 1, 0, ""),
        4: (True, None, None, 0, 0, ""),
    }


def test_every_producer_of_a_shared_table_is_a_row(spark):
    make, read = "CREATE TEMP TABLE t_x AS SELECT 1", "SELECT * FROM t_x"
    rows = [(1, task, make) for task in "abc"] + [(1, "r", read), (2, "a", f"{make}; {read}"), (3, "a", f"{make}; {read}"), (3, "b", f"{make}; {read}")]
    tasks = spark.createDataFrame([(dag, task, "PostgresOperator", sql) for dag, task, sql in rows], "dag_id long, task_id string, operator string, sql_text string")
    got = sorted(tuple(r) for r in audit_sql.shared_temp_producers(tasks).collect())
    assert got == [(1, "t_x", "a"), (1, "t_x", "b"), (1, "t_x", "c"), (3, "t_x", "a"), (3, "t_x", "b")]


def test_every_warning_is_told(spark):
    said = [(1, "schedule", "b"), (1, "schedule", "a"), (1, "schedule", "a"), (1, "no_deps", "0"), (2, "conn_id", "late")]
    rows = [(i, findings.CHECKS[check], check, "0", "logic", "warning", message) for i, check, message in said]
    found = spark.createDataFrame(rows, "id long, check_no int, check_name string, item string, stage string, severity string, message string")
    subjects = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    told = {r["id"]: (r["valid"], r["warning_count"], r["warnings"]) for r in findings.roll_up(subjects, found).collect()}
    assert told == {1: (True, 4, "a b 0"), 2: (True, 1, "late"), 3: (True, 0, "")}


def test_script_verdicts(spark):
    steps = [
        (1, 1, "CREATE TABLE ws.a AS SELECT 1"), (1, 2, "SELECT * FROM ws.a"),
        (2, 1, "SELECT 1"), (2, 2, "WITH x AS (SELECT 1) SELECT * FROM x"),
        (3, 1, "SELECT :day"), (4, 1, "  "), (6, 1, "EXPLAIN SELECT 1"), (6, 2, " "),
        (7, 1, "INSERT INTO ws.a VALUES ('%s', 1::int)"), (8, 1, "WITH x AS (SELECT 1) INSERT INTO ws.a SELECT * FROM x"),
    ]
    df = spark.createDataFrame(steps, "script_id long, step int, statement string")
    scripts = spark.range(1, 9).toDF("script_id")
    got = {r.script_id: (r.valid, r.stage, r.error) for r in audit_sql.script_verdicts(scripts, df).collect()}
    good = (True, None, None)
    assert got == {
        1: good, 2: (False, "logic", fixed.SELECT_ONLY), 3: (False, "logic", fixed.PLACEHOLDER_ERROR),
        4: (False, "syntax", fixed.EMPTY_SCRIPT), 5: (False, "syntax", fixed.EMPTY_SCRIPT),
        6: (False, "logic", fixed.NOT_MATERIALIZING), 7: good, 8: good,
    }
    assert not {r.script_id: r.valid for r in audit_sql.script_verdicts(scripts, df, literal=True).collect()}[7]
    assert audit_sql.script_verdicts(scripts.limit(0), df).count() == 0
