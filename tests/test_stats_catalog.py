import datetime

import pytest
from pyspark.sql import functions as F

from tidemill.operators import loads, marts, taskstats
from tidemill.session import scratch_database
from tidemill.sources import catalog

TASKS = "id int, created_at timestamp_ntz, status string, output_format string, etl_pattern string, generation_time_ms long"
ARTIFACTS = "id int, task_id int, artifact_type string, attempts int, is_valid boolean, created_at timestamp_ntz"


def at(hour):
    return datetime.datetime(2024, 1, 1, hour)


def test_overview(spark):
    tasks = spark.createDataFrame(
        [(1, at(1), "done", "sql", "scd2", 10), (2, at(2), "error", None, None, 15), (3, at(3), "pending", "sql", None, None),
         (4, at(4), "processing", "sql", "scd2", None)],
        TASKS,
    )
    artifacts = spark.createDataFrame([(1, 1, "sql", 1, True, at(1)), (2, 2, "sql", 2, False, at(1)), (3, 2, "sql", 2, False, at(2))], ARTIFACTS)
    row = taskstats.overview(tasks, artifacts).first().asDict()
    assert row == {
        "total_tasks": 4, "done_tasks": 1, "error_tasks": 1, "pending_tasks": 2, "success_rate": 25.0,
        "avg_attempts": 1.67, "avg_generation_time_ms": 12.5,
    }
    assert {r[0]: r[1] for r in taskstats.per_pattern(tasks).collect()} == {"scd2": 2}
    assert {r[0]: r[1] for r in taskstats.per_format(tasks).collect()} == {"sql": 3, None: 1}
    assert taskstats.as_map(taskstats.per_format(tasks), "output_format").first()[0] == {"sql": 3, "null": 1}


def test_overview_of_nothing(spark):
    row = taskstats.overview(spark.createDataFrame([], TASKS), spark.createDataFrame([], ARTIFACTS)).first()
    assert (row["total_tasks"], row["success_rate"], row["avg_attempts"], row["avg_generation_time_ms"]) == (0, 0.0, 0.0, None)


def test_zero_times_count_as_unknown(spark):
    tasks = spark.createDataFrame([(1, at(1), "done", "sql", None, 0)], TASKS)
    assert taskstats.overview(tasks, spark.createDataFrame([], ARTIFACTS)).first()["avg_generation_time_ms"] is None


def test_recent_tasks(spark):
    tasks = spark.createDataFrame([(i, at(i % 5), "done", "sql", None, None) for i in range(8)], TASKS)
    artifacts = spark.createDataFrame([(10, 4, "sql", 1, True, at(1)), (11, 4, "sql", 1, True, at(2)), (12, 0, "sql", 1, True, at(1))], ARTIFACTS)
    got = [(r["id"], r["artifact_id"]) for r in taskstats.recent_tasks(tasks, artifacts, 3).collect()]
    assert got == [(4, 11), (4, 10), (3, None), (7, None)] or got == [(4, 11), (4, 10), (7, None), (3, None)]
    assert [(r["id"], r["artifact_id"]) for r in taskstats.task_detail(tasks, artifacts, 4).collect()] == [(4, 11), (4, 10)]
    assert [(r["id"], r["artifact_id"]) for r in taskstats.task_detail(tasks, artifacts, 1).collect()] == [(1, None)]
    assert taskstats.task_detail(tasks, artifacts, 99).count() == 0


def test_runs(spark):
    runs = spark.createDataFrame(
        [(1, 1, at(1), at(2), "success"), (2, 1, at(2), None, "failed"), (3, 2, at(3), at(3), None)],
        "id int, artifact_id int, started_at timestamp_ntz, finished_at timestamp_ntz, state string",
    )
    got = [(r["id"], r["status"], r["duration_ms"]) for r in taskstats.run_log(runs, 1).collect()]
    assert got == [(2, "error", None), (1, "success", 3_600_000)]


@pytest.mark.parametrize(
    "error,stage,errors,message",
    [
        ("e", "logic", [], "Validation failed at stage 'logic': e"),
        ("e", None, [], "Validation failed: e"),
        (None, None, [("security", "s")], "Validation failed at stage 'security': s"),
        ("", "", [(None, "s")], "Validation failed: s"),
        (None, "x", [("security", "s")], "Validation failed at stage 'x': s"),
        (None, None, [], None),
        (None, None, None, None),
    ],
)
def test_validation_message(spark, error, stage, errors, message):
    df = spark.createDataFrame([(error, stage, errors)], "e string, s string, l array<struct<stage:string,error:string>>")
    assert df.select(taskstats.validation_message(F.col("e"), F.col("s"), F.col("l"))).first()[0] == message


def test_outcome(spark):
    df = spark.createDataFrame(
        [(1, True, None, True, None, None, []), (2, False, "g", False, "e", "x", []), (3, True, "", False, "e", "x", []),
         (4, True, None, False, None, None, []), (5, None, None, None, None, None, None)],
        "task_id int, generated boolean, generation_error string, valid boolean, error string, stage string, "
        "errors array<struct<stage:string,error:string>>",
    )
    got = [tuple(r)[1:] for r in taskstats.task_outcome(df).orderBy("task_id").collect()]
    assert got == [
        ("done", None), ("error", "g"), ("error", "Validation failed at stage 'x': e"), ("error", "Generation failed"),
        ("error", "Generation failed"),
    ]


def _nullable(spark, table, **how):
    return {r["column"]: r["nullable"] for r in catalog.columns(spark, tables=[table], **how).collect()}


def _pushed(spark, table):
    return "PushedAggregation: [COUNT(*)" in catalog.columns(spark, tables=[table])._jdf.queryExecution().executedPlan().toString()


def test_columns_from_footers(spark, new_table):
    table = new_table("footers")
    rows = "id", "IF(id % 7 = 0, NULL, id) AS `odd name`", "array(id, NULL) AS list", "IF(id > 4, NULL, array(1)) AS other", "'x' AS v"
    loads.publish(spark.range(0, 1000, 1, 5).selectExpr(*rows), table)
    expected = {"id": False, "odd name": True, "list": False, "other": True, "v": False}
    assert _pushed(spark, table) and _nullable(spark, table) == expected == _nullable(spark, table, footers=False)
    loads.append(spark.range(3).selectExpr("id", "id AS `odd name`", "array(id) AS list", "array(1) AS other", "CAST(NULL AS STRING) AS v"), table)
    assert _pushed(spark, table) and _nullable(spark, table) == expected | {"v": True}
    # Files that lack a column answer by position what was not asked: they are read.
    loads.append(spark.range(3).selectExpr("id", "id AS more"), table, evolve=True)
    assert not _pushed(spark, table) and _nullable(spark, table)["more"] and not _nullable(spark, table)["id"]
    loads.publish(spark.table(table), table)
    assert _pushed(spark, table) and _nullable(spark, table)["more"]


def test_columns_that_footers_cannot_answer(spark, new_table):
    nested, parts, many, empty, foreign = (new_table(name) for name in ("nested", "parts", "many", "empty", "foreign"))
    loads.publish(spark.range(9).selectExpr("struct(id, NULL AS gap) AS s", "IF(id = 1, NULL, id) AS a", "id AS b"), nested)
    assert not _pushed(spark, nested) and _nullable(spark, nested) == {"s": False, "a": True, "b": False}
    spark.range(9).selectExpr("id", "id % 2 AS p").write.partitionBy("p").saveAsTable(parts)
    assert not _pushed(spark, parts) and _nullable(spark, parts) == {"id": False, "p": False}
    spark.range(0, 9, 1, 3).write.saveAsTable(many)  # nobody vouches for these files
    assert not _pushed(spark, many) and _nullable(spark, many) == {"id": False}
    loads.publish(spark.range(0), empty)
    assert _nullable(spark, empty) == {"id": False}
    spark.sql(f"CREATE TABLE {foreign} (id INT) USING csv")
    assert not _pushed(spark, foreign) and _nullable(spark, foreign) == {"id": False}


def test_catalog(spark):
    import uuid

    db = scratch_database(spark, f"cat_{uuid.uuid4().hex[:8]}")
    spark.sql("SELECT 1 AS id, CAST(NULL AS STRING) AS v").write.saveAsTable(f"{db}.one")
    spark.sql("SELECT 1.5D AS x").write.saveAsTable(f"{db}.two")
    assert [tuple(r) for r in catalog.tables(spark, db).orderBy("table_name").collect()] == [
        ("one", 1, 2, "id, v", "BIGINT, TEXT"), ("two", 1, 1, "x", "DOUBLE PRECISION"),
    ]
    everything = catalog.columns(spark, db)
    assert sorted(tuple(r) for r in everything.collect()) == [
        ("one", 1, "id", "BIGINT", False), ("one", 2, "v", "TEXT", True), ("two", 1, "x", "DOUBLE PRECISION", False),
    ]
    assert catalog.columns(spark, db, []).count() == 0
    assert {r["table_name"] for r in catalog.columns(spark, "default", [f"{db}.two"]).collect()} == {f"{db}.two"}
    lines = {r["table_name"]: r["text"] for r in catalog.schema_lines(everything).collect()}
    assert lines["one"] == "Таблица one: id (BIGINT, NOT NULL), v (TEXT, NULL)"
    blocks = {r["table_name"]: r["text"] for r in catalog.schema_blocks(everything).collect()}
    assert blocks["one"] == "Table: one\n  - id: BIGINT (NOT NULL)\n  - v: TEXT (NULL)"
    assert catalog.split_table_name("a.b.c") == ("a", "b.c")


def test_orphans(spark):
    child = spark.createDataFrame([(1,), (1,), (2,), (None,)], "fk int")
    parent = spark.createDataFrame([(2,)], "pk int")
    row = catalog.orphans(child, parent, catalog.ForeignKey("c", "fk", "p", "pk")).first()
    assert (row["orphan_keys"], row["orphan_rows"]) == (1, 2)


def test_preview(spark):
    df = spark.sql(
        "SELECT 1 AS i, true AS b, 1.50BD AS d, DATE '2024-01-01' AS day, array(1, 2) AS a, CAST(NULL AS DATE) AS n"
    )
    assert catalog.preview(df).first().asDict() == {"i": 1, "b": True, "d": "1.50", "day": "2024-01-01", "a": "[1,2]", "n": None}
    assert catalog.preview(spark.range(2000)).count() == 500


ORDERS = "o_orderkey int, o_custkey int, o_totalprice double, o_orderdate date, o_orderstatus string"


def test_marts_on_the_small_case(spark):
    day = datetime.date
    orders = spark.createDataFrame(
        [(1, 1, 120.5, day(2026, 4, 10), "F"), (2, 2, 55.0, day(2026, 3, 15), "O"), (3, 1, 220.0, day(2025, 12, 10), "F")], ORDERS
    )
    as_of = F.lit(day(2026, 4, 14))
    assert [r["o_orderkey"] for r in marts.recent_orders(orders, as_of).orderBy("o_orderkey").collect()] == [1, 2]
    assert [r["o_orderkey"] for r in marts.recent_orders(orders, as_of, days=29).collect()] == [1]
    assert {r[0]: r[1] for r in marts.totals_by_user(orders).collect()} == {1: 340.5, 2: 55.0}
    assert [tuple(r) for r in marts.top_users(orders, 1).collect()] == [(1, 340.5)]
    assert [tuple(r) for r in marts.orders_by_month(orders).collect()] == [
        ("2025-12", 1, 220.0), ("2026-03", 1, 55.0), ("2026-04", 1, 120.5),
    ]
    assert marts.completed_orders(orders).count() == 2


def test_filters_reach_the_scan(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    from tidemill.functions.scalars import scalar_literal

    recent = marts.recent_orders(orders, scalar_literal(orders, F.max("o_orderdate")))
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan
    totals = marts.totals_by_user(orders)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double>" in totals
    top = marts.top_users(orders)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in top
