import re

import pytest
from pyspark.sql import functions as F

from tidemill.functions.schemas import ETL_TASKS
from tidemill.operators import loads
from tidemill.operators.loads import Expectations, ScriptFailed, StageRejected, Step


def rows(spark, table):
    return sorted((tuple(r) for r in spark.table(table).collect()), key=str)


def test_publish_creates_then_replaces(spark, new_table):
    table = new_table("t")
    first = loads.publish(spark.range(3).toDF("id"), table)
    second = loads.publish(spark.range(5).toDF("id"), table)
    assert (first.rows, first.replaced_existing, second.rows, second.replaced_existing) == (3, False, 5, True)
    assert spark.table(table).count() == 5


def test_a_table_can_be_rewritten_from_itself(spark, new_table):
    table = new_table("t")
    loads.publish(spark.range(4).toDF("id"), table)
    loads.publish(spark.table(table).filter("id > 1"), table)
    assert rows(spark, table) == [(2,), (3,)]


@pytest.mark.parametrize(
    "expect,df",
    [
        (Expectations(min_rows=3), "SELECT 1 AS id, 'a' AS v"),
        (Expectations(not_null=["v"]), "SELECT 1 AS id, CAST(NULL AS STRING) AS v"),
        (Expectations(unique=["id"]), "SELECT 1 AS id, 'a' AS v UNION ALL SELECT 1, 'b'"),
    ],
)
def test_a_refused_load_changes_nothing(spark, new_table, expect, df):
    table = new_table("t")
    loads.publish(spark.sql("SELECT 7 AS id, 'old' AS v"), table)
    before = loads.table_location(spark, table)
    with pytest.raises(StageRejected):
        loads.publish(spark.sql(df), table, expect)
    assert rows(spark, table) == [(7, "old")] and loads.table_location(spark, table) == before
    assert loads.purge_snapshots(spark, table) == 0


def test_old_snapshots_are_purged(spark, new_table):
    table = new_table("t")
    for n in range(3):
        loads.publish(spark.range(n + 1).toDF("id"), table)
    assert loads.purge_snapshots(spark, table) == 2
    assert spark.table(table).count() == 3


def test_columns_are_matched_by_name(spark, new_table):
    table = new_table("t")
    loads.publish(spark.sql("SELECT 1 AS a, 'x' AS b"), table)
    loads.append(spark.sql("SELECT 'y' AS b, 2 AS a"), table)
    assert rows(spark, table) == [(1, "x"), (2, "y")]
    with pytest.raises(ValueError, match="missing"):
        loads.append(spark.sql("SELECT 3 AS a"), table)
    with pytest.raises(ValueError, match="unknown"):
        loads.append(spark.sql("SELECT 3 AS a, 'z' AS b, 1 AS c"), table)
    loads.append(spark.sql("SELECT 3 AS a, 1.5D AS c"), table, evolve=True)
    assert rows(spark, table) == [(1, "x", None), (2, "y", None), (3, None, 1.5)]


def test_truncate_insert_needs_the_table(spark, new_table):
    with pytest.raises(ValueError, match="does not exist"):
        loads.truncate_insert(spark.range(1), new_table("t"))


def test_insert_only_handles_the_mark(spark, new_table):
    table = new_table("t")
    loads.publish(spark.createDataFrame([(1, 10), (2, 20)], "id int, day int"), table)
    batch = spark.createDataFrame([(1, 10), (2, 20), (3, 20), (4, 30), (9, 5)], "id int, day int")
    for _ in range(2):
        loads.insert_only(batch, table, "day", ["id"])
    assert rows(spark, table) == [(1, 10), (2, 20), (3, 20), (4, 30)]


def test_insert_only_into_an_empty_table_takes_all(spark, new_table):
    table = new_table("t")
    batch = spark.createDataFrame([(1, 10), (2, None)], "id int, day int")
    loads.publish(batch.limit(0), table)
    loads.insert_only(batch, table, "day", ["id"])
    assert spark.table(table).count() == 2


def test_upsert(spark, new_table):
    table = new_table("t")
    schema = "id int, v string, n int"
    loads.publish(spark.createDataFrame([(1, "a", 1), (2, "b", 1)], schema), table)
    batch = spark.createDataFrame([(2, "b2", 2), (2, "b3", 3), (3, "c", 1), (3, "d", 1), (None, "x", 1)], schema)
    expected = [(1, "a", 1), (2, "b3", 3), (3, "d", 1)]
    for _ in range(2):
        loads.upsert(batch, table, ["id"], ["n"])
        assert rows(spark, table) == expected
    _, refused = loads.split_null_keys(batch, ["id"])
    assert [r["v"] for r in refused.collect()] == ["x"]


def test_partition_upsert_leaves_other_partitions_alone(spark, new_table):
    table = new_table("t")
    schema = "id int, p string, v string"
    spark.createDataFrame([(1, "x", "a"), (2, "y", "b")], schema).write.partitionBy("p").saveAsTable(table)
    batch = spark.createDataFrame([(2, "y", "B"), (3, "z", "c")], schema)
    for _ in range(2):
        loads.upsert_partitions(batch, table, ["id", "p"], ["v"], ["p"])
    assert sorted((r["id"], r["p"], r["v"]) for r in spark.table(table).collect()) == [(1, "x", "a"), (2, "y", "B"), (3, "z", "c")]
    with pytest.raises(ValueError):
        loads.upsert_partitions(batch, table, ["id"], ["v"], ["p"])
    wanted = spark.table(table).filter(loads._in_partitions(batch, ["p"]))
    assert re.search(r"PartitionFilters: \[\(*p#", wanted._jdf.queryExecution().executedPlan().toString())


def test_latest_per_key_trims_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 2 AS k", "id AS ts", "id AS v")
    plan = loads.latest_per_key(df, ["k"], ["ts"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text
    assert sorted(tuple(r) for r in plan.collect()) == [(0, 998, 998), (1, 999, 999)]


def test_archive_move_keeps_rows_whose_condition_is_null(spark, new_table):
    table, archive = new_table("t"), new_table("a")
    df = spark.createDataFrame([(1, 5), (2, 50), (3, None)], "id int, age int")
    loads.publish(df, table)
    loads.publish(df.limit(0), archive)
    for _ in range(2):
        loads.archive_move(table, archive, F.col("age") > 10, ["id"])
    assert rows(spark, table) == [(1, 5), (3, None)] and rows(spark, archive) == [(2, 50)]


def test_an_interrupted_archive_move_is_completed(spark, new_table):
    table, archive = new_table("t"), new_table("a")
    df = spark.createDataFrame([(1, 5), (2, 50), (4, 60)], "id int, age int")
    loads.publish(df, table)
    loads.publish(df.filter("id = 2"), archive)
    loads.archive_move(table, archive, F.col("age") > 10, ["id"])
    assert rows(spark, table) == [(1, 5)] and rows(spark, archive) == [(2, 50), (4, 60)]


def test_update_does_not_touch_null_conditions(spark):
    df = spark.createDataFrame([("a", 1), ("b", None), ("c", 9)], "s string, n int")
    out = loads.updated(df, "s", F.lit("old"), F.col("n") > 5)
    assert [r["s"] for r in out.collect()] == ["a", "b", "old"]


def test_delete_cascade(spark):
    tasks = spark.createDataFrame([(1,), (2,)], "id int")
    artifacts = spark.createDataFrame([(10, 1), (20, 2), (21, 2)], "id int, task_id int")
    runs = spark.createDataFrame([(100, 10), (200, 20), (210, 21)], "id int, artifact_id int")
    left = loads.delete_cascade(tasks, artifacts, runs, spark.createDataFrame([(2,)], "id int"))
    assert [[r["id"] for r in df.collect()] for df in left] == [[1], [10], [100]]


def test_a_failed_script_leaves_all_tables(spark, new_table):
    first, second = new_table("a"), new_table("b")
    loads.publish(spark.sql("SELECT 1 AS id"), first)
    steps = [
        Step("one", "SELECT id + 1 AS id FROM {src}", first),
        Step("two", "SELECT id FROM {one}", second),
        Step("bad", "SELECT nothing FROM {two}"),
    ]
    with pytest.raises(ScriptFailed, match=r"Statement #3 \(bad\)") as failure:
        loads.run_steps(spark, steps, {"src": spark.range(1).toDF("id")})
    assert [entry.status for entry in failure.value.log] == ["success", "success", "error"]
    assert rows(spark, first) == [(1,)] and not spark.catalog.tableExists(second)
    result, log = loads.run_steps(spark, steps[:2], {"src": spark.range(1).toDF("id")})
    assert [tuple(r) for r in result.collect()] == [(1,)] and len(log) == 2
    assert rows(spark, first) == [(1,)] and rows(spark, second) == [(1,)]


def test_step_report(spark):
    log = spark.createDataFrame(
        [(1, 1, "CREATE", "success", None), (1, 2, "INSERT", "error", "no table"), (1, 3, "UPDATE", "error", "x"),
         (2, 1, "CREATE", "success", None)],
        "script_id int, step int, kind string, status string, message string",
    )
    got = {r["script_id"]: (r["steps"], r["failed_steps"], r["first_failed_step"], r["error"]) for r in loads.step_report(log).collect()}
    assert got == {1: (3, 2, 2, "Statement #2 (INSERT): no table"), 2: (1, 0, None, None)}


def test_service_tables_are_made_and_widened(spark, new_table):
    table = new_table("etl_tasks")
    old = ", ".join(ETL_TASKS.split(", ")[:8])
    assert len(loads.ensure_table(spark, table, old)) == 8
    loads.append(spark.createDataFrame([(1, None, None, "t", "sql", "done", ["a"], None)], old), table)
    assert loads.ensure_table(spark, table, ETL_TASKS) == ["etl_pattern", "generation_time_ms", "dag_schedule"]
    assert loads.ensure_table(spark, table, ETL_TASKS) == []
    row = spark.table(table).first()
    assert row["source_tables"] == ["a"] and row["dag_schedule"] is None


def test_tables_made_elsewhere_can_be_replaced(spark, new_table):
    plain, parted = new_table("plain"), new_table("parted")
    df = spark.createDataFrame([(1, "x", "a b"), (2, "y", "c")], "id int, v string, p string")
    df.write.saveAsTable(plain)
    df.write.partitionBy("p").saveAsTable(parted)
    new = spark.createDataFrame([(3, "z", "c"), (4, "w", "d/e")], "id int, v string, p string")
    for table in (plain, parted):
        assert loads.truncate_insert(new, table, Expectations(unique=["id"])).rows == 2
        assert rows(spark, table) == [(3, "z", "c"), (4, "w", "d/e")]
    loads.append(df, parted)
    assert spark.table(parted).count() == 4 and spark.table(parted).filter("p = 'c'").count() == 2
    with pytest.raises(StageRejected):
        loads.publish(new.unionByName(new), parted, Expectations(unique=["id"]))
    assert loads.purge_snapshots(spark, parted) == 0
    assert spark.table(parted).count() == 4
    loads.publish(new, parted)
    assert loads.purge_snapshots(spark, parted) == 1
    assert rows(spark, parted) == [(3, "z", "c"), (4, "w", "d/e")]
