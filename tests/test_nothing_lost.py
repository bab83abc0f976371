"""No row vanishes or changes unseen: rejects, null keys and marks, odd partition values, a moving clock."""

import datetime

from pyspark.sql import functions as F
import pytest

from tidemill.operators import cleaning, history, loads, prompts
from tidemill.sources import csv


def write(path, *texts):
    path.mkdir()
    for i, text in enumerate(texts):
        (path / f"part{i}.csv").write_text(text, encoding="utf-8", newline="")
    return str(path)


def test_lines_that_do_not_fit_are_kept_and_counted(spark, new_table, tmp_path):
    path = write(tmp_path / "in", "id,name\n1,a\n2,b,too,many\n3,c\n")
    database, _, name = new_table("csv").partition(".")
    for _ in range(2):  # the same load again sets nothing aside twice
        report = csv.load(spark, path, name, database)
    assert report.rows == 2 and report.rejected == 1 and "1 lines" in report.warnings[-1]
    rejects = spark.table(report.rejects_table).collect()
    assert [r.line for r in rejects] == ["2,b,too,many"]
    with pytest.raises(loads.StageRejected):
        csv.load(spark, path, name, database, most_rejects=0)
    assert spark.table(report.table).count() == 2


def test_line_breaks_in_quoted_cells(spark, new_table, tmp_path):
    path = write(tmp_path / "in", 'id,name\n1,"first\nsecond"\n2,"say ""x"""\n', "id,name\n3,plain\n")
    database, _, name = new_table("csv").partition(".")
    report = csv.load(spark, path, name, database)
    rows = {(r.id, r.name) for r in spark.table(report.table).collect()}
    assert rows == {(1, "first\nsecond"), (2, 'say "x"'), (3, "plain")} and report.rejected == 0


def test_blank_first_line_and_header_over_two_lines(spark, tmp_path):
    blank = csv.scan(spark, write(tmp_path / "a", "\n \nid,name\n1,x\n"))
    assert blank.rows.columns == ["id", "name"]
    broken = csv.scan(spark, write(tmp_path / "b", 'id,"na\nme"\n1,x\n'))
    assert len(broken.rows.columns) == 2 and [tuple(r) for r in broken.rows.collect()] == [("1", "x")]


def test_null_keys_of_an_upsert(spark, new_table):
    table = new_table("upsert")
    loads.publish(spark.createDataFrame([(1, "a")], "id int, v string"), table)
    batch = spark.createDataFrame([(1, "b"), (2, "c"), (None, "d")], "id int, v string")
    for _ in range(2):
        report = loads.upsert(batch, table, ["id"], ["v"])
    assert report.rows == 2 and report.rejected == 1 and report.warnings
    assert [tuple(r) for r in spark.table(report.rejects_table).collect()] == [(None, "d")]


@pytest.mark.parametrize("filled", [True, False])
def test_null_marks(spark, new_table, filled):
    table = new_table("marks")
    before = [(1, 10)] if filled else []
    loads.publish(spark.createDataFrame(before, "id int, mark int"), table)
    batch = spark.createDataFrame([(2, 11), (3, None)], "id int, mark int")
    for _ in range(2):
        loads.insert_only(batch, table, "mark", ["id"])
    assert {tuple(r) for r in spark.table(table).collect()} == {*before, (2, 11), (3, None)}
    assert spark.table(table).count() == len(before) + 2


def test_odd_partition_values(spark, new_table):
    table = new_table("parts")
    spark.sql(f"CREATE TABLE {table} (v INT, p STRING) USING parquet PARTITIONED BY (p)")
    rows = [(1, "a"), (2, None), (3, "O'Brien"), (4, "back\\slash"), (5, "a=b/c")]
    for kept in (rows, rows[1:], rows):
        loads.publish(spark.createDataFrame(kept, "v int, p string"), table)
        assert sorted(tuple(r) for r in spark.table(table).collect()) == kept
    batch = spark.createDataFrame([(3, "O'Brien"), (6, "O'Brien"), (7, None)], "v int, p string")
    report = loads.upsert_partitions(batch, table, ["v", "p"], ["v"], ["p"])
    assert sorted(r.v for r in spark.table(table).collect()) == [1, 2, 3, 4, 5, 6] and report.rejected == 1


def test_archive_with_a_condition_that_moves(spark, new_table):
    table, archive = new_table("live"), new_table("archive")
    schema = "id long, ts timestamp"
    rows = spark.range(20_000).select("id", (F.current_timestamp() + F.make_interval(secs=F.col("id") / 4000)).alias("ts"))
    loads.publish(rows, table)
    loads.publish(spark.createDataFrame([], schema), archive)
    loads.archive_move(table, archive, F.col("ts") < F.current_timestamp(), ["id"])
    ids = [r.id for r in spark.table(table).select("id").union(spark.table(archive).select("id")).collect()]
    assert sorted(ids) == list(range(20_000))


def test_a_failed_move_of_a_script_goes_back(spark, new_table, monkeypatch):
    first, second = new_table("first"), new_table("second")
    loads.publish(spark.range(1), first)
    steps = [loads.Step("a", "SELECT id + 5 AS id FROM {src}", first), loads.Step("b", "SELECT id FROM {src}", second)]
    swap = loads.swap

    def failing(session, table, path):
        if table == second:
            raise RuntimeError("no")
        return swap(session, table, path)

    monkeypatch.setattr(loads, "swap", failing)
    with pytest.raises(loads.ScriptFailed) as failed:
        loads.run_steps(spark, steps, {"src": spark.range(3)})
    assert failed.value.log[-1].status == "error" and [r.id for r in spark.table(first).collect()] == [0]


def test_a_correction_without_an_error_text(spark):
    row = spark.createDataFrame([("SELECT 1", None, "sql")], "code string, error string, f string")
    text = row.select(prompts.correction_text(F.col("code"), F.col("error"), F.col("f"))).first()[0]
    assert "SELECT 1" in text


def test_history_rows_without_key_or_time_are_kept_and_counted(spark, new_table):
    table = new_table("history")
    schema = "k int, ts timestamp_ntz, id int, a string"
    moment = datetime.datetime(2024, 1, 1)
    early = spark.createDataFrame([(1, moment, 1, "x"), (None, moment, 2, "x"), (None, moment, 2, "x"), (1, None, 3, "y")], schema)
    for _ in range(2):
        report = history.load_history(early, table, ["k"], "ts", "id", ["a"])
        assert report.rows == 1 and report.rejected == 3 and "3 rows without key or time" in report.warnings[-1]
    assert spark.table(report.rejects_table).count() == 3
    late = spark.createDataFrame([(1, moment + datetime.timedelta(1), 4, "z"), (2, None, 5, None)], schema)
    report = history.load_history(late, table, ["k"], "ts", "id", ["a"])
    assert report.rows == 2 and report.rejected == 1
    assert sorted(r.id for r in spark.table(report.rejects_table).collect()) == [2, 2, 3, 5]
    assert sorted((r.a, r.is_current) for r in spark.table(table).collect()) == [("x", False), ("z", True)]


def test_repeated_rejects_are_appended_as_often_as_they_come(spark, new_table):
    table = new_table("rejects")
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "id int, v string")
    assert loads.set_aside(rows, table)[0] == 3
    location = loads.table_location(spark, f"{table}_rejects")
    assert loads.set_aside(rows.orderBy(F.desc("id")), table)[0] == 3  # the same load again
    assert loads.set_aside(rows.filter("id = 1"), table)[0] == 2  # another one, of rows known already
    assert loads.set_aside(spark.createDataFrame([(3, 1.5)], "id int, more double"), table)[0] == 1
    kept = spark.table(f"{table}_rejects")
    assert sorted(r.id for r in kept.collect()) == [1, 1, 1, 1, 2, 3] and kept.columns == ["id", "v", "more"]
    assert loads.table_location(spark, f"{table}_rejects") == location  # appended, not rewritten
    assert loads.set_aside(rows.limit(0), new_table("none")) == (0, None)
    gap = spark.createDataFrame([(None, "a")], "id int, v string")
    other = spark.createDataFrame([(1, None)], "id int, v string")
    assert loads.content_id(gap) != loads.content_id(other)


def test_a_batch_that_reads_its_table_sees_the_old_rows(spark, new_table):
    """Rejects are those of the batch as it was, not of one evaluated again after the swap."""
    table = new_table("self")
    loads.publish(spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), table)
    batch = spark.table(table).select(F.when(F.col("v") == "a", F.col("id")).alias("id"), F.concat("v", F.lit("!")).alias("v"))
    report = loads.upsert(batch, table, ["id"], ["v"])
    assert report.rejected == 1 and [r.v for r in spark.table(report.rejects_table).collect()] == ["b!"]
    assert sorted(r.v for r in spark.table(table).collect()) == ["a!", "b"]


@pytest.mark.parametrize("fails", ["create", "rename"])
def test_a_failed_replacement_leaves_the_table(spark, new_table, monkeypatch, fails):
    table = new_table("replaced")
    loads.create_replace(spark.range(3), table)
    assert loads.create_replace(spark.range(4), table).replaced_existing and spark.table(table).count() == 4
    if fails == "create":
        monkeypatch.setattr(type(spark.catalog), "createTable", lambda *args, **kw: 1 / 0)
    else:
        sql = type(spark).sql

        def failing(session, text, *args, **kw):
            if "__new_" in text and "RENAME" in text:
                raise RuntimeError("no")
            return sql(session, text, *args, **kw)

        monkeypatch.setattr(type(spark), "sql", failing)
    with pytest.raises((ZeroDivisionError, RuntimeError)):
        loads.create_replace(spark.range(5).selectExpr("id", "'x' AS more"), table)
    monkeypatch.undo()
    spark.catalog.refreshTable(table)
    assert spark.table(table).columns == ["id"] and spark.table(table).count() == 4
    loads.create_replace(spark.range(5).selectExpr("id", "'x' AS more"), table)
    assert spark.table(table).columns == ["id", "more"] and spark.table(table).count() == 5
    database, _, name = table.rpartition(".")
    assert [t.name for t in spark.catalog.listTables(database) if t.name.startswith(name)] == [name]


def test_the_text_null_is_not_the_null_partition(spark, new_table):
    table = new_table("nulls")
    spark.sql(f"CREATE TABLE {table} (v INT, p STRING) USING parquet PARTITIONED BY (p)")
    rows = [(1, None), (2, "null"), (3, "a")]
    for kept in (rows, rows[:1] + rows[2:], rows, rows[1:], rows[2:], rows):
        loads.publish(spark.createDataFrame(kept, "v int, p string"), table)
        assert sorted(tuple(r) for r in spark.table(table).collect()) == kept


def test_cells_lost_to_a_type_are_counted(spark):
    raw = spark.createDataFrame([("2024-01-01", "a"), ("2024-01-02", "b"), ("soon", "c"), (None, "d")], "Created_At string, v string")
    loose = cleaning.clean(raw, cleaning.Typing(parse_rate=0.5))
    assert loose.rows.schema["created_at"].dataType.typeName() == "timestamp_ntz"
    assert loose.warnings == ["1 cells of created_at are no timestamps and became null"]
    assert cleaning.clean(raw).warnings == []
