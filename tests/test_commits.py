"""Commits of several tables, numbered batches, keyed tables, removal of what was replaced."""

import os
from urllib.parse import unquote, urlsplit

import pytest
from pyspark.sql import functions as F

from tidemill.operators import commits, history, keyed, loads
from tidemill.operators.commits import Batch, Change
from tidemill.session import scratch_path
from tidemill.streaming import incremental
from tests.test_history import COLUMNS, SCHEMA as CHANGES, got, some_events

ROWS = "id int, part string, v string"


def rows(spark, *values):
    return spark.createDataFrame(list(values), ROWS)


def held(spark, table):
    return sorted(map(tuple, spark.table(table).select("id", "v").collect()))


def folders(spark, table):
    """The folder of each bucket."""
    found = spark.table(table).select(keyed.BUCKET, F.regexp_replace("_metadata.file_path", "/[^/]*$", "")).distinct()
    return dict(map(tuple, found.collect()))


class Stop(Exception):
    pass


def stop_at(monkeypatch, number):
    """The step of that number fails, and all later ones; returns the steps reached."""
    seen = []

    def reached(step):
        seen.append(step)
        if len(seen) > number:
            raise Stop(step)

    monkeypatch.setattr(commits, "_reached", reached)
    return seen


def five_tables(spark, new_table):
    names = {how: new_table(how) for how in ("replace", "parted", "partitions", "append", "anew")}
    first = rows(spark, (1, "a", "old"), (2, "b", "old")).coalesce(1)
    for how, name in names.items():
        if how in ("parted", "partitions"):
            first.write.partitionBy("part").saveAsTable(name)
        else:
            loads.publish(first, name)
    return names


def changes(spark, names):
    new = rows(spark, (2, "b", "new"), (3, None, "new")).coalesce(1)
    return [
        Change(new, names["replace"]),
        Change(new, names["parted"]),
        Change(new, names["partitions"], "partitions"),
        Change(new, names["append"], "append"),
        Change(new.withColumn("more", F.lit(1)), names["anew"], "anew"),
    ]


OLD = [(1, "old"), (2, "old")]
NEW = [(2, "new"), (3, "new")]
AFTER = {"replace": NEW, "parted": NEW, "partitions": [(1, "old"), *NEW], "append": sorted(OLD + NEW), "anew": NEW}


def test_all_tables_are_old_or_all_are_new(spark, new_table, monkeypatch):
    batch, step, total = Batch("s", 4), 0, None
    while total is None or step < total:
        names = five_tables(spark, new_table)
        seen = stop_at(monkeypatch, step)
        with pytest.raises(Stop):
            commits.commit(spark, changes(spark, names), batch)
        begun = "move" in seen
        if begun:
            with pytest.raises(commits.Unfinished):
                commits.commit(spark, changes(spark, names), batch)
            # The recovery dies as well, at its second step, before one goes through.
            stop_at(monkeypatch, 1)
            with pytest.raises(Stop):
                commits.recover_table(spark, names["replace"])
                raise Stop
        every = stop_at(monkeypatch, 1000)
        commits.recover_table(spark, names["replace"])
        for how, name in names.items():
            assert held(spark, name) == (AFTER[how] if begun else OLD), (step, seen, how)
            assert commits.applied(spark, name, "s") == (4 if begun else -1)
        if total is None:
            commits.commit(spark, changes(spark, names), batch)
            total = len(every)
            assert held(spark, names["append"]) == AFTER["append"]
        # A few steps in the middle are like their neighbours.
        step += 1 if step < 3 or step > total - 2 else 3


def test_a_batch_is_taken_once(spark, new_table):
    table = new_table("numbered")
    loads.publish(rows(spark, (1, "a", "x")), table)
    more = [Change(rows(spark, (2, "b", "y")), table, "append")]
    assert len(commits.commit(spark, more, Batch("one", 0))) == 1
    assert commits.commit(spark, more, Batch("one", 0)) == []
    assert len(commits.commit(spark, more, Batch("two", 0))) == 1
    assert held(spark, table) == [(1, "x"), (2, "y"), (2, "y")]


def test_refused_changes_leave_nothing(spark, new_table):
    good, bad = new_table("good"), new_table("bad")
    for name in (good, bad):
        loads.publish(rows(spark, (1, "a", "x")), name)
    twice = rows(spark, (2, "b", "y"), (2, "b", "z"))
    with pytest.raises(loads.StageRejected):
        commits.commit(spark, [Change(twice, good), Change(twice, bad, expect=loads.Expectations(unique=["id"]))])
    assert held(spark, good) == held(spark, bad) == [(1, "x")]
    for wrong in ([], [Change(twice, good), Change(twice, good)], [Change(twice, good, "partitions")], [Change(twice, good, "sideways")]):
        with pytest.raises(ValueError):
            commits.commit(spark, wrong)


def test_everything_deleted_from_a_partitioned_table(spark, new_table):
    table = new_table("emptied")
    rows(spark, (1, "a", "x"), (2, None, "y")).write.partitionBy("part").saveAsTable(table)
    commits.commit(spark, [Change(rows(spark), table)])
    assert held(spark, table) == []


# -- keyed tables ------------------------------------------------------------


def keyed_table(spark, new_table, buckets=8):
    table = new_table("keyed")
    keyed.create(spark, table, rows(spark).schema, ["id"], buckets)
    first = spark.range(200).selectExpr("cast(id as int) AS id", "'p' AS part", "'old' AS v")
    keyed.upsert(first, table, ["v"], loads.Expectations(unique=["id"]))
    return table


def test_only_the_buckets_of_a_batch_are_rewritten(spark, new_table):
    table = keyed_table(spark, new_table)
    before = folders(spark, table)
    assert len(before) == 8
    report = keyed.upsert(rows(spark, (7, "p", "new"), (7, "p", "newer"), (None, "p", "lost")), table, ["v"])
    after = folders(spark, table)
    bucket = spark.table(table).filter("id = 7").first()[keyed.BUCKET]
    assert {b for b in before if before[b] != after[b]} == {bucket}
    assert report.rows == spark.table(table).filter(F.col(keyed.BUCKET) == bucket).count()
    assert report.rejected == 1 and spark.table(report.rejects_table).columns == ["id", "part", "v"]
    assert [r for r in held(spark, table) if r[1] != "old"] == [(7, "newer")]
    assert keyed.rows_of(spark, table).count() == 200


def test_other_buckets_are_not_read(spark, new_table):
    table = keyed_table(spark, new_table)
    one = keyed.in_buckets(spark.table(table), [3])
    files = one.select(keyed.BUCKET).distinct().collect()
    assert [r[0] for r in files] == [3]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(key_bucket" in plan or "PartitionFilters: [(key_bucket" in plan


def test_empty_batches_and_repeated_ones(spark, new_table):
    table = keyed_table(spark, new_table)
    before = folders(spark, table)
    assert keyed.upsert(rows(spark), table, ["v"], batch_id=Batch("s", 0)).rows == 0
    assert commits.applied(spark, table, "s") == 0
    assert keyed.upsert(rows(spark, (None, "p", "x")), table, ["v"], batch_id=Batch("s", 1)).rejected == 1
    assert folders(spark, table) == before
    assert keyed.upsert(rows(spark, (1, "p", "new")), table, ["v"], batch_id=Batch("s", 2)).rows > 0
    assert keyed.upsert(rows(spark, (1, "p", "other")), table, ["v"], batch_id=Batch("s", 2)) is None
    assert (1, "new") in held(spark, table)
    with pytest.raises(ValueError):
        keyed.layout(spark, _plain(spark, new_table))
    with pytest.raises(ValueError):
        keyed.create(spark, new_table("bad"), rows(spark).schema, ["nowhere"], 8)


def _plain(spark, new_table):
    table = new_table("plain")
    loads.publish(rows(spark, (1, "a", "x")), table)
    return table


def test_a_refused_upsert_changes_no_bucket(spark, new_table):
    table = keyed_table(spark, new_table)
    before = folders(spark, table)
    with pytest.raises(loads.StageRejected):
        keyed.upsert(rows(spark, (1, None, "new"), (900, None, "new")), table, ["v"], loads.Expectations(not_null=["part"]))
    assert folders(spark, table) == before and keyed.rows_of(spark, table).count() == 200


def test_history_in_buckets_equals_history_at_once(spark, new_table):
    table = new_table("keyed_history")
    events = some_events(5, 300, 0.4, 100)
    frame = spark.createDataFrame(events, CHANGES)
    keyed.create_history(spark, table, frame.schema, *COLUMNS, 4)
    parts = [frame.filter(F.col("id") % 3 == part) for part in range(3)]
    for part in (*parts, parts[0]):
        keyed.load_history(part.filter("k IS NOT NULL").orderBy("ts"), table, *COLUMNS[1:])
    in_order = sorted(events, key=lambda event: event[1])
    table_in_order = new_table("keyed_history")
    keyed.create_history(spark, table_in_order, frame.schema, *COLUMNS, 4)
    for chunk in (in_order[:150], in_order[150:], in_order[150:]):
        report = keyed.load_history(spark.createDataFrame(chunk, CHANGES), table_in_order, *COLUMNS[1:])
    assert got(keyed.rows_of(spark, table_in_order)) == got(history.build_history(frame, *COLUMNS))
    assert report.rejected == sum(event[0] is None for event in in_order[150:])
    before = folders(spark, table_in_order)
    late = spark.createDataFrame([(2, max(e[1] for e in events), 10**6, "z", 9)], CHANGES)
    keyed.load_history(late, table_in_order, *COLUMNS[1:])
    after = folders(spark, table_in_order)
    assert len({b for b in before if before[b] != after[b]}) == 1


# -- removal of what was replaced --------------------------------------------


def stored_files(spark, table):
    root = unquote(urlsplit(loads._snapshot_root(spark, table)).path)
    return [os.path.join(at, name) for at, _, names in os.walk(root) for name in names if name.endswith(".parquet")]


def test_repeated_loads_leave_bounded_storage(spark, new_table):
    table = keyed_table(spark, new_table)
    sizes = []
    for turn in range(4):
        keyed.upsert(rows(spark, (turn, "p", f"v{turn}"), (50 + turn, "p", "w")), table, ["v"])
        assert loads.purge_snapshots(spark, table, older_than=3600) == 0
        loads.purge_snapshots(spark, table)
        sizes.append(len(stored_files(spark, table)))
    assert len(folders(spark, table)) == 8 and max(sizes) <= 16
    assert keyed.rows_of(spark, table).count() == 200
    assert sum(v != "old" for _, v in held(spark, table)) == 8


def test_partitions_with_odd_names_outlive_a_purge(spark, new_table):
    table = new_table("odd")
    rows(spark, (1, "a b/c%", "x")).write.partitionBy("part").saveAsTable(table)
    for _ in range(2):
        loads.publish(rows(spark, (1, "a b/c%", "x"), (2, None, "y"), (3, "null", "z")), table)
    assert loads.purge_snapshots(spark, table) == 1
    assert held(spark, table) == [(1, "x"), (2, "y"), (3, "z")]


def test_no_purge_beside_an_unfinished_commit(spark, new_table, monkeypatch):
    table = _plain(spark, new_table)
    stop_at(monkeypatch, 1)
    with pytest.raises(Stop):
        commits.commit(spark, [Change(rows(spark, (2, "b", "y")), table)])
    with pytest.raises(ValueError):
        loads.purge_snapshots(spark, table)
    stop_at(monkeypatch, 1000)
    assert commits.recover_table(spark, table) == 1
    assert loads.purge_snapshots(spark, table) == 1
    assert held(spark, table) == [(2, "y")]


# -- streams -----------------------------------------------------------------


def test_a_replayed_micro_batch_changes_nothing(spark, new_table, tmp_path):
    log, state, buckets = new_table("log"), new_table("state"), keyed_table(spark, new_table)
    schema = "id int, part string, v string"
    source = str(tmp_path / "in")
    rows(spark, (1, "a", None), (1, "a", None), (2, "b", "m")).coalesce(1).write.parquet(source)
    for name in (log, state):
        loads.publish(rows(spark), name)
    places = [scratch_path(spark, "stream") for _ in range(3)]

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        incremental.append_new(stream, log, "v", ["id"], places[0]).awaitTermination()
        incremental.upsert_new(stream, state, ["id"], ["v"], places[1]).awaitTermination()
        incremental.upsert_new(stream, buckets, ["id"], ["v"], places[2]).awaitTermination()

    run()
    before = [held(spark, log), loads.table_location(spark, state), folders(spark, buckets)]
    assert len(before[0]) == 3
    for place in places:
        # As if the driver had died after the tables moved and before the checkpoint did.
        for name in ("0", ".0.crc"):
            os.remove(f"{place}/commits/{name}")
    run()
    assert [held(spark, log), loads.table_location(spark, state), folders(spark, buckets)] == before
