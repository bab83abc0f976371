"""Named load queries: each prepares a target table, runs the load and reads the table back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemill.functions.scalars import money, scalar_literal
from tidemill.operators import commits, history, keyed, loads, marts
from tidemill.plans.derived import view, with_views
from tidemill.plans.registry import query
from tidemill.session import scratch_database, scratch_path
from tidemill.streaming import incremental

CUTOFF = "2000-01-01"


def scratch_table(t, name: str) -> str:
    return f"{scratch_database(t.spark)}.{name}_{uuid.uuid4().hex[:12]}"


def before(day: str):
    return F.col("o_orderdate") < F.lit(day).cast("timestamp_ntz")


@query(
    "load_truncate_insert",
    """
    SELECT strftime(o_orderdate, '%Y-%m') AS order_month, count(*) AS orders_count,
           CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_amount
    FROM orders GROUP BY 1
    """,
)
def load_truncate_insert(t):
    """A mart table built from completed orders, then refreshed from all of them."""
    table = scratch_table(t, "orders_by_month")
    loads.publish(marts.orders_by_month(marts.completed_orders(t.orders)), table)
    loads.truncate_insert(
        marts.orders_by_month(t.orders), table, loads.Expectations(min_rows=1, unique=["order_month"])
    )
    return t.spark.table(table)


@query(
    "load_create_replace",
    """
    SELECT o_orderstatus AS status, count(*) AS orders_count,
           CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_amount
    FROM orders GROUP BY 1
    """,
)
def load_create_replace(t):
    """The columns of the table change with the new definition."""
    table = scratch_table(t, "orders_by_status")
    by_status = t.orders.groupBy(F.col("o_orderstatus").alias("status"))
    loads.create_replace(by_status.agg(F.count(F.lit(1)).alias("orders_count")), table)
    loads.create_replace(
        by_status.agg(
            F.count(F.lit(1)).alias("orders_count"), F.sum(money("o_totalprice")).cast("double").alias("total_amount")
        ),
        table,
    )
    return t.spark.table(table)


@query("load_insert_only", "SELECT * FROM orders")
def load_insert_only(t):
    """Orders up to a day are there; the whole source is offered, twice."""
    table = scratch_table(t, "orders_log")
    loads.publish(t.orders.filter(before(CUTOFF)), table)
    for _ in range(2):
        loads.insert_only(t.orders, table, "o_orderdate", ["o_orderkey"])
    return t.spark.table(table)


# Orders that changed: the open ones, with a new price; every order of the last year is offered twice.
UPSERT_BATCH = """
SELECT o_orderkey, o_custkey, 'X' AS o_orderstatus, o_totalprice + 1 AS o_totalprice, o_orderdate, o_orderpriority
FROM {orders} WHERE o_orderstatus = 'O' OR o_orderdate >= TIMESTAMP_NTZ '2000-01-01 00:00:00'
UNION ALL
SELECT o_orderkey, o_custkey, 'Y' AS o_orderstatus, o_totalprice + 2 AS o_totalprice, o_orderdate, o_orderpriority
FROM {orders} WHERE o_orderdate >= TIMESTAMP_NTZ '2000-01-01 00:00:00'
"""

UPSERT_RESULT = """
SELECT o_orderkey, o_custkey,
       CASE WHEN o_orderdate >= TIMESTAMP '2000-01-01' THEN 'Y' WHEN o_orderstatus = 'O' THEN 'X'
            ELSE o_orderstatus END AS o_orderstatus,
       CASE WHEN o_orderdate >= TIMESTAMP '2000-01-01' THEN o_totalprice + 2 WHEN o_orderstatus = 'O' THEN o_totalprice + 1
            ELSE o_totalprice END AS o_totalprice,
       o_orderdate, o_orderpriority
FROM orders
"""


@query("load_upsert", UPSERT_RESULT)
def load_upsert(t):
    """Known orders change, unknown ones are added, the last version of a key in the batch wins."""
    table = scratch_table(t, "orders")
    loads.publish(t.orders.filter(before(CUTOFF)), table)
    batch = t.spark.sql(UPSERT_BATCH, orders=t.orders)
    loads.upsert(batch, table, ["o_orderkey"], ["o_orderstatus"], loads.Expectations(unique=["o_orderkey"]))
    return t.spark.table(table)


@query(
    "load_upsert_partitions",
    "SELECT *, CAST(strftime(o_orderdate, '%Y') AS INTEGER) AS order_year FROM (" + UPSERT_RESULT + ")",
)
def load_upsert_partitions(t):
    """As ``load_upsert`` on a table partitioned by year: only the years of the batch are rewritten."""
    table = scratch_table(t, "orders_by_year")
    year = F.year("o_orderdate").alias("order_year")
    t.orders.filter(before(CUTOFF)).select("*", year).repartition("order_year").write.partitionBy(
        "order_year"
    ).saveAsTable(table)
    batch = t.spark.sql(UPSERT_BATCH, orders=t.orders).select("*", year)
    loads.upsert_partitions(batch, table, ["o_orderkey", "order_year"], ["o_orderstatus"], ["order_year"])
    return t.spark.table(table)


@query("load_keyed_upsert", UPSERT_RESULT)
def load_keyed_upsert(t):
    """As ``load_upsert`` on a table in buckets of its key; the numbered batch is offered twice."""
    table = scratch_table(t, "keyed_orders")
    keyed.create(t.spark, table, t.orders.schema, ["o_orderkey"], 16)
    keyed.upsert(t.orders.filter(before(CUTOFF)), table, ["o_orderdate"])
    batch = t.spark.sql(UPSERT_BATCH, orders=t.orders)
    for _ in range(2):
        keyed.upsert(batch, table, ["o_orderstatus"], loads.Expectations(unique=["o_orderkey"]), commits.Batch("orders", 0))
    return keyed.rows_of(t.spark, table)


@query("load_incremental_stream", "SELECT * FROM orders")
def load_incremental_stream(t):
    """The files of the source as a stream, taken twice: the second run finds nothing new."""
    table = scratch_table(t, "orders")
    loads.publish(t.orders.filter(before(CUTOFF)), table)
    checkpoint = scratch_path(t.spark, "stream")
    for _ in range(2):
        stream = t.spark.readStream.schema(t.orders.schema).option("pathGlobFilter", "orders.parquet").parquet(t.sf_dir)
        incremental.upsert_new(stream, table, ["o_orderkey"], ["o_orderdate"], checkpoint).awaitTermination()
    return t.spark.table(table)


@query(
    "dedup_latest",
    """
    SELECT event_id, ts, user_id, event_type, value, props FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events
    ) WHERE rn = 1
    """,
)
def dedup_latest(t):
    return loads.latest_per_key(t.events, ["user_id"], ["ts", "event_id"])


@query(
    "archive_copy",
    "SELECT o_orderstatus, o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders",
)
def archive_copy(t):
    """Insert-select: columns are matched by name, not by position."""
    table = scratch_table(t, "orders_archive")
    t.spark.sql(
        f"""CREATE TABLE {table} (o_orderstatus STRING, o_orderkey BIGINT, o_custkey BIGINT,
            o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ) USING parquet"""
    )
    loads.append(t.orders.drop("o_orderpriority"), table)
    return t.spark.table(table)


@query(
    "archive_move",
    """
    SELECT CASE WHEN o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 90 DAY
                THEN 'archive' ELSE 'table' END AS place, *
    FROM orders
    """,
)
def archive_move(t):
    """Old orders move once, although the move is run twice."""
    table, archive = scratch_table(t, "orders"), scratch_table(t, "orders_archive")
    as_of = scalar_literal(t.orders, F.max("o_orderdate"))
    loads.publish(t.orders, table)
    loads.publish(t.orders.limit(0), archive)
    for _ in range(2):
        loads.archive_move(table, archive, F.col("o_orderdate") < as_of - F.expr("INTERVAL 90 DAYS"), ["o_orderkey"])
    places = [t.spark.table(name).select(F.lit(label).alias("place"), "*") for name, label in
              ((table, "table"), (archive, "archive"))]
    return places[0].unionByName(places[1])


@query(
    "update_expired",
    """
    SELECT o_orderkey, o_custkey,
           CASE WHEN o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 90 DAY
                THEN 'expired' ELSE o_orderstatus END AS o_orderstatus,
           o_totalprice, o_orderdate, o_orderpriority
    FROM orders
    """,
)
def update_expired(t):
    table = scratch_table(t, "orders")
    as_of = scalar_literal(t.orders, F.max("o_orderdate"))
    loads.publish(t.orders, table)
    old = F.col("o_orderdate") < as_of - F.expr("INTERVAL 90 DAYS")
    loads.publish(loads.updated(t.spark.table(table), "o_orderstatus", F.lit("expired"), old), table)
    return t.spark.table(table)


@query(
    "delete_cascade",
    with_views("tasks", "artifacts", "runs")
    + """
    SELECT 'tasks' AS table_name, id FROM tasks WHERE status <> 'error' AND generation_time_ms >= 1000
        OR status <> 'error' AND generation_time_ms IS NULL
    UNION ALL
    SELECT 'artifacts', a.id FROM artifacts a JOIN tasks t ON t.id = a.task_id
    WHERE status <> 'error' AND generation_time_ms >= 1000
    UNION ALL
    SELECT 'runs', r.id FROM runs r JOIN artifacts a ON a.id = r.artifact_id JOIN tasks t ON t.id = a.task_id
    WHERE status <> 'error' AND generation_time_ms >= 1000
    """,
)
def delete_cascade(t):
    """Failed tasks and tasks generated within a second go, with their artifacts and runs."""
    tasks, artifacts, runs = (view(t, n) for n in ("tasks", "artifacts", "runs"))
    doomed = tasks.filter("status = 'error' OR generation_time_ms < 1000").select("id")
    kept = loads.delete_cascade(tasks, artifacts, runs, doomed)
    labelled = [
        df.select(F.lit(label).alias("table_name"), "id") for df, label in zip(kept, ("tasks", "artifacts", "runs"))
    ]
    return labelled[0].unionByName(labelled[1]).unionByName(labelled[2])


@query(
    "delete_cascade_commit",
    with_views("tasks", "artifacts", "runs")
    + """
    SELECT 'tasks' AS table_name, id FROM tasks WHERE status <> 'error'
    UNION ALL
    SELECT 'artifacts', a.id FROM artifacts a JOIN tasks t ON t.id = a.task_id WHERE status <> 'error'
    UNION ALL
    SELECT 'runs', r.id FROM runs r JOIN artifacts a ON a.id = r.artifact_id JOIN tasks t ON t.id = a.task_id
    WHERE status <> 'error'
    """,
)
def delete_cascade_commit(t):
    """Failed tasks leave three tables in one commit; it is run again."""
    names = {name: scratch_table(t, name) for name in ("tasks", "artifacts", "runs")}
    for name, table in names.items():
        loads.publish(view(t, name), table)
    for _ in range(2):
        commits.delete_cascade(*names.values(), t.spark.table(names["tasks"]).filter("status = 'error'").select("id"))
    left = [t.spark.table(table).select(F.lit(name).alias("table_name"), "id") for name, table in names.items()]
    return left[0].unionByName(left[1]).unionByName(left[2])


HISTORY_SQL = """
WITH moments AS (
    SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) AS rn FROM events
), marked AS (
    SELECT *, lag(event_type) OVER w AS before_type, row_number() OVER w AS n
    FROM moments WHERE rn = 1 WINDOW w AS (PARTITION BY user_id ORDER BY ts)
), versions AS (
    SELECT user_id, event_type, event_id, ts FROM marked WHERE n = 1 OR event_type IS DISTINCT FROM before_type
)
SELECT user_id, event_type, event_id, ts AS valid_from,
       lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS valid_to,
       lead(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL AS is_current
FROM versions
"""


@query("scd2_build", HISTORY_SQL)
def scd2_build(t):
    return history.build_history(t.events, ["user_id"], "ts", "event_id", ["event_type"])


@query("scd2_merge", HISTORY_SQL)
def scd2_merge(t):
    """History of the first weeks, then the remaining events merged into the table, twice."""
    table = scratch_table(t, "user_history")
    day = F.lit("2024-01-20").cast("timestamp_ntz")
    columns = (["user_id"], "ts", "event_id", ["event_type"])
    loads.publish(history.build_history(t.events.filter(F.col("ts") < day), *columns), table)
    batch = t.events.filter(F.col("ts") >= day)
    for _ in range(2):
        loads.publish(history.merge_history(t.spark.table(table), batch, *columns), table)
    return t.spark.table(table)


@query("scd2_keyed", HISTORY_SQL)
def scd2_keyed(t):
    """The same as a table in buckets of the key: each part rewrites the buckets of its users."""
    table = scratch_table(t, "keyed_history")
    columns = ("ts", "event_id", ["event_type"])
    day = F.lit("2024-01-20").cast("timestamp_ntz")
    keyed.create_history(t.spark, table, t.events.schema, ["user_id"], *columns, buckets=16)
    for part in (F.col("ts") < day, F.col("ts") >= day, F.col("ts") >= day):
        keyed.load_history(t.events.filter(part), table, *columns)
    return keyed.rows_of(t.spark, table)


# Changes of which some lack their key or their time, and some come twice.
GAPPY_EVENTS = """
SELECT event_id, CASE WHEN event_id % 50 <> 0 THEN user_id END AS user_id, CASE WHEN event_id % 77 <> 0 THEN ts END AS ts, event_type
FROM {events}
UNION ALL
SELECT event_id, NULL, ts, event_type FROM {events} WHERE event_id % 100 = 0
"""


@query(
    "scd2_rejects",
    f"SELECT * FROM ({GAPPY_EVENTS.format(events='events')}) WHERE user_id IS NULL OR ts IS NULL",
)
def scd2_rejects(t):
    """Changes that no history can hold, set aside by two loads, each run twice."""
    table = scratch_table(t, "gappy_history")
    changes = t.spark.sql(GAPPY_EVENTS, events=t.events)
    for part in (0, 0, 1, 1):
        batch = changes.filter(F.col("event_id") % 2 == part)
        report = history.load_history(batch, table, ["user_id"], "ts", "event_id", ["event_type"])
    return t.spark.table(report.rejects_table)


@query(
    "run_steps",
    """
    SELECT c_mktsegment AS segment, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_amount,
           count(DISTINCT o_custkey) AS users
    FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1
    """,
)
def run_steps(t):
    """A script of two steps that feed tables and a last one whose result is kept."""
    totals, segments = scratch_table(t, "user_totals"), scratch_table(t, "segment_totals")
    result, _ = loads.run_steps(
        t.spark,
        [
            loads.Step(
                "totals",
                "SELECT o_custkey AS user_id, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS amount "
                "FROM {orders} GROUP BY o_custkey",
                totals,
                loads.Expectations(min_rows=1, not_null=["user_id"], unique=["user_id"]),
            ),
            loads.Step(
                "segments",
                "SELECT c_mktsegment AS segment, sum(amount) AS amount, count(*) AS users "
                "FROM {totals} JOIN {customer} ON c_custkey = user_id GROUP BY c_mktsegment",
                segments,
            ),
            loads.Step("report", "SELECT segment, CAST(amount AS DOUBLE) AS total_amount, users FROM {segments}"),
        ],
        {"orders": t.orders, "customer": t.customer},
    )
    return result


@query("stage_check_publish", "SELECT * FROM orders")
def stage_check_publish(t):
    """A sound load is published, one with repeated keys is refused and changes nothing."""
    table = scratch_table(t, "orders")
    expect = loads.Expectations(min_rows=1, not_null=["o_orderkey"], unique=["o_orderkey"])
    loads.publish(t.orders, table, expect)
    try:
        loads.publish(t.orders.unionByName(t.orders), table, expect)
        raise AssertionError("repeated keys were published")
    except loads.StageRejected:
        pass
    return t.spark.table(table)


@query(
    "schema_evolve",
    """
    SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate,
           CASE WHEN o_orderdate < TIMESTAMP '2000-01-01' THEN NULL ELSE o_orderpriority END AS o_orderpriority
    FROM orders
    """,
)
def schema_evolve(t):
    """A column that comes with later rows is added; earlier rows show null."""
    table = scratch_table(t, "orders")
    narrow = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    loads.publish(narrow.filter(before(CUTOFF)), table)
    loads.append(t.orders.drop("o_orderstatus").filter(~before(CUTOFF)), table, evolve=True)
    return t.spark.table(table)


@query(
    "step_report",
    """
    SELECT l_orderkey AS script_id, count(*) AS steps, count(*) FILTER (WHERE l_returnflag = 'R') AS failed_steps,
           min(l_linenumber) FILTER (WHERE l_returnflag = 'R') AS first_failed_step,
           'Statement #' || (min(l_linenumber) FILTER (WHERE l_returnflag = 'R')) || ' (' ||
           split_part(min(l_linenumber || ':' || CASE l_linestatus WHEN 'F' THEN 'INSERT' ELSE 'UPDATE' END || ':relation ws.t' || l_partkey || ' does not exist')
               FILTER (WHERE l_returnflag = 'R'), ':', 2) || '): ' ||
           split_part(min(l_linenumber || ':' || CASE l_linestatus WHEN 'F' THEN 'INSERT' ELSE 'UPDATE' END || ':relation ws.t' || l_partkey || ' does not exist')
               FILTER (WHERE l_returnflag = 'R'), ':', 3) AS error
    FROM lineitem GROUP BY l_orderkey
    """,
)
def step_report(t):
    """Order lines stand for the statements of a script, returned ones for failures."""
    returned = F.col("l_returnflag") == "R"
    log = t.lineitem.select(
        F.col("l_orderkey").alias("script_id"),
        F.col("l_linenumber").alias("step"),
        F.when(F.col("l_linestatus") == "F", "INSERT").otherwise("UPDATE").alias("kind"),
        F.when(returned, "error").otherwise("success").alias("status"),
        F.when(returned, F.concat(F.lit("relation ws.t"), F.col("l_partkey").cast("string"), F.lit(" does not exist")))
        .alias("message"),
    )
    return loads.step_report(log)
