from tidemill.operators import loads
from tidemill.session import scratch_path
from tidemill.streaming import incremental

SCHEMA = "id int, day int, v string"


def test_a_stream_is_taken_once(spark, new_table, tmp_path):
    table, upserts = new_table("log"), new_table("state")
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, 1, "a"), (2, 2, "b")], SCHEMA).coalesce(1).write.parquet(source)
    empty = spark.createDataFrame([], SCHEMA)
    loads.publish(empty, table)
    loads.publish(empty, upserts)
    checkpoints = [scratch_path(spark, "stream") for _ in range(2)]

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        incremental.append_new(stream, table, "day", ["id"], checkpoints[0]).awaitTermination()
        incremental.upsert_new(stream, upserts, ["id"], ["day"], checkpoints[1]).awaitTermination()

    run()
    run()
    assert spark.table(table).count() == 2
    spark.createDataFrame([(3, 3, "c"), (2, 3, "b2")], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    run()
    assert spark.table(table).count() == 4
    assert sorted((r["id"], r["v"]) for r in spark.table(upserts).collect()) == [(1, "a"), (2, "b2"), (3, "c")]
