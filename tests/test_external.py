"""Files of other formats, and the size of files a load writes."""

import pytest
from pyspark.sql import functions as F

from tidemill.operators import loads
from tidemill.session import scratch_path
from tidemill.sources.external import read_files

SCHEMA = "id bigint, name string, at timestamp_ntz"


def some(spark):
    return spark.range(5).selectExpr("id", "if(id = 2, null, concat('n', id)) AS name", "timestamp_ntz'2024-01-01 10:00:00' AS at")


@pytest.mark.parametrize("kind", ["parquet", "json"])
def test_files_are_read_back(spark, kind):
    path = scratch_path(spark, kind)
    some(spark).write.format(kind).save(path)
    assert sorted(map(tuple, read_files(spark, path, kind, SCHEMA).collect())) == sorted(map(tuple, some(spark).collect()))
    found = read_files(spark, path, kind)
    assert set(found.columns) == {"id", "name", "at"} and found.filter("name IS NULL").count() == 1


def test_columns_that_are_absent_are_null(spark):
    path = scratch_path(spark, "json")
    some(spark).write.json(path)
    assert read_files(spark, path, "json", "id bigint, other int").filter("other IS NULL").count() == 5


def test_other_formats_are_refused(spark):
    with pytest.raises(ValueError, match="xml"):
        read_files(spark, "/nowhere", "xml")


@pytest.mark.parametrize("most", [1, 7, 1000])
def test_rows_per_file(spark, new_table, most):
    table = new_table("chunks")
    assert loads.publish(spark.range(50).coalesce(2), table, rows_per_file=most).rows == 50
    sizes = [row["count"] for row in spark.table(table).groupBy(F.col("_metadata.file_name")).count().collect()]
    assert sum(sizes) == 50 and max(sizes) <= most and len(sizes) >= 50 / most


def test_rows_per_file_of_no_rows(spark, new_table):
    table = new_table("chunks")
    loads.publish(spark.range(0), table, rows_per_file=3)
    assert spark.table(table).count() == 0
