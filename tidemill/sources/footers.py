"""Counts of rows and values from the footers of Parquet files, without reading a page of data.

Spark pushes counts down to footers if a table is read through its newer reader and every file holds the
columns of the table in their order, as it looks values up by position. That is known of tables whose rows
come from one snapshot of :mod:`tidemill.operators.loads` (they carry a mark) and of tables of one file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from tidemill.operators.loads import described, is_uniform, partition_columns

_V1_SOURCES = "spark.sql.sources.useV1SourceList"


def _is_one_column(kind: DataType) -> bool:
    """Whether Parquet keeps a column in one piece."""
    if isinstance(kind, ArrayType):
        return _is_one_column(kind.elementType)
    return not isinstance(kind, (MapType, StructType, VariantType))


def is_flat(kind: DataType) -> bool:
    return _is_one_column(kind) and not isinstance(kind, ArrayType)


def _only_file(spark: SparkSession, location: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(location)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return sum(status.getPath().getName()[0] not in "._" for status in files) == 1


def with_footers(spark: SparkSession, table: str) -> DataFrame | None:
    """``table`` read so that counts of its flat columns come from footers; None where they could be wrong.

    Sets ``spark.sql.parquet.aggregatePushdown`` on the session, which other reads do not heed.
    """
    schema = spark.table(table).schema
    if described(spark, table, "Provider") != "parquet" or partition_columns(spark, table):
        return None
    if not all(_is_one_column(f.dataType) for f in schema):
        return None
    location = described(spark, table, "Location")
    if not is_uniform(spark, table):
        if not _only_file(spark, location):
            return None
        stored = spark.read.parquet(location).schema
        if [(f.name, f.dataType) for f in stored] != [(f.name, f.dataType) for f in schema]:
            return None
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    before = spark.conf.get(_V1_SOURCES)
    spark.conf.set(_V1_SOURCES, ",".join(name for name in before.split(",") if name.strip() != "parquet"))
    try:
        return spark.read.schema(schema).parquet(location)
    finally:
        spark.conf.set(_V1_SOURCES, before)
