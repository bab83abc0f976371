"""Tables outside the catalog: files of other formats and databases reached by JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ROWS_PER_INSERT = 500


def read_files(spark: SparkSession, path: str, kind: str, schema: str | None = None) -> DataFrame:
    """Parquet or JSON files (``schema`` saves the pass that finds that of JSON)."""
    if kind not in ("parquet", "json"):
        raise ValueError(f"unsupported format: {kind}")
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.format(kind).load(path)


def read_database(
    spark: SparkSession, url: str, table: str, split_by: str | None = None, bounds: tuple[str, str] | None = None, parts: int = 1
) -> DataFrame:
    """A database table; with ``split_by`` and its ``bounds`` it is read by ``parts`` tasks at once.

    Filters and the choice of columns are passed on to the database.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if split_by and bounds:
        reader = reader.options(partitionColumn=split_by, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return reader.load()


def write_database(df: DataFrame, url: str, table: str, replace: bool = False, connections: int = 8) -> None:
    """Append to a database table or replace its rows, a few hundred rows per statement."""
    writer = df.write.format("jdbc").options(
        url=url, dbtable=table, batchsize=ROWS_PER_INSERT, numPartitions=connections, truncate=True
    )
    writer.mode("overwrite" if replace else "append").save()
