"""What tables there are, what columns they have, and whether their references hold."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemill.operators.cleaning import column_profile, profile_of, sql_type_name
from tidemill.sources.footers import is_flat, with_footers


def split_table_name(name: str, default: str | None = None) -> tuple[str | None, str]:
    """``schema.table`` at the first dot; without dot the default schema."""
    head, dot, tail = name.partition(".")
    return (head, tail) if dot else (default, name)


def _wanted(spark: SparkSession, database: str | None, tables: Sequence[str] | None) -> list[tuple[str, str]]:
    """(label, qualified name); None means all tables of the database, an empty list none."""
    if tables is None:
        tables = sorted(t.name for t in spark.catalog.listTables(database) if t.tableType != "TEMPORARY")
    out = []
    for label in tables:
        schema, name = split_table_name(label, database)
        out.append((label, f"{schema}.{name}" if schema else name))
    return out


CATALOG_SCHEMA = "table_name string, position bigint, column string, type string, nullable boolean"


def _profile(spark: SparkSession, name: str, footers: bool) -> DataFrame:
    """Flat columns from footers, where they can be trusted; columns with nested values are read."""
    counted = with_footers(spark, name) if footers and spark.catalog.getTable(name).tableType != "VIEW" else None
    if counted is None:
        return column_profile(spark.table(name))
    fields = list(enumerate(counted.schema.fields, start=1))
    flat = [(i, f) for i, f in fields if is_flat(f.dataType)]
    nested = [(i, f) for i, f in fields if not is_flat(f.dataType)]
    profiles = [profile_of(df, part) for df, part in ((counted, flat), (spark.table(name), nested)) if part]
    return reduce(DataFrame.unionAll, profiles)


def columns(
    spark: SparkSession, database: str | None = None, tables: Sequence[str] | None = None, footers: bool = True
) -> DataFrame:
    """(table_name, position, column, type, nullable), one row per column.

    Files do not declare nullability, so a column counts as nullable when a
    null is found in it: one aggregate per table, all of them in one plan. Footers of Parquet files know how many nulls
    there are, so no data is read for flat columns of tables of which :mod:`tidemill.sources.footers` can tell;
    ``footers=False`` reads all columns, for files written without statistics.
    """
    parts = []
    for label, name in _wanted(spark, database, tables):
        profile = _profile(spark, name, footers)
        parts.append(
            profile.select(
                F.lit(label).alias("table_name"), "position", F.col("name").alias("column"),
                F.col("sql_type").alias("type"), "nullable",
            )
        )
    if not parts:
        return spark.createDataFrame([], CATALOG_SCHEMA)
    return reduce(DataFrame.unionAll, parts)


def tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """(table_name, row_count, column_count, columns, types) of every table in a database; names and types in the same order."""
    parts = []
    for label, name in _wanted(spark, database, None):
        df = spark.table(name)
        parts.append(
            df.agg(F.count(F.lit(1)).alias("row_count")).select(
                F.lit(label).alias("table_name"),
                "row_count",
                F.lit(len(df.columns)).cast("bigint").alias("column_count"),
                F.lit(", ".join(df.columns)).alias("columns"),
                F.lit(", ".join(sql_type_name(f.dataType) for f in df.schema)).alias("types"),
            )
        )
    if not parts:
        return spark.createDataFrame([], "table_name string, row_count bigint, column_count bigint, columns string, types string")
    return reduce(DataFrame.unionAll, parts)


def _nullness(nullable: Column) -> Column:
    return F.when(nullable, "NULL").otherwise("NOT NULL")


def _joined(catalog: DataFrame, entry: Column, separator: str) -> DataFrame:
    """Entries of a table in column order; a group is as long as a table is wide."""
    listed = F.array_sort(F.collect_list(F.struct(F.col("position"), entry.alias("entry"))))
    return catalog.groupBy("table_name").agg(
        F.concat_ws(separator, F.transform(listed, lambda e: e.getField("entry"))).alias("body")
    )


def schema_lines(catalog: DataFrame) -> DataFrame:
    """(table_name, text): one line per table."""
    entry = F.concat(F.col("column"), F.lit(" ("), F.col("type"), F.lit(", "), _nullness(F.col("nullable")), F.lit(")"))
    return _joined(catalog, entry, ", ").select(
        "table_name", F.concat(F.lit("Таблица "), "table_name", F.lit(": "), "body").alias("text")
    )


def schema_blocks(catalog: DataFrame) -> DataFrame:
    """(table_name, text): a heading per table and a line per column."""
    entry = F.concat(
        F.lit("  - "), F.col("column"), F.lit(": "), F.col("type"), F.lit(" ("), _nullness(F.col("nullable")), F.lit(")")
    )
    return _joined(catalog, entry, "\n").select(
        "table_name", F.concat(F.lit("Table: "), "table_name", F.lit("\n"), "body").alias("text")
    )


# -- references --------------------------------------------------------------


@dataclass(frozen=True)
class ForeignKey:
    """A declared reference; Parquet tables hold no constraints of their own."""

    table: str
    column: str
    referred_table: str
    referred_column: str


def orphans(child: DataFrame, parent: DataFrame, fk: ForeignKey) -> DataFrame:
    """One row per reference: keys without parent and rows that carry them (null keys refer to nothing).

    Rows are counted per key before the join, so a key that most rows share
    crosses the network as one row per task.
    """
    used = child.filter(F.col(fk.column).isNotNull()).groupBy(F.col(fk.column).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    lost = used.join(parent.select(F.col(fk.referred_column).alias("k")), "k", "left_anti")
    return lost.agg(
        F.count(F.lit(1)).alias("orphan_keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("orphan_rows")
    ).select(
        F.lit(fk.table).alias("table_name"),
        F.lit(fk.column).alias("column"),
        F.lit(fk.referred_table).alias("referred_table"),
        F.lit(fk.referred_column).alias("referred_column"),
        "orphan_keys",
        "orphan_rows",
    )


# -- preview -----------------------------------------------------------------

_PLAIN = ("boolean", "byte", "short", "integer", "long", "float", "double", "string", "void")


def preview(df: DataFrame, n: int = 500) -> DataFrame:
    """At most ``n`` rows; cells other than numbers, booleans and text become text.

    The limit is part of the plan: no more rows than that are ever fetched.
    """
    cells = []
    for f in df.schema:
        cell = F.col(f"`{f.name}`")
        if f.dataType.typeName() in ("array", "map", "struct", "variant"):
            cell = F.to_json(cell)
        elif f.dataType.typeName() not in _PLAIN:
            cell = cell.cast("string")
        cells.append(cell.alias(f.name))
    return df.limit(n).select(*cells)
