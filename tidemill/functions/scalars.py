"""Single values brought to the driver as typed literals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def scalar_literal(df: DataFrame, aggregate: Column) -> Column | None:
    """The value of one aggregate over ``df`` as a literal of the same type, or None.

    It travels as text, so that no time zone is applied on the way; the cast of
    a constant is folded, which leaves a plain column-vs-literal filter that
    reaches the Parquet scan.
    """
    row = df.agg(aggregate.alias("v"))
    kind = row.schema["v"].dataType
    value = row.select(F.col("v").cast("string")).first()[0]
    return None if value is None else F.lit(value).cast(kind)


def money(column: str | Column) -> Column:
    """Amounts are summed as decimals, so the order of addition cannot change them."""
    column = F.col(column) if isinstance(column, str) else column
    return column.cast("decimal(18,2)")
