"""Neighbouring rows of a key in time order, without one task per key.

A plain ``lag`` over ``PARTITION BY key`` sorts all rows of a key in one task,
however many they are.  Keys that hold a large share of the rows are therefore
cut into time slices; neighbours are found inside a slice, and the one that
lies in another slice comes from the rows at the edges, one per (key, slice).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import Row, StructType

QUANTILES = 64
SLICES_PER_QUANTILE = 256


@dataclass(frozen=True)
class HotKeys:
    """Keys with many rows and quantiles of the time of their rows."""

    rows: list[Row]
    schema: StructType
    bounds: list[int]

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def hot_keys(df: DataFrame, key: Sequence[str], ts: str, limit: int | None = None) -> HotKeys | None:
    """Keys with more than ``1 / limit`` of all rows; None if there is no such key.

    By their definition there are fewer than ``limit`` of them, which bounds
    what comes to the driver and what is broadcast later.  Without ``limit``
    it is twice the number of shuffle partitions.  Only the key and time columns
    are read.
    """
    spark = df.sparkSession
    limit = limit or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = df.count()
    if total <= limit:
        return None
    least = total // limit
    counted = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > least).drop("_n")
    rows = counted.collect()
    if not rows:
        return None
    hot = F.broadcast(spark.createDataFrame(rows, counted.schema))
    moments = df.select(*key, micros(ts).cast("double").alias("_t")).join(hot, list(key), "left_semi")
    shares = [i / QUANTILES for i in range(QUANTILES + 1)]
    found = moments.approxQuantile("_t", shares, 1 / (4 * QUANTILES))
    return HotKeys(rows, counted.schema, sorted({int(b) for b in found}))


def _place(value: Column, bounds: Sequence[int], low: int, high: int) -> Column:
    """Slice number of ``value``: the quantile it lies in, found by a tree of comparisons, and the
    part of that quantile's time span."""
    if low == high:
        if low in (0, len(bounds)):
            return F.lit(low * SLICES_PER_QUANTILE)
        start, end = bounds[low - 1], bounds[low]
        part = F.floor((value - F.lit(start)) / F.lit(float(end - start)) * SLICES_PER_QUANTILE)
        return F.lit(low * SLICES_PER_QUANTILE) + F.least(part, F.lit(SLICES_PER_QUANTILE - 1)).cast("int")
    middle = (low + high) // 2
    return F.when(value < F.lit(bounds[middle]), _place(value, bounds, low, middle)).otherwise(
        _place(value, bounds, middle + 1, high)
    )


def with_time_slice(df: DataFrame, ts: str, hot: HotKeys, name: str = "_slice") -> DataFrame:
    """Adds the number of the time slice of a row; ``df`` holds rows of hot keys alone."""
    return df.withColumn(name, _place(micros(ts), hot.bounds, 0, len(hot.bounds)))


def with_neighbour(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    values: Sequence[str],
    name: str,
    ahead: bool = False,
    sliced: bool = True,
) -> DataFrame:
    """Adds struct ``name`` with ``values`` of the previous (or next) row of the key; null at the end.

    ``order`` must be total within a key.  With ``sliced`` the rows carry
    ``_slice`` numbers that rise with ``order``.
    """
    step, other = (F.lead, F.lag) if ahead else (F.lag, F.lead)
    if not sliced:
        return df.withColumn(name, step(F.struct(*values)).over(Window.partitionBy(*key).orderBy(*order)))
    group = [*key, "_slice"]
    within = Window.partitionBy(*group).orderBy(*order)
    inside = df.withColumns({name: step(F.struct(*values)).over(within), "_last": other(F.lit(1)).over(within).isNull()})
    edges = inside.filter("_last").select(*group, F.struct(*values).alias("_edge"))
    across = edges.withColumn("_edge", step("_edge").over(Window.partitionBy(*key).orderBy("_slice")))
    joined = inside.drop("_last").join(across, group, "left")
    return joined.withColumn(name, F.coalesce(name, "_edge")).drop("_edge")
