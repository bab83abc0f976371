"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemill.session import Materialized, materialize


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def _star(edges: DataFrame, downwards: bool) -> DataFrame:
    """Hang neighbours of every node on the smallest of them.

    Upwards: the larger neighbours of a node; downwards: the node itself and its smaller neighbours.
    Minima are aggregated first and joined back, so that a node with very many neighbours is
    one row in the aggregate and can be split in the join.
    """
    if downwards:
        least = edges.groupBy("a").agg(F.min("b").alias("least"))
        hung = edges.join(least, "a")
        pairs = hung.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
    else:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least"))
        least = least.select("a", F.least("a", "least").alias("least"))
        pairs = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return pairs.where("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node it is connected to, for every node that is not its own root.

    ``edges`` has columns ``a`` and ``b`` of one ordered type; direction, repeats and loops do
    not matter. Large stars and small stars take turns until nothing changes;
    the rounds needed grow with the logarithm of the longest path. Each round is written to the scratch folder.
    """
    current: Materialized = materialize(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges"
    )
    before = _signature(current.rows)
    while current.count:
        following = materialize(_star(_star(current.rows, downwards=False), downwards=True), "edges")
        after = _signature(following.rows)
        current.drop()
        current = following
        if after == before:
            break
        before = after
    return current.rows.select(F.col("a").alias("node"), F.col("b").alias("root"))
