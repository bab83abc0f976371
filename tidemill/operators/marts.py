"""Data marts over orders, customers and products.

All of them are lazy plans.  ``as_of`` stands in for the wall clock, so that a
mart gives the same rows whenever it is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemill.functions.scalars import money


def recent_orders(orders: DataFrame, as_of: Column, days: int = 30, date_col: str = "o_orderdate") -> DataFrame:
    """Orders dated at most ``days`` days before ``as_of`` (that day included)."""
    return orders.filter(F.col(date_col) >= as_of - F.expr(f"INTERVAL {days} DAYS"))


def totals_by_user(orders: DataFrame) -> DataFrame:
    return orders.groupBy(F.col("o_custkey").alias("user_id")).agg(
        F.sum(money("o_totalprice")).cast("double").alias("total_amount")
    )


def orders_with_user_names(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """No join hint: the planner broadcasts the users only when their size allows it
    and adaptive execution splits the partitions of users with very many orders."""
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.col("c_name").alias("name"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderstatus").alias("status"),
    )


def completed_orders(orders: DataFrame, status: str = "F") -> DataFrame:
    return orders.filter(F.col("o_orderstatus") == status)


def avg_check_by_category(parts: DataFrame) -> DataFrame:
    price = money("p_retailprice")
    return parts.groupBy(F.col("p_type").alias("category")).agg(
        F.round(F.sum(price).cast("double") / F.count(price), 6).alias("avg_check")
    )


def orders_by_month(orders: DataFrame) -> DataFrame:
    month = F.date_format("o_orderdate", "yyyy-MM").alias("order_month")
    return (
        orders.groupBy(month)
        .agg(
            F.count(F.lit(1)).alias("orders_count"),
            F.sum(money("o_totalprice")).cast("double").alias("total_amount"),
        )
        .orderBy("order_month")
    )


def top_users(orders: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` users with the greatest sum; equal sums go to the smaller key."""
    return totals_by_user(orders).orderBy(F.desc("total_amount"), "user_id").limit(n)


def users_in_category(
    customers: DataFrame, orders: DataFrame, lineitems: DataFrame, parts: DataFrame, category: str
) -> DataFrame:
    """Distinct users who ordered a product of ``category``.

    Semi joins keep each step to a set of keys: no row is multiplied on the way
    and no final DISTINCT over wide rows is needed.  Keys are made distinct
    before each shuffle, so a user or order with very many rows weighs no more
    than any other.
    """
    part_keys = parts.filter(F.col("p_type") == category).select("p_partkey")
    order_keys = lineitems.join(part_keys, F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("l_orderkey").distinct()
    user_keys = orders.join(order_keys, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_custkey").distinct()
    return customers.join(user_keys, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.col("c_nationkey").alias("nation_id"),
        F.col("c_mktsegment").alias("segment"),
    )
