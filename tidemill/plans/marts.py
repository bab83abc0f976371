"""Named mart queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions.scalars import scalar_literal
from tidemill.operators import marts
from tidemill.plans.registry import query


@query(
    "mart_recent_orders",
    """
    SELECT * FROM orders
    WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY
    """,
)
def mart_recent_orders(t):
    return marts.recent_orders(t.orders, scalar_literal(t.orders, F.max("o_orderdate")))


@query(
    "mart_totals_by_user",
    """
    SELECT o_custkey AS user_id,
           CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_amount
    FROM orders GROUP BY o_custkey
    """,
)
def mart_totals_by_user(t):
    return marts.totals_by_user(t.orders)


@query(
    "mart_orders_with_user_names",
    """
    SELECT o_orderkey AS id, o_custkey AS user_id, c_name AS name, o_totalprice AS amount,
           o_orderdate AS created_at, o_orderstatus AS status
    FROM orders JOIN customer ON c_custkey = o_custkey
    """,
)
def mart_orders_with_user_names(t):
    return marts.orders_with_user_names(t.orders, t.customer)


@query("mart_completed_orders", "SELECT * FROM orders WHERE o_orderstatus = 'F'")
def mart_completed_orders(t):
    return marts.completed_orders(t.orders)


@query(
    "mart_avg_check_by_category",
    """
    SELECT p_type AS category,
           round(CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) / count(p_retailprice), 6) AS avg_check
    FROM part GROUP BY p_type
    """,
)
def mart_avg_check_by_category(t):
    return marts.avg_check_by_category(t.part)


@query(
    "mart_orders_by_month",
    """
    SELECT strftime(o_orderdate, '%Y-%m') AS order_month, count(*) AS orders_count,
           CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_amount
    FROM orders GROUP BY 1 ORDER BY 1
    """,
)
def mart_orders_by_month(t):
    return marts.orders_by_month(t.orders)


@query(
    "mart_top10_users",
    """
    SELECT o_custkey AS user_id,
           CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_amount
    FROM orders GROUP BY o_custkey ORDER BY total_amount DESC, user_id LIMIT 10
    """,
)
def mart_top10_users(t):
    return marts.top_users(t.orders)


@query(
    "mart_users_in_category",
    """
    SELECT DISTINCT c_custkey AS id, c_name AS name, c_nationkey AS nation_id, c_mktsegment AS segment
    FROM customer
    JOIN orders ON o_custkey = c_custkey
    JOIN lineitem ON l_orderkey = o_orderkey
    JOIN part ON p_partkey = l_partkey
    WHERE p_type = 'PROMO'
    """,
)
def mart_users_in_category(t):
    return marts.users_in_category(t.customer, t.orders, t.lineitem, t.part, "PROMO")
