"""Named queries on the catalog."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemill.operators import marts
from tidemill.plans.registry import query
from tidemill.session import scratch_database, scratch_path
from tidemill.sources import catalog
from tidemill.sources.external import read_files

# The given tables and their columns with the type they are reported with.
COLUMNS = {
    "region": "r_regionkey BIGINT, r_name TEXT",
    "nation": "n_nationkey BIGINT, n_name TEXT, n_regionkey BIGINT",
    "customer": "c_custkey BIGINT, c_name TEXT, c_nationkey BIGINT, c_acctbal DOUBLE PRECISION, c_mktsegment TEXT",
    "supplier": "s_suppkey BIGINT, s_name TEXT, s_nationkey BIGINT, s_acctbal DOUBLE PRECISION",
    "part": "p_partkey BIGINT, p_name TEXT, p_brand TEXT, p_type TEXT, p_size BIGINT, p_retailprice DOUBLE PRECISION",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus TEXT, o_totalprice DOUBLE PRECISION, "
    "o_orderdate TIMESTAMP, o_orderpriority TEXT",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber BIGINT, "
    "l_quantity DOUBLE PRECISION, l_extendedprice DOUBLE PRECISION, l_discount DOUBLE PRECISION, "
    "l_tax DOUBLE PRECISION, l_returnflag TEXT, l_linestatus TEXT, l_shipdate TIMESTAMP",
    "events": "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type TEXT, value DOUBLE PRECISION, props TEXT",
    "documents": "doc_id BIGINT, text TEXT, lang TEXT, source TEXT, n_chars BIGINT",
    "labels": "doc_id BIGINT, quality BIGINT, toxic BIGINT",
    "conversations": "conv_id BIGINT, turn BIGINT, role TEXT, text TEXT",
    "pages": "page_id BIGINT, url TEXT, html TEXT",
    "benchmark": "item_id BIGINT, text TEXT",
    "embeddings": "vec_id BIGINT, embedding TEXT, label BIGINT",
}


def _columns_sql() -> str:
    parts = []
    for table, columns in COLUMNS.items():
        for position, entry in enumerate(columns.split(", "), start=1):
            name, _, kind = entry.partition(" ")
            parts.append(
                f"SELECT '{table}' AS table_name, CAST({position} AS BIGINT) AS position, '{name}' AS \"column\", "
                f"'{kind}' AS type, coalesce(bool_or({name} IS NULL), FALSE) AS nullable FROM {table}"
            )
    return " UNION ALL ".join(parts)


def _work_database(t) -> str:
    """A database with one external table per given file."""
    name = scratch_database(t.spark, f"work_{uuid.uuid4().hex[:12]}")
    for table in COLUMNS:
        t.spark.catalog.createTable(f"{name}.{table}", path=f"{t.sf_dir}/{table}.parquet", source="parquet")
    return name


@query(
    "catalog_tables",
    " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, count(*) AS row_count, CAST({len(columns.split(', '))} AS BIGINT) AS column_count, "
        f"'{', '.join(c.split(' ')[0] for c in columns.split(', '))}' AS columns, "
        f"'{', '.join(c.partition(' ')[2] for c in columns.split(', '))}' AS types FROM {table}"
        for table, columns in COLUMNS.items()
    ),
)
def catalog_tables(t):
    return catalog.tables(t.spark, _work_database(t))


@query("catalog_columns", _columns_sql())
def catalog_columns(t):
    return catalog.columns(t.spark, _work_database(t))


@query(
    "schema_text",
    f"""
    WITH c AS ({_columns_sql()})
    SELECT table_name, 'lines' AS layout, 'Таблица ' || table_name || ': ' ||
           string_agg("column" || ' (' || type || ', ' || CASE WHEN nullable THEN 'NULL' ELSE 'NOT NULL' END || ')', ', '
                      ORDER BY position) AS text
    FROM c GROUP BY table_name
    UNION ALL
    SELECT table_name, 'blocks', 'Table: ' || table_name || chr(10) ||
           string_agg('  - ' || "column" || ': ' || type || ' (' || CASE WHEN nullable THEN 'NULL' ELSE 'NOT NULL' END || ')',
                      chr(10) ORDER BY position)
    FROM c GROUP BY table_name
    """,
)
def schema_text(t):
    columns = catalog.columns(t.spark, _work_database(t))
    lines = catalog.schema_lines(columns).select("table_name", F.lit("lines").alias("layout"), "text")
    blocks = catalog.schema_blocks(columns).select("table_name", F.lit("blocks").alias("layout"), "text")
    return lines.unionAll(blocks)


def _orphans_sql(child, column, parent, key, condition) -> str:
    return f"""
    SELECT '{child}' AS table_name, '{column}' AS "column", '{parent}' AS referred_table, '{key}' AS referred_column,
           count(DISTINCT {column}) AS orphan_keys, count(*) AS orphan_rows
    FROM {child} WHERE {column} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} WHERE {key} = {column} AND {condition})
    """


@query(
    "fk_orphans",
    " UNION ALL ".join(
        [
            _orphans_sql("orders", "o_custkey", "customer", "c_custkey", "c_acctbal >= 0"),
            _orphans_sql("lineitem", "l_partkey", "part", "p_partkey", "p_type <> 'PROMO'"),
            _orphans_sql("lineitem", "l_suppkey", "supplier", "s_suppkey", "s_acctbal >= 0"),
            _orphans_sql("lineitem", "l_orderkey", "orders", "o_orderkey", "TRUE"),
        ]
    ),
)
def fk_orphans(t):
    """References to parents of which some were removed."""
    cases = [
        (t.orders, t.customer.filter("c_acctbal >= 0"), ("orders", "o_custkey", "customer", "c_custkey")),
        (t.lineitem, t.part.filter("p_type <> 'PROMO'"), ("lineitem", "l_partkey", "part", "p_partkey")),
        (t.lineitem, t.supplier.filter("s_acctbal >= 0"), ("lineitem", "l_suppkey", "supplier", "s_suppkey")),
        (t.lineitem, t.orders, ("lineitem", "l_orderkey", "orders", "o_orderkey")),
    ]
    found = [catalog.orphans(child, parent, catalog.ForeignKey(*names)) for child, parent, names in cases]
    return found[0].unionAll(found[1]).unionAll(found[2]).unionAll(found[3])


@query(
    "preview_rows",
    """
    SELECT o_orderkey AS id, o_custkey AS user_id, c_name AS name, o_totalprice AS amount,
           CAST(o_orderdate AS VARCHAR) AS created_at, o_orderstatus AS status
    FROM orders JOIN customer ON c_custkey = o_custkey ORDER BY o_orderkey LIMIT 500
    """,
)
def preview_rows(t):
    """The first rows of a script's last result."""
    return catalog.preview(marts.orders_with_user_names(t.orders, t.customer).orderBy("id"))


@query("files_json", "SELECT doc_id, lang, source, n_chars, text FROM documents")
def files_json(t):
    """A table written as JSON lines and read back with a schema, so that no pass is needed to find one."""
    path = scratch_path(t.spark, "json")
    t.documents.write.json(path)
    return read_files(t.spark, path, "json", "doc_id bigint, lang string, source string, n_chars bigint, text string")
