"""Named queries on CSV intake and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions.names import table_name_column
from tidemill.functions.text import NULL_TOKENS
from tidemill.operators import cleaning
from tidemill.plans.derived import VIEWS, view, with_views
from tidemill.plans.loads import scratch_table
from tidemill.plans.registry import query
from tidemill.session import scratch_path
from tidemill.sources import catalog, csv

# Customers as a careless export would give them: padded, with tokens for
# missing values, mixed dates, repeated rows, empty rows and an empty column.
VIEWS["messy_customers"] = """
SELECT CAST(c_custkey AS STRING) AS customer_id,
       CASE c_custkey % 5 WHEN 0 THEN '  ' || c_name WHEN 1 THEN c_name || '   '
                          WHEN 2 THEN chr(160) || c_name || chr(9) ELSE c_name END AS full_name,
       CASE c_custkey % 9 WHEN 4 THEN 'NULL' ELSE CAST(c_nationkey AS STRING) END AS nation_key,
       CASE c_custkey % 7 WHEN 0 THEN 'NA' ELSE CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS STRING) END AS acct_bal,
       CASE c_custkey % 11 WHEN 0 THEN '' WHEN 3 THEN 'n/a' WHEN 4 THEN ' NA ' WHEN 5 THEN '   '
                           ELSE c_mktsegment END AS segment,
       CASE c_custkey % 2 WHEN 0 THEN iso_day
            ELSE substr(iso_day, 9, 2) || '.' || substr(iso_day, 6, 2) || '.' || substr(iso_day, 1, 4) END AS signup_date,
       CASE WHEN c_acctbal < 0 THEN 'closed, debt' ELSE 'active' END AS status,
       CAST(NULL AS STRING) AS notes
FROM (SELECT *, CAST(DATE '2020-01-01' + CAST(c_custkey % 900 AS INT) AS STRING) AS iso_day FROM {customer}) AS c
"""

VIEWS["messy_export"] = """
SELECT * FROM {messy_customers}
UNION ALL SELECT * FROM {messy_customers} WHERE status = 'closed, debt'
UNION ALL SELECT CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING),
                 CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING) FROM {nation}
"""

# Headers of the file, in the order of the view's columns.
HEADERS = ["Customer ID", " Full  Name ", "Nation/Key", "Acct-Bal", "Ségment", "Signup Date", "status", "Notes!"]
CLEAN_NAMES = [
    "customer_id", "full_name", "nation_key", "acct_bal", "segment", "signup_date", "status", "notes",
]

_TOKENS = ", ".join(f"'{token}'" for token in NULL_TOKENS)


def _tokens(expr: str) -> str:
    return f"CASE WHEN {expr} IN ({_TOKENS}) THEN NULL ELSE {expr} END"


def _trimmed(expr: str) -> str:
    return f"nullif(regexp_replace({expr}, '^[ \\t\\n\\r\\x{{A0}}]+|[ \\t\\n\\r\\x{{A0}}]+$', '', 'g'), '')"


def _each(expr, names=CLEAN_NAMES, aliases=None) -> str:
    return ", ".join(f'{expr(n)} AS "{a}"' for n, a in zip(names, aliases or names))


_DAY = (
    "CASE WHEN signup_date LIKE '____-__-__' THEN CAST(signup_date AS TIMESTAMP) "
    "ELSE strptime(signup_date, '%d.%m.%Y') END"
)

TYPED = f"""
    SELECT CAST({_trimmed(_tokens('customer_id'))} AS BIGINT) AS customer_id,
           {_trimmed(_tokens('full_name'))} AS full_name,
           CAST({_trimmed(_tokens('nation_key'))} AS BIGINT) AS nation_key,
           CAST({_trimmed(_tokens('acct_bal'))} AS DOUBLE) AS acct_bal,
           {_trimmed(_tokens('segment'))} AS segment,
           {_DAY} AS signup_date,
           {_trimmed(_tokens('status'))} AS status
    FROM messy_export WHERE customer_id IS NOT NULL
"""


def export(t, **options) -> str:
    """The messy export written as CSV below the scratch folder."""
    path = scratch_path(t.spark, "export.csv")
    view(t, "messy_export").toDF(*HEADERS).write.options(
        header=True, sep=";", quote='"', escape='"', emptyValue="", nullValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, **options,
    ).csv(path)
    return path


@query(
    "csv_scan",
    with_views("messy_export")
    + f"""SELECT {_each(lambda c: f"nullif({c}, '')", aliases=HEADERS)} FROM messy_export""",
)
def csv_scan(t):
    """Encoding, delimiter and header are found; all cells arrive as text."""
    return csv.scan(t.spark, export(t)).rows


@query(
    "csv_quoted_breaks",
    "SELECT CAST(doc_id AS VARCHAR) AS doc_id, nullif(source, '') AS source, nullif(lang, '') AS lang, nullif(text, '') AS text FROM documents",
)
def csv_quoted_breaks(t):
    """Documents as CSV, line breaks inside their cells, read back by as many tasks as the files have splits."""
    path = scratch_path(t.spark, "documents.csv")
    t.documents.select("doc_id", "source", "lang", "text").write.options(
        header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)
    return csv.scan(t.spark, path, multiline=True, encoding=csv.UTF8).rows


@query("csv_null_tokens", with_views("messy_export") + f"SELECT {_each(_tokens)} FROM messy_export")
def csv_null_tokens(t):
    return cleaning.null_tokens(view(t, "messy_export"))


@query(
    "csv_intake",
    """
    SELECT 'csv/' || c_mktsegment AS folder, 'accepted' AS verdict FROM customer GROUP BY c_mktsegment
    UNION ALL
    SELECT 'text/' || c_mktsegment, 'not a .csv file' FROM customer GROUP BY c_mktsegment
    """,
)
def csv_intake(t):
    """Exports per segment, some of them not CSV: verdict per folder."""
    root = scratch_path(t.spark, "intake")
    rows = t.customer.withColumn("part", F.concat(F.lit("csv-"), "c_mktsegment"))
    rows.write.partitionBy("part").csv(f"{root}/csv", header=True)
    t.customer.select(
        F.concat_ws(" ", "c_custkey", "c_name").alias("value"), F.concat(F.lit("text-"), "c_mktsegment").alias("part")
    ).write.partitionBy("part").text(f"{root}/text")
    folder = F.regexp_replace(F.regexp_extract("file", "part=([^/]*)/", 1), "-", "/")
    return (
        csv.intake(t.spark, root)
        .select(folder.alias("folder"), F.coalesce("reason", F.lit("accepted")).alias("verdict"))
        .distinct()
    )


@query(
    "csv_table_names",
    """
    SELECT p_partkey AS file_id,
           trim(regexp_replace(regexp_replace(lower(p_name || ' ' || p_brand), '[ /-]+', '_', 'g'), '[^a-z0-9_]', '', 'g'), '_')
           || CASE WHEN p_type = 'PROMO' THEN '_promo' ELSE '' END AS table_name
    FROM part
    """,
)
def csv_table_names(t):
    """Uploads named after parts; an explicit name is given for some."""
    label = F.concat_ws(" ", "p_name", "p_brand")
    explicit = F.when(F.col("p_type") == "PROMO", F.concat(label, F.lit(" / Promo")))
    path = F.concat(F.lit("/uploads/2024/"), label, F.lit(".CSV"))
    return t.part.select(F.col("p_partkey").alias("file_id"), table_name_column(explicit, path).alias("table_name"))


@query(
    "clean_empty_rows",
    with_views("messy_export") + "SELECT * FROM messy_export WHERE customer_id IS NOT NULL",
)
def clean_empty_rows(t):
    return cleaning.drop_empty_rows(view(t, "messy_export"))


@query("clean_empty_cols", with_views("messy_export") + "SELECT * EXCLUDE (notes) FROM messy_export")
def clean_empty_cols(t):
    return cleaning.drop_empty_columns(view(t, "messy_export"))[0]


@query(
    "clean_names",
    with_views("messy_export") + 'SELECT * EXCLUDE (notes), notes AS customer_id_1 FROM messy_export',
)
def clean_names(t):
    """The last header meets the first one once both are normalised."""
    return cleaning.normal_names(view(t, "messy_export").toDF(*HEADERS[:-1], "customer-id"))


@query("clean_trim", with_views("messy_export") + f"SELECT {_each(_trimmed)} FROM messy_export")
def clean_trim(t):
    return cleaning.trim_cells(view(t, "messy_export"))


@query(
    "clean_infer_dates",
    with_views("messy_export")
    + f"SELECT {_DAY} AS signup_date, CAST(customer_id AS BIGINT) AS customer_id, nullif(status, '') AS status FROM messy_export",
)
def clean_infer_dates(t):
    """Two date formats in a column; ``status`` stays text."""
    return cleaning.infer_types(view(t, "messy_export").select("signup_date", "customer_id", "status"))


@query(
    "clean_infer_numbers",
    with_views("messy_export")
    + f"""
    SELECT CAST({_tokens('nation_key')} AS BIGINT) AS nation_key, CAST({_tokens('acct_bal')} AS DOUBLE) AS acct_bal,
           full_name_key FROM (
        SELECT *, {_trimmed("customer_id || ' ' || segment")} AS full_name_key FROM messy_export)
    """,
)
def clean_infer_numbers(t):
    """Whole columns become numbers; a column of digits and words stays text."""
    mixed = F.concat("customer_id", F.lit(" "), "segment").alias("full_name_key")
    return cleaning.infer_types(cleaning.null_tokens(view(t, "messy_export").select("nation_key", "acct_bal", mixed)))


@query("clean_dedup_rows", with_views("messy_export") + "SELECT DISTINCT * FROM messy_export")
def clean_dedup_rows(t):
    return cleaning.drop_repeated_rows(view(t, "messy_export"))


@query("csv_load", with_views("messy_export") + "SELECT DISTINCT * FROM (" + TYPED + ")")
def csv_load(t):
    """The export, loaded twice under one name: read back from the table."""
    database, _, name = scratch_table(t, "customers").partition(".")
    path = export(t)
    for _ in range(2):
        report = csv.load(t.spark, path, name, database)
    return t.spark.table(report.table)


@query(
    "csv_load_report",
    with_views("messy_export")
    + f"""
    SELECT 'Удалено 1 полностью пустых столбца(-ов). | Удалено ' || (count(*) - count(DISTINCT customer_id))
           || ' дублирующихся строк.' AS warnings,
           count(DISTINCT customer_id) AS rows_loaded, FALSE AS replaced_existing, CAST(7 AS BIGINT) AS column_count
    FROM ({TYPED})
    """,
)
def csv_load_report(t):
    database, _, name = scratch_table(t, "customers").partition(".")
    report = csv.load(t.spark, export(t), name, database)
    loaded = t.spark.table(report.table)
    return loaded.limit(1).select(
        F.lit(" | ".join(report.warnings)).alias("warnings"),
        F.lit(report.rows).cast("bigint").alias("rows_loaded"),
        F.lit(report.replaced_existing).alias("replaced_existing"),
        F.lit(len(loaded.columns)).cast("bigint").alias("column_count"),
    )


PROFILE_SQL = (
    with_views("messy_export")
    + f"""
    , typed AS ({TYPED})
    SELECT CAST(1 AS BIGINT) AS position, 'customer_id' AS name, 'BIGINT' AS sql_type, bool_or(customer_id IS NULL) AS nullable FROM typed
    UNION ALL SELECT 2, 'full_name', 'TEXT', bool_or(full_name IS NULL) FROM typed
    UNION ALL SELECT 3, 'nation_key', 'BIGINT', bool_or(nation_key IS NULL) FROM typed
    UNION ALL SELECT 4, 'acct_bal', 'DOUBLE PRECISION', bool_or(acct_bal IS NULL) FROM typed
    UNION ALL SELECT 5, 'segment', 'TEXT', bool_or(segment IS NULL) FROM typed
    UNION ALL SELECT 6, 'signup_date', 'TIMESTAMP', bool_or(signup_date IS NULL) FROM typed
    UNION ALL SELECT 7, 'status', 'TEXT', bool_or(status IS NULL) FROM typed
    """
)


@query("csv_load_columns", PROFILE_SQL)
def csv_load_columns(t):
    """The columns of a load's report, read as the catalog shows them: nulls are counted in the footers of the loaded files."""
    database, _, name = scratch_table(t, "customers").partition(".")
    report = csv.load(t.spark, export(t), name, database)
    shown = catalog.columns(t.spark, tables=[report.table])
    reported = t.spark.createDataFrame([(c.name,) for c in report.columns], "name string")
    return shown.withColumnRenamed("column", "name").join(reported, "name", "left_semi").select(
        "position", "name", F.col("type").alias("sql_type"), "nullable"
    )


@query("column_profile", PROFILE_SQL)
def column_profile(t):
    return cleaning.column_profile(cleaning.clean(view(t, "messy_export").toDF(*HEADERS)).rows)
