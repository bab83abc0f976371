"""Named queries on task descriptions and model responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import fixed
from tidemill.operators import classify, prompts, responses
from tidemill.plans.catalog import _columns_sql, _work_database
from tidemill.plans.derived import VIEWS, view, with_views
from tidemill.plans.registry import query
from tidemill.sources import catalog


def sql_text(text: str) -> str:
    """A SQL string literal; line breaks are written as chr(10)."""
    return "(" + " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in text.split("\n")) + ")"


# Descriptions: a request in front of the whole text of a document or of a turn of a conversation.
VIEWS["task_texts"] = """
SELECT id, output_format, source_set,
       CASE id % 13
            WHEN 0 THEN 'Построй ежедневную витрину продаж с агрегацией по регионам. '
            WHEN 1 THEN 'Загрузи инкрементально новые записи заказов за последние сутки '
            WHEN 2 THEN 'Реализуй SCD2 для таблицы клиентов — храни историю изменений адреса: '
            WHEN 3 THEN 'Удали дубликаты из таблицы пользователей, оставь уникальные записи. '
            WHEN 4 THEN 'Merge данные: вставить новые строки или обновить существующие по ключу в таблицу ' || chr(39) || 'dwh.clients' || chr(39) || ' '
            WHEN 5 THEN 'Перенеси старые заказы в архив orders_archive, target = orders_archive; '
            WHEN 6 THEN 'Полная перезагрузка справочника продуктов, insert into etl_workspace.products_ref: '
            WHEN 7 THEN 'Создай таблицу mart_daily_sales из заказов за сегодня. '
            WHEN 8 THEN 'Delta append, changed since yesterday; on conflict upsert. COUNT and SUM per country, monthly report '
            WHEN 9 THEN 'Целевая: stage_orders; truncate, overwrite '
            WHEN 10 THEN 'Slowly changing dimension (scd type 2), DISTINCT rows by row_number, в витрину mart_v1 '
            WHEN 11 THEN 'Сделай что-нибудь с данными. '
            ELSE '' END || body AS description
FROM (
    SELECT doc_id * 2 AS id, text AS body, CASE doc_id % 3 WHEN 0 THEN 'sql' WHEN 1 THEN 'python' ELSE 'airflow_dag' END AS output_format,
           doc_id % 4 AS source_set
    FROM {documents}
    UNION ALL
    SELECT (conv_id * 1000 + turn) * 2 + 1 AS id, text AS body,
           CASE role WHEN 'user' THEN 'sql' WHEN 'assistant' THEN 'python' ELSE 'airflow_dag' END AS output_format,
           turn % 4 AS source_set
    FROM {conversations}
) AS bodies
"""

# Model responses: each turn of a conversation as code, fenced in one way or another.
VIEWS["responses"] = """
SELECT conv_id * 1000 + turn AS id,
       CASE role WHEN 'user' THEN 'python' ELSE 'sql' END AS expected_language,
       CASE (conv_id + turn) % 10
            WHEN 0 THEN 'Here it is:' || chr(10) || f || 'sql' || chr(10) || '  ' || text || chr(10) || f || chr(10) || 'Done.'
            WHEN 1 THEN f || 'python' || chr(10) || text || chr(10) || f
            WHEN 2 THEN f || 'sqlite' || chr(10) || text || chr(10) || f
            WHEN 3 THEN f || 'SQL' || chr(10) || text || chr(10) || f
            WHEN 4 THEN f || chr(10) || text || chr(10) || f
            WHEN 5 THEN text
            WHEN 6 THEN text || chr(10) || f || 'sql' || chr(10) || f
            WHEN 7 THEN f || 'yaml' || chr(10) || 'a: 1' || chr(10) || f || chr(10) || f || 'sql' || chr(10) || text || f
            WHEN 8 THEN f || 'python3' || chr(10) || text || chr(10) || f
            ELSE f || 'sql SELECT 1' || chr(10) || '-- ' || text || f || chr(10) || f || 'sql' || chr(10) || 'SELECT 2' || f END AS response
FROM (SELECT *, chr(96) || chr(96) || chr(96) AS f FROM {conversations}) AS turns
"""

# Python scripts: imports, statements and the whole text of a document as comments.
VIEWS["scripts"] = """
SELECT doc_id AS script_id, 'python' AS language,
       CASE doc_id % 5 WHEN 0 THEN 'import os, sys' || chr(10) || 'from pandas import DataFrame' || chr(10)
                       WHEN 1 THEN 'import pandas as pd' || chr(10) || 'import os' || chr(10) || '    import hidden' || chr(10)
                       WHEN 2 THEN 'from airflow.operators.postgres_operator import PostgresOperator' || chr(10)
                       WHEN 3 THEN 'import os.path as p, json' || chr(10) || 'from airflow.operators.python_operator import PythonOperator' || chr(10)
                       ELSE '' END
       || CASE doc_id % 7 WHEN 0 THEN 'df = pd.read_sql(q, engine)' || chr(10)
                          WHEN 1 THEN 'PASSWORD = ' || chr(39) || 'x' || source || chr(39) || chr(10)
                          WHEN 2 THEN 'engine = Create_Engine(' || chr(34) || 'postgresql://u:p@host/db' || chr(34) || ')' || chr(10)
                          WHEN 3 THEN 'exec(code); os.system(cmd)' || chr(10)
                          WHEN 4 THEN 'Variable.get(' || chr(39) || 'connection_string' || chr(39) || ')' || chr(10)
                          WHEN 5 THEN 'api-key=' || chr(34) || lang || chr(34) || '; secret = ' || chr(34) || 's' || chr(34) || chr(10)
                          ELSE '' END
       || '# ' || replace(text, chr(10), chr(10) || '# ') || chr(10) AS code
FROM {documents}
"""

# Results of model calls, one per turn of a conversation.
VIEWS["attempts"] = """
SELECT conv_id * 1000 + turn AS id,
       CASE conv_id % 3 WHEN 0 THEN 'sql' WHEN 1 THEN 'python' ELSE 'airflow_dag' END AS output_format,
       CASE turn % 5 WHEN 4 THEN '' ELSE text END AS code,
       turn % 5 <> 4 AS extracted,
       (conv_id + turn) % 4 = 0 AS valid,
       CASE (conv_id + turn) % 4 WHEN 0 THEN NULL
            WHEN 1 THEN 'SQL script contains placeholders or bind parameters.' ELSE 'relation ' || role || ' does not exist' END AS error,
       (conv_id + turn) % 3 + 1 AS attempts
FROM {conversations}
"""

_RULES_SQL = ", ".join(
    f"({number}, '{pattern}', '{strategy}', {sql_text(description)}, {k}, {sql_text(keyword)})"
    for number, (pattern, strategy, description, keywords) in enumerate(fixed.RULES, start=1)
    for k, keyword in enumerate(keywords)
)

_SCORED = (
    with_views("task_texts")
    + f"""
    , rules(rule_no, pattern, strategy, pattern_description, k, keyword) AS (VALUES {_RULES_SQL})
    , scored AS (
        SELECT id, rule_no, pattern, strategy, pattern_description, count(*) AS score,
               string_agg(keyword, '|' ORDER BY k) AS keywords
        FROM task_texts JOIN rules ON contains(lower(description), keyword)
        GROUP BY id, rule_no, pattern, strategy, pattern_description)
    """
)

_HINT = "coalesce(" + ", ".join(
    f"nullif(regexp_extract(lower(description), {sql_text(p)}, 1), '')" for p in fixed.TARGET_PATTERNS
) + ")"

_CLASSIFIED = (
    _SCORED
    + f"""
    , best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, rule_no) AS rn FROM scored)
    , classified AS (
        SELECT t.id, t.description, t.output_format, t.source_set, coalesce(b.pattern, '{fixed.DEFAULT_RULE[0]}') AS pattern,
               coalesce(b.strategy, '{fixed.DEFAULT_RULE[1]}') AS strategy,
               coalesce(b.pattern_description, {sql_text(fixed.DEFAULT_RULE[2])}) AS pattern_description,
               coalesce(b.keywords, '') AS keywords, {_HINT} AS target_hint
        FROM task_texts t LEFT JOIN best b ON b.id = t.id AND b.rn = 1)
    """
)


@query("classify_scores", _SCORED + "SELECT id, rule_no, pattern, strategy, score, keywords FROM scored")
def classify_scores(t):
    scored = classify.scores(view(t, "task_texts"))
    return scored.select(
        "id", "rule_no", "pattern", "strategy", F.col("score").cast("bigint").alias("score"),
        F.array_join("keywords", "|").alias("keywords"),
    )


@query(
    "classify_tasks",
    _CLASSIFIED + "SELECT id, pattern, strategy, pattern_description, keywords FROM classified",
)
def classify_tasks(t):
    return classify.classify(view(t, "task_texts")).select(
        "id", "pattern", "strategy", "pattern_description", F.array_join("keywords", "|").alias("keywords")
    )


@query("target_hints", with_views("task_texts") + f"SELECT id, {_HINT} AS target_hint FROM task_texts")
def target_hints(t):
    return view(t, "task_texts").select("id", classify.target_hint(F.lower("description")).alias("target_hint"))


_STRIP = r"'^[\s\x1c-\x1f\p{Z}\x{85}]+|[\s\x1c-\x1f\p{Z}\x{85}]+$', '', 'g'"


def _block_sql(language: str) -> str:
    pattern = f"'```{language}\\s+(.*?)```'"
    return (
        f"CASE WHEN regexp_matches(response, {pattern}, 's') "
        f"THEN regexp_replace(regexp_extract(response, {pattern}, 1, 's'), {_STRIP}) END"
    )


@query(
    "extract_blocks",
    with_views("responses")
    + f"""
    , blocks AS (
        SELECT *, {_block_sql('sql')} AS b_sql, {_block_sql('python')} AS b_python, {_block_sql('yaml')} AS b_yaml,
               regexp_extract(response, '```([a-zA-Z0-9_+-]+)\\s*(.*?)```', 1, 's') AS tag,
               regexp_replace(regexp_extract(response, '```([a-zA-Z0-9_+-]+)\\s*(.*?)```', 2, 's'), {_STRIP}) AS tagged
        FROM responses)
    , chosen AS (
        SELECT id, tag, tagged,
               CASE WHEN expected_language = 'python' AND b_python IS NOT NULL THEN 'python'
                    WHEN b_sql IS NOT NULL THEN 'sql' WHEN b_python IS NOT NULL THEN 'python'
                    WHEN b_yaml IS NOT NULL THEN 'yaml' END AS lang, b_sql, b_python, b_yaml
        FROM blocks)
    SELECT id, coalesce(CASE lang WHEN 'sql' THEN b_sql WHEN 'python' THEN b_python WHEN 'yaml' THEN b_yaml
                             ELSE CASE WHEN tag <> '' THEN tagged END END, '') AS code,
           coalesce(lang, tag, '') AS language, lang IS NOT NULL OR tag <> '' AS success
    FROM chosen
    """,
)
def extract_blocks(t):
    return responses.parse(view(t, "responses")).select("id", "code", "language", "success")


@query(
    "imports_count",
    with_views("scripts")
    + r"""
    , lines AS (
        SELECT script_id, unnest(regexp_extract_all(code, '(?m)^(?:import|from)[ \t]+\S[^\n]*')) AS line FROM scripts)
    , named AS (
        SELECT script_id, regexp_extract(line, '^from[ \t]+([^\s,;#]+)', 1) AS module FROM lines WHERE line LIKE 'from%'
        UNION
        SELECT script_id, regexp_extract(item, '^\s*([^\s,;#]+)', 1) FROM (
            SELECT script_id, unnest(string_split(regexp_replace(line, '^import[ \t]+', ''), ',')) AS item
            FROM lines WHERE line LIKE 'import%'))
    SELECT module, count(*) AS scripts FROM named WHERE module <> '' GROUP BY module
    """,
)
def imports_count(t):
    return responses.module_counts(view(t, "scripts"))


_SOURCES = {0: None, 1: ["orders", "customer"], 2: ["lineitem"], 3: ["no_such_table"]}
_SOURCE_NAMES = "CASE source_set WHEN 1 THEN '|orders|customer|' WHEN 2 THEN '|lineitem|' WHEN 3 THEN '|' END"


def _case(key: str, table: dict[str, str]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {sql_text(v)}" for k, v in table.items()) + " END"


@query(
    "prompt_table",
    _CLASSIFIED
    + f"""
    , catalog_columns AS ({_columns_sql()})
    , blocks AS (
        SELECT table_name, 'Table: ' || table_name || chr(10) ||
               string_agg('  - ' || "column" || ': ' || type || ' (' || CASE WHEN nullable THEN 'NULL' ELSE 'NOT NULL' END || ')',
                          chr(10) ORDER BY position) AS block
        FROM catalog_columns GROUP BY table_name)
    , everything AS (SELECT string_agg(block, chr(10) ORDER BY table_name) AS blocks FROM blocks)
    , pair AS (SELECT (SELECT block FROM blocks WHERE table_name = 'orders') || chr(10) ||
                      (SELECT block FROM blocks WHERE table_name = 'customer') AS blocks)
    SELECT id, concat_ws(chr(10) || chr(10),
        'Task description:' || chr(10) || description,
        'Database schema:' || chr(10) || CASE source_set WHEN 0 THEN (SELECT blocks FROM everything)
            WHEN 1 THEN (SELECT blocks FROM pair) WHEN 2 THEN (SELECT block FROM blocks WHERE table_name = 'lineitem')
            ELSE '{fixed.NO_SCHEMA}' END,
        'Required output format: ' || output_format,
        CASE WHEN output_format = 'sql' THEN
            'Detected ETL pattern: ' || pattern || chr(10) || 'Load strategy: ' || strategy || chr(10) ||
            'Pattern description: ' || pattern_description || chr(10) || 'Implementation hint: ' || {_case('strategy', fixed.STRATEGY_HINTS)}
            || coalesce(chr(10) || 'Target table hint from the task: ' || target_hint, '') END,
        {_case('output_format', fixed.FORMAT_RULES)}) AS prompt
    FROM classified
    """,
)
def prompt_table(t):
    """Prompts that quote the catalog of the given tables."""
    rendered = catalog.schema_blocks(catalog.columns(t.spark, _work_database(t))).collect()
    names = {k: F.array(*[F.lit(n) for n in v]) for k, v in _SOURCES.items() if v}
    chosen = F.lit(None).cast("array<string>")
    for number, tables in names.items():
        chosen = F.when(F.col("source_set") == number, tables).otherwise(chosen)
    tasks = view(t, "task_texts").select("id", "description", "output_format", chosen.alias("source_tables"))
    return prompts.prompts(tasks, {r["table_name"]: r["text"] for r in rendered})


@query(
    "correction_queue",
    with_views("attempts")
    + f"""
    , staged AS (
        SELECT * REPLACE (CASE WHEN extracted THEN error ELSE '{fixed.NOT_A_DAG}' END AS error),
               NOT extracted AND NOT (output_format = 'airflow_dag' AND attempts = 1) AS no_code FROM attempts)
    , decided AS (
        SELECT *, CASE WHEN no_code THEN 'failed' WHEN extracted AND valid THEN 'accepted' WHEN attempts <= 2 THEN 'retry' ELSE 'failed' END AS state
        FROM staged)
    SELECT id, state, CASE WHEN state = 'retry' THEN attempts + 1 END AS next_attempt,
           CASE WHEN state = 'retry' THEN
               'The following code has an error. Fix it and return the full corrected code.' || chr(10) || chr(10) ||
               'Original code:' || chr(10) || CASE WHEN output_format = 'airflow_dag' AND code = '' THEN '# No DAG code' ELSE code END
               || chr(10) || chr(10) || 'Error: ' || error
               || coalesce({_case('output_format', fixed.CORRECTION_RULES)}, '')
               || CASE WHEN output_format = 'sql' AND error LIKE '%placeholders or bind parameters%'
                       THEN {sql_text(fixed.PLACEHOLDER_ADVICE)} ELSE '' END END AS prompt,
           CASE WHEN state = 'failed' THEN CASE WHEN no_code THEN {_case('output_format', fixed.NO_CODE_ERRORS)} ELSE error END END AS final_error
    FROM decided
    """,
)
def correction_queue(t):
    return prompts.correction_round(view(t, "attempts")).select("id", "state", "next_attempt", "prompt", "final_error")
