"""Word lists, patterns and texts that results depend on, in their natural order."""

# -- task descriptions -------------------------------------------------------

# (pattern, load strategy, description, keywords); on equal scores the earlier rule wins.
RULES = [
    (
        "scd2", "upsert", "Slowly Changing Dimension Type 2 — версионирование исторических изменений",
        ["scd", "scd2", "scd type 2", "история изменений", "историческ", "версионирован", "медленно меняющ",
         "slowly changing"],
    ),
    (
        "deduplication", "create_replace", "Дедупликация — удаление дубликатов из набора данных",
        ["дублик", "дедупликац", "dedup", "duplicate", "уникальн запис", "distinct", "row_number",
         "убрать повтор"],
    ),
    (
        "incremental", "insert_only", "Инкрементальная загрузка — добавление только новых/изменённых записей",
        ["инкрементальн", "incremental", "новые записи", "приращени", "delta", "дельта", "changed since",
         "за последн", "новых данн", "обновлённ", "только новые", "append"],
    ),
    (
        "merge", "upsert", "Merge/Upsert — вставка новых и обновление существующих записей",
        ["merge", "upsert", "insert or update", "вставить или обновить", "обновить существующ", "on conflict",
         "при совпадени"],
    ),
    (
        "aggregation", "truncate_insert", "Агрегация — вычисление сводных метрик и построение витрин",
        ["витрин", "агрегац", "суммарн", "статистик", "метрик", "отчёт", "отчет", "report", "сгруппир",
         "group by", "sum", "count", "avg", "average", "топ", "top-n", "ежедневн", "еженедельн",
         "ежемесячн", "weekly", "monthly", "daily", "продаж", "выручк"],
    ),
    (
        "archive", "insert_only", "Архивация — перенос старых данных в архивные таблицы",
        ["архив", "archive", "перенести старые", "устаревш", "старше", "older than", "перемести"],
    ),
    (
        "full_refresh", "truncate_insert", "Полная перезагрузка — замена всего содержимого целевой таблицы",
        ["полная перезагрузк", "full refresh", "пересоздать", "truncate", "полностью обновить", "перезалить",
         "overwrite"],
    ),
]

# What a description without any keyword counts as.
DEFAULT_RULE = ("aggregation", "truncate_insert", "Агрегация — паттерн по умолчанию для ETL-витрин")

# Where a description names its target table; the first pattern that matches counts.
TARGET_PATTERNS = [
    r"(?:в таблицу|в витрину|создать таблицу|таблица результат)\s+['\"]?([a-z_][a-z0-9_.]*)['\"]?",
    r"(?:target|целевая)\s*[=:]\s*['\"]?([a-z_][a-z0-9_.]*)['\"]?",
    r"(?:into|в)\s+['\"]?(etl_workspace\.[a-z_][a-z0-9_]*)['\"]?",
    r"(?:создай|создать|create)\s+(?:таблицу|витрину)\s+([a-z_][a-z0-9_]*)",
]

# Words of which a text must hold one for the pattern at the same place to match.
TARGET_WORDS = [
    ["в таблицу", "в витрину", "создать таблицу", "таблица результат"],
    ["target", "целевая"],
    ["etl_workspace."],
    ["таблицу", "витрину"],
]

# -- prompts -----------------------------------------------------------------

STRATEGY_HINTS = {
    "truncate_insert": "Use TRUNCATE + INSERT INTO ... SELECT or CREATE TABLE IF NOT EXISTS + TRUNCATE + INSERT.",
    "insert_only": "Use INSERT INTO ... SELECT with a filter that keeps only new rows based on date or a surrogate key.",
    "upsert": "Use INSERT INTO ... ON CONFLICT (key) DO UPDATE SET ... or MERGE INTO to update existing rows and "
    "insert new ones.",
    "create_replace": "Use DROP TABLE IF EXISTS + CREATE TABLE AS SELECT or CREATE OR REPLACE TABLE AS SELECT.",
}

FORMAT_RULES = {
    "sql": "Generate a materialization-first SQL ETL script. The script must create or update a table in "
    "etl_workspace and must not be read-only. Do not use placeholders like %s or :name. Return SQL code only.",
    "airflow_dag": "Return a full Airflow DAG. Use retry_delay only as timedelta(minutes=N) after importing "
    "datetime and timedelta from the datetime module. In every PostgresOperator use fully qualified table names "
    "in schema etl_workspace.",
}

NO_SCHEMA = "Schema not provided."

CORRECTION_RULES = {
    "sql": "\n\nRequirements for corrected SQL:\n"
    "- Return a materializing ETL script, not only SELECT.\n"
    "- Do not use placeholders like %s, %(name)s, :name, ?, $1.\n"
    "- Return SQL code only.",
    "airflow_dag": "\n\nRequirements for corrected DAG:\n"
    "- Return full Python DAG code with imports, DAG definition, and operators.\n"
    "- The code must be syntactically valid Python.\n"
    "- If PostgresOperator is used, set postgres_conn_id='postgres_default'.\n"
    "- In PostgresOperator SQL use fully qualified table names like etl_workspace.orders and "
    "etl_workspace.target_table for all real source and target tables.\n"
    "- For retry_delay use only timedelta(minutes=5) with from datetime import datetime, timedelta.\n"
    "- Do not use 00:05, 00:05:00, strings, or datetime.timedelta(...) when datetime was imported via "
    "from ... import datetime.\n"
    "- Do not use Variable.get('connection_string') or custom raw connection strings.",
}

PLACEHOLDER_ADVICE = (
    "\nRewrite the SQL so it contains no placeholders at all. Replace bind parameters with executable SQL literals "
    "or SQL date/time expressions. Example: use DATE('now', '-30 day') or '2026-04-28' instead of %s or :start_date."
)

NO_CODE_ERRORS = {
    "sql": "Failed to extract SQL from LLM response",
    "python": "Failed to extract Python code from LLM response",
    "airflow_dag": "Failed to extract Python DAG from the correction response.",
}
NOT_A_DAG = "Model response does not contain a valid Airflow DAG."

# -- audits ------------------------------------------------------------------

PLACEHOLDERS = [r"%s", r"%\([A-Za-z_][A-Za-z0-9_]*\)s", r":[A-Za-z_][A-Za-z0-9_]*", r"\$\d+", r"\?"]
PLACEHOLDER_ERROR = (
    "SQL script contains placeholders or bind parameters. Use executable SQL with literal values or SQL expressions "
    "instead of %s, %(name)s, :name, ?, $1."
)

STATEMENT_KINDS = ["SELECT", "CREATE", "INSERT", "UPDATE", "DELETE", "TRUNCATE", "ALTER", "DROP", "MERGE"]
MATERIALIZING = ["CREATE", "INSERT", "UPDATE", "DELETE", "TRUNCATE", "ALTER", "DROP", "MERGE"]
EMPTY_SCRIPT = "SQL script is empty after normalization"
SELECT_ONLY = (
    "SQL script contains only SELECT statements. For ETL generation a materializing script is required: "
    "CREATE TABLE AS, INSERT INTO ... SELECT, TRUNCATE + INSERT, or similar."
)
NOT_MATERIALIZING = (
    "SQL script does not contain a materializing operation. "
    "Expected CREATE, INSERT, UPDATE, DELETE, TRUNCATE, ALTER, DROP, or MERGE."
)

DATA_READS = [
    "pd.read_sql", "read_sql_query", "read_sql_table", "read_csv", "read_parquet", "read_json", "read_excel",
    "psycopg2.connect", "engine.connect", "engine.execute", "session.execute", "cursor.execute", "sqlalchemy",
    "create_engine",
]
NO_DATA_READ = (
    "Data read step not found. Expected one of: pd.read_sql, read_csv, psycopg2.connect, create_engine, "
    "engine.connect, cursor.execute, etc."
)

FORBIDDEN = [
    ('Variable.get("connection_string")', "Do not read raw DB connection strings from Airflow Variables."),
    ("Variable.get('connection_string')", "Do not read raw DB connection strings from Airflow Variables."),
    ('BaseHook.get_connection("connection_string")',
     "Use standard Airflow connection ids instead of custom connection_string."),
    ("BaseHook.get_connection('connection_string')",
     "Use standard Airflow connection ids instead of custom connection_string."),
    ("eval(", "Usage of eval() is forbidden inside DAG files."),
    ("exec(", "Usage of exec() is forbidden inside DAG files."),
    ("pickle.loads", "pickle.loads is unsafe and forbidden in DAG files."),
    ("subprocess.Popen", "subprocess.Popen usage inside DAGs is restricted."),
    ("os.system(", "os.system() usage inside DAGs is forbidden."),
]

SECRETS = [
    r"password\s*=\s*['\"].+?['\"]",
    r"passwd\s*=\s*['\"].+?['\"]",
    r"postgresql:\/\/.+:.+@",
    r"api[_-]?key\s*=\s*['\"].+?['\"]",
    r"secret\s*=\s*['\"].+?['\"]",
]
SECRET_ERROR = "Possible hardcoded secret detected in DAG code."

DEPRECATED_IMPORTS = {
    "airflow.operators.postgres_operator": "Use airflow.providers.postgres.operators.postgres",
    "airflow.operators.python_operator": "Use airflow.operators.python",
}

DAG_MARKERS = [r"\bwith\s+DAG\s*\(", r"\bDAG\s*\(", r"@dag\b"]
TASK_MARKERS = [r"\b[A-Za-z_][A-Za-z0-9_]*Operator\s*\(", r"@task\b"]
NO_DAG = "Airflow DAG definition not found. Expected DAG(...), with DAG(...), or @dag."
NO_TASK = "No Airflow task/operator found. Expected @task decorator or *Operator usage."

TABLE_USE = r"\b(?:from|join|into|update)\s+([a-zA-Z_][a-zA-Z0-9_\.]*)"
TEMP_TABLE = r"\bcreate\s+temp(?:orary)?\s+table\s+(?:if\s+not\s+exists\s+)?([a-zA-Z_][a-zA-Z0-9_\.]*)"
TABLE_REFERENCE = (
    r"\b(create\s+table(?:\s+if\s+not\s+exists)?|insert\s+into|from|join|update)\s+([a-zA-Z_][a-zA-Z0-9_\.]*)"
)

CONNECTION_IDS = ["postgres_conn_id='postgres_default'", 'postgres_conn_id="postgres_default"']
CONNECTION_ERROR = "PostgresOperator must explicitly use postgres_conn_id='postgres_default'."

SCHEDULE_PRESETS = ["@hourly", "@daily", "@weekly", "@monthly", "@yearly", "@annually"]
CYCLE_ERROR = "Cyclic task dependency detected."
NO_DEPENDENCIES = "No task dependencies detected."
NO_SCHEDULE = "DAG has no schedule defined."
RUNS_ONCE = "DAG runs only once."
