import pytest
from pyspark.sql import functions as F

from tidemill.functions import fixed
from tidemill.operators import classify, prompts, responses

DESCRIPTIONS = [
    ("Построй ежедневную витрину продаж с агрегацией по регионам", "aggregation", "truncate_insert", None),
    ("Загрузи инкрементально новые записи заказов за последние сутки", "incremental", "insert_only", None),
    ("Реализуй SCD2 для таблицы клиентов — храни историю изменений адреса", "scd2", "upsert", None),
    ("Удали дубликаты из таблицы пользователей, оставь уникальные записи", "deduplication", "create_replace", None),
    ("Merge данные: вставить новые строки или обновить существующие по ключу", "merge", "upsert", None),
    ("Перенеси старые заказы в архив orders_archive", "archive", "insert_only", None),
    ("Полная перезагрузка справочника продуктов из источника", "full_refresh", "truncate_insert", None),
    ("Сделай что-нибудь с данными", "aggregation", "truncate_insert", None),
    ("Агрегируй заказы по дням", "aggregation", "truncate_insert", None),
    ("Создай таблицу mart_daily_sales из заказов за сегодня", "aggregation", "truncate_insert", "mart_daily_sales"),
    ("Загрузи в таблицу 'dwh.sales'", "aggregation", "truncate_insert", "dwh.sales"),
    ("TARGET = stage_x", "aggregation", "truncate_insert", "stage_x"),
    ("insert into etl_workspace.t1 now", "aggregation", "truncate_insert", "etl_workspace.t1"),
    ("", "aggregation", "truncate_insert", None),
]


def test_descriptions(spark):
    df = spark.createDataFrame([(i, d[0]) for i, d in enumerate(DESCRIPTIONS)], "id int, description string")
    got = {r["id"]: (r["pattern"], r["strategy"], r["target_hint"]) for r in classify.classify(df).collect()}
    assert got == {i: d[1:] for i, d in enumerate(DESCRIPTIONS)}


def test_scores_by_hand(spark):
    texts = [d[0] for d in DESCRIPTIONS] + [
        "SUMMARY of the country count", "scd2 scd type 2", "append delta merge upsert", "x история изменений y",
        "история, изменений", "история  изменений", "a новые записи", "новые a записи", "новые записи1", "1топ2отчёт",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, description string")
    got = {(r["id"], r["pattern"]): (r["score"], r["keywords"]) for r in classify.scores(df).collect()}
    want = {}
    for i, text in enumerate(texts):
        for pattern, _, _, keywords in fixed.RULES:
            hits = [k for k in keywords if k in text.lower()]
            if hits:
                want[i, pattern] = (len(hits), hits)
    assert got == want


def test_ties_go_to_the_earlier_rule(spark):
    df = spark.createDataFrame([(1, "merge then archive"), (2, "archive, delta")], "id int, description string")
    assert [r["pattern"] for r in classify.classify(df).orderBy("id").collect()] == ["merge", "incremental"]


def test_whole_words(spark):
    df = spark.createDataFrame([(1, "summary of the country"), (2, "sum per day")], "id int, description string")
    assert [r["id"] for r in classify.scores(df, whole_words=True).collect()] == [2]


FENCE = "```"


@pytest.mark.parametrize(
    "text,expected,outcome",
    [
        (f"Here:\n{FENCE}sql\nSELECT 1\n{FENCE}\n", "sql", ("SELECT 1", "sql", True)),
        ("no fence", "sql", ("", "", False)),
        (f"{FENCE}sql\n{FENCE}", "sql", ("", "sql", True)),
        (f"{FENCE}sqlite\nitems\n{FENCE}", "sql", ("items", "sqlite", True)),
        (f"{FENCE}python3\nx\n{FENCE}", "python", ("x", "python3", True)),
        (f"{FENCE}SQL\nSELECT 1\n{FENCE}", "sql", ("SELECT 1", "SQL", True)),
        (f"{FENCE}\nSELECT 1\n{FENCE}", "sql", ("", "", False)),
        (f"{FENCE}yaml\na\n{FENCE}\n{FENCE}sql\nb\n{FENCE}", "python", ("b", "sql", True)),
        (f"{FENCE}python\nimport x\n{FENCE}\n{FENCE}sql\nb\n{FENCE}", "python", ("import x", "python", True)),
        (f"{FENCE}sql\na\n{FENCE}{FENCE}sql\nb\n{FENCE}", "sql", ("a", "sql", True)),
    ],
)
def test_blocks(spark, text, expected, outcome):
    df = spark.createDataFrame([(1, text, expected)], "id int, response string, expected_language string")
    got = responses.parse(df).first()
    assert (got["code"], got["language"], got["success"]) == outcome


def test_legacy_tags(spark):
    df = spark.createDataFrame([(1, f"{FENCE}sqlite\nx\n{FENCE}", "sql")], "id int, response string, expected_language string")
    got = responses.parse(df, legacy=True).first()
    assert (got["code"], got["language"]) == ("ite\nx", "sql")


def test_long_blocks_do_not_overflow(spark):
    body = "x " * 200_000
    df = spark.createDataFrame([(1, f"{FENCE}sql\n{body}\n{FENCE}", "sql")], "id int, response string, expected_language string")
    assert len(responses.parse(df).first()["code"]) == len(body.strip())


def test_imports(spark):
    code = "import os, sys as s\nfrom pandas.core import x, y\n    import hidden\nimport a.b # note\nfrom os import path\n"
    df = spark.createDataFrame([(code,)], "code string")
    assert df.select(responses.imported_modules(F.col("code"))).first()[0] == ["os", "sys", "pandas.core", "a.b", "os"]
    assert {r["module"]: r["scripts"] for r in responses.module_counts(df).collect()}["os"] == 1


TASK = "id int, description string, output_format string, source_tables array<string>"


def test_prompt_sections(spark):
    df = spark.createDataFrame(
        [
            (1, "Создай таблицу m1", "sql", ["a"]), (2, "x", "python", None), (3, "x", "airflow_dag", ["missing"]),
            (4, "x", "python", []),
        ],
        TASK,
    )
    blocks = {"b": "Table: b", "a": "Table: a"}
    got = {r["id"]: r["prompt"].split("\n\n") for r in prompts.prompts(df, blocks).collect()}
    assert got[1][0] == "Task description:\nСоздай таблицу m1" and got[1][1] == "Database schema:\nTable: a"
    assert got[1][2] == "Required output format: sql" and got[1][3].endswith("Target table hint from the task: m1")
    assert got[1][4] == fixed.FORMAT_RULES["sql"] and len(got[1]) == 5
    assert got[2] == ["Task description:\nx", "Database schema:\nTable: a\nTable: b", "Required output format: python"]
    assert got[3][1] == "Database schema:\nSchema not provided." and got[3][3] == fixed.FORMAT_RULES["airflow_dag"]
    assert got[4][1] == "Database schema:\nSchema not provided."
    every = prompts.prompts(df, blocks, classify_all=True).filter("id = 2").first()["prompt"]
    assert "Detected ETL pattern: aggregation" in every


def test_correction_rounds(spark):
    df = spark.createDataFrame(
        [
            (1, "sql", "S", True, False, "placeholders or bind parameters", 1),
            (2, "sql", "S", True, False, "e", 3),
            (3, "sql", "", False, False, None, 1),
            (4, "airflow_dag", "", False, False, None, 1),
            (5, "airflow_dag", "", False, False, None, 2),
            (6, "python", "P", True, True, None, 1),
            (7, "python", "SELECT", True, False, "e", 2),
        ],
        "id int, output_format string, code string, extracted boolean, valid boolean, error string, attempts int",
    )
    got = {r["id"]: r for r in prompts.correction_round(df).collect()}
    assert [got[i]["state"] for i in range(1, 8)] == ["retry", "failed", "failed", "retry", "failed", "accepted", "retry"]
    assert got[1]["prompt"].endswith(fixed.PLACEHOLDER_ADVICE) and got[1]["next_attempt"] == 2
    assert got[2]["final_error"] == "e" and got[3]["final_error"] == fixed.NO_CODE_ERRORS["sql"]
    assert "# No DAG code" in got[4]["prompt"] and fixed.NOT_A_DAG in got[4]["prompt"]
    assert got[5]["final_error"] == fixed.NO_CODE_ERRORS["airflow_dag"]
    assert got[7]["prompt"].endswith("Error: e")
