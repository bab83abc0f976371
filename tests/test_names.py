import pytest
from pyspark.sql import functions as F

from tidemill.functions.names import (
    header_names,
    qualified,
    snake_case,
    snake_case_column,
    table_name,
    table_name_column,
    unique_names,
)

CASES = {
    "Customer ID": "customer_id",
    " Full  Name ": "full_name",
    "Nation/Key": "nation_key",
    "Acct-Bal": "acct_bal",
    "Prénom": "prenom",
    "Дата заказа": "col",
    "№5": "no5",
    "ß": "col",
    "a__b___c_": "a_b_c",
    "100%": "100",
    "": "col",
    "x\ty": "x_y",
}


@pytest.mark.parametrize("given,expected", CASES.items())
def test_snake_case(given, expected):
    assert snake_case(given) == expected


def test_snake_case_over_a_column(spark):
    df = spark.createDataFrame([(k, v) for k, v in CASES.items()], "given string, expected string")
    got = df.select(snake_case_column(F.col("given")).alias("got"), "expected").collect()
    assert all(r["got"] == r["expected"] for r in got)


def test_translation_table_keeps_other_alphabets():
    assert snake_case("дата", {"д": "d", "а": "a", "т": "t"}) == "data"


def test_unique_names_are_unique():
    assert unique_names(["a", "b", "a"]) == ["a", "b", "a_1"]
    assert unique_names(["a", "a", "a_1"]) == ["a", "a_2", "a_1"]
    names = unique_names(["col"] * 4 + ["col_1", "col_2"])
    assert len(set(names)) == 6


def test_header_names():
    assert header_names(["a", "", "a", None, "a"]) == ["a", "Unnamed: 1", "a.1", "Unnamed: 3", "a.2"]


def test_table_names(spark):
    assert table_name(None, "Sales Report.CSV") == "sales_report"
    assert table_name("My Table", "x.csv") == "my_table"
    assert table_name(None, "отчёт.csv") == "col"
    rows = spark.createDataFrame(
        [(None, "/up/Sales Report.CSV"), ("My Table", "/up/x.csv"), ("", "/up/b-c.csv")], "e string, p string"
    ).select(table_name_column(F.col("e"), F.col("p")).alias("n"))
    assert [r["n"] for r in rows.collect()] == ["sales_report", "my_table", "b_c"]


def test_qualified_names():
    assert qualified("t", "public") == "t" and qualified("t", "") == "t" and qualified("t", "ws") == "ws.t"
    with pytest.raises(ValueError):
        qualified("t", "a; DROP")
