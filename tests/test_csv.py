import datetime

import pytest
from pyspark.sql import functions as F

from tidemill.operators import cleaning
from tidemill.operators.cleaning import Typing, clean, column_profile, hints_at_date, infer_types
from tidemill.operators.loads import StageRejected
from tidemill.sources import csv
from tidemill.session import scratch_database


def write(tmp_path, name, data):
    path = tmp_path / name
    path.write_bytes(data if isinstance(data, bytes) else data.encode("utf-8"))
    return str(path)


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize(
    "codec,expected",
    [("utf-8", "utf-8"), ("utf-8-sig", "utf-8"), ("cp1251", "windows-1251"), ("ascii", "utf-8")],
)
def test_encodings(spark, tmp_path, codec, expected):
    text = "имя;n\nПётр;1\nИван;2\n" if codec != "ascii" else "name;n\nPeter;1\nIvan;2\n"
    found = csv.scan(spark, write(tmp_path, "a.csv", text.encode(codec)))
    assert found.shape.encoding == expected
    assert found.rows.columns == (["имя", "n"] if codec != "ascii" else ["name", "n"])
    assert sorted(r[1] for r in rows(found.rows)) == ["1", "2"]
    assert sorted(r[0] for r in rows(found.rows)) == (["Иван", "Пётр"] if codec != "ascii" else ["Ivan", "Peter"])


def test_byte_without_meaning_in_cp1251_makes_latin1(spark, tmp_path):
    found = csv.scan(spark, write(tmp_path, "a.csv", b"a,b\n\x98\xe9,1\n"))
    assert found.shape.encoding == "iso-8859-1"
    assert rows(found.rows) == [("\x98é", "1")]


def test_files_of_different_encodings_in_one_folder(spark, tmp_path):
    write(tmp_path, "a.csv", "k,v\n1,Пётр\n".encode("utf-8"))
    write(tmp_path, "b.csv", "k,v\n2,Иван\n".encode("cp1251"))
    assert sorted(rows(csv.scan(spark, str(tmp_path)).rows)) == [("1", "Пётр"), ("2", "Иван")]


def test_different_headers_are_refused(spark, tmp_path):
    write(tmp_path, "a.csv", "k,v\n1,Пётр\n".encode("utf-8"))
    write(tmp_path, "b.csv", "k,w\n2,Иван\n".encode("cp1251"))
    with pytest.raises(ValueError, match="headers"):
        csv.scan(spark, str(tmp_path))


def test_different_headers_in_one_encoding_are_refused_on_reading(spark, tmp_path):
    write(tmp_path, "a.csv", "k,v\n1,x\n")
    write(tmp_path, "b.csv", "k,w\n2,y\n")
    with pytest.raises(Exception, match="header"):
        csv.scan(spark, str(tmp_path)).rows.collect()


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_delimiters(spark, tmp_path, sep):
    found = csv.scan(spark, write(tmp_path, "a.csv", f'"x{sep},;y"{sep}b\n1{sep}2\n'))
    assert found.shape.sep == sep
    assert rows(found.rows) == [("1", "2")]


def test_one_column_is_not_split(spark, tmp_path):
    found = csv.scan(spark, write(tmp_path, "a.csv", "name\nanna\n"))
    assert found.rows.columns == ["name"] and rows(found.rows) == [("anna",)]


def test_ragged_rows(spark, tmp_path):
    found = csv.scan(spark, write(tmp_path, "a.csv", 'a,b,c\n1,2,3\n4\n5,6,7,8\n9,"x,y",\n10,11,12,\n'))
    assert sorted(rows(found.rows)) == [("1", "2", "3"), ("10", "11", "12"), ("4", None, None), ("9", "x,y", None)]
    rejected = found.rejects.collect()
    assert [(r["first_cell"], r["line"]) for r in rejected] == [("5", "5,6,7,8")]
    assert rejected[0]["file"].endswith("a.csv")
    assert found.rows.count() == 4 and found.rejects.count() == 1
    assert sorted(r[0] for r in found.rows.select("a").collect()) == ["1", "10", "4", "9"]


def test_quotes_and_line_breaks(spark, tmp_path):
    path = write(tmp_path, "a.csv", 'a,b\n"say ""hi""","two\nlines"\n')
    assert rows(csv.scan(spark, path, multiline=True).rows) == [('say "hi"', "two\nlines")]


def test_blank_and_repeated_headers(spark, tmp_path):
    found = csv.scan(spark, write(tmp_path, "a.csv", "a,,a\n1,2,3\n"))
    assert found.rows.columns == ["a", "Unnamed: 1", "a.1"]
    assert clean(found.rows).rows.columns == ["a", "unnamed_1", "a1"]


def test_empty_file(spark, tmp_path):
    with pytest.raises(ValueError):
        csv.scan(spark, write(tmp_path, "a.csv", ""))


def test_intake(spark, tmp_path):
    write(tmp_path, "a.CSV", "a\n1\n")
    write(tmp_path, "b.csv", "")
    write(tmp_path, "c.txt", "a\n")
    verdicts = {r["file"].rsplit("/", 1)[-1]: (r["accepted"], r["reason"]) for r in csv.intake(spark, str(tmp_path)).collect()}
    assert verdicts == {"a.CSV": (True, None), "b.csv": (False, "empty file"), "c.txt": (False, "not a .csv file")}


def frame(spark, columns, data):
    return spark.createDataFrame(data, ", ".join(f"`{c}` string" for c in columns))


def test_null_tokens_are_compared_before_trimming(spark):
    df = frame(spark, ["a"], [("NA",), (" NA ",), ("null",), ("Null",), ("",), ("x",)])
    assert [r[0] for r in cleaning.trim_cells(cleaning.null_tokens(df)).collect()] == [None, "NA", None, "Null", None, "x"]


def test_trim_takes_every_white_space(spark):
    df = frame(spark, ["a"], [("  x\t\n",), (" ",), ("\x1fy　",)])
    assert [r[0] for r in cleaning.trim_cells(df).collect()] == ["x", None, "y"]


def test_order_of_steps(spark):
    """Rows and columns of white space alone are not empty when emptiness is judged."""
    df = frame(spark, ["a", "b", "c"], [("1", " ", None), ("  ", None, None), (None, None, None)])
    result = clean(df)
    assert result.rows.columns == ["a", "b"]
    assert sorted(map(str, rows(result.rows))) == sorted(map(str, [(1, None), (None, None)]))
    assert result.warnings == ["Удалено 1 полностью пустых столбца(-ов)."]
    strict = clean(df, drop_after_trim=True)
    assert strict.rows.columns == ["a"] and rows(strict.rows) == [(1,)]


def test_date_hints_are_whole_words():
    assert hints_at_date("created_at") and hints_at_date("order_date") and hints_at_date("dt")
    assert not any(hints_at_date(n) for n in ("status", "category", "region", "location", "nation", "rating", "person"))


def test_status_stays_text_and_dates_are_typed(spark):
    df = frame(spark, ["status", "created_at"], [("new", "2024-01-05"), ("old", "05.02.2024 10:30"), (None, "3/4/2024")])
    out = infer_types(df)
    assert dict(out.dtypes) == {"status": "string", "created_at": "timestamp_ntz"}
    assert [r[1] for r in out.collect()] == [
        datetime.datetime(2024, 1, 5), datetime.datetime(2024, 2, 5, 10, 30), datetime.datetime(2024, 3, 4),
    ]


def test_a_date_column_with_other_text_stays_text(spark):
    df = frame(spark, ["date"], [("2024-01-05",), ("2024-13-45",), ("soon",)])
    assert dict(infer_types(df).dtypes) == {"date": "string"}
    assert dict(infer_types(df, Typing(parse_rate=0.3)).dtypes) == {"date": "timestamp_ntz"}


@pytest.mark.parametrize(
    "cells,kind,values",
    [
        (["1", "-2", "+3"], "bigint", [1, -2, 3]),
        (["007", "8", None], "bigint", [7, 8, None]),
        (["1.5", "1e3", ".5"], "double", [1.5, 1000.0, 0.5]),
        (["inf", "-Infinity", "2"], "double", [float("inf"), float("-inf"), 2.0]),
        (["0x10", "1"], "string", ["0x10", "1"]),
        (["1_000"], "string", ["1_000"]),
        (["1d", "2"], "string", ["1d", "2"]),
        (["99999999999999999999", "1"], "string", ["99999999999999999999", "1"]),
        (["1", "x"], "string", ["1", "x"]),
        ([None, " "], "string", [None, None]),
        (["True", "False"], "string", ["True", "False"]),
    ],
)
def test_numbers_all_or_nothing(spark, cells, kind, values):
    out = infer_types(frame(spark, ["n"], [(c,) for c in cells]))
    assert out.dtypes == [("n", kind)]
    assert [r[0] for r in out.collect()] == values


def test_number_options(spark):
    df = frame(spark, ["n"], [("007",), (None,)])
    assert infer_types(df, Typing(keep_leading_zeros=True)).dtypes == [("n", "string")]
    assert infer_types(df, Typing(nullable_integers_as_double=True)).dtypes == [("n", "double")]


def test_load(spark, tmp_path):
    path = write(tmp_path, "Sales Report.csv", "Order ID;Дата;Amount;Empty\n1;2024-01-01;1.5;\n1;2024-01-01;1.5;\n2;x;;\n")
    schema = scratch_database(spark)
    report = csv.load(spark, path, "Load Test " + tmp_path.name, schema)
    assert report.rows == 2 and not report.replaced_existing
    assert report.warnings == ["Удалено 1 полностью пустых столбца(-ов).", "Удалено 1 дублирующихся строк."]
    loaded = spark.table(report.table)
    assert loaded.dtypes == [("order_id", "bigint"), ("col", "string"), ("amount", "double")]
    assert csv.load(spark, path, "Load Test " + tmp_path.name, schema).replaced_existing
    with pytest.raises(ValueError, match="exists"):
        csv.load(spark, path, "Load Test " + tmp_path.name, schema, replace_if_exists=False)


def test_nothing_left_after_cleaning(spark, tmp_path):
    path = write(tmp_path, "none.csv", "a,b\nNA,\n,null\n")
    schema = scratch_database(spark)
    with pytest.raises(StageRejected):
        csv.load(spark, path, "none_" + tmp_path.name, schema)


def test_column_profile(spark):
    df = spark.createDataFrame([(1, 1.0, "x", True), (2, None, "y", False)], "a bigint, b double, c string, d boolean")
    df = df.withColumn("e", F.lit("2024-01-01").cast("timestamp_ntz"))
    assert [tuple(r)[1:] for r in column_profile(df).collect()] == [
        ("a", "BIGINT", False), ("b", "DOUBLE PRECISION", True), ("c", "TEXT", False), ("d", "BOOLEAN", False),
        ("e", "TIMESTAMP", False),
    ]
    assert [r["nullable"] for r in column_profile(df.limit(0)).collect()] == [False] * 5
