"""Quoted line breaks read in small splits, against Spark's reader of whole files and Python's."""

import csv
import itertools
import random

import pytest

from tidemill.sources import csv as source, records as R

CELLS = ["", "x", "two words", "a,b", 'say "hi"', "line\nbreak", "\n", '"', "a;b", "é", "long " * 40, '"\n"', "end\n", ",\n,", "tail\r\nx"]


def write(path, rows, sep=",", ending="\n", encoding="utf-8"):
    with open(path, "w", newline="", encoding=encoding) as file:
        csv.writer(file, delimiter=sep, lineterminator=ending).writerows(rows)


@pytest.fixture
def small_splits(spark):
    before = {key: spark.conf.get(key) for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def test_effects_are_those_of_reading_on():
    effects, rng = R.LineEffects(","), random.Random(4)

    def plain(line, inside):
        """Character by character."""
        at, fresh = 0, not inside
        while at < len(line):
            c = line[at : at + 1]
            if inside:
                if c == b'"':
                    if line[at + 1 : at + 2] == b'"':
                        at += 1
                    else:
                        inside = False
                        fresh = False
            elif c == b",":
                fresh = True
            elif c == b'"' and fresh:
                inside, fresh = True, False
            else:
                fresh = False
            at += 1
        return inside

    for size in (1, 3, 6, 12, 25):
        for _ in range(3000):
            line = bytes(rng.choices(b'",a', k=size))
            assert effects.of(line) == (plain(line, False), plain(line, True)), line


@pytest.mark.parametrize("start", [False, True])
def test_states(start):
    import numpy as np

    for kinds in itertools.product([(0, 0), (0, 1), (1, 0), (1, 1)], repeat=4):
        outside, inside = (np.array(side, bool) for side in zip(*kinds, strict=True))
        held, expected = start, []
        for i in range(4):
            held = bool(inside[i] if held else outside[i])
            expected.append(held)
        assert R.states(outside, inside, start).tolist() == expected


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_many_tasks_read_what_one_reads(spark, tmp_path, small_splits, ending):
    rng = random.Random(7)
    header = ["id", "first\nname", 'the "text"']
    rows = {}
    for n in range(3):
        rows[n] = [[f"{n}-{i}", rng.choice(CELLS), rng.choice(CELLS)] for i in range(25)]
        write(tmp_path / f"{n}.csv", [header, *rows[n]], ending=ending)
    scanned = source.scan(spark, str(tmp_path))
    expected = sorted((r[0], r[1] or None, r[2] or None) for part in rows.values() for r in part)
    assert sorted(map(tuple, scanned.rows.collect())) == expected
    assert scanned.rejects.count() == 0 and scanned.shape.columns[0] == "id"
    whole = spark.read.csv(str(tmp_path), header=True, multiLine=True, quote='"', escape='"')
    if ending == "\n":
        assert sorted(map(tuple, whole.collect())) == expected
    parts = R.lines_of(spark, str(tmp_path)).select("file", "block").distinct().count()
    assert parts > 12


def test_encodings_and_rejects_together(spark, tmp_path, small_splits):
    write(tmp_path / "a.csv", [["id", "имя"], ["1", "плащ\nи зонт"], ["2", "x"]])
    write(tmp_path / "b.csv", [["id", "имя"], ["3", "ёж\nбеж"], ["4", "x", "more\nthan"], ["5"]], encoding="cp1251")
    (tmp_path / "c.csv").write_text("\n\nid,имя\n\n6,x\n", encoding="utf-8")
    scanned = source.scan(spark, str(tmp_path))
    expected = [("1", "плащ\nи зонт"), ("2", "x"), ("3", "ёж\nбеж"), ("5", None), ("6", "x")]
    assert sorted(map(tuple, scanned.rows.collect())) == expected
    rejected = scanned.rejects.collect()
    assert ("4", '4,x,"more\nthan"') in {(r["first_cell"], r["line"]) for r in rejected}


def test_headers_that_differ(spark, tmp_path):
    write(tmp_path / "a.csv", [["id", "v"], ["1", "a\nb"]])
    write(tmp_path / "b.csv", [["id", "w"], ["2", "c"]])
    with pytest.raises(ValueError, match="different headers"):
        source.scan(spark, str(tmp_path)).rows.collect()


def test_a_long_header_is_whole_or_refused(spark, tmp_path):
    lines = "\n".join(f"l{i}" for i in range(30))
    write(tmp_path / "a.csv", [["id", lines], ["1", "x"]])
    with pytest.raises(ValueError, match="header"):
        source.scan(spark, str(tmp_path))


def test_a_quote_that_is_never_closed(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,v\n1,"a\n' + "more\n" * 50)
    encodings = source.detect_encodings(spark, str(tmp_path))
    with pytest.raises(ValueError, match="more than 20 lines"):
        R.records(spark, str(tmp_path), ",", encodings, most_lines=20)
    assert R.records(spark, str(tmp_path), ",", encodings).rows.count() == 2


def test_no_path_in_the_plan(spark, tmp_path):
    for n in range(40):
        write(tmp_path / f"file-{n}.csv", [["id", "v"], [str(n), "a\nb" if n % 3 else "c"]])
    rows = source.scan(spark, str(tmp_path)).rows
    assert "file-7" not in rows._jdf.queryExecution().toString()
    assert rows.count() == 40
