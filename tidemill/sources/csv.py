"""CSV files of unknown encoding and delimiter."""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence
from dataclasses import dataclass, replace
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidemill.functions.names import header_names, qualified, table_name
from tidemill.operators.cleaning import Typing, clean, duplicate_row_warnings, quoted
from tidemill.operators.loads import Expectations, LoadReport, ReportedColumn, StageRejected, create_replace, set_aside
from tidemill.session import materialize
from tidemill.sources import catalog
from tidemill.sources.records import records

DELIMITERS = (",", ";", "\t", "|")
UTF8, CP1251, LATIN1 = "utf-8", "windows-1251", "iso-8859-1"
_BAD = "_unparsed_line"


def intake(spark: SparkSession, path: str) -> DataFrame:
    """(file, length, accepted, reason) for every file below ``path``.

    A file must be named ``*.csv`` and hold something.  Contents are not read.
    A scan leaves out empty files, so the listing itself names them.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    listed = spark.createDataFrame([(unquote(name),) for name in found.inputFiles()], "file string")
    plain = [F.regexp_replace(c, "^([a-z]+):///", "$1:/").alias("file") for c in ("file", "path")]
    files = listed.select(plain[0]).join(found.select(plain[1], "length"), "file", "left")
    length = F.coalesce("length", F.lit(0).cast("bigint"))
    reason = F.when(~F.lower("file").endswith(".csv"), "not a .csv file").when(length == 0, "empty file")
    return files.select("file", length.alias("length"), reason.isNull().alias("accepted"), reason.alias("reason"))


def detect_encodings(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(file, encoding, open_quotes): UTF-8 if every line is, else CP1251, or Latin-1 if a byte has no meaning in CP1251.

    ``open_quotes``: some line holds an odd number of quotes, so a quoted cell goes on in the next line.

    Lines are judged where they lie; each task sends on one row per file.
    """
    line = F.col("value").cast("binary")
    valid = F.is_valid_utf8("value")
    beyond_1251 = F.when(valid, F.lit(False)).otherwise(F.contains(line, F.lit(b"\x98")))
    odd = (F.length(line) - F.length(F.replace("value", F.lit('"'), F.lit("")).cast("binary"))) % 2 == 1
    per_file = (
        spark.read.text(paths)
        .select(F.col("_metadata.file_path").alias("file"), valid.alias("valid"), beyond_1251.alias("beyond"), odd.alias("odd"))
        .groupBy("file")
        .agg(F.bool_and("valid").alias("valid"), F.bool_or("beyond").alias("beyond"), F.bool_or("odd").alias("odd"))
    )
    encoding = F.when(F.col("valid"), UTF8).when(F.col("beyond"), LATIN1).otherwise(CP1251)
    return per_file.select("file", encoding.alias("encoding"), F.col("odd").alias("open_quotes"))


def detect_delimiter(header: str) -> str:
    """The most frequent of ``, ; tab |`` outside quotes; a comma if there is none."""
    bare = "".join(header.split('"')[::2])
    best = max(DELIMITERS, key=bare.count)
    return best if bare.count(best) else ","


@dataclass(frozen=True)
class CsvShape:
    encoding: str
    sep: str
    columns: list[str]
    plain_header: bool = True


HEADER_LINES = 20


def first_line(spark: SparkSession, path: str, encoding: str) -> str:
    """The first line that is not blank, and those after it while a quoted cell is open (``HEADER_LINES`` at most)."""
    lines = spark.read.text(path).filter(F.trim("value") != "").select(F.col("value").cast("binary").alias("b"))
    rows = lines.take(1)
    if not rows:
        raise ValueError(f"{path} holds no lines")
    text = bytes(rows[0]["b"])
    if text.count(b'"') % 2:
        text = b""
        for row in lines.take(HEADER_LINES):
            text += bytes(row["b"])
            if text.count(b'"') % 2 == 0:
                break
            text += b"\n"
        else:
            raise ValueError(f"{path}: the header has a quoted cell that {HEADER_LINES} lines do not close")
    return text.decode("utf-8-sig" if encoding == UTF8 else encoding)


def shape_of(spark: SparkSession, path: str, encoding: str, sep: str | None = None) -> CsvShape:
    """Delimiter and column names from the header line."""
    header = first_line(spark, path, encoding)
    sep = sep or detect_delimiter(header)
    cells = next(csv.reader(io.StringIO(header), delimiter=sep))
    return CsvShape(encoding, sep, header_names(cells), cells == header_names(cells))


def _allow(spark: SparkSession, *encodings: str) -> None:
    """Spark refuses to decode CP1251 unless this is set."""
    if CP1251 in encodings:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def _read_alike(spark: SparkSession, files: Sequence[str], shape: CsvShape) -> DataFrame:
    """Files of one encoding, without line breaks in cells, as text columns c0, c1, … with the line kept where it did not fit.

    The parser must see every column, whatever is selected later, to tell which
    lines do not fit.  Where the header cells are distinct names, Spark compares
    the header of each file with them as it opens the file.
    """
    _allow(spark, shape.encoding)
    width = len(shape.columns)
    cells = [StructField(f"c{i}", StringType()) for i in range(width)]
    comparable = shape.plain_header and len({c.lower() for c in [*shape.columns, _BAD]}) == width + 1
    read_as = [StructField(c, StringType()) for c in shape.columns] if comparable else cells
    options = {"sep": shape.sep, "quote": '"', "escape": '"'}
    parsed = (
        spark.read.schema(StructType([*read_as, StructField(_BAD, StringType())]))
        .options(
            header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=_BAD,
            encoding=shape.encoding, enforceSchema=not comparable, columnPruning=False, **options,
        )
        .csv(list(files))
    )
    parsed = parsed.select(
        *[quoted(f.name).alias(f"c{i}") for i, f in enumerate(read_as)], _BAD, F.col("_metadata.file_path").alias("_file")
    )
    wider = StructType([*cells, StructField("beyond", StringType())])
    # Spark refuses plans that read nothing but the kept line, hence the mention of c0.
    beyond = F.from_csv(F.coalesce(F.col(_BAD), F.col("c0")), wider.simpleString()[len("struct<"):-1].replace(":", " "), options)
    too_long = F.coalesce(F.when(F.col(_BAD).isNotNull(), beyond.getField("beyond").isNotNull()), F.lit(False))
    return parsed.select("*", too_long.alias("_too_long"))


@dataclass(frozen=True)
class CsvScan:
    """``rows`` with the names of the header; ``rejects`` (file, first_cell, line) did not fit it."""

    rows: DataFrame
    rejects: DataFrame
    shape: CsvShape


def _read_records(spark: SparkSession, path: str, encodings: DataFrame, shape: CsvShape) -> DataFrame:
    """Files of any encoding with line breaks in cells, in the form of ``_read_alike``; every header is compared."""
    found = records(spark, path, shape.sep, encodings).rows
    headers = found.where("header").select("text").distinct().take(HEADER_LINES + 1)
    if any(cells_of(row["text"], shape.sep) != shape.columns for row in headers):
        raise ValueError(f"{path}: files with different headers")
    fields = ", ".join(f"c{i} string" for i in range(len(shape.columns))) + ", beyond string"
    cells = F.from_csv("text", fields, {"sep": shape.sep, "quote": '"', "escape": '"', "maxCharsPerColumn": "-1"})
    parsed = found.where("NOT header").select("file", "text", cells.alias("cells"))
    return parsed.select(
        *(F.col(f"cells.c{i}").alias(f"c{i}") for i in range(len(shape.columns))),
        F.col("text").alias(_BAD), F.col("file").alias("_file"), F.col("cells.beyond").isNotNull().alias("_too_long"),
    )


def cells_of(header: str, sep: str) -> list[str]:
    """Column names of a header record."""
    return header_names(next(csv.reader(io.StringIO(header.lstrip("\ufeff"), newline=""), delimiter=sep)))


def scan(
    spark: SparkSession, path: str, sep: str | None = None, multiline: bool | None = None, encoding: str | None = None
) -> CsvScan:
    """All cells as text.  Short rows are filled with nulls, rows with cells beyond the header are rejected.

    The files below ``path`` share one header; each is read in its own
    encoding.  ``multiline`` allows line breaks in quoted cells; left open, they are looked for.  Files without
    such breaks and of one encoding go to Spark's reader as they are. All others are put together from
    their lines by as many tasks as they have splits; what is told of a file is a row of a table and joined.
    Naming ``multiline`` and the ``encoding`` saves the pass that looks for them.
    """
    listed = spark.read.text(path).select(F.col("_metadata.file_path").alias("file")).distinct
    if encoding and multiline is not None:
        files = listed().select("file", F.lit(encoding).alias("encoding"), F.lit(multiline).alias("open_quotes")) if multiline else None
        ways = [(encoding, multiline)]
    else:
        files = materialize(detect_encodings(spark, path), "encodings").rows
        if encoding:
            files = files.withColumn("encoding", F.lit(encoding))
        if multiline is not None:
            files = files.withColumn("open_quotes", F.lit(multiline))
        ways = sorted((row["encoding"], row["open_quotes"]) for row in files.select("encoding", "open_quotes").distinct().collect())
    if not ways:
        raise ValueError(f"{path} holds no lines")
    if ways == [(ways[0][0], False)]:
        shape = shape_of(spark, path, ways[0][0], sep)
        whole = _read_alike(spark, [path], shape)
    else:
        _allow(spark, *(way[0] for way in ways))
        first = files.orderBy("file").first()
        shape = shape_of(spark, unquote(first["file"]), first["encoding"], sep)
        whole = _read_records(spark, path, files, shape)
    rows = whole.filter(~F.col("_too_long")).select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(shape.columns)])
    rejects = whole.filter("_too_long").select(
        F.col("_file").alias("file"), F.col("c0").alias("first_cell"), F.col(_BAD).alias("line")
    )
    return CsvScan(rows, rejects, shape)


def load(
    spark: SparkSession,
    path: str,
    table: str | None = None,
    schema: str | None = None,
    replace_if_exists: bool = True,
    typing: Typing = Typing(),
    sep: str | None = None,
    multiline: bool | None = None,
    encoding: str | None = None,
    most_rejects: int | None = None,
) -> LoadReport:
    """CSV files to a table: scan, clean, type, stage, swap.

    The report names the columns, their types and whether nulls are in them. Lines with more cells
    than the header are set aside in ``<table>_rejects`` and counted in the report; with more than ``most_rejects`` of them nothing is loaded.
    """
    target = qualified(table_name(table, path.rstrip("/").rsplit("/", 1)[-1]), schema)
    existed = spark.catalog.tableExists(target)
    if existed and not replace_if_exists:
        raise ValueError(f"{target} exists")
    scanned = scan(spark, path, sep, multiline, encoding)
    if most_rejects is not None and (found := scanned.rejects.count()) > most_rejects:
        raise StageRejected(f"{target}: {found} lines do not fit the header, at most {most_rejects} expected")
    result = clean(scanned.rows, typing)
    if not result.rows.columns:
        raise StageRejected(f"{target}: no data is left after cleaning")
    report = create_replace(result.rows, target, Expectations(min_rows=1))
    warnings = result.warnings + duplicate_row_warnings(result.rows_before_dedup - report.rows)
    rejected, rejects_table = set_aside(scanned.rejects, target)
    if rejected:
        warnings = [*warnings, f"{rejected} lines with more cells than the header are in {rejects_table}"]
    kept = catalog.columns(spark, tables=[target]).orderBy("position").collect()
    columns = [ReportedColumn(row["column"], row["type"], row["nullable"]) for row in kept]
    return replace(report, warnings=warnings, rejected=rejected, rejects_table=rejects_table, columns=columns)
