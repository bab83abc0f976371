"""Cleaning and typing of tables whose cells are all text.

Cleaning takes two passes over the data: one aggregate that answers every
question about every column at once, and the projection that uses the answers.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (
    BooleanType,
    DataType,
    DoubleType,
    FloatType,
    IntegralType,
    StructField,
    StructType,
    TimestampNTZType,
    TimestampType,
)

from tidemill.functions.names import snake_case, unique_names
from tidemill.functions.text import as_integer, as_number, as_timestamp, null_tokens_to_null, trim_to_null

# Words in a column name that hint at dates.
DATE_WORDS = frozenset(
    ["date", "дата", "time", "время", "dt", "created", "updated", "at", "on", "period", "timestamp"]
)


def quoted(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def null_tokens(df: DataFrame) -> DataFrame:
    """Cells that spell a missing value become null; cells are compared as they are, before trimming."""
    return df.select(*[null_tokens_to_null(quoted(c)).alias(c) for c in df.columns])


def drop_empty_rows(df: DataFrame) -> DataFrame:
    filled = F.lit(False)
    for name in df.columns:
        filled = filled | quoted(name).isNotNull()
    return df.filter(filled)


def filled_counts(df: DataFrame) -> dict[str, int]:
    names = df.columns
    row = df.agg(*[F.count(quoted(c)).alias(f"n{i}") for i, c in enumerate(names)]).first()
    return {c: row[f"n{i}"] for i, c in enumerate(names)}


def drop_empty_columns(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """(rows without the columns that hold no value, warnings)."""
    filled = filled_counts(df)
    kept = [c for c in df.columns if filled[c]]
    return df.select(*[quoted(c) for c in kept]), empty_column_warnings(len(df.columns) - len(kept))


def empty_column_warnings(n: int) -> list[str]:
    return [f"Удалено {n} полностью пустых столбца(-ов)."] if n else []


def duplicate_row_warnings(n: int) -> list[str]:
    return [f"Удалено {n} дублирующихся строк."] if n else []


def unread_cell_warnings(facts: dict[str, ColumnFacts], types: dict[str, str]) -> list[str]:
    """One text per column of which filled cells become null, because they are no moments."""
    lost = {c: facts[c].filled - facts[c].moments for c, kind in types.items() if kind == "timestamp_ntz"}
    return [f"{n} cells of {c} are no timestamps and became null" for c, n in lost.items() if n]


def normal_names(df: DataFrame) -> DataFrame:
    """Column names in snake case, each of them once."""
    return df.toDF(*unique_names(snake_case(c) for c in df.columns))


def trim_cells(df: DataFrame) -> DataFrame:
    """Text cells without surrounding white space; empty ones become null."""
    texts = {f.name for f in df.schema if f.dataType.typeName() == "string"}
    return df.select(*[trim_to_null(quoted(c)).alias(c) if c in texts else quoted(c) for c in df.columns])


def hints_at_date(name: str) -> bool:
    """Whole words of the name are compared: ``status`` and ``region`` hint at nothing."""
    return not DATE_WORDS.isdisjoint(name.lower().split("_"))


@dataclass(frozen=True)
class Typing:
    """How columns of text are given types.

    ``parse_rate`` is the share of filled cells that must parse before a column
    becomes a timestamp; below 1 the cells that do not become null, which :func:`clean` counts in its warnings.
    """

    parse_rate: float = 1.0
    keep_leading_zeros: bool = False
    nullable_integers_as_double: bool = False


@dataclass(frozen=True)
class ColumnFacts:
    raw_filled: int
    filled: int
    integers: int
    numbers: int
    moments: int
    leading_zeros: int


def column_facts(df: DataFrame) -> tuple[int, dict[str, ColumnFacts]]:
    """(rows, facts per column) in one pass; cells are judged as they will be after trimming."""
    trimmed = df.select("*", *[trim_to_null(quoted(c)).alias(f"_trimmed{i}") for i, c in enumerate(df.columns)])
    asked = [F.count(F.lit(1)).alias("rows")]
    for i, name in enumerate(df.columns):
        cell = F.col(f"_trimmed{i}")
        asked += [
            F.count(quoted(name)).alias(f"r{i}"),
            F.count(cell).alias(f"f{i}"),
            F.count(as_integer(cell)).alias(f"i{i}"),
            F.count(as_number(cell)).alias(f"n{i}"),
            (F.count(as_timestamp(cell)) if hints_at_date(snake_case(name)) else F.lit(0)).alias(f"t{i}"),
            F.count_if(cell.rlike(r"^[+-]?0[0-9]")).alias(f"z{i}"),
        ]
    row = trimmed.agg(*asked).first()
    facts = {
        name: ColumnFacts(*(row[f"{k}{i}"] or 0 for k in "rfintz")) for i, name in enumerate(df.columns)
    }
    return row["rows"], facts


def inferred_type(name: str, rows: int, facts: ColumnFacts, typing: Typing = Typing()) -> str:
    """A column gets a type as a whole or stays text."""
    if not facts.filled:
        return "string"
    if hints_at_date(name) and facts.moments and facts.moments >= typing.parse_rate * facts.filled:
        return "timestamp_ntz"
    if typing.keep_leading_zeros and facts.leading_zeros:
        return "string"
    if facts.integers == facts.filled:
        return "double" if typing.nullable_integers_as_double and facts.filled < rows else "bigint"
    return "double" if facts.numbers == facts.filled else "string"


_READ_AS = {"timestamp_ntz": as_timestamp, "bigint": as_integer, "double": as_number}


def typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """The columns of ``df`` read as ``types``; text columns are left alone."""
    return df.select(
        *[
            _READ_AS[types[c]](quoted(c)).alias(c) if types.get(c, "string") in _READ_AS else quoted(c)
            for c in df.columns
        ]
    )


def infer_types(df: DataFrame, typing: Typing = Typing(), only: Sequence[str] | None = None) -> DataFrame:
    """Types for the text columns of ``df`` (or those in ``only``), all or nothing per column."""
    names = list(df.columns if only is None else only)
    rows, facts = column_facts(df.select(*[quoted(c) for c in names]))
    return typed(trim_cells(df), {c: inferred_type(c, rows, facts[c], typing) for c in names})


def drop_repeated_rows(df: DataFrame) -> DataFrame:
    """Each distinct row once; nulls are equal.

    Spark drops repeats inside each task before the shuffle, so a group of
    copies sends one row per task.
    """
    return df.dropDuplicates()


@dataclass(frozen=True)
class Cleaned:
    """``rows`` is lazy; ``rows_before_dedup`` counts its rows before repeats are dropped."""

    rows: DataFrame
    rows_before_dedup: int
    warnings: list[str] = field(default_factory=list)


def clean(raw: DataFrame, typing: Typing = Typing(), drop_after_trim: bool = False) -> Cleaned:
    """Drop empty rows and columns, normalise names, trim, type, drop repeats: in this order.

    Rows and columns that hold white space alone are not empty unless
    ``drop_after_trim`` is set.
    """
    df = null_tokens(raw)
    if drop_after_trim:
        df = trim_cells(df)
    df = drop_empty_rows(df)
    rows, facts = column_facts(df)
    kept = [c for c in df.columns if facts[c].raw_filled]
    names = unique_names(snake_case(c) for c in kept)
    types = {name: inferred_type(name, rows, facts[c], typing) for name, c in zip(names, kept)}
    df = trim_cells(df.select(*[quoted(c).alias(name) for c, name in zip(kept, names)]))
    warnings = empty_column_warnings(len(raw.columns) - len(kept))
    warnings += unread_cell_warnings({name: facts[c] for c, name in zip(kept, names)}, types)
    return Cleaned(drop_repeated_rows(typed(df, types)), rows, warnings)


# -- column profile ----------------------------------------------------------


def sql_type_name(kind: DataType) -> str:
    """The SQL type a column is reported with."""
    if isinstance(kind, IntegralType):
        return "BIGINT"
    if isinstance(kind, (DoubleType, FloatType)):
        return "DOUBLE PRECISION"
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return "TIMESTAMP"
    return "BOOLEAN" if isinstance(kind, BooleanType) else "TEXT"


def column_profile(df: DataFrame, schema: StructType | None = None) -> DataFrame:
    """(position, name, sql_type, nullable): a column is nullable if a null was seen in it.

    One aggregate of counts over all columns, turned to rows afterwards.
    """
    fields = (schema or df.schema).fields
    return profile_of(df, list(enumerate(fields, start=1)))


def profile_of(df: DataFrame, fields: Sequence[tuple[int, StructField]]) -> DataFrame:
    """The profile of some columns, given with their positions. Counts are what a source may answer itself."""
    counts = df.agg(F.count(F.lit(1)).alias("all"), *[F.count(quoted(f.name)).alias(f"c{i}") for i, f in fields])
    entries = [
        F.struct(
            F.lit(i).cast("bigint").alias("position"),
            F.lit(f.name).alias("name"),
            F.lit(sql_type_name(f.dataType)).alias("sql_type"),
            F.coalesce(F.col(f"c{i}") < F.col("all"), F.lit(False)).alias("nullable"),
        )
        for i, f in fields
    ]
    return counts.select(F.inline(F.array(*entries)))
