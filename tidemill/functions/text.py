"""Expressions over text cells."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The cells a CSV reader takes for missing by default.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

_BLANKS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def null_tokens_to_null(cell: Column) -> Column:
    return F.when(~cell.isin(*NULL_TOKENS), cell)


def strip_blanks(cell: Column) -> Column:
    """Without leading and trailing white space of any kind (``trim`` removes spaces only)."""
    return F.regexp_replace(cell, _BLANKS, "")


def trim_to_null(cell: Column) -> Column:
    return F.nullif(strip_blanks(cell), F.lit(""))


_INTEGER = r"^[+-]?[0-9]+$"
_DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_SPECIAL = r"(?i)^[+-]?(inf|infinity|nan)$"


def as_integer(cell: Column) -> Column:
    """The integer a cell spells, else null."""
    return F.when(cell.rlike(_INTEGER), cell.try_cast("bigint"))


def as_number(cell: Column) -> Column:
    """The number a cell spells, else null.

    An integer beyond 64 bits does not count as a number, so that digits are
    never lost; ``1d`` and ``0x1p3``, which a plain cast takes, do not either.
    """
    integer = cell.rlike(_INTEGER)
    other = cell.rlike(_DECIMAL) | cell.rlike(_SPECIAL)
    return F.when(integer, F.when(cell.try_cast("bigint").isNotNull(), cell.try_cast("double"))).when(
        other, cell.try_cast("double")
    )


_CLOCK = r"([ T][0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,6})?)?)?$"
_ISO = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}" + _CLOCK
_DOTTED = r"^([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{4})" + _CLOCK
_SLASHED = r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})" + _CLOCK


def as_timestamp(cell: Column) -> Column:
    """The moment a cell spells, else null: ISO, ``dd.MM.yyyy`` or ``MM/dd/yyyy``, with or without a time.

    No time zone is involved on any way.
    """
    iso = (
        F.when(cell.rlike(_ISO), cell)
        .when(cell.rlike(_DOTTED), F.regexp_replace(cell, _DOTTED, "$3-$2-$1$4"))
        .when(cell.rlike(_SLASHED), F.regexp_replace(cell, _SLASHED, "$3-$1-$2$4"))
    )
    return iso.try_cast("timestamp_ntz")
