"""Identifiers made from arbitrary names (metadata: runs on column and table names)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, functions as F

IDENTIFIER = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


def snake_case(name: str, translate: dict[str, str] | None = None) -> str:
    """Lower-case ASCII identifier; ``col`` when nothing is left.

    Letters without an ASCII base are dropped unless ``translate`` names them
    (Cyrillic letters, for instance, have none).
    """
    if translate:
        name = name.translate(str.maketrans(translate))
    ascii_only = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode("ascii")
    words = re.sub(r"[\s/-]+", "_", ascii_only.strip().lower())
    kept = "".join(ch for ch in words if ch == "_" or ch.isalnum())
    return re.sub(r"_{2,}", "_", kept).strip("_") or "col"


def unique_names(names: Iterable[str]) -> list[str]:
    """Repeated names get ``_1``, ``_2``, … (the first number that gives a free name)."""
    given = list(names)
    taken: set[str] = set()
    reserved = set(given)
    out = []
    for name in given:
        candidate, n = name, 0
        while candidate in taken or (n and candidate in reserved):
            n += 1
            candidate = f"{name}_{n}"
        taken.add(candidate)
        out.append(candidate)
    return out


def header_names(cells: Iterable[str | None]) -> list[str]:
    """Names as a header row gives them: blank ones are numbered, repeated ones get ``.1``, ``.2``."""
    seen: dict[str, int] = {}
    out = []
    for position, cell in enumerate(cells):
        name = cell if cell else f"Unnamed: {position}"
        count = seen.get(name, 0)
        seen[name] = count + 1
        out.append(f"{name}.{count}" if count else name)
    return out


def table_name(explicit: str | None, file_name: str) -> str:
    """The explicit name, else the file name without its ``.csv``; both in snake case."""
    return snake_case(explicit if explicit else re.sub(r"(?i)\.csv$", "", file_name))


def qualified(table: str, schema: str | None = None) -> str:
    """``schema.table``, without prefix for the default schema."""
    if not schema or schema in ("public", "default"):
        return table
    if not IDENTIFIER.match(schema):
        raise ValueError(f"invalid schema name: {schema}")
    return f"{schema}.{table}"


def _ascii_base(name: Column) -> Column:
    # Defined here and not at module level, so that it travels to the executors
    # by value: these need not have the package installed.
    @F.pandas_udf("string")
    def ascii_base(text: pd.Series) -> pd.Series:
        return text.str.normalize("NFKD").str.encode("ascii", "ignore").str.decode("ascii")

    return ascii_base(name)


def snake_case_column(name: Column) -> Column:
    """``snake_case`` over a column of names.

    Only the Unicode decomposition, which Spark lacks, runs in Python (Arrow
    batches); the rest is built in.
    """
    text = F.lower(_ascii_base(name))
    text = F.regexp_replace(text, r"^\s+|\s+$", "")
    text = F.regexp_replace(text, r"[\s/-]+", "_")
    text = F.regexp_replace(text, r"[^a-z0-9_]", "")
    text = F.regexp_replace(text, r"_{2,}", "_")
    text = F.regexp_replace(text, r"^_|_$", "")
    return F.when(text != "", text).otherwise("col")


def table_name_column(explicit: Column, file_path: Column) -> Column:
    """``table_name`` over many files."""
    stem = F.regexp_replace(F.regexp_extract(file_path, r"([^/]*)$", 1), r"(?i)\.csv$", "")
    return snake_case_column(F.coalesce(F.nullif(explicit, F.lit("")), stem))
