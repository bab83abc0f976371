"""Helpers shared by the operators: Arrow plumbing, words, stored intermediate tables."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterable, Iterator
from functools import lru_cache, wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from tidemill.session import materialize, scratch_path

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"

#: Caches of models by kind, and the kind asked for last.
_caches: dict[str, list] = {}
_asked: list[str] = []


def give_back() -> None:
    """Return free memory to the system: Python workers outlive their tasks, and what they once held would stay theirs."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not a C library that can
        pass


def kept(kind: str, most: int) -> Callable:
    """A cache of ``most`` models, emptied when a model of another kind is asked for.

    Python workers outlive their stage: without this, the models of a
    pipeline's stages would add up in them.
    """

    def wrap(make: Callable) -> Callable:
        cached = lru_cache(maxsize=most)(make)
        _caches.setdefault(kind, []).append(cached)

        @wraps(make)
        def held(*key: Hashable):
            if _asked != [kind]:
                _asked[:] = [kind]
                for other in _caches.keys() - {kind}:
                    for cache in _caches[other]:
                        cache.cache_clear()
                give_back()
            return cached(*key)

        return held

    return wrap


def parts(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that Python objects are made for few whole texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_batches(
    df: DataFrame,
    worker: Callable[..., list],
    schema: StructType,
    *settings,
) -> DataFrame:
    """``worker(batch, *settings)`` for every Arrow batch of every partition.

    The worker is a plain function of a module, so tasks import it instead of
    unpickling it, and returns one list or Arrow array per column of
    ``schema``. Batches are bounded by Spark in rows and bytes, nothing
    is kept between them but what the worker's module caches.
    """
    names = schema.names
    arrow = _arrow_types(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            columns = [
                column if isinstance(column, pa.Array) and column.type == kind else pa.array(column, type=kind)
                for column, kind in zip(worker(batch, *settings), arrow, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        give_back()

    return df.mapInArrow(run, schema)


def _arrow_types(schema: StructType) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(field.dataType) for field in schema.fields]


def texts_of(batch: pa.RecordBatch, column: int = 1) -> list[str]:
    """The texts of a column; null counts as empty."""
    return [text or "" for text in batch.column(column).to_pylist()]


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text, null: 0; one letter per word is counted, no array is made."""
    letters = F.regexp_replace(F.ltrim(F.coalesce(text, F.lit("")), F.lit(BLANKS)), r"[^ \t-\r]+[ \t-\r]*", "w")
    return F.length(letters).cast("long")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once below the scratch folder and read back: lineage ends there."""
    return materialize(df, label).rows


__all__ = ["BLANKS", "give_back", "kept", "map_batches", "parts", "scratch_path", "stored", "texts_of", "word_count"]
