"""Records of CSV files whose quoted cells hold line breaks, read by many tasks.

A split of a file cannot tell whether it begins inside a quoted cell. So every
line is first taken as what it does to the state of the reader, outside or
inside a quoted cell: it leaves the state alone, swaps it, or ends in the same one
whatever it was. What a whole split does follows from its lines; a running
composition over the splits of a file, a row each, gives every split the state it
begins in. Lines that are a record by themselves, nearly all, stay where they
are; the others are numbered by the quoted cell that holds them together and meet by that number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemill.session import Materialized, materialize

#: A quoted cell of more lines than this is taken for a quote that somebody forgot to close.
MOST_LINES = 100_000


class LineEffects:
    """What a line does to the state: whether it ends inside a quoted cell, beginning outside or inside one.

    A cell is quoted if a quote is its first character; a quote inside is doubled. What follows
    the closing quote belongs to the cell up to the delimiter.
    """

    def __init__(self, sep: str) -> None:
        s = re.escape(sep.encode())
        quoted = rb'[^"]*+(?:""[^"]*+)*+'
        closed = rb'(?:"%b"[^%b]*+|[^"%b][^%b]*+)?+' % (quoted, s, s, s)
        opened = rb'(?:%b%b)*+"%b\Z' % (closed, s, quoted)
        self._from_outside = re.compile(opened, re.DOTALL)
        self._from_inside = re.compile(rb'%b(?:\Z|"[^%b]*+%b%b)' % (quoted, s, s, opened), re.DOTALL)

    def of(self, line: bytes) -> tuple[bool, bool]:
        return self._from_outside.match(line) is not None, self._from_inside.match(line) is not None


def states(from_outside: np.ndarray, from_inside: np.ndarray, start: bool) -> np.ndarray:
    """State after each line (true: inside a quoted cell), from the state before the first."""
    at = np.arange(len(from_outside))
    fixed = np.maximum.accumulate(np.where(from_outside == from_inside, at, -1))
    swaps = np.cumsum(from_outside & ~from_inside)
    known = fixed >= 0
    since = swaps - np.where(known, swaps[fixed], 0)
    return np.where(known, from_outside[fixed], start) ^ (since % 2 == 1)


@dataclass
class _Split:
    """Where the reader is in a split, for both states it may have begun in."""

    place: tuple[str, int]
    lines: int = 0
    filled: int = 0
    inside: tuple[bool, bool] = (False, True)
    opened: tuple[int, int] = (0, 0)


def _runs(files: pa.Array, blocks: pa.Array) -> Iterator[tuple[tuple[str, int], int, int]]:
    """Stretches of a batch that lie in one split."""
    coded = files.dictionary_encode()
    numbers, starts = coded.indices.to_numpy(), blocks.to_numpy()
    ends = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(starts) != 0)) + 1
    for begin, end in zip([0, *ends], [*ends, len(numbers)], strict=True):
        if end > begin:
            yield (coded.dictionary[int(numbers[begin])].as_py(), int(starts[begin])), int(begin), int(end)


def _advance(split: _Split, values: pa.Array, effects: LineEffects) -> dict[str, np.ndarray]:
    """Columns of the next lines of a split; the split moves on behind them."""
    size = len(values)
    outside, inside = np.zeros(size, bool), np.ones(size, bool)
    for i in np.flatnonzero(pc.greater_equal(pc.find_substring(values, pattern=b'"'), 0).to_numpy(zero_copy_only=False)):
        outside[i], inside[i] = effects.of(values[int(i)].as_py())
    filled = np.array([bool(value.strip()) for value in values.to_pylist()], bool)
    columns = {"line": split.lines + np.arange(size), "filled": split.filled + np.cumsum(filled) - filled, "blank": ~filled}
    after_all, opened_all = [], []
    for number, start in enumerate(split.inside):
        after = states(outside, inside, start)
        before = np.concatenate([[start], after[:-1]])
        opens = ~before & after
        columns |= {f"before{number}": before, f"after{number}": after, f"opened{number}": split.opened[number] + np.cumsum(opens) - opens}
        after_all.append(bool(after[-1]))
        opened_all.append(split.opened[number] + int(opens.sum()))
    split.lines += size
    split.filled += int(filled.sum())
    split.inside, split.opened = tuple(after_all), tuple(opened_all)
    return columns


_TOTALS = "file string, block bigint, inside0 boolean, inside1 boolean, opened0 bigint, opened1 bigint, filled bigint"
_MARKS = (
    "file string, block bigint, value binary, line bigint, filled bigint, blank boolean, before0 boolean, after0 boolean, "
    "opened0 bigint, before1 boolean, after1 boolean, opened1 bigint"
)


def _totals(sep: str):
    """One row per split: what it does to either state, cells it opens, lines that are not blank."""

    def row(split: _Split) -> pa.RecordBatch:
        values = [*split.place, *split.inside, *split.opened, split.filled]
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
        names = [part.split(" ")[0] for part in _TOTALS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(values, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        effects, split = LineEffects(sep), None
        for batch in batches:
            for place, begin, end in _runs(batch.column(0), batch.column(1)):
                if split is None or split.place != place:
                    if split is not None:
                        yield row(split)
                    split = _Split(place)
                _advance(split, batch.column(2).slice(begin, end - begin), effects)
        if split is not None:
            yield row(split)

    return run


def _marks(sep: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        effects, split = LineEffects(sep), None
        names = [part.split(" ")[0] for part in _MARKS.split(", ")]
        for batch in batches:
            for place, begin, end in _runs(batch.column(0), batch.column(1)):
                if split is None or split.place != place:
                    split = _Split(place)
                piece = batch.slice(begin, end - begin)
                columns = _advance(split, piece.column(2), effects)
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns, *(pa.array(columns[name]) for name in names[3:])], names=names
                )

    return run


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): lines in the order of the file, with the split they lie in."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value")
    )


def split_states(lines: DataFrame, sep: str) -> DataFrame:
    """(file, block, inside, opened, filled): state, cells opened and filled lines before each split."""
    totals = lines.mapInArrow(_totals(sep), _TOTALS)
    in_file = Window.partitionBy("file").orderBy("block")
    until = in_file.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = F.col("inside0") == F.col("inside1")
    # since the last split that ends in one state whatever it began in, states only swap
    since = totals.withColumn("era", F.sum(known.cast("int")).over(until))
    ends = F.sum(F.col("inside0").cast("int")).over(Window.partitionBy("file", "era").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)) % 2 == 1
    ended = since.withColumn("ends", ends)
    begun = ended.withColumn("inside", F.coalesce(F.lag("ends").over(in_file), F.lit(False)))
    opened = F.when(F.col("inside"), F.col("opened1")).otherwise(F.col("opened0"))
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda count: F.coalesce(F.sum(count).over(before), F.lit(0))
    return begun.select("file", "block", "inside", earlier(opened).alias("opened"), earlier(F.col("filled")).alias("filled"))


@dataclass(frozen=True)
class Records:
    """``rows`` (file, header, text) of all files; ``parts`` are the lines they were put together from."""

    rows: DataFrame
    parts: Materialized


def records(spark: SparkSession, path: str, sep: str, encodings: DataFrame, most_lines: int = MOST_LINES) -> Records:
    """Records of the files below ``path`` as texts, the first filled one of each file marked as its header.

    ``encodings`` (file, encoding) has a row per file. Files are read by as many tasks as they
    have splits, whatever their cells hold. A record keeps the line breaks inside it and loses the one at its end;
    blank lines between records are left out. A quoted cell of more than
    ``most_lines`` lines is refused, because it must fit a task: most likely a quote is missing.
    """
    lines = lines_of(spark, path)
    begun = materialize(split_states(lines, sep), "splits").rows
    begun = begun.select(*(F.col(name).alias(f"begun_{name}") for name in begun.columns))
    files = encodings.select(F.col("file").alias("of_file"), "encoding")
    marked = (
        lines.mapInArrow(_marks(sep), _MARKS)
        .join(begun, (F.col("file") == F.col("begun_file")) & (F.col("block") == F.col("begun_block")), "left")
        .join(files, F.col("file") == F.col("of_file"), "left")
    )
    # splits are cut anew for every reading; a start that was not counted cannot be told
    state = F.coalesce("begun_inside", F.raise_error(F.lit("a file was split otherwise than before")).cast("boolean"))
    chosen = lambda name: F.when(state, F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
    before, after = chosen("before"), chosen("after")
    opened = F.col("begun_opened") + chosen("opened")
    number = F.when(before, opened).when(after, opened + 1)
    text = F.when(F.col("encoding") == "utf-8", F.make_valid_utf8(F.col("value").cast("string")))
    for other in ("windows-1251", "iso-8859-1"):
        text = text.when(F.col("encoding") == other, F.decode("value", other))
    marked = marked.select(
        "file", "block", "line", number.alias("number"), text.alias("text"),
        (~F.col("blank") & (F.col("begun_filled") + F.col("filled") == 0)).alias("header"), "blank",
    )
    parts = materialize(marked, "csv_lines")
    alone = parts.rows.where("number IS NULL AND NOT blank").select("file", "header", "text")
    open_cells = parts.rows.where("number IS NOT NULL").groupBy("file", "number")
    longest = open_cells.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_lines).select("file").first()
    if longest:
        raise ValueError(f"{longest['file']}: a quoted cell goes on for more than {most_lines} lines")
    ordered = F.array_sort(F.collect_list(F.struct("block", "line", "text")))
    joined = open_cells.agg(
        F.bool_or("header").alias("header"), F.array_join(F.transform(ordered, lambda part: part["text"]), "\n").alias("text")
    )
    whole = alone.unionByName(joined.select("file", "header", "text"))
    return Records(whole.withColumn("text", F.regexp_replace("text", r"\r\z", "")), parts)
