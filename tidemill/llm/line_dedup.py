"""Removal of lines that other documents hold as well.

Two Bloom filters are built over 64-bit hashes of the lines, each document
counting a line once: one of hashes seen, one of hashes seen again. The hash space is cut
into slices, so that each slice is built by one task in bounded memory. Only lines
that the second filter suspects are shuffled, as digests; there it is settled
which are repeated and which document holds them first. False positives of the
filters cost shuffle, never results.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from tidemill.llm.common import BLANKS, parts, texts_of
from tidemill.session import materialize

#: Bits of one slice of a filter: 1 MB.
SLICE_BITS = 1 << 23
PROBES = 3


def line_key(line: str) -> tuple[str, bytes]:
    """What a line is compared by: blanks stripped at both ends, A-Z in lower case."""
    stripped = line.strip(BLANKS)
    return stripped, stripped.encode().lower()


def long_keys(text: str, least: int) -> set[bytes]:
    keys = (line_key(line) for line in text.split("\n"))
    return {key for stripped, key in keys if len(stripped) >= least}


def _hashes(keys) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(key) for key in keys), np.uint64)


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def slice_of(hashes: np.ndarray, slices: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) % np.uint64(slices)).astype(np.int32)


def probes(hashes: np.ndarray) -> np.ndarray:
    """Places of each hash in its slice, one row per probe."""
    first = hashes & np.uint64(0xFFFFFFFF)
    step = (hashes >> np.uint64(29)) | np.uint64(1)
    return np.stack([(first + np.uint64(i) * step) % np.uint64(SLICE_BITS) for i in range(PROBES)]).astype(np.int64)


class Filter:
    """A slice of a Bloom filter."""

    def __init__(self, content: bytes | None = None) -> None:
        self.bytes = np.frombuffer(content, np.uint8) if content else np.zeros(SLICE_BITS // 8, np.uint8)

    def has(self, places: np.ndarray) -> np.ndarray:
        return ((self.bytes[places >> 3] >> (places & 7).astype(np.uint8)) & 1).all(axis=0)

    def put(self, places: np.ndarray) -> None:
        flat = places.ravel()
        np.bitwise_or.at(self.bytes, flat >> 3, np.left_shift(1, flat & 7).astype(np.uint8))


def _hash_rows(least: int, slices: int):
    """Per batch of documents and slice: the distinct hashes, and those of two documents of the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            per_text = [_hashes(long_keys(text, least)) for part in parts([batch]) for text in texts_of(part, 0)]
            if not per_text:
                continue
            once, counts = np.unique(np.concatenate(per_text), return_counts=True)
            in_slice = slice_of(once, slices)
            order = np.argsort(in_slice, kind="stable")
            found, starts = np.unique(in_slice[order], return_index=True)
            rows = [(once[at], once[at[counts[at] > 1]]) for at in np.split(order, starts[1:]) if len(at)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(found[: len(rows)], pa.int32()),
                    pa.array([a.tobytes() for a, _ in rows], pa.binary()),
                    pa.array([b.tobytes() for _, b in rows], pa.binary()),
                ],
                names=["slice", "once", "twice"],
            )

    return run


def _filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by slice -> the filter of hashes seen again, by slice; two filters in memory at a time."""
    current, once, twice = None, Filter(), Filter()

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([current], pa.int32()), pa.array([twice.bytes.tobytes()], pa.binary())], names=["slice", "twice"]
        )

    for batch in batches:
        rows = (zip(*(column.to_pylist() for column in piece.columns), strict=True) for piece in parts([batch]))
        for part, seen, again in itertools.chain.from_iterable(rows):
            if part != current:
                if current is not None:
                    yield done()
                current, once, twice = part, Filter(), Filter()
            places = probes(np.frombuffer(seen, np.uint64))
            known = once.has(places)
            twice.put(places[:, known])
            twice.put(probes(np.frombuffer(again, np.uint64)))
            once.put(places)
    if current is not None:
        yield done()


def _suspects(least: int, filters):
    """Digests of the lines of each document that the filter of repeated hashes holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {part: Filter(content) for part, content in filters.value.items()}
        slices = max(held, default=-1) + 1
        for batch in parts(batches):
            rows, digests = [], []
            for row, text in enumerate(texts_of(batch)):
                keys = list(long_keys(text, least))
                if not keys or not slices:
                    continue
                hashes = _hashes(keys)
                in_slice, places = slice_of(hashes, slices), probes(hashes)
                for part in np.unique(in_slice):
                    at = np.flatnonzero(in_slice == part)
                    for i in at[held[part].has(places[:, at])]:
                        rows.append(row)
                        digests.append(_digest(keys[i]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int32())), pa.array(digests, pa.binary())], names=["id", "digest"]
            )

    return run


def filter_of_repeats(docs: DataFrame, text: str, least: int, lines: int, most_bytes: int) -> dict[int, bytes]:
    """The filter of line hashes seen in two documents, by slice.

    Ten bits a line, but ``most_bytes`` in all: a filter that is too small
    suspects more lines and changes no result, so that the driver and the tasks hold
    a bounded filter however long the table is. Slices nobody hashed to are empty.
    """
    slices = max(1, min(most_bytes * 8, 10 * lines) // SLICE_BITS)
    spread = min(slices, 256)
    built = (
        docs.select(text)
        .mapInArrow(_hash_rows(least, slices), "slice int, once binary, twice binary")
        .repartition(spread, "slice")
        .sortWithinPartitions("slice")
        .mapInArrow(_filters, "slice int, twice binary")
    )
    empty = bytes(SLICE_BITS // 8)
    return dict.fromkeys(range(slices), empty) | {row["slice"]: bytes(row["twice"]) for row in built.collect()}


def repeated_lines(docs: DataFrame, key: str, text: str, least: int = 10, most_bytes: int = 32 << 20) -> DataFrame:
    """Exact list of what goes: ``id`` of a document, ``digest`` of a line an earlier document holds."""
    spark: SparkSession = docs.sparkSession
    shown = F.coalesce(F.col(text), F.lit(""))
    lines = docs.select(F.sum(F.length(shown) - F.length(F.translate(shown, "\n", "")) + 1).alias("n")).first()["n"] or 0
    filters = spark.sparkContext.broadcast(filter_of_repeats(docs, text, least, lines, most_bytes))
    kind = docs.schema[key].dataType
    schema = StructType([StructField("id", kind), StructField("digest", BinaryType())])
    suspects = materialize(
        docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(_suspects(least, filters), schema), "suspects"
    ).rows
    # A very common line has many rows here, but one row in the aggregate, so that
    # adaptive execution can split it in the join.
    first = suspects.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL")
    return suspects.join(first, "digest").where(~F.col("id").eqNullSafe(F.col("first"))).select("id", "digest")


def _without(text: str, drop: frozenset[bytes], least: int) -> tuple[str, int, int]:
    lines = text.split("\n")
    if not drop:
        return text, len(lines), 0
    kept = []
    for line in lines:
        stripped, key = line_key(line)
        if len(stripped) < least or _digest(key) not in drop:
            kept.append(line)
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def _rebuild(least: int, place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            drops = batch.column(batch.num_columns - 1).to_pylist()
            done = [_without(text, frozenset(drop or ()), least) for text, drop in zip(texts_of(batch, place), drops, strict=True)]
            columns = batch.columns[:-1]
            columns[place] = pa.array([row[0] for row in done], pa.string())
            columns += [pa.array([row[i] for row in done], pa.int64()) for i in (1, 2)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "n_lines", "n_dropped"])

    return run


def drop_repeated_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 10, most_bytes: int = 32 << 20
) -> DataFrame:
    """``docs`` without the lines an earlier document holds, and ``n_lines`` (before), ``n_dropped``.

    Lines end at line feeds; null and empty texts are one empty line and come back
    empty. Lines are compared without blanks at both ends and with A-Z in lower
    case, if that leaves ``least`` code points or more. Of a line in several
    documents, only the document with the smallest key keeps it, each time it has
    it; rows of one key are one document, rows without a key come after
    all others and keep what no row with a key holds. All other columns stay as
    they are; columns of ``docs`` named like the two new ones give way to them.
    """
    docs = docs.drop(*({"n_lines", "n_dropped"} - {key, text}))
    drops = repeated_lines(docs, key, text, least, most_bytes)
    drops = drops.groupBy("id").agg(F.collect_list("digest").alias("digests"))
    # Names of docs cannot clash: its columns are reached through the frame.
    marked = docs.join(drops, docs[key].eqNullSafe(drops["id"]), "left").select(*(docs[name] for name in docs.columns), drops["digests"])
    fields = [StructField(f.name, StringType()) if f.name == text else f for f in docs.schema.fields]
    schema = StructType([*fields, StructField("n_lines", LongType()), StructField("n_dropped", LongType())])
    return marked.mapInArrow(_rebuild(least, docs.columns.index(text)), schema)
