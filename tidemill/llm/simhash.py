"""Near-duplicates by SimHash, found with covering locality-sensitive hashing.

Every bit of a fingerprint carries a vector of ``radius + 1`` bits. For each nonzero vector v
there is a table whose mask keeps the bits whose vector has an odd product
with v. At most ``radius`` differing bits span too small a space to meet every v, so some table
masks them all out: every pair within the radius collides there, without exception.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce
from operator import xor

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemill.llm.common import map_batches, stored, texts_of
from tidemill.llm.graph import components
from tidemill.session import materialize

BITS = 64
SEED = 42
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 16


def _signed(number: int) -> int:
    return number - (1 << BITS) if number >> (BITS - 1) else number


def masks(radius: int) -> list[int]:
    """The masks of the ``2 ** (radius + 1) - 1`` tables."""
    vectors = (1 << (radius + 1)) - 1
    of_bit = [1 + bit % vectors for bit in range(BITS)]
    return [sum(1 << bit for bit in range(BITS) if (of_bit[bit] & v).bit_count() & 1) for v in range(1, vectors + 1)]


def fingerprint(text: str, shingle: int) -> int:
    """Bits set in more than half of the hashes of all shingles, repeats included; 0 without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(itertools.accumulate(len(word) + 1 for word in words))
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    last = ends[shingle - 1 :] or ends[-1:]
    hashes = np.fromiter((digest(joined[a : b - 1], SEED) for a, b in zip(starts, last, strict=False)), np.uint64)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), BLOCK):
        counts += np.unpackbits(hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(np.uint64)[0])


def _fingerprint_batch(batch, shingle: int, text_at: int) -> list:
    found = [_signed(fingerprint(text, shingle)) for text in texts_of(batch, text_at)]
    return [*batch.columns, found]


def with_fingerprints(docs: DataFrame, text: str, shingle: int, name: str = "fingerprint") -> DataFrame:
    """``docs`` and the fingerprint of each whole text, as a signed long."""
    schema = StructType([*docs.schema.fields, StructField(name, LongType())])
    return map_batches(docs, _fingerprint_batch, schema, shingle, docs.columns.index(text))


def linked(members: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect whatever is within the radius: one fewer than members at most, not all pairs."""
    links = []
    unseen = members[1:]
    waiting = [members[0]]
    while len(unseen):
        if not waiting:
            waiting, unseen = [unseen[0]], unseen[1:]
            continue
        node = waiting.pop()
        near = np.bitwise_count((unseen ^ node).view(np.uint64)) <= radius
        if near.any():
            found = unseen[near]
            links.append((np.full(len(found), node), found))
            waiting += list(found)
            unseen = unseen[~near]
    return links


def _bucket_links(radius: int):
    """Rows (table, value, fingerprint) sorted by bucket -> links (a, b); one bucket in memory at a time."""

    def of_group(rows: np.ndarray) -> list:
        return linked(rows, radius) if len(rows) > 1 else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, open_rows = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            table, value, prints = (column.to_numpy() for column in batch.columns)
            new = np.flatnonzero((table[1:] != table[:-1]) | (value[1:] != value[:-1])) + 1
            bounds = [0, *new.tolist(), len(table)]
            links = []
            for start, end in itertools.pairwise(bounds):
                key = (table[start], value[start])
                if key != open_key:
                    if len(open_rows) > 1 or (open_rows and len(open_rows[0]) > 1):
                        links += of_group(np.concatenate(open_rows))
                    open_key, open_rows = key, []
                open_rows.append(prints[start:end])
            yield _link_batch(links)
        if open_rows:
            yield _link_batch(of_group(np.concatenate(open_rows)))

    return run


def _link_batch(links: list) -> pa.RecordBatch:
    empty = [np.zeros(0, np.int64)]
    a, b = (np.concatenate([link[i] for link in links] or empty) for i in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _ball(radius: int) -> list[tuple[int, int]]:
    """All bit patterns of at most ``radius`` bits, with their number of bits."""
    return [
        (_signed(reduce(xor, (1 << bit for bit in bits), 0)), size)
        for size in range(radius + 1)
        for bits in itertools.combinations(range(BITS), size)
    ]


def crowded_links(prints: DataFrame, radius: int) -> DataFrame:
    """Links of fingerprints from crowded buckets, in time and space linear in their number.

    Two fingerprints within the radius meet in a pattern that one reaches by flipping half the
    radius of bits, rounded down, and the other by the rest. Around a pattern only so many
    fingerprints exist, so that no group here is large.
    """
    small, large = radius // 2, radius - radius // 2
    flips = F.array(*(F.struct(F.lit(flip).alias("flip"), F.lit(size <= small).alias("near")) for flip, size in _ball(large)))
    met = prints.select("fingerprint", F.explode(flips).alias("step"))
    met = met.select("fingerprint", F.col("step.near"), F.col("fingerprint").bitwiseXOR(F.col("step.flip")).alias("pattern"))
    first = F.min(F.when(F.col("near"), F.col("fingerprint"))).over(Window.partitionBy("pattern"))
    met = met.select(F.col("fingerprint").alias("a"), first.alias("b"))
    return met.where("b IS NOT NULL AND a <> b").distinct()


def print_links(prints: DataFrame, radius: int, crowd: int = 4096) -> DataFrame:
    """Links ``a``, ``b`` that connect all of the distinct fingerprints within the radius.

    A bucket with more than ``crowd`` fingerprints is not compared inside one task;
    its members are linked by ``crowded_links``.
    """
    tables = F.array(
        *(
            F.struct(F.lit(i).alias("table"), F.col("fingerprint").bitwiseAND(F.lit(_signed(mask))).alias("value"))
            for i, mask in enumerate(masks(radius))
        )
    )
    dealt = prints.select("fingerprint", F.explode(tables).alias("bucket")).select("bucket.table", "bucket.value", "fingerprint")
    bucket = ["table", "value"]
    crowded = materialize(dealt.groupBy(bucket).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select(bucket), "crowded")
    calm = dealt.join(crowded.rows, bucket, "left_anti") if crowded.count else dealt
    links = calm.repartition(*bucket).sortWithinPartitions(*bucket).mapInArrow(_bucket_links(radius), "a bigint, b bigint")
    if crowded.count:
        members = dealt.join(crowded.rows, bucket, "left_semi").select("fingerprint").distinct()
        links = links.unionByName(crowded_links(members, radius))
    return links


def _rooted(rows: DataFrame, radius: int, crowd: int) -> DataFrame:
    """``fingerprint`` -> ``root`` for the distinct fingerprints of rows."""
    prints = stored(rows.select("fingerprint").distinct(), "fingerprints")
    roots = components(print_links(prints, radius, crowd))
    found = prints.join(roots, prints["fingerprint"] == roots["node"], "left")
    return found.select("fingerprint", F.coalesce("root", "fingerprint").alias("root"))


def near_copies(
    docs: DataFrame, shingle: int, radius: int, key: str = "doc_id", text: str = "text", crowd: int = 4096
) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``fingerprint`` (16 hexadecimal digits), ``component_id``.

    Fingerprints are linked at ``radius`` or fewer differing bits; ``component_id`` is the smallest key
    reachable by links, a null key counting as larger than all others. Texts without words, null and
    empty ones among them, have fingerprint zero, which is linked like any other. Repeated rows
    come back repeated. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    rows = with_fingerprints(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), "text", shingle)
    rows = stored(rows.select("id", "fingerprint"), "simhash")
    roots = stored(_rooted(rows, radius, crowd), "roots")
    first = rows.groupBy("fingerprint").agg(F.min("id").alias("first")).join(roots, "fingerprint")
    smallest = first.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stored(roots.join(smallest, "root").select("fingerprint", "component_id"), "components")
    return rows.join(named, "fingerprint").select(
        F.col("id").alias(key), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one_of_each(
    docs: DataFrame, shingle: int, radius: int, key: str = "doc_id", text: str = "text", crowd: int = 4096
) -> DataFrame:
    """Rows of ``docs``, all columns: of each component the row with the smallest key, and exactly one of rows that share it."""
    # the text goes to Python once, beside the other columns
    others = [name for name in docs.columns if name != text]
    packed = docs.select(F.struct(*others).alias("doc"), F.col(text).alias("text"))
    rows = with_fingerprints(packed, "text", shingle)
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "simhash_docs")
    roots = _rooted(rows, radius, crowd)
    keyed = rows.select("fingerprint", F.struct(F.col(f"doc.{key}").isNull(), F.col(f"doc.{key}"), "row").alias("place"))
    best = keyed.groupBy("fingerprint").agg(F.min("place").alias("place")).join(roots, "fingerprint")
    winners = best.groupBy("root").agg(F.min("place").alias("place")).select(F.col("place.row"))
    kept = rows.join(winners, "row", "left_semi")
    return kept.select(*(F.col("text").alias(name) if name == text else F.col(f"doc.`{name}`") for name in docs.columns))
