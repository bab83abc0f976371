"""Exact deduplication that takes frequent texts out before anything is shuffled.

Misra-Gries summaries of the partitions, added up, name every digest that may hold
more than a given share of all rows. Their exact counts and last rows are found by a
partial aggregate over those few digests, and the verified winners, fewer than
``counters`` by definition, are broadcast: rows with these digests are
answered where they are. All other digests, each with a bounded share of the
rows, take the ordinary shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemill.session import materialize


def frequent(digests: Iterator[bytes], counters: int) -> Counter:
    """A Misra-Gries summary: short of the true count by at most rows / (counters + 1)."""
    held: Counter = Counter()
    for digest in digests:
        if digest in held or len(held) < counters:
            held[digest] += 1
        else:
            held = Counter({d: n - 1 for d, n in held.items() if n > 1})
    return held


def _summaries(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = frequent((d for batch in batches for d in batch.column(0).to_pylist()), counters)
        yield pa.RecordBatch.from_arrays(
            [pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["digest", "counted"]
        )

    return run


def find_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", counters: int = 1000) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when they are identical; null counts as empty. Of equal
    texts the row with the largest key stays, a null key being smaller than any
    other; of rows repeated with the same key exactly one stays. Texts are told
    apart by SHA-256. An empty table gives no rows; columns other than the
    two are ignored, whatever their names.
    """
    found = materialize(
        docs.select(
            F.col(key).alias("id"),
            F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "digests",
    )
    rows, total = found.rows, found.count
    # A digest with more than 2 / (counters + 1) of all rows keeps more than
    # 1 / (counters + 1) of them in the sum of the summaries, and fewer than
    # counters + 1 digests can do so.
    candidates = (
        rows.select("digest")
        .mapInArrow(_summaries(counters), "digest binary, counted bigint")
        .groupBy("digest")
        .agg(F.sum("counted").alias("counted"))
        .where(F.col("counted") * (counters + 1) > total)
        .select("digest")
    )
    candidates = materialize(candidates, "candidates").rows
    last = F.max(F.struct("id", "row"))
    winners = (
        rows.join(F.broadcast(candidates), "digest", "left_semi")
        .groupBy("digest")
        .agg(last.alias("last"), F.count(F.lit(1)).alias("group_size"))
        .where(F.col("group_size") * (counters + 1) > 2 * total)
    )
    winners = F.broadcast(materialize(winners, "winners").rows)
    same = Window.partitionBy("digest")
    hot = rows.join(winners, "digest").select("id", "digest", "row", "last", "group_size")
    others = rows.join(winners, "digest", "left_anti").select(
        "id", "digest", "row", last.over(same).alias("last"), F.count(F.lit(1)).over(same).alias("group_size")
    )
    return hot.unionByName(others).select(
        F.col("id").alias(key),
        F.col("last.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("last.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
