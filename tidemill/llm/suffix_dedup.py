"""Removal of byte strings that occur earlier in the corpus, by parsing it into phrases.

Rolling hashes of 8 bytes choose triggers: the least hash in some window of the given length. So every window
has exactly one trigger, equal windows have it at the same place, and the text between
two triggers is a phrase. All windows of one trigger, half of them to either side, make an entry of the dictionary:
a stretch of text a little longer than a window. The parse lists which entry stands where in the corpus.

What is equal is found in three steps. Entries are grouped by the bytes around their trigger that
all their windows share; a group of one entry, by far the most, is done with. Of an entry that occurs again
as a whole, the parse tells the first place, and all others are repeats. What
is left, different entries of one group, are the places where repeated passages begin and end: the suffixes of
these dictionary entries are sorted, equal ones in the order of the parse, that is of the corpus, and all but the first are repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from tidemill.llm.common import texts_of
from tidemill.session import materialize

GRAM = 8
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64((1 << 40) - 1)
_rng = np.random.default_rng(20)
_BASE = np.uint64(int(_rng.integers(1 << 62)) * 2 + 1)
_VALUES = _rng.integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < size:
        size = max(size, 2 * len(_powers))
        one = np.ones(1, np.uint64)
        _powers = np.concatenate([one, np.cumprod(np.full(size, _BASE))])
        _inverse = np.concatenate([one, np.cumprod(np.full(size, np.uint64(pow(int(_BASE), -1, 1 << 64))))])
    return _powers, _inverse


class Hashes:
    """Polynomial hashes of any stretch of a text, from running sums."""

    def __init__(self, data: np.ndarray) -> None:
        powers, self.inverse = _power_tables(len(data) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[data] * powers[: len(data)])])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        value = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
        value = (value ^ (value >> np.uint64(32))) * _MIX
        return value ^ (value >> np.uint64(29))


def triggers(data: np.ndarray, length: int) -> np.ndarray:
    """For each window of ``length`` bytes, by its start, the place of its trigger."""
    grams = np.ndarray(len(data) - GRAM + 1, "<u8", np.ascontiguousarray(data), strides=(1,))
    mixed = grams * _MIX
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX
    least = (mixed & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)  # of equal hashes the leftmost
    span, covered = length - GRAM + 1, 1
    while covered * 2 <= span:
        least = np.minimum(least[:-covered], least[covered:])
        covered *= 2
    if covered < span:
        least = np.minimum(least[: covered - span], least[span - covered :])
    return (least & _PLACE).astype(np.int64)


def entries(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Dictionary entries of a text: first and last window start, hash of what all windows share, hash of the whole.

    Windows that begin up to ``half`` bytes before their trigger share the bytes from the trigger on, the others those before it.
    """
    at = triggers(data, length)
    starts = np.arange(len(at))
    half = (length - GRAM) // 2
    left = starts < at - half
    change = np.flatnonzero((at[1:] != at[:-1]) | (left[1:] != left[:-1])) + 1
    first = np.concatenate([[0], change])
    last = np.concatenate([change, [len(at)]]) - 1
    trigger, left = at[first], left[first]
    hashes = Hashes(data)
    shared = hashes.of(np.where(left, trigger - half - 1, trigger), np.where(left, trigger + GRAM, trigger + length - half))
    shared ^= left.astype(np.uint64)
    whole = hashes.of(first, last + length) + (trigger - first).astype(np.uint64) * _MIX
    return first, last, shared, whole


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8)


_PARSE = "known boolean, shared long, whole long, id {id}, text_hash long, place long"
#: From so many entries of a batch in one group on, copies are told before the shuffle.
CROWD = 64
#: A place is the first window start of an entry and its number of windows less one, in so many bits.
_RUN_BITS = 12


def _parse(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = [], []
            hashes = batch.column(2).to_numpy(zero_copy_only=False)
            for row, text in enumerate(texts_of(batch)):
                data = _bytes(text)
                if len(data) < length:
                    continue
                first, last, shared, whole = entries(data, length)
                ids.append(np.full(len(first), row))
                parts.append((shared, whole, first << _RUN_BITS | (last - first)))
            if parts:
                shared, whole, place = (np.concatenate([part[i] for part in parts]).view(np.int64) for i in range(3))
                rows = np.concatenate(ids)
                known = _known_copies(shared, whole, rows, place, batch.column(0), hashes)
                shared = np.where(known, shared ^ (place * int(_MIX >> np.uint64(1))) ^ hashes[rows], shared)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(known), pa.array(shared), pa.array(whole), batch.column(0).take(pa.array(rows)), pa.array(hashes[rows]), pa.array(place)],
                    names=["known", "shared", "whole", "id", "text_hash", "place"],
                )

    return run


def _known_copies(shared, whole, rows, place, ids: pa.Array, hashes) -> np.ndarray:
    """Entries of crowded groups that have an earlier copy in the same batch: repeats, whatever else the corpus holds.

    They are spread over all tasks, so that what is left of a crowded group are its entries, once per batch.
    """
    known = np.zeros(len(shared), bool)
    order = np.argsort(shared, kind="stable")
    bounds = np.flatnonzero(np.diff(shared[order], prepend=shared[order[0]] ^ 1))
    sizes = np.diff(np.append(bounds, len(order)))
    crowded = order[np.repeat(sizes >= CROWD, sizes)]
    if len(crowded):
        # Documents in corpus order, equal ones with equal numbers.
        table = pa.table({"id": ids, "hash": hashes})
        by = pc.sort_indices(table, sort_keys=[("id", "ascending"), ("hash", "ascending")], null_placement="at_end").to_numpy()
        codes = ids.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        moved = np.concatenate([[False], (codes[by][1:] != codes[by][:-1]) | (hashes[by][1:] != hashes[by][:-1])])
        document = np.empty(len(by), np.int64)
        document[by] = np.cumsum(moved)
        document = document[rows[crowded]]
        inner = np.lexsort((place[crowded], document, whole[crowded], shared[crowded]))
        entry, document = crowded[inner], document[inner]
        new = np.concatenate([[True], (shared[entry][1:] != shared[entry][:-1]) | (whole[entry][1:] != whole[entry][:-1])])
        first = np.repeat(np.flatnonzero(new), np.diff(np.append(np.flatnonzero(new), len(new))))
        known[entry] = (document != document[first]) | (place[entry] != place[entry][first])
    return known


def _same(columns: list, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    result = np.ones(len(i), bool)
    for column in columns:
        result &= column[i] == column[j]
    return result


def _judge_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by what entries share, by entry, then in corpus order -> repeats (kind 0) and entries left to compare (kind 1).

    Of each entry the first row is left to compare if the group has several entries; a later
    row at another place is a repeat. Only one row is carried from batch to batch, so groups may have any size.
    An entry is alone if neither the row before it nor the one after its last has the same shared bytes.
    """
    held: pa.RecordBatch | None = None  # the first row of the entry that is open
    held_lonely = True

    def out(batch, rows, kind) -> pa.RecordBatch:
        part = batch.take(pa.array(rows))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), kind, np.int32)), *part.columns], names=["kind", *part.schema.names])

    for batch in batches:
        told = batch.filter(batch.column("known"))
        if told.num_rows:
            yield out(told, np.arange(told.num_rows), 0)
        batch = batch.filter(pc.invert(batch.column("known")))
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        shared, whole, text_hash, place = (batch.column(name).to_numpy() for name in ("shared", "whole", "text_hash", "place"))
        group = np.concatenate([[True], shared[1:] != shared[:-1]])
        entry = np.concatenate([[True], (whole[1:] != whole[:-1]) | group[1:]])
        if held is not None:
            entry[0] = True
        firsts = np.flatnonzero(entry)
        first_of = np.repeat(firsts, np.diff(np.append(firsts, len(entry))))
        same_id = _ids_equal(batch.column("id"), first_of)
        moved = ~(same_id & _same([text_hash, place], np.arange(len(entry)), first_of))
        repeats = np.flatnonzero(moved)
        if len(repeats):
            yield out(batch, repeats, 0)
        starts_group = group[firsts].copy()
        if held is not None:
            starts_group[0] = held_lonely
        ends_group = np.append(group[firsts[1:]], True)
        lonely = starts_group & ends_group
        done = firsts[:-1][~lonely[:-1]]
        if len(done):
            yield out(batch, done, 1)
        held, held_lonely = batch.slice(firsts[-1], 1), bool(starts_group[-1])
    if held is not None and not held_lonely:
        yield out(held, np.array([0]), 1)


def _ids_equal(ids: pa.Array, other: np.ndarray) -> np.ndarray:
    codes = ids.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return codes == codes[other]


def _stretches(length: int):
    """Texts with the places of their entries -> the entries' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, shared, places, stretches = [], [], [], []
            for row, (text, wanted) in enumerate(zip(texts_of(batch), batch.column(3).to_pylist(), strict=True)):
                data = text.encode()
                for entry in wanted:
                    first, more = entry["place"] >> _RUN_BITS, entry["place"] & ((1 << _RUN_BITS) - 1)
                    rows.append(row)
                    shared.append(entry["shared"])
                    places.append(entry["place"])
                    stretches.append(data[first : first + more + length])
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(shared, pa.int64()), batch.column(0).take(at), batch.column(2).take(at), pa.array(places, pa.int64()), pa.array(stretches, pa.binary())],
                names=["shared", "id", "text_hash", "place", "stretch"],
            )

    return run


def sorted_suffixes(stretches: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the stretches as suffixes in order, equal ones in the order given: stretch, offset, new (not equal to the one before), window."""
    windows, row, offset = [], [], []
    for i, stretch in enumerate(stretches):
        data = np.frombuffer(stretch, np.uint8)
        windows.append(np.lib.stride_tricks.sliding_window_view(data, length))
        row.append(np.full(len(windows[-1]), i))
        offset.append(np.arange(len(windows[-1])))
    text = np.ascontiguousarray(np.concatenate(windows)).view(f"S{length}").ravel()
    order = np.argsort(text, kind="stable")
    text = text[order]
    new = np.concatenate([[True], text[1:] != text[:-1]])
    return np.concatenate(row)[order], np.concatenate(offset)[order], new, text


def _judge_windows(length: int, most: int):
    """Entries sorted by what they share, then in corpus order -> repeats (kind 0) and, for groups too large for one
    sort, the first window of each kind in each part (kind 1) with its digest.

    Whole groups are sorted together, about ``most`` entries at a time: equal windows are in one group.
    """
    names = ("id", "text_hash", "place", "stretch")

    def judged(rows: list[tuple], whole: bool, id_type: pa.DataType) -> pa.RecordBatch:
        ids, hashes, places, stretches = zip(*rows)
        row, offset, new, text = sorted_suffixes(stretches, length)
        heads = np.flatnonzero(new)
        first = np.repeat(heads, np.diff(np.append(heads, len(new))))
        start = (np.array(places) >> _RUN_BITS)[row] + offset
        codes: dict = {}
        document = np.array([codes.setdefault(pair, len(codes)) for pair in zip(ids, hashes)])[row]
        repeats = np.flatnonzero((document != document[first]) | (start != start[first]))
        at = repeats if whole else np.concatenate([repeats, heads])
        digests = [None] * len(repeats) + ([] if whole else [_digest(window, length) for window in text[heads]])
        kinds = np.repeat(np.array([0, 1], np.int32), [len(repeats), len(at) - len(repeats)])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(kinds),
                pa.array(ids, id_type).take(pa.array(row[at])),
                pa.array(np.array(hashes, np.int64)[row[at]]),
                pa.array(start[at].astype(np.int64)),
                pa.array(digests, pa.binary()),
            ],
            names=["kind", "id", "text_hash", "start", "digest"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows, begin, parted, kind = None, [], 0, False, pa.int64()
        for batch in batches:
            kind = batch.column("id").type
            for shared, *row in zip(batch.column("shared").to_pylist(), *(batch.column(name).to_pylist() for name in names), strict=True):
                if shared != group:
                    if rows and (parted or len(rows) >= most):
                        yield judged(rows, not parted, kind)
                        rows = []
                    group, begin, parted = shared, len(rows), False
                elif len(rows) - begin >= most:
                    if begin:
                        yield judged(rows[:begin], True, kind)
                    yield judged(rows[begin:], False, kind)
                    rows, begin, parted = [], 0, True
                rows.append(tuple(row))
        if rows:
            yield judged(rows, not parted, kind)

    return run


def _digest(window: bytes, length: int) -> bytes:
    return hashlib.blake2b(bytes(window).ljust(length, b"\0"), digest_size=16).digest()


def _in_corpus_order(prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}id").asc_nulls_last(), F.col(f"{prefix}text_hash")]


def repeated_windows(texts: DataFrame, length: int, most: int) -> DataFrame:
    """``id``, ``text_hash``, ``start``, ``more`` of runs of windows that occur earlier. ``texts``: id, text, text_hash."""
    kind = texts.schema["id"].dataType.simpleString()
    parse = texts.mapInArrow(_parse(length), _PARSE.format(id=kind))
    parse = parse.repartition("shared").sortWithinPartitions("shared", "whole", *_in_corpus_order(), "place")
    judged = materialize(parse.mapInArrow(_judge_entries, f"kind int, {_PARSE.format(id=kind)}"), "parse").rows
    runs = F.shiftright("place", _RUN_BITS).alias("start"), F.col("place").bitwiseAND((1 << _RUN_BITS) - 1).alias("more")
    copies = judged.where("kind = 0").select("id", "text_hash", *runs)
    wanted = judged.where("kind = 1").groupBy("id", "text_hash").agg(F.collect_list(F.struct("place", "shared")).alias("wanted"))
    wanted = wanted.select(F.col("id").alias("of_id"), F.col("text_hash").alias("of_hash"), "wanted")
    once = texts.join(wanted, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_hash")))
    stretches = once.select("id", "text", "text_hash", "wanted").mapInArrow(
        _stretches(length), StructType([StructField("shared", LongType()), texts.schema["id"], StructField("text_hash", LongType()), StructField("place", LongType()), StructField("stretch", BinaryType())])
    )
    stretches = stretches.repartition("shared").sortWithinPartitions("shared", *_in_corpus_order(), "place")
    windows = materialize(stretches.mapInArrow(_judge_windows(length, most), f"kind int, id {kind}, text_hash long, start long, digest binary"), "windows").rows
    inside = windows.where("kind = 0").select("id", "text_hash", "start", F.lit(0).cast("long").alias("more"))
    parts = windows.where("kind = 1")
    order = F.struct(F.col("id").isNull().alias("last"), "id", "text_hash", "start")
    first = materialize(parts.groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first"), "first").rows
    across = parts.join(first, "digest").where(order != F.col("first")).select("id", "text_hash", "start", F.lit(0).cast("long").alias("more"))
    return copies.unionByName(inside).unionByName(across)


def cut_out(data: bytes, runs: list, length: int) -> tuple[bytes, int]:
    """What is left of a text without the windows of the runs, and the number of stretches taken out."""
    left, at, spans = [], 0, 0
    reached = -1
    for start, more in sorted(runs):
        end = start + more + length
        if start > reached:
            left.append(data[max(at, 0) : start])
            spans += 1
            at = reached = end
        elif end > reached:
            at = reached = end
    left.append(data[at:])
    return b"".join(left), spans


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, kept, spans = [], [], []
            for text, runs in zip(texts_of(batch), batch.column(2).to_pylist(), strict=True):
                data = text.encode()
                left, n = cut_out(data, [(run["start"], run["more"]) for run in runs or ()], length)
                sizes.append(len(data))
                kept.append(left)
                spans.append(n)
            removed = [size - len(left) for size, left in zip(sizes, kept, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(part, pa.int64()) for part in (sizes, removed, spans)), pa.array(kept, pa.binary())],
                names=["id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return run


def remove_repeats(docs: DataFrame, length: int = 100, key: str = "doc_id", text: str = "text", most: int = 4000) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (the bytes that are left).

    Texts are UTF-8 bytes, null counts as empty; what is left may cut a character. Removed is every byte of a string of ``length`` bytes
    that starts earlier as well: in a document with a smaller key, or before in the same one. Null keys come last;
    documents with one key stand in the order of a hash of their texts; rows repeated with key and text are one document and
    come back alike. Texts shorter than ``length`` stay. An empty table gives no rows; other columns are ignored. Groups of more than
    ``most`` entries are sorted in parts, whose first windows then meet in a shuffle by digest.
    """
    shown = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.xxhash64(shown).alias("text_hash"))
    runs = repeated_windows(texts, length, most)
    runs = runs.groupBy(F.col("id").alias("of_id"), F.col("text_hash").alias("of_hash")).agg(F.collect_set(F.struct("start", "more")).alias("runs"))
    marked = texts.join(runs, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_hash")), "left").select("id", "text", "runs")
    kind = texts.schema["id"].dataType.simpleString()
    found = marked.mapInArrow(_cut(length), f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
    return found.withColumnRenamed("id", key)
