"""Token counts by byte-pair merging on a heap and a linked list.

The symbols of a word stand in a linked list. A heap holds every adjacent pair
that the vocabulary can merge, by rank and then by place. The lowest pair is
popped and merged, which makes at most two new pairs. What is left after the last
merge is ``symbols - merges`` tokens; no identifier of a token is ever put out.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from tidemill.llm.bpe_model import Memory, Vocabulary, blank_runs, byte_symbols, spaced_chunks, spaced_pieces, unspaced_chunks, vocabulary
from tidemill.llm.common import kept, map_batches, texts_of


def count_merges(symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> int:
    """How many merges byte-pair encoding makes in a word given by the ids of its symbols."""
    part = list(symbols)
    end = len(part)
    after = list(range(1, end + 1))
    before = list(range(-1, end - 1))
    heap = []
    for place in range(end - 1):
        found = merges.get((part[place], part[place + 1]))
        if found:
            heap.append((found[0], place, found[1]))
    heapify(heap)
    done = 0
    while heap:
        rank, place, made = heappop(heap)
        right = after[place]
        if part[place] < 0 or right >= end:
            continue
        if merges.get((part[place], part[right]), (-1,))[0] != rank:
            continue  # one side has been merged meanwhile
        done += 1
        part[place], part[right] = made, -1
        following = after[place] = after[right]
        if following < end:
            before[following] = place
            found = merges.get((made, part[following]))
            if found:
                heappush(heap, (found[0], place, found[1]))
        previous = before[place]
        if previous >= 0:
            found = merges.get((part[previous], made))
            if found:
                heappush(heap, (found[0], previous, found[1]))
    return done


class Counter:
    """Counts tokens of whole texts with one vocabulary."""

    def __init__(self, model: Vocabulary) -> None:
        self.model = model
        self.words = Memory(self._word, 500_000)
        self.plain = Memory(self._chunk, 200_000)
        self.spaced = Memory(self._spaced_chunk, 500_000)
        self._space = byte_symbols()[ord(" ")]

    def _word(self, piece: str) -> int:
        symbols = self.model.symbol_ids(piece)
        return len(symbols) - count_merges(symbols, self.model.merges)

    def _chunk(self, chunk: str) -> int:
        return sum(map(self.words.__getitem__, self.model.pieces(chunk)))

    def _spaced_chunk(self, chunk: str) -> int:
        if chunk.isascii() and chunk.isalpha():
            return self.words[self._space + chunk]
        return self._chunk(" " + chunk)

    def _section(self, section: str) -> int:
        if self.model.lowers:
            return sum(map(self.plain.__getitem__, unspaced_chunks(section)))
        if blank_runs(section):
            return sum(map(self.plain.__getitem__, spaced_pieces(section)))
        plain, spaced, feeds = spaced_chunks(section)
        return feeds + sum(map(self.plain.__getitem__, plain)) + sum(map(self.spaced.__getitem__, spaced))

    def count(self, text: str) -> int:
        sections, special = self.model.sections(text)
        return len(special) + sum(map(self._section, sections))


@kept("bpe", 4)
def _counter(path: str) -> Counter:
    return Counter(vocabulary(path))


def _count_batch(batch, path: str, limit: int) -> list:
    counter = _counter(path)
    texts = texts_of(batch)
    tokens = [counter.count(text) for text in texts]
    return [batch.column(0), [len(text.encode()) for text in texts], tokens, [n > limit for n in tokens]]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokens of every whole text: ``key``, ``n_bytes``, ``n_tokens``, ``over_limit``.

    One row per row of ``docs``, also for repeated rows and null keys; no
    shuffle. A null or empty text has 0 bytes and 0 tokens. Special strings
    inside a text are one token each, as the vocabulary's library has it; no
    others are added. Texts of any length are counted whole. Columns of
    ``docs`` other than the two are ignored, whatever their names.
    """
    kind = docs.schema[key].dataType
    schema = StructType(
        [
            StructField(key, kind),
            StructField("n_bytes", LongType()),
            StructField("n_tokens", LongType()),
            StructField("over_limit", BooleanType()),
        ]
    )
    return map_batches(docs.select(F.col(key), F.col(text)), _count_batch, schema, tokenizer, limit)
