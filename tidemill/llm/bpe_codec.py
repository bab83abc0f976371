"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

Every prefix of a word has exactly one encoding, so it has one last token. All
tokens that end where a prefix ends come from an automaton over the vocabulary
(each state knows its suffixes); the right one is the only one that is
compatible with the last token of the prefix before it. Two tokens are
compatible if merging never crosses the border between them. The ids are read off
from the end of the word along the back-pointers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from tidemill.llm.bpe_model import Memory, Vocabulary, byte_symbols, spaced_pieces, unspaced_chunks, vocabulary
from tidemill.llm.common import kept, map_batches, texts_of

#: Stands for the end of a word inside the automaton; no byte symbol.
END = "\n"
_NO_RANK = 1 << 60
_LEFT = 1 << 20
_MOST_PAIRS = 400_000


class Codec:
    """Exact encoding and decoding with one vocabulary."""

    def __init__(self, model: Vocabulary) -> None:
        self.model = model
        self.tokens = {number: token for token, number in model.ids.items()} | {
            number: token for token, number in model.special.items()
        }
        #: token id -> (rank of the merge that makes it, left id, right id)
        self.made = {made: (rank, left, right) for (left, right), (rank, made) in model.merges.items()}
        #: left id times ``_LEFT`` plus right id -> whether the two are compatible; one number takes a third of the room of two
        self._pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token, number in model.ids.items():
            if self._stands(number):
                text = token
                if model.suffix and token.endswith(model.suffix):
                    text = token[: -len(model.suffix)] + END
                self.automaton.add_word(text, (len(text) - 1, number))
        self.automaton.make_automaton()
        self.words = Memory(self._word, 300_000)
        self.chunks = Memory(self._chunk, 100_000)
        self._raw = {symbol: byte for byte, symbol in enumerate(byte_symbols())}
        self.decodes = model.library.decoder is not None

    def _stands(self, number: int) -> bool:
        """Whether a token is the encoding of its own text."""
        if number not in self.made:
            return True
        rank, left, right = self.made[number]
        return self._apart(left, right, rank)

    def _apart(self, left: int, right: int, below: int = _NO_RANK) -> bool:
        """Whether no merge crosses the border of two tokens, before merge ``below`` at least.

        The tokens are taken apart again, latest merge first. At each step the
        parts that touch the border were there until the merge just undone; a
        merge of these two comes first if it has a lower rank, or the same
        one while the undone merge lies to the right of the border.
        """
        limit = below * 2
        while True:
            crossing = self.model.merges.get((left, right))
            if crossing and crossing[0] * 2 < limit:
                return False
            left_made, right_made = self.made.get(left), self.made.get(right)
            left_rank = left_made[0] if left_made else -1
            right_rank = right_made[0] if right_made else -1
            if left_rank < 0 and right_rank < 0:
                return True
            if left_rank > right_rank:
                limit, left = left_rank * 2, left_made[2]
            else:
                limit, right = right_rank * 2 + 1, right_made[1]

    def compatible(self, left: int, right: int) -> bool:
        pair = left * _LEFT + right
        known = self._pairs.get(pair)
        if known is None:
            if len(self._pairs) >= _MOST_PAIRS:
                self._pairs.clear()
            known = self._pairs[pair] = self._apart(left, right)
        return known

    def _word(self, piece: str) -> tuple[int, ...]:
        symbols = piece + END if self.model.suffix else piece
        size = len(symbols)
        last = [-1] * size  # last token of the prefix that ends with this symbol
        before = [-1] * size  # where the prefix before that token ends
        pairs, compatible = self._pairs, self.compatible
        known = -1
        for end, (reach, number) in self.automaton.iter(symbols):
            if end == known:
                continue
            start = end - reach - 1
            if start >= 0:
                fits = pairs.get(last[start] * _LEFT + number)
                if fits is None:
                    fits = compatible(last[start], number)
                if not fits:
                    continue
            last[end], before[end] = number, start
            known = end
        ids = []
        place = size - 1
        while place >= 0:
            ids.append(last[place])
            place = before[place]
        ids.reverse()
        return tuple(ids)

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        return tuple(number for piece in self.model.pieces(chunk) for number in self.words[piece])

    def _section(self, section: str) -> list[str]:
        if self.model.lowers:
            return unspaced_chunks(section)
        return spaced_pieces(section)

    def encode(self, text: str) -> list[int]:
        """Ids of a text; special strings inside it become their own id."""
        sections, special = self.model.sections(text)
        ids: list[int] = []
        for place, section in enumerate(sections):
            for chunk in self._section(section):
                ids += self.chunks[chunk]
            if place < len(special):
                ids.append(self.model.special[special[place]])
        return ids

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids. Without a decoder in the file, tokens are joined by spaces, as its library does."""
        known = [self.tokens[number] for number in ids if number in self.tokens]
        if not self.decodes:
            return " ".join(known)
        raw = self._raw
        return b"".join(
            token.encode() if token in self.model.special else bytes(raw[symbol] for symbol in token) for token in known
        ).decode(errors="replace")


class Digests:
    """Number of tokens, ids and decoded text of whole documents, word by word from memory.

    For vocabularies without a decoder: tokens are joined by spaces then, so that
    a decoded document is its decoded words joined by spaces. With a decoder, ids are decoded at once.
    """

    def __init__(self, codec: Codec) -> None:
        self.codec = codec
        self.plain = Memory(self._plain, 250_000)
        self.words = Memory(self._word, 150_000)
        self.chunks = Memory(self._chunk, 150_000)

    def _word(self, piece: str) -> tuple[int, str, str]:
        ids = self.codec._word(piece)
        return len(ids), " ".join(map(str, ids)), self.codec.decode(ids)

    def _plain(self, word: str) -> tuple[int, str, str]:
        return self._word(self.codec.model.as_symbols(word))

    def _chunk(self, chunk: str) -> tuple[int, str, str]:
        pieces = self.codec.model.pieces(chunk)
        if len(pieces) == 1:
            return self.words[pieces[0]]
        return _joined([self.words[piece] for piece in pieces])

    def of(self, text: str) -> tuple[int, str, str]:
        codec = self.codec
        if codec.decodes or codec.model.has_special(text):
            ids = codec.encode(text)
            return len(ids), " ".join(map(str, ids)), codec.decode(ids)
        words = codec.model.plain_words(text)
        if words is not None:
            return _joined(list(map(self.plain.__getitem__, words)))
        return _joined(list(map(self.chunks.__getitem__, codec._section(text))))


def _joined(parts: list[tuple[int, str, str]]) -> tuple[int, str, str]:
    if not parts:
        return 0, "", ""
    counts, ids, decoded = zip(*parts, strict=True)
    return sum(counts), " ".join(ids), " ".join(decoded)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@kept("bpe", 4)
def codec(path: str) -> Codec:
    return Codec(vocabulary(path))


@kept("bpe", 4)
def _digests(path: str) -> Digests:
    return Digests(codec(path))


def _digest_batch(batch, path: str, with_ids: bool) -> list:
    digests = _digests(path)
    counts, ids, shas, decoded = [], [], [], []
    for text in texts_of(batch):
        count, numbers, plain = digests.of(text)
        counts.append(count)
        shas.append(_sha(numbers))
        decoded.append(_sha(plain))
        if with_ids:
            ids.append(np.array(numbers.split(), np.int32))
    return [batch.column(0), counts, shas, decoded, *([ids] if with_ids else [])]


def _encode_batch(batch, path: str) -> list:
    encode = codec(path).encode
    return [batch.column(0), [encode(text) for text in texts_of(batch)]]


def _decode_batch(batch, path: str) -> list:
    decode = codec(path).decode
    return [batch.column(0), [decode(ids or []) for ids in batch.column(1).to_pylist()]]


def encode_texts(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids of every whole text: ``key``, ``ids``.

    One row per row of ``docs``, repeated rows and null keys included, without
    a shuffle. A null or empty text has no ids. Special strings inside a
    text become their own id, none are added; nothing is truncated or padded.
    Columns other than the two are ignored, whatever their names.
    """
    schema = StructType([StructField(key, docs.schema[key].dataType), StructField("ids", ArrayType(IntegerType()))])
    return map_batches(docs.select(F.col(key), F.col(text)), _encode_batch, schema, tokenizer)


def decode_ids(encoded: DataFrame, tokenizer: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Texts of rows of ids: ``key``, ``text``. Unknown ids are left out, null ids give an empty text."""
    schema = StructType([StructField(key, encoded.schema[key].dataType), StructField("text", StringType())])
    return map_batches(encoded.select(F.col(key), F.col(ids)), _decode_batch, schema, tokenizer)


def code_digests(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """``key``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of every whole text.

    The same as ``encode_texts`` and ``decode_ids`` one after the other, rows
    and special cases included, but the ids of a document, many times its
    size as rows of numbers, leave the task that made them only if ``with_ids`` asks for a column ``ids``.
    """
    schema = StructType(
        [
            StructField(key, docs.schema[key].dataType),
            StructField("n_tokens", LongType()),
            StructField("ids_sha256", StringType()),
            StructField("decoded_sha256", StringType()),
            *([StructField("ids", ArrayType(IntegerType()))] if with_ids else []),
        ]
    )
    return map_batches(docs.select(F.col(key), F.col(text)), _digest_batch, schema, tokenizer, with_ids)
