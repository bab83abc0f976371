"""Byte-pair vocabularies: loading, splitting a text into pieces, bounded memory of results.

The files are those of the public tokenizers library. Their path is a
parameter; each Python worker loads a file once.
"""

from __future__ import annotations

import json
import re

import regex
from tokenizers import Tokenizer

from tidemill.llm.common import kept

#: White space as the splitting patterns of the vocabularies understand it (the Unicode property).
SPACE = "\t-\r \x85\xa0  -     　"
#: Below this code point letters, digits and lower case are the same in every
#: Unicode version and every text is in normal form; texts with other
#: characters are split by the library's own tables.
PLAIN_BELOW = 0x250

#: The splitting patterns of the two kinds of vocabulary.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_plain = re.compile(f"[^\x00-{chr(PLAIN_BELOW - 1)}]")
_not_blank_for_patterns = re.compile("[\x1c-\x1f]")
_run_of_blanks = re.compile(f"[{SPACE}][{SPACE}]")
_spaced_pieces = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
_unspaced_pieces = re.compile(f"[^{SPACE}]+")


def _plain_word_pattern() -> re.Pattern:
    """``WORD_PATTERN`` with its classes spelled out below ``PLAIN_BELOW``: the standard module is faster with sets than the other with properties.

    Letters come first, which changes nothing: no other alternative starts with one.
    """
    below = [chr(code) for code in range(PLAIN_BELOW)]
    letters, numbers = ("".join(char for char in below if regex.match(kind, char)) for kind in (r"\p{L}", r"\p{N}"))
    return re.compile(f"[{letters}]+|'s|'t|'re|'ve|'m|'ll|'d|[{numbers}]|[^{SPACE}{letters}{numbers}]+")


_plain_words = _plain_word_pattern()


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a vocabulary file."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    symbols = {byte: chr(byte) for byte in printable}
    others = [byte for byte in range(256) if byte not in symbols]
    symbols |= {byte: chr(256 + i) for i, byte in enumerate(others)}
    return [symbols[byte] for byte in range(256)]


class Memory(dict):
    """Results by key, computed on demand, in two generations of bounded size.

    When the young one is full it becomes the old one; what is still asked for
    moves up again, the rest is forgotten. Long keys are not kept.
    """

    def __init__(self, compute, most: int, longest: int = 64) -> None:
        super().__init__()
        self.compute, self.most, self.longest = compute, most, longest
        self.old: dict = {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Vocabulary:
    """Merges and ids of a vocabulary file, and how it splits texts."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model = content["model"]
        self.library = Tokenizer.from_file(path)
        self.special = {token["content"]: token["id"] for token in content["added_tokens"]}
        self.ids: dict[str, int] = dict(model["vocab"])
        self.suffix: str = model["end_of_word_suffix"] or ""
        merges = [pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"]]
        #: (left id, right id) -> (rank, id of the merged token)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (left, right) in enumerate(merges):
            self.merges[self.ids[left], self.ids[right]] = (rank, self.ids[left + right])
        self.lowers = content["normalizer"] is not None
        self.pattern = regex.compile(WORD_PATTERN if self.lowers else BYTE_PATTERN)
        self._bytes = byte_symbols()
        self._at_special = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")

    def sections(self, text: str) -> tuple[list[str], list[str]]:
        """The text between special strings, and these strings."""
        return self._at_special.split(text), self._at_special.findall(text)

    def has_special(self, text: str) -> bool:
        return self._at_special.search(text) is not None

    def pieces(self, chunk: str) -> list[str]:
        """The words of a stretch of text, each as byte symbols."""
        if chunk.isascii() and chunk.isalpha():
            return [chunk.lower() if self.lowers else chunk]
        if _plain.search(chunk):
            if self.lowers:
                chunk = self.library.normalizer.normalize_str(chunk)
            return [piece for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(chunk)]
        if self.lowers:
            chunk = chunk.lower()
        found = self.pattern.findall(chunk)
        if chunk.isascii() and " " not in chunk and chunk.isprintable():
            return found
        symbols = self._bytes
        return ["".join([symbols[byte] for byte in piece.encode()]) for piece in found]

    def plain_words(self, section: str) -> list[str] | None:
        """The words of a whole section as they stand in it, lower-cased, or None where only ``pieces`` can tell them.

        No word of a vocabulary without spaces holds white space, so that a section needs no cutting beforehand.
        """
        if not self.lowers or _plain.search(section):
            return None
        lowered = section.lower()  # some plain letters have a lower case beyond
        return None if _plain.search(lowered) else _plain_words.findall(lowered)

    def as_symbols(self, word: str) -> str:
        """A word of ``plain_words`` as byte symbols."""
        if word.isascii() and word.isprintable():
            return word
        return "".join([self._bytes[byte] for byte in word.encode()])

    def symbol_ids(self, piece: str) -> list[int]:
        """Ids of the single symbols of a piece; the last one carries the end of the word."""
        ids = self.ids
        if not self.suffix:
            return [ids[symbol] for symbol in piece]
        return [ids[symbol] for symbol in piece[:-1]] + [ids[piece[-1] + self.suffix]]


@kept("bpe", 4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def spaced_chunks(section: str) -> tuple[list[str], list[str], int]:
    """Cut a section for a vocabulary whose tokens carry the space before them.

    Returns chunks without and with a leading space (the space itself left
    out), and the number of line feeds between them that are tokens by themselves.
    Only white space runs of one character allow that; see ``blank_runs``.
    """
    plain, spaced = [], []
    lines = section.split("\n")
    for line in lines:
        first, *rest = line.split(" ")
        plain.append(first)
        spaced += rest
    return plain, spaced, len(lines) - 1


def blank_runs(section: str) -> bool:
    return _run_of_blanks.search(section) is not None


def spaced_pieces(section: str) -> list[str]:
    """Stretches that can be split independently, whatever the white space."""
    return _spaced_pieces.findall(section)


def unspaced_chunks(section: str) -> list[str]:
    """Stretches without white space."""
    return _unspaced_pieces.findall(section) if _not_blank_for_patterns.search(section) else section.split()
