"""Byte-level byte-pair encoding and decoding in Spark's own higher-order functions.

A word is an array of its bytes, each as two hex digits, so that joining two pieces
is joining two strings. A fold over that array merges, step by step, the adjacent pair
with the lowest rank; ranks come from a map that is a literal of the plan. Words of
corpora repeat: the most frequent distinct words are folded once and their ids are the value
of a subquery, all others are folded where they stand. Decoding looks up the
bytes of every id and concatenates them. No row leaves its task.

What every task holds is bounded: the rank file, and ``most_words`` words of at most ``LONGEST_KNOWN`` bytes.
"""

from __future__ import annotations

import base64
import json
from functools import lru_cache

from pyspark.sql import Column, DataFrame, functions as F

NO_RANK = 2**31 - 1
#: Ids are below this; an entry of the map is the left id, its bits turned over, times this plus the token made.
BITS = 17
LEFT = 1 << BITS
GONE = -1
NONE = LEFT - 1
#: Up to this many bytes a word is merged pair by pair, beyond it all pairs of one rank at once.
SHORT = 64
#: A number of a word has the rank of a pair above so many bits, and below it a place; in short words the rank has room for foreign entries of the map.
SHORT_ABOVE = 63 - 2 * BITS
LONG_ABOVE = 63 - BITS
#: Words known beforehand have at most so many bytes.
LONGEST_KNOWN = 32

#: Letters and numbers that newer Unicode versions have and the character classes of a
#: Java 17 runtime lack, as the tokenizer's library has them.
NEWER_LETTERS = (
    "\\x{870}-\\x{887}\\x{889}-\\x{88e}\\x{8b5}\\x{8c8}-\\x{8c9}\\x{c5d}\\x{cdd}\\x{170d}\\x{171f}\\x{1b4c}\\x{1c89}-\\x{1c8a}\\x{2c2f}\\x{2c5f}"
    "\\x{9ffd}-\\x{9fff}\\x{a7c0}-\\x{a7c1}\\x{a7cb}-\\x{a7cd}\\x{a7d0}-\\x{a7d1}\\x{a7d3}\\x{a7d5}-\\x{a7dc}\\x{a7f2}-\\x{a7f4}\\x{10570}-\\x{1057a}"
    "\\x{1057c}-\\x{1058a}\\x{1058c}-\\x{10592}\\x{10594}-\\x{10595}\\x{10597}-\\x{105a1}\\x{105a3}-\\x{105b1}\\x{105b3}-\\x{105b9}"
    "\\x{105bb}-\\x{105bc}\\x{105c0}-\\x{105f3}\\x{10780}-\\x{10785}\\x{10787}-\\x{107b0}\\x{107b2}-\\x{107ba}\\x{10d4a}-\\x{10d65}"
    "\\x{10d6f}-\\x{10d85}\\x{10ec2}-\\x{10ec4}\\x{10f70}-\\x{10f81}\\x{11071}-\\x{11072}\\x{11075}\\x{1123f}-\\x{11240}\\x{11380}-\\x{11389}"
    "\\x{1138b}\\x{1138e}\\x{11390}-\\x{113b5}\\x{113b7}\\x{113d1}\\x{113d3}\\x{11740}-\\x{11746}\\x{11ab0}-\\x{11abf}\\x{11bc0}-\\x{11be0}\\x{11f02}"
    "\\x{11f04}-\\x{11f10}\\x{11f12}-\\x{11f33}\\x{12f90}-\\x{12ff0}\\x{1342f}\\x{13441}-\\x{13446}\\x{13460}-\\x{143fa}\\x{16100}-\\x{1611d}"
    "\\x{16a70}-\\x{16abe}\\x{16d40}-\\x{16d6c}\\x{18cff}\\x{1aff0}-\\x{1aff3}\\x{1aff5}-\\x{1affb}\\x{1affd}-\\x{1affe}\\x{1b11f}-\\x{1b122}\\x{1b132}"
    "\\x{1b155}\\x{1df00}-\\x{1df1e}\\x{1df25}-\\x{1df2a}\\x{1e030}-\\x{1e06d}\\x{1e290}-\\x{1e2ad}\\x{1e4d0}-\\x{1e4eb}\\x{1e5d0}-\\x{1e5ed}\\x{1e5f0}"
    "\\x{1e7e0}-\\x{1e7e6}\\x{1e7e8}-\\x{1e7eb}\\x{1e7ed}-\\x{1e7ee}\\x{1e7f0}-\\x{1e7fe}\\x{2a6de}-\\x{2a6df}\\x{2b735}-\\x{2b739}\\x{2ebf0}-\\x{2ee5d}"
    "\\x{31350}-\\x{323af}"
)
NEWER_NUMBERS = (
    "\\x{10d40}-\\x{10d49}\\x{116d0}-\\x{116e3}\\x{11bf0}-\\x{11bf9}\\x{11f50}-\\x{11f59}\\x{16130}-\\x{16139}\\x{16ac0}-\\x{16ac9}\\x{16d70}-\\x{16d79}"
    "\\x{1ccf0}-\\x{1ccf9}\\x{1d2c0}-\\x{1d2d3}\\x{1e4f0}-\\x{1e4f9}\\x{1e5f1}-\\x{1e5fa}"
)


def java_pattern(pattern: str) -> str:
    """The splitting pattern with the character classes of the tokenizer's library, for a Java runtime."""
    newer = r"[\x{870}-\x{323af}&&[%s]]"  # tried last, and only where they are
    letters, numbers = rf"\p{{L}}{newer % NEWER_LETTERS}", rf"\p{{N}}{newer % NEWER_NUMBERS}"
    blank = r"\p{IsWhite_Space}"
    return (
        # the same matches, the apostrophe being looked for once
        pattern.replace("'s|'t|'re|'ve|'m|'ll|'d|", "'(?:[stmd]|re|ve|ll)|")
        .replace(r"[^\s\p{L}\p{N}]", f"[^{blank}{letters}{numbers}]")
        .replace(r"\p{L}+", f"[{letters}]+")
        .replace(r"\p{N}+", f"[{numbers}]+")
        .replace(r"\s", blank)
        .replace(r"\S", r"\P{IsWhite_Space}")
    )


def words_of(text: Column, pattern: str) -> Column:
    """The matches of the pattern in a text; null has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(java_pattern(pattern)), F.lit(0))


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def merge_alone(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """What merging makes of the bytes of a token."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 1:
        least, at = min((ranks.get(parts[i] + parts[i + 1], NO_RANK), i) for i in range(len(parts) - 1))
        if least == NO_RANK:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


@lru_cache(maxsize=4)
def _tables(path: str) -> tuple[str, str, str, str, tuple[tuple[str, int], ...]]:
    """What the literals hold, in JSON, and the tokens that merging does not make of their own bytes.

    The map from two neighbours to the token they make is one array: a pair's place is the right id
    plus the shift of the left one, shifts being chosen so that no two pairs meet. An entry names its
    left id, so that a foreign one is told. The id after the last stands beside both ends of a word.
    """
    ranks = read_ranks(path)
    end = max(ranks.values()) + 1
    made_by: dict[int, dict[int, int]] = {}
    for token, made in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                made_by.setdefault(left, {})[right] = made
    shifts = [0] * (end + 1)
    taken = 0  # its bits are the places
    for left in sorted(made_by, key=lambda left: (-len(made_by[left]), left)):
        rights = sorted(made_by[left])
        met = 0
        for right in rights:
            met |= taken >> (right - rights[0])
        shifts[left] = (~met & (met + 1)).bit_length() - 1 - rights[0]  # from the lowest bit that is not set
        for right in rights:
            taken |= 1 << (shifts[left] + right)
    entries = [0] * taken.bit_length()  # the plan's texts hold them: zeros take least
    for left, made_with in made_by.items():
        for right, made in made_with.items():
            entries[shifts[left] + right] = (left ^ NONE) << BITS | made  # so that zero is no pair
    of_bytes = [*(ranks[bytes([byte])] for byte in range(256)), end]
    tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    odd = tuple((token.decode(), rank) for token, rank in ranks.items() if _is_text(token) and len(merge_alone(token, ranks)) > 1)
    return (
        json.dumps(entries),
        json.dumps(shifts),
        json.dumps(of_bytes),
        json.dumps([base64.b64encode(token).decode() for token in tokens]),
        odd,
    )


def _is_text(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


def _literal(value: str, kind: str) -> Column:
    """A constant of the plan from JSON: Spark evaluates it once, when it plans."""
    return F.from_json(F.lit(value), kind)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, and once in the plan.

    Results of a transformed array are copied, arrays with all that is in them; those of an empty fold are not.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda bound, _: bound, body)


class Merger:
    """Merging of words with the map of ranks, bound to variables so that the plan holds it once.

    A piece is the id of its token, which is also its rank. A word is an array of
    numbers, from high to low bits: what a piece makes with the next one, ``NONE`` or more if nothing; its place in the
    array; the piece. So the least number is the pair to merge first and says where it is: array_position()
    had a fifth of all samples of a profile. Before the first piece and after the last
    stands one that makes nothing.
    """

    def __init__(self, tables: dict[str, Column], short: bool = True) -> None:
        """``short``: for words of up to ``SHORT`` bytes. Their places are small, so that foreign entries of the map need not be cut to ``NONE``."""
        self.entries, self.shifts = tables["entries"], tables["shifts"]
        self.tables, self.short = tables, short
        self.above = SHORT_ABOVE if short else LONG_ABOVE

    def made(self, left: Column, right: Column) -> Column:
        """The token two neighbours make, ``NONE`` if they make none; more than that in short words."""
        found = F.get(self.entries, (F.get(self.shifts, left.cast("int")) + right).cast("int"))
        made = F.coalesce(found, F.lit(0).cast("long")).bitwiseXOR(F.shiftleft(left, BITS)).bitwiseXOR(F.lit(NONE << BITS))
        return made if self.short else F.least(made, F.lit(NONE))

    def _entry(self, rank: Column, place: Column, piece: Column) -> Column:
        return F.shiftleft(rank, self.above).bitwiseOR(F.shiftleft(place.cast("long"), BITS)).bitwiseOR(piece)

    def _place(self, entry: Column) -> Column:
        return F.shiftright(entry, BITS).bitwiseAND(F.lit((1 << (self.above - BITS)) - 1)).cast("int")

    def _rank(self, entry: Column) -> Column:
        return F.shiftright(entry, self.above)

    def _with_ranks(self, pieces: Column) -> Column:
        # beside the end there is null, which makes nothing
        return F.transform(pieces, lambda a, i: self._entry(self.made(a, F.get(pieces, i + 1)), i, a))

    def _merge_first(self, word: Column, least: Column) -> Column:
        """Merge the first pair with the lowest rank: only what is beside it changes."""
        token = self._rank(least)

        def merged(after: Column) -> Column:
            def entry(old: Column, i: Column) -> Column:
                # one transformed array is several times cheaper than slices joined
                return (
                    F.when(i > after, old - LEFT)
                    .when(i < after - 2, old)
                    .when(i == after, GONE)
                    .when(i == after - 1, self._entry(self.made(token, _piece(F.get(word, after + 1))), i, token))
                    .otherwise(self._entry(self.made(_piece(old), token), i, _piece(old)))
                )

            return F.array_remove(F.transform(word, entry), GONE)

        return _let(self._place(least) + 1, merged)

    def _merge_all(self, word: Column, first: Column) -> Column:
        """Merge every pair of the lowest rank, from left to right.

        The same as one after the other, unless a merge makes a pair of a lower
        rank still, which would come next; then only the first is merged.
        """
        least = self._rank(first)
        flags = F.array_join(F.transform(word, lambda entry: F.when(self._rank(entry) == least, "1").otherwise("0")), "")
        # of overlapping pairs, as in aaa, the left one counts
        marked = F.regexp_extract_all(F.regexp_replace(flags, "11", "10"), F.lit("."), F.lit(0))
        replaced = lambda marks: F.filter(
            F.transform(
                word, lambda entry, i: F.when(F.get(marks, i) == "1", least).when((i == 0) | (F.get(marks, i - 1) == "0"), _piece(entry))
            ),
            lambda piece: piece.isNotNull(),
        )
        # a merged pair stands beside its old neighbour on the right before that is merged in turn
        meets = lambda marks: F.exists(
            F.transform(word, lambda _, i: F.when(F.get(marks, i) == "1", self.made(least, _piece(F.get(word, i + 2))))),
            lambda made: made < least,
        )
        checked = lambda marks, new: F.when(
            (self._rank(F.array_min(new)) < least) | F.coalesce(meets(marks), F.lit(False)), self._merge_first(word, first)
        ).otherwise(new)
        return _let(marked, lambda marks: _let(_let(replaced(marks), self._with_ranks), lambda new: checked(marks, new)))

    def _fold(self, start: Column, codes: Column, merge) -> Column:
        step = lambda word, _: _let(
            F.array_min(word), lambda least: F.when(least < NONE << self.above, merge(word, least)).otherwise(word)
        )
        # one step less than there are pieces, the two at the ends not counted
        return F.aggregate(F.slice(codes, 4, F.size(codes)), start, step)

    def encode_word(self, word: Column) -> Column:
        """Ids of a word, merged from its bytes."""
        beyond = Merger(self.tables, short=False)
        edge = chr(256)
        letters = F.split(F.concat(F.lit(edge), F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), F.lit(edge)), "")

        def merged(codes: Column) -> Column:
            pieces = F.transform(codes, lambda code: F.get(self.tables["bytes"], code))
            return F.when(F.size(codes) <= SHORT + 2, self._fold(_let(pieces, self._with_ranks), codes, self._merge_first)).otherwise(
                beyond._fold(_let(pieces, beyond._with_ranks), codes, beyond._merge_all)
            )

        numbers = lambda done: F.transform(F.slice(done, 2, F.size(done) - 2), lambda entry: _piece(entry).cast("int"))
        return _let(_let(F.transform(letters, lambda letter: F.ascii(letter)), merged), numbers)


def _piece(entry: Column) -> Column:
    return entry.bitwiseAND(F.lit(LEFT - 1))


class Ranks:
    """A rank file as literals of a plan."""

    def __init__(self, path: str) -> None:
        entries, shifts, of_bytes, tokens, self.odd = _tables(path)
        self._merging = _literal(
            f'{{"entries":{entries},"shifts":{shifts},"bytes":{of_bytes}}}',
            "struct<entries:array<bigint>,shifts:array<bigint>,bytes:array<bigint>>",
        )
        # JSON has bytes in base64; as strings, which need not be UTF-8, array_join puts them together
        self._tokens = _literal(tokens, "array<binary>").cast("array<string>")

    def merging(self, body) -> Column:
        """``body(merger)``, the merger's map being a literal, its arrays taken out once."""

        def bound(held: Column, names: tuple[str, ...], arrays: dict[str, Column]) -> Column:
            if not names:
                return body(Merger(arrays))
            return _let(held[names[0]], lambda array: bound(held, names[1:], arrays | {names[0]: array}))

        return _let(self._merging, lambda held: bound(held, ("entries", "shifts", "bytes"), {}))

    def bytes_of(self, ids: Column) -> Column:
        """The bytes of ids, concatenated; ids that are none add nothing."""
        return self._joined(ids).cast("binary")

    def _joined(self, ids: Column) -> Column:
        return _let(self._tokens, lambda held: F.array_join(F.transform(ids, lambda i: F.get(held, i)), ""))

    def coded(self, ids: Column) -> Column:
        """``numbers``, the ids as unsigned 32-bit integers, lowest byte first, and ``decoded``, their bytes; as strings, for joining."""
        digits = F.array_join(F.transform(ids, lambda i: F.lpad(F.hex(i), 8, "0")), "")
        numbers = F.unhex(F.regexp_replace(digits, "(..)(..)(..)(..)", "$4$3$2$1")).cast("string")
        return F.struct(numbers.alias("numbers"), self._joined(ids).alias("decoded"))


class KnownWords:
    """Encodings of frequent words as one value of the plan: arrays by slots of the words' hash.

    A slot holds its most frequent word and the ids, found by comparing one string; its other words and ids are
    an array more, null for most slots. Spark makes the arrays and holds them as the result of a subquery, so that no row
    passes through Python.
    """

    #: Low bits of a word's hash that name its slot.
    MASK = (1 << 19) - 1

    def __init__(self, words: DataFrame, odd: tuple[tuple[str, int], ...] = (), coded=None) -> None:
        """``words``: word, ids, n (the larger, the sooner found); what ``odd`` says of a word counts instead.

        With ``coded`` a word has ``coded(ids)`` for its ids, and is found by what they are decoded to; a word
        that is not what they are decoded to is not held.
        """
        self.coded = coded is not None
        session = words.sparkSession
        entries = words.select("word", "ids", F.lit(0).alias("turn"), "n")
        if odd:
            entries = entries.unionByName(
                session.createDataFrame(odd, "word string, id int").select(
                    "word", F.array("id").alias("ids"), F.lit(1).alias("turn"), F.lit(0).cast("long").alias("n")
                )
            )
        held = F.struct("turn", "n", "word", "ids")
        if coded:
            entries = entries.select("word", coded(F.col("ids")).alias("ids"), "turn", "n")
            held = F.when(F.col("ids.decoded") == F.col("word"), held)
        dealt = entries.select(self._slot(F.col("word")).alias("slot"), held.alias("held"))
        # every slot has a place in the arrays, filled or not; collect_list passes over nulls
        places = session.range(self.MASK + 1).select(F.col("id").cast("int").alias("slot"), F.lit(None).cast(dealt.schema["held"].dataType).alias("held"))
        slots = dealt.unionByName(places).groupBy("slot").agg(F.sort_array(F.collect_list("held"), asc=False).alias("held"))  # the one to be found first stands first
        first, others = F.get("held", F.lit(0)), F.slice("held", 2, F.size("held"))
        other = lambda entry: entry["ids"] if coded else F.struct(entry["word"].alias("word"), entry["ids"].alias("ids"))
        rest = F.when(F.size("held") > 1, F.transform(others, other))
        filled = slots.select(F.struct("slot", first["word"].alias("word"), first["ids"].alias("ids"), rest.alias("rest")).alias("filled"))
        ordered = filled.agg(F.sort_array(F.collect_list("filled")).alias("all"))
        self.slots = ordered.select(F.struct(*[F.col("all").getField(name).alias(name) for name in self._names()]).alias("slots")).scalar()

    def _names(self) -> tuple[str, ...]:
        return ("ids", "rest") if self.coded else ("ids", "rest", "word")

    @classmethod
    def _slot(cls, word: Column) -> Column:
        return F.hash(word).bitwiseAND(F.lit(cls.MASK))

    def of(self, words: Column, slots: Column, unknown) -> Column:
        """For each word its ids, or what is held for them, ``unknown(word)`` if it is not among them.

        ``slots`` is a column of the rows just selected, with the value ``self.slots``: Spark forbids to write
        a subquery into a lambda, but puts a column that is used once in its place itself, so that no row carries it.
        """

        def ids(word: Column, found: Column, rest: Column, first: Column | None = None) -> Column:
            slot = self._slot(word)  # made again is cheaper than held: two arrays side by side took a pass more
            held = F.get(found, slot)
            other = F.get(F.filter(F.get(rest, slot), lambda entry: entry["decoded" if self.coded else "word"] == word), F.lit(0))
            name = held["decoded"] if self.coded else F.get(first, slot)
            return F.when(name == word, held).otherwise(F.coalesce(other if self.coded else other["ids"], unknown(word)))

        # every array is taken out of the slots once a row, not once a word
        def bound(held: Column, names: tuple[str, ...], arrays: tuple[Column, ...]) -> Column:
            if not names:
                return F.transform(words, lambda word: ids(word, *arrays))
            return _let(held[names[0]], lambda array: bound(held, names[1:], (*arrays, array)))

        return _let(slots, lambda held: bound(held, self._names(), ()))


def known_words(docs: DataFrame, text: str, ranks: Ranks, pattern: str, most_words: int, spread: int = 64, coded=None) -> KnownWords:
    """The most frequent words, counted over all documents, with their ids, or ``coded(ids)`` for them.

    Ties go to the smaller word. At most ``most_words`` are held, of ``LONGEST_KNOWN`` bytes at most.
    Tokens that merging would not make of their own bytes come last and count: a word that is a token is that token.
    """
    counted = (
        docs.select(F.explode(words_of(F.col(text), pattern)).alias("word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .where((F.octet_length("word") <= LONGEST_KNOWN) & (F.col("n") > 1))
        .orderBy(F.desc("n"), "word")
        .limit(most_words)
    )
    ids = ranks.merging(lambda merger: merger.encode_word(F.col("word"))).alias("ids")
    return KnownWords(counted.repartition(spread, "word").select("word", ids, "n"), ranks.odd, coded)


def _by_words(docs: DataFrame, ranks: Ranks, pattern: str, key: str, text: str, most_words: int, coded=None) -> DataFrame:
    """``key`` and ``words``, an array of the ids of every word or of ``coded(ids)``, under these names."""
    known = known_words(docs, text, ranks, pattern, most_words, coded=coded)
    found = docs.select(F.col(key).alias("key"), words_of(F.col(text), pattern).alias("words"), known.slots.alias("slots"))
    # both columns are used once, so that Spark puts them in their place: no row carries the slots
    unknown = lambda merger: lambda word: _let(merger.encode_word(word), coded) if coded else merger.encode_word(word)
    of_words = ranks.merging(lambda merger: _let(F.col("words"), lambda words: known.of(words, F.col("slots"), unknown(merger))))
    return found.select("key", of_words.alias("words"))


def encode_texts(
    docs: DataFrame, rank_file: str, pattern: str, key: str = "doc_id", text: str = "text", most_words: int = 500_000
) -> DataFrame:
    """Ids of every whole text: ``key``, ``ids`` (array of int).

    One row per row of ``docs``, repeated rows and null keys included; an empty
    table gives no rows. A null or empty text has no ids. Texts and words of any
    length are encoded whole, special strings in them as ordinary text; a word of more than
    ``SHORT`` bytes may take steps in number of its bytes, each as long as what is left of it. The splitting
    ``pattern`` must be made of letter, number and blank classes, as those of the public
    rank files. Other columns are ignored, whatever their names.
    """
    of_words = _by_words(docs, Ranks(rank_file), pattern, key, text, most_words)
    return of_words.select(F.col("key").alias(key), F.flatten("words").alias("ids"))


def decode_ids(encoded: DataFrame, rank_file: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Bytes of rows of ids: ``key``, ``decoded`` (binary). Null ids give no bytes, unknown ones add none."""
    known = F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>"))
    return encoded.select(F.col(key), Ranks(rank_file).bytes_of(known).alias("decoded"))


def code_digests(
    docs: DataFrame, rank_file: str, pattern: str, key: str = "doc_id", text: str = "text", most_words: int = 500_000
) -> DataFrame:
    """``key``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` of every whole text; rows and special cases as in ``encode_texts``."""
    ranks = Ranks(rank_file)
    of_words = _by_words(docs, ranks, pattern, key, text, most_words, ranks.coded)
    joined = lambda name: F.array_join(F.col("words")[name], "").cast("binary").alias(name)
    return (
        of_words.select("key", joined("numbers"), joined("decoded"))
        .select(
            "key",
            F.shiftright(F.octet_length("numbers"), 2).cast("long").alias("n_tokens"),
            # a name of their own: an unnamed column is called by its expression, literals included
            F.sha2("numbers", 256).alias("ids_sha256"),
            F.sha2("decoded", 256).alias("decoded_sha256"),
        )
        .withColumnRenamed("key", key)
    )
