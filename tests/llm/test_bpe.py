"""Token counts and the codec against the library whose results they must give."""

import functools
import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tidemill.llm import bpe_codec, bpe_model, token_counts
from tidemill.llm.bpe_model import Memory, vocabulary
from tidemill.llm.common import kept

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")
BITS = [
    "a", "b", "th", "the", " ", "  ", "\n", "\t", "'s", "'T", "1", "23", "!", "é", "ß", "日", "ſ", "<|endoftext|>",
    "<|startoftext|>", "\x1c", "\xa0", "́", "İ", "Σ", "ΑΣ", "😀", "_", "-", "Ạ̈", "Ᲊ", " ",
    "ing", "aaaa", "abab",
]


tokenizer_of = functools.cache(Tokenizer.from_file)


def library(path, text):
    return tokenizer_of(path).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_counts_and_ids_of_odd_texts(path):
    rng, tokenizer = random.Random(5), Tokenizer.from_file(path)
    counter, codec = token_counts.Counter(vocabulary(path)), bpe_codec.codec(path)
    for _ in range(3000):
        text = "".join(rng.choice(BITS) for _ in range(rng.randint(0, 14)))
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert counter.count(text) == len(ids), ascii(text)
        assert codec.encode(text) == ids, ascii(text)
        assert codec.decode(ids) == tokenizer.decode(ids, skip_special_tokens=False), ascii(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_any_text(text):
    for path in (BYTE, WORD):
        assert bpe_codec.codec(path).encode(text) == library(path, text)


def test_a_very_long_word_and_long_runs():
    for text in ("ab" * 40_000, "a" * 30_000, " " * 5000 + "x", "é" * 5000):
        expected = library(BYTE, text)
        assert token_counts.Counter(vocabulary(BYTE)).count(text) == len(expected)
        assert bpe_codec.codec(BYTE).encode(text) == expected


def test_memory_is_bounded_and_right():
    memory = Memory(lambda key: len(key), most=10, longest=5)
    assert [memory[str(i)] for i in range(100)] == [len(str(i)) for i in range(100)]
    assert len(memory) <= 10 and len(memory.old) <= 10
    assert memory["x" * 50] == 50 and "x" * 50 not in memory


def test_queries_on_documents(spark):
    long = "wörd " * 50_000
    rows = [(1, "Hello there", "x"), (1, "Hello there", "x"), (None, "It's", None), (2, None, "y"), (3, "", "z"), (4, long, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    counted = token_counts.count_tokens(docs, BYTE, limit=512).collect()
    expected = [(i, len((t or "").encode()), len(library(BYTE, t or ""))) for i, t, _ in rows]
    key = lambda row: (row[0] or 0, row[1])
    assert sorted([tuple(row)[:3] for row in counted], key=key) == sorted(expected, key=key)
    assert {row.doc_id: row.over_limit for row in counted}[4] is True
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    tokenizer = Tokenizer.from_file(WORD)
    for row in bpe_codec.code_digests(docs, WORD).collect():
        text = next(t for i, t, _ in rows if i == row.doc_id) or ""
        ids = library(WORD, text)
        assert row.n_tokens == len(ids) and row.ids_sha256 == sha(" ".join(map(str, ids)))
        assert row.decoded_sha256 == sha(tokenizer.decode(ids, skip_special_tokens=False))
    encoded = bpe_codec.encode_texts(docs, BYTE)
    back = {row.doc_id: row.text for row in bpe_codec.decode_ids(encoded, BYTE).collect()}
    assert back == {1: "Hello there", None: "It's", 2: "", 3: "", 4: long}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.count_tokens(docs, BYTE, limit=5).count() == 0
    assert bpe_codec.code_digests(docs, WORD).count() == 0


def test_models_of_another_kind_are_let_go():
    made = []
    first = kept("test kind a", 2)(lambda name: made.append(name) or name)
    second = kept("test kind b", 1)(lambda name: made.append(name) or name)
    assert [first("x"), first("y"), first("x")] == ["x", "y", "x"] and made == ["x", "y"]
    assert second("z") == "z" and first("x") == "x" and made == ["x", "y", "z", "x"]


def test_plain_texts_are_cut_once(monkeypatch):
    """Words of a text of plain characters come from one search of the whole text, not stretch by stretch; same as the library."""
    rng = random.Random(11)
    digests = bpe_codec.Digests(bpe_codec.codec(WORD))
    texts = ["", " ", "It's we'LL\x1c'S o'\x85clock\xa0x", "ĲSSEL ǅ ª²¼ \x1c\x1d a\x1e\x1fb", "don't,can't 'tis '' 's", "word " * 500]
    below = [chr(code) for code in range(bpe_model.PLAIN_BELOW)]
    pool = "".join(char for char in below if max(char.lower()) < chr(bpe_model.PLAIN_BELOW))
    beyond = "".join(char for char in below if char not in pool)
    mixed = lambda few: "".join(rng.choice(few if rng.random() < 0.3 else "abe  'stIlL1,\n") for _ in range(rng.randrange(60)))

    def agrees(text):
        expected = library(WORD, text)
        decoded = tokenizer_of(WORD).decode(expected, skip_special_tokens=False)
        assert digests.of(text) == (len(expected), " ".join(map(str, expected)), decoded), text

    assert {"İ", "Ɔ"} <= set(beyond)
    for text in ["İstanbul", "IIIƆ", *(mixed(beyond + pool[-50:]) for _ in range(1000))]:
        agrees(text)
    monkeypatch.setattr(bpe_model.Vocabulary, "pieces", lambda *_: pytest.fail("cut stretch by stretch"))
    for text in texts + [mixed(pool) for _ in range(3000)]:
        agrees(text)
