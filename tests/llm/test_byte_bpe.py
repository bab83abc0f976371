"""Byte-level encoding against the public library, and exact round trips."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidemill.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})


def odd_texts():
    rng = random.Random(5)
    pool = [chr(c) for c in [*range(0x250), 0x301, 0x870, 0x1680, 0x2003, 0x2028, 0x3000, 0x4E00, 0x9FFD, 0xFEFF, 0x10D45, 0x1F600, 0x31360]]
    yield from ["", None, " ", "hello world  \n\n  x", "\x01a\x02b\x01", "!!\x01\x02!!", "\x01!\x02", "<|endoftext|> it's", " " * 500, "\r\n\t \x85\xa0x"]
    yield from ["a" * 600, "ab" * 300, "=" * 300, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=900)), "word " * 40_000]
    for _ in range(1500):
        yield "".join(rng.choice(pool) if rng.random() < 0.5 else rng.choice("abc  etaoin'srdl\n0") for _ in range(rng.randrange(60)))


@pytest.mark.parametrize("most_words", [1, 300])
def test_against_the_library(spark, library, most_words):
    texts = list(odd_texts())
    rows = [(i, text, "ids") for i, text in enumerate(texts)] + [(None, "no key", "x"), (3, "again", "y"), (3, "again", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string").repartition(11)
    encoded = byte_bpe.encode_texts(docs, PATH, PATTERN, most_words=most_words)
    both = byte_bpe.decode_ids(encoded, PATH).withColumnRenamed("decoded", "bytes")
    found = sorted((row.doc_id if row.doc_id is not None else -1, row.ids) for row in encoded.collect())
    expected = sorted((i if i is not None else -1, library.encode_ordinary(text or "")) for i, text, _ in rows)
    assert found == expected
    decoded = sorted((row.doc_id if row.doc_id is not None else -1, bytes(row.bytes)) for row in both.collect())
    assert decoded == sorted((i if i is not None else -1, (text or "").encode()) for i, text, _ in rows)


def test_digests(spark, library):
    texts = ["", None, "Äpfel und Birnen", "one two one two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "ids long, text string")
    found = {row.ids: row for row in byte_bpe.code_digests(docs, PATH, PATTERN, key="ids").collect()}
    for i, text in enumerate(texts):
        ids = library.encode_ordinary(text or "")
        assert found[i].n_tokens == len(ids)
        assert found[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert found[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert byte_bpe.code_digests(docs.limit(0), PATH, PATTERN, key="ids").collect() == []


def test_decoding_unknown_ids(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [0, 10_000_000, 1])], "doc_id long, ids array<int>")
    found = {row.doc_id: bytes(row.decoded) for row in byte_bpe.decode_ids(rows, PATH).collect()}
    tokens = {rank: token for token, rank in byte_bpe.read_ranks(PATH).items()}
    assert found == {1: b"", 2: b"", 3: tokens[0] + tokens[1]}


def test_merges_that_make_a_lower_rank_come_first(spark):
    """Where merging leads back to a lower rank, all pairs at once would differ from one after the other."""
    tokens = [bytes([i]) for i in range(256)] + [b"aaa", b"bb", b"aa", b"bbb", b"aaaa", b"xyz"]
    ranks = {token: rank for rank, token in enumerate(tokens)}
    library = tiktoken.Encoding("tiny", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    import base64
    import tempfile

    with tempfile.NamedTemporaryFile("w", suffix=".tiktoken", delete=False) as file:
        file.writelines(f"{base64.b64encode(token).decode()} {rank}\n" for token, rank in ranks.items())
    rng = random.Random(1)
    texts = ["".join(rng.choices("ab", weights=(3, 1), k=n)) for n in (5, 30, 70, 90, 200) for _ in range(20)] + ["xyz", "xyzx"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {row.doc_id: row.ids for row in byte_bpe.encode_texts(docs, file.name, PATTERN, most_words=1).collect()}
    assert [found[i] for i in range(len(texts))] == [library.encode_ordinary(text) for text in texts]


def test_no_row_leaves_its_task(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = byte_bpe.code_digests(docs, PATH, PATTERN)._jdf.queryExecution().executedPlan()
    names = []
    walk = lambda node: (names.append(node.nodeName()), [walk(node.children().apply(i)) for i in range(node.children().size())])
    walk(plan)
    assert not any("Exchange" in name or "Python" in name or "Arrow" in name for name in names)


def test_known_words_stay_in_spark(spark, library, monkeypatch):
    """They were collected and passed through Python, which took the driver's memory; no row may carry them either."""
    texts = ["one two one two", "two one three", "three xyz", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    with monkeypatch.context() as patch:
        patch.setattr(type(docs), "collect", lambda self: pytest.fail("rows came to Python"))
        coded = byte_bpe.encode_texts(docs, PATH, PATTERN)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = coded._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    nodes = []
    walk = lambda node: (nodes.append(node), [walk(node.children().apply(i)) for i in range(node.children().size())])
    walk(plan)
    assert not any("Exchange" in node.nodeName() or "Python" in node.nodeName() or "buckets" in node.output().toString() for node in nodes)
    assert {row.doc_id: row.ids for row in coded.collect()} == {i: library.encode_ordinary(text or "") for i, text in enumerate(texts)}


def test_tokens_that_merging_does_not_make(spark, tmp_path):
    """A word that is a token is that token, also where it is a frequent word; words of one bucket stay apart."""
    import base64

    ranks = {token: rank for rank, token in enumerate([bytes([i]) for i in range(256)] + [b"ab", b"xyz"])}
    file = tmp_path / "tiny.tiktoken"
    file.write_text("".join(f"{base64.b64encode(token).decode()} {rank}\n" for token, rank in ranks.items()))
    tiny = tiktoken.Encoding("tiny", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["xyz ab", "xyz", "abab xyz", "xyz", *[f"abc{i}" for i in range(50)] * 2]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for most_words in (1, 300):
        found = {row.doc_id: row.ids for row in byte_bpe.encode_texts(docs, str(file), PATTERN, most_words=most_words).collect()}
        assert [found[i] for i in range(len(texts))] == [tiny.encode_ordinary(text) for text in texts]


def test_a_frequent_word_is_found_by_one_comparison(spark, library, monkeypatch):
    """Every lookup searched a string of several words; only words that share a slot with a more frequent one need that."""
    texts = ["one two three", "one two three", "one two", "one", "!!\x01\x02!!", "!!\x01\x02!!", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = lambda: spark.range(1).select(byte_bpe.known_words(docs, "text", byte_bpe.Ranks(PATH), PATTERN, 10).slots.alias("s")).first().s
    slots = held()
    assert {"one", " two", " three"} <= set(slots.word) and sum(rest is not None for rest in slots.rest) <= 1
    monkeypatch.setattr(byte_bpe.KnownWords, "MASK", 1)
    slots = held()
    assert len(slots.word) == 2 and "one" in slots.word and any(slots.rest)
    found = {row.doc_id: row.ids for row in byte_bpe.encode_texts(docs, PATH, PATTERN).collect()}
    assert found == {i: library.encode_ordinary(text or "") for i, text in enumerate(texts)}


def test_merges_know_their_place_and_ids_stay_numbers(spark, library, monkeypatch):
    """array_position() had a fifth of a profile's samples; ids went through text of decimals for every token."""
    texts = ["one two one two", "two one three", "aaaa" * 40, "unheardofwordlike", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(byte_bpe.F, "array_position", lambda *_: pytest.fail("a place was searched for"))
    slots = byte_bpe.known_words(docs, "text", byte_bpe.Ranks(PATH), PATTERN, 10).slots
    assert spark.range(1).select(slots.alias("s")).schema["s"].dataType["ids"].dataType.simpleString() == "array<array<int>>"
    found = {row.doc_id: row.ids for row in byte_bpe.encode_texts(docs, PATH, PATTERN).collect()}
    assert found == {i: library.encode_ordinary(text or "") for i, text in enumerate(texts)}


def test_known_words_are_coded_once(spark, library, tmp_path):
    """Every id of every known word was turned into bytes twice in every row; words were counted once a document, however often they stood there."""
    import base64

    texts = ["one one one one two", "two three", "three", "!!\x01\x02!!", "unheardofwordlike", "ab" * 60, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ranks = byte_bpe.Ranks(PATH)
    slots = byte_bpe.known_words(docs, "text", ranks, PATTERN, 1, coded=ranks.coded).slots
    held = spark.range(1).select(F.explode(slots["ids"]).alias("held")).where("held IS NOT NULL").select("held.*")
    held = held.select("decoded", F.col("numbers").cast("binary").alias("numbers")).collect()
    assert [entry.decoded for entry in held] == [" one"]
    assert bytes(held[0].numbers) == np.array(library.encode_ordinary(" one"), "<u4").tobytes()
    # words that share a slot, tokens not made of their own bytes, and whole words as tokens come out as from the ids
    tiny = {token: rank for rank, token in enumerate([bytes([i]) for i in range(256)] + [b"ab", b"xyz", b"uvw", b" uv"])}
    file = tmp_path / "tiny.tiktoken"
    file.write_text("".join(f"{base64.b64encode(token).decode()} {rank}\n" for token, rank in tiny.items()))
    own = tiktoken.Encoding("tiny", pat_str=PATTERN, mergeable_ranks=tiny, special_tokens={})
    words = ["xyz uvw", "xyz", "uvw xyz", "it's we'll they're I'd 'sx 'x", *[f"abc{i} é{i}" for i in range(50)] * 2]
    rows = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    mask, byte_bpe.KnownWords.MASK = byte_bpe.KnownWords.MASK, 1
    try:
        found = {row.doc_id: row for row in byte_bpe.code_digests(rows, str(file), PATTERN).collect()}
    finally:
        byte_bpe.KnownWords.MASK = mask
    for i, text in enumerate(words):
        ids = own.encode_ordinary(text)
        assert found[i].n_tokens == len(ids)
        assert found[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert found[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
