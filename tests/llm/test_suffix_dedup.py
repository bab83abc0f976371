"""Removal of repeated strings against marking every repeated window by brute force."""

import random

import numpy as np
import pytest

from tidemill.llm import suffix_dedup as S


def brute(rows, length):
    """rows of (key, text) in corpus order -> {row number: (bytes, removed, spans, kept)}."""
    seen, out = set(), []
    for _, text in rows:
        data = (text or "").encode()
        covered = bytearray(len(data))
        for start in range(len(data) - length + 1):
            window = data[start : start + length]
            if window in seen:
                covered[start : start + length] = b"\1" * length
            seen.add(window)
        kept = bytes(x for x, c in zip(data, covered) if not c)
        spans = sum(1 for i, c in enumerate(covered) if c and (not i or not covered[i - 1]))
        out.append((len(data), len(data) - len(kept), spans, kept))
    return out


def test_every_window_has_a_trigger_that_depends_on_its_bytes_alone():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 3000).astype(np.uint8)
    data[500:900] = data[1500:1900]
    data[2000:2300] = 7
    at = S.triggers(data, 100)
    starts = np.arange(len(at))
    assert len(at) == len(data) - 99 and (at >= starts).all() and (at + S.GRAM <= starts + 100).all()
    assert (np.diff(at) >= 0).all()
    for start in range(500, 801):
        assert at[start] - start == at[start + 1000] - start - 1000
    first, last, _, _ = S.entries(data, 100)
    assert first[0] == 0 and last[-1] == len(at) - 1 and (first[1:] == last[:-1] + 1).all()


def test_hashes_of_stretches():
    data = np.frombuffer(b"abcabcabd" * 3, np.uint8)
    h = S.Hashes(data)
    a, b = np.array([0, 3, 9]), np.array([3, 6, 12])
    values = h.of(a, b)
    assert values[0] == values[1] == values[2] != h.of(np.array([6]), np.array([9]))[0]


def test_suffixes_are_in_order():
    row, offset, new, text = S.sorted_suffixes([b"banana-banana", b"ananab", b"\0\0\0\0\0\0"], 5)
    assert list(text) == sorted(text)
    groups = {}
    for r, o, t in zip(row, offset, text):
        groups.setdefault(bytes(t), []).append((int(r), int(o)))
    assert groups[b"anana"] == [(0, 1), (0, 8), (1, 0)] and new.sum() == len(groups)


@pytest.mark.parametrize("most", [4000, 2])
def test_texts(spark, most):
    rng = random.Random(most)
    words = ["".join(rng.choice("abcdeé日") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    passage = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [passage(n) for n in (25, 60, 200)] + ["a" * 350, "ab" * 200, "x" * 99, "y" * 100, "y" * 101]
    texts = [" ".join(rng.choice([passage(5), passage(30), rng.choice(shared)]) for _ in range(rng.randint(0, 7))) for _ in range(70)]
    texts += [shared[1]] * 30 + ["", None, "short", passage(30_000), "z" * 20_000, "\0" * 300, shared[2][:150] + "!", "?" + shared[2][100:]]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = spark.createDataFrame([(t, i, 3) for i, t in rows], "text string, doc_id long, n_spans int").repartition(5)
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in S.remove_repeats(docs, most=most).collect()}
    rows.sort()
    expected = brute(rows, 100)
    assert len(found) == len(rows)
    for (i, _), right in zip(rows, expected, strict=True):
        assert found[i] == right, i


def test_keys(spark):
    text = "one two three four " * 3 + "".join(chr(97 + i % 26) + str(i) for i in range(60))
    rows = [(None, text), (7, text), (7, text), (3, text), (3, "other " + text), (None, "nothing of the kind " * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [(r.doc_id, r.n_removed) for r in S.remove_repeats(docs, length=50).collect()]
    assert len(found) == 6
    size = len(text.encode())
    assert [n for i, n in found if i == 7] == [size, size]  # rows of one key and text come back alike
    assert sorted(n for i, n in found if i == 3) == [0, size]
    assert (None, size) in found and (None, 0) in found
    assert S.remove_repeats(docs.limit(0)).count() == 0
    named = spark.createDataFrame([("b", text), ("a", text), ("c", "")], "doc_id string, text string")
    assert {r.doc_id: r.n_removed for r in S.remove_repeats(named, length=50).collect()} == {"a": 0, "b": size, "c": 0}
