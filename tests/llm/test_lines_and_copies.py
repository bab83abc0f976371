"""Exact dedup, line dedup and mixing on odd rows, against plain versions of their contracts."""

import collections
import hashlib
import random
import re

import pytest

from tidemill.llm import exact_dedup, line_dedup, mixing


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_frequent_digests_are_never_missed():
    rng = random.Random(2)
    stream = [rng.choice([b"a"] * 5 + [b"b"] * 3 + [bytes([i]) for i in range(200)]) for _ in range(5000)]
    held, true = exact_dedup.frequent(iter(stream), 20), collections.Counter(stream)
    assert len(held) <= 20
    for digest, n in true.items():
        assert n - len(stream) / 21 <= held[digest] <= n


@pytest.mark.parametrize("counters", [1, 2, 1000])
def test_copies(spark, counters):
    texts = ["same"] * 40 + ["", None, "", "x", "X", "x ", "long " * 30_000, "long " * 30_000]
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(3, "same", 0), (39, "same", 0), (None, "x", 1), (None, "n", 1), (None, "n", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep_id int").repartition(7)
    found = exact_dedup.find_copies(docs, counters=counters).collect()
    groups = collections.defaultdict(list)
    for i, t, _ in rows:
        groups[sha(t or "")].append(i)
    assert len(found) == len(rows)
    for row in found:
        ids = groups[row.text_sha256]
        assert row.group_size == len(ids)
        assert row.keep_id == max((i for i in ids if i is not None), default=None)
        assert not row.kept or row.doc_id == row.keep_id
    kept = collections.Counter(row.text_sha256 for row in found if row.kept)
    assert kept == dict.fromkeys(groups, 1)
    assert exact_dedup.find_copies(docs.limit(0)).count() == 0


def plain_lines(rows, least=10):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    first = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None:
                first[key(line)] = min(i, first.get(key(line), i))
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or first.get(key(x), i) == i]
        yield i, "\n".join(kept), len(lines), len(lines) - len(kept)


@pytest.mark.parametrize("full", [False, True])
def test_lines(spark, full, monkeypatch):
    rng = random.Random(6)
    pool = ["a line of some length %d" % i for i in range(40)] + ["short", "", "  A LINE of some length 3 ", "É line wíth accents", "é line wíth accents", "\tbar\x0b"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))) for i in rng.sample(range(1000), 60)]
    rows += [(None, pool[0] + "\nnobody else has this"), (None, "nobody else has this"), (2000, None), (2001, ""), (rows[0][0], pool[1]), (3000, "long line " * 20_000 + "\n" + pool[2])]
    docs = spark.createDataFrame([(7, t, i) for i, t in rows], "n_dropped int, text string, doc_id long")
    if full:  # a filter that is far too small suspects everything and changes nothing
        filters = {0: b"\xff" * (line_dedup.SLICE_BITS // 8)}
        monkeypatch.setattr(line_dedup, "filter_of_repeats", lambda *_: filters)
    found = line_dedup.drop_repeated_lines(docs)
    assert found.columns == ["text", "doc_id", "n_lines", "n_dropped"]
    key = lambda row: (row[0] is None, row[0] or 0, row[1])
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in found.collect()), key=key) == sorted(plain_lines(rows), key=key)
    assert line_dedup.drop_repeated_lines(docs.limit(0)).count() == 0


def test_line_filter_holds_every_repeat(spark):
    docs = spark.createDataFrame([(i, f"only in number {i} here\nin all of the documents\nin two of them {i // 2}") for i in range(400)], "doc_id long, text string")
    held = line_dedup.filter_of_repeats(docs.repartition(9), "text", 10, 1200, 32 << 20)
    hashes = lambda keys: line_dedup._hashes([k.encode() for k in keys])
    in_filter = lambda keys: line_dedup.Filter(held[0]).has(line_dedup.probes(hashes(keys)))
    assert in_filter(["in all of the documents", *(f"in two of them {i}" for i in range(200))]).all()
    assert in_filter([f"only in number {i} here" for i in range(400)]).mean() < 0.05


def test_mixing(spark):
    rng = random.Random(8)
    rows = [(i, "w " * int(rng.paretovariate(0.8) * 5), rng.choice(["a"] * 6 + ["b", "B", "ä", None])) for i in range(3000)]
    rows += [(1, None, "a"), (1, None, "a"), (None, "x y", "b"), (5000, "", "empty"), (5001, " \t", "empty")]
    docs = spark.createDataFrame([(1, i, t, s) for i, t, s in rows], "size int, doc_id long, text string, source string")
    for bucket_rows in (2000, 3):
        plan = mixing.mix_plan(docs, bucket_rows=bucket_rows).collect()
        assert len(plan) == len(rows)
        if bucket_rows == 2000:
            first = sorted(map(str, plan))
        assert sorted(map(str, plan)) == first  # reruns and the cut into buckets change nothing
    taken, size, target = collections.Counter(), {}, {}
    source_of = {i: s for i, t, s in rows if i is not None}
    for row in plan:
        source = source_of.get(row.doc_id, "b")
        assert row.taken in (0, row.size, 2 * row.size)
        taken[source] += row.taken
        size[source], target[source] = row.source_size, row.target
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6 * sum(size.values())
    largest = collections.Counter()
    for row in plan:
        source = source_of.get(row.doc_id, "b")
        largest[source] = max(largest[source], row.size)
    for source in size:
        assert target[source] <= 2 * size[source]
        assert abs(taken[source] - target[source]) <= 0.02 * target[source] + largest[source]
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    copies = collections.Counter(r.doc_id for r in mixed.collect() if r.text and r.text.strip())
    assert {r.doc_id: r.taken // r.size for r in plan if r.taken} == dict(copies)
    assert mixing.mix_plan(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0
