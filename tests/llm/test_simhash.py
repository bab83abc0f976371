"""Covering hashing and components against comparison of all pairs on small inputs."""

import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from tidemill.llm import graph, simhash


def plain_fingerprint(text, n):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    words = [re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), w) for w in words]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius):
    """{id: smallest id reachable} for a list of (id, fingerprint)."""
    root = {i: i for i, _ in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, x), (b, y) in itertools.combinations(prints, 2):
        if (x ^ y).bit_count() <= radius:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: find(i) for i, _ in prints}


@pytest.mark.parametrize("radius", [1, 2, 4])
def test_every_pair_within_the_radius_collides_in_some_table(radius):
    rng, tables = random.Random(1), simhash.masks(radius)
    for _ in range(20_000):
        flips = sum(1 << bit for bit in rng.sample(range(64), rng.randint(0, radius)))
        assert any(flips & mask == 0 for mask in tables)


def test_fingerprints():
    for text in ("", "  \n", "One", "a b c", "a b c d e", "Ä b\tc d " * 300, "x\x0by z É é", "a\x1cb c\xa0d e f g"):
        assert simhash.fingerprint(text, 4) == plain_fingerprint(text, 4)
    block, simhash.BLOCK = simhash.BLOCK, 7
    assert simhash.fingerprint("a b c d e f g h i j k l m n" * 9, 4) == plain_fingerprint("a b c d e f g h i j k l m n" * 9, 4)
    simhash.BLOCK = block


def test_links_of_a_bucket_connect_all_near_members():
    rng = np.random.default_rng(3)
    members = np.unique(rng.integers(0, 1 << 12, 300))
    edges = [(int(a), int(b)) for x, y in simhash.linked(members, 2) for a, b in zip(x, y)]
    assert len(edges) < len(members) and all((a ^ b).bit_count() <= 2 for a, b in edges)


@pytest.mark.parametrize(("radius", "crowd"), [(4, 4096), (4, 1), (3, 4096), (3, 1)])
def test_components_of_fingerprints(spark, radius, crowd):
    rng = random.Random(radius + crowd)
    bases = [rng.getrandbits(64) for _ in range(12)] + [0, (1 << 64) - 1]
    prints = []
    for i in range(250):
        x = rng.choice(bases)
        for bit in rng.sample(range(64), rng.randint(0, 6)):
            x ^= 1 << bit
        prints.append((i, x))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    frame = spark.createDataFrame([(signed(x),) for _, x in prints], "fingerprint long")
    roots = {row.fingerprint: row.root for row in simhash._rooted(frame, radius, crowd).collect()}
    groups, expected = {}, {}
    for (i, x), (_, root) in zip(prints, sorted(plain_components(prints, radius).items())):
        groups.setdefault(roots[signed(x)], set()).add(i)
        expected.setdefault(root, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_components_of_a_long_path(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(500)] + [(900, 901), (7, 7)], "a long, b long")
    roots = {row.node: row.root for row in graph.components(path).collect()}
    assert roots == {i: 0 for i in range(1, 501)} | {901: 900}
    assert graph.components(path.limit(0)).count() == 0


def test_documents(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    text = " ".join(words)
    near = " ".join([*words[:200], "Other", *words[201:]])
    rows = [(5, text), (3, near), (3, near), (None, text.upper()), (8, "x y"), (9, None), (10, ""), (11, "\n"), (12, "one")]
    docs = spark.createDataFrame([(i, t, "s", i) for i, t in rows], "doc_id long, text string, fingerprint string, component_id long")
    found = simhash.near_copies(docs, 4, 4).collect()
    prints = [(i if i is not None else 99, plain_fingerprint(t, 4)) for i, t in rows]
    root = plain_components(list(dict(prints).items()), 4)
    assert len(found) == len(rows)
    for row in found:
        i = 99 if row.doc_id is None else row.doc_id
        assert (row.fingerprint, row.component_id) == (f"{dict(prints)[i]:016x}", root[i])
    assert root[5] == root[99] == 3 and root[11] == 9
    kept = simhash.keep_one_of_each(docs, 4, 4)
    assert kept.columns == docs.columns
    assert sorted(row.doc_id for row in kept.collect()) == sorted(set(root.values()))
    nameless = spark.createDataFrame([(None, text), (None, text), (None, "other words are here")], "doc_id long, text string")
    assert sorted(row.text for row in simhash.keep_one_of_each(nameless, 4, 4).collect()) == sorted([text, "other words are here"])
    assert simhash.near_copies(docs.limit(0), 4, 4).count() == 0 and simhash.keep_one_of_each(docs.limit(0), 4, 4).count() == 0
