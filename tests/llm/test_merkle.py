"""The manifest against a plain tree, and its comparison SQL on odd rows."""

import collections
import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemill.llm import merkle, oracles

FIELDS = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, lower=False):
    values = [str(v) if v is not None else None for v in row[:5]]
    if lower and values[4] is not None:
        values[4] = values[4].translate({c: c + 32 for c in range(65, 91)})
    return h(*("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def tree(nodes):
    """Root, and for every leaf its steps (left siblings, right siblings)."""
    steps, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        parents, owned = [], []
        for at in range(0, len(nodes), 16):
            run = nodes[at : at + 16]
            for i in range(len(run)):
                for member in owners[at + i]:
                    steps[member].append((run[:i], run[i + 1 :]))
            parents.append(h(*run))
            owned.append([member for group in owners[at : at + 16] for member in group])
        nodes, owners = parents, owned
    return nodes[0], steps


def plain(rows):
    sources = collections.defaultdict(list)
    for row in rows:
        sources[row[1]].append(row)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        held = sorted(sources[source], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[source] = (held, *tree([leaf(r) for r in held]))
    root, upper = tree([trees[s][1] for s in order])
    for number, source in enumerate(order):
        held, subroot, lower = trees[source]
        for row, steps in zip(held, lower, strict=True):
            way = steps + upper[number]
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            folded = leaf(row, changed)
            for before, after in way:
                folded = h(*before, folded, *after)
            yield row[0], leaf(row), subroot, root, h(*(x for step in way for side in step for x in side)), folded, folded == root


def rows_of(sizes):
    texts = ["Same TEXT", "", None, "äÖ Z\nß", "long " * 20_000, "plain"]
    i = 0
    for source, many in sizes.items():
        for k in range(many):
            i += 1
            yield i * 7 % 10_007, source, None if k % 5 == 4 else "en", None if k % 7 == 6 else k, texts[k % 6], "extra", k


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 1},
        {None: 1, "b": 17},
        {"one": 16, "two": 1, "three": 33, None: 15},
        {"hot": 700, **{f"s{i:02}": 1 + i for i in range(20)}},
        {f"s{i}": 1 for i in range(300)},
    ],
)
def test_against_a_plain_tree(spark, sizes):
    rows = list(rows_of(sizes))
    rows += [(None, *rows[0][1:]), (None, *rows[0][1:]), rows[0], rows[0]]  # null and repeated keys, repeated rows
    docs = spark.createDataFrame(rows, FIELDS + ", node string, position int").repartition(5)
    fifth = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0
    found = merkle.manifest(docs, tampered=fifth)
    expected = collections.Counter(plain(rows))
    assert collections.Counter(map(tuple, found.collect())) == expected
    con = duckdb.connect()
    documents = docs.select("doc_id", "source", "lang", "n_chars", "text").toArrow()
    con.register("documents", documents)
    assert collections.Counter(con.sql(oracles.OP12).fetchall()) == expected


def test_untampered_and_empty(spark):
    rows = list(rows_of({"x": 40, "y": 2}))
    docs = spark.createDataFrame(rows, FIELDS + ", node string, position int")
    assert all(row.verified for row in merkle.manifest(docs).collect())
    assert merkle.manifest(docs.limit(0)).collect() == []


def test_leaves_move_once_on_the_last_way(spark):
    leaves = spark.createDataFrame([("a", 0, 20, "x")], "tree string, position long, many long, node string")
    ways = spark.createDataFrame([("a", 0)], "of_tree string, at long").withColumn("way", F.array().cast(merkle.WAY))
    plan = merkle.with_ways(leaves, ways.hint("merge"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # the leaves, the ways
