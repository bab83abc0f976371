import datetime
import random

import pytest

from tidemill.operators.history import build_history, merge_history
from tidemill.session import materialize

SCHEMA = "k int, ts timestamp_ntz, id int, a string, b int"
COLUMNS = (["k"], "ts", "id", ["a", "b"])


def at(minute):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


def by_hand(events):
    """The definition, read literally."""
    latest = {}
    for k, ts, i, a, b in events:
        if k is None or ts is None:
            continue
        if (k, ts) not in latest or latest[k, ts][0] < i:
            latest[k, ts] = (i, a, b)
    versions = {}
    for k, ts in sorted(latest):
        i, a, b = latest[k, ts]
        known = versions.setdefault(k, [])
        if not known or known[-1][2:] != [a, b]:
            known.append([ts, i, a, b])
    out = []
    for k, known in versions.items():
        for n, (ts, i, a, b) in enumerate(known):
            end = known[n + 1][0] if n + 1 < len(known) else None
            out.append((k, a, b, i, ts, end, end is None))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def some_events(seed, n, hot_share, span):
    rng = random.Random(seed)
    return [
        (
            1 if rng.random() < hot_share else rng.choice([2, 3, 4, None]),
            at(rng.randrange(span)),
            i,
            rng.choice(["x", "y", None]),
            rng.choice([1, 2]),
        )
        for i in range(n)
    ]


@pytest.mark.parametrize(
    "seed,hot_share,span,hot_limit",
    [(1, 0.2, 400, 1000), (2, 0.9, 400, 2), (2, 0.9, 400, 10), (3, 0.6, 5, 2), (4, 1.0, 100000, 2)],
)
def test_build_against_the_definition(spark, seed, hot_share, span, hot_limit):
    events = some_events(seed, 400, hot_share, span)
    df = spark.createDataFrame(events, SCHEMA)
    assert got(build_history(df, *COLUMNS, hot_limit=hot_limit)) == by_hand(events)


def test_hot_keys_are_worked_on_in_slices(spark):
    df = spark.createDataFrame(some_events(5, 600, 0.8, 5000), SCHEMA)
    plan = build_history(df, *COLUMNS, hot_limit=4)._jdf.queryExecution().optimizedPlan().toString()
    assert "_slice" in plan
    even = build_history(df.filter("k > 1"), *COLUMNS, hot_limit=2)._jdf.queryExecution().optimizedPlan().toString()
    assert "_slice" not in even.replace("0 AS _slice", "")


@pytest.mark.parametrize("hot_limit", [2, 1000])
def test_merge_equals_build_of_everything(spark, hot_limit):
    events = some_events(6, 400, 0.7, 2000)
    early = [e for e in events if e[1] < at(900)]
    late = [e for e in events if e[1] >= at(900)]
    history = build_history(spark.createDataFrame(early, SCHEMA), *COLUMNS, hot_limit=hot_limit)
    batch = spark.createDataFrame(late, SCHEMA)
    once = materialize(merge_history(materialize(history, "h").rows, batch, *COLUMNS, hot_limit=hot_limit), "h").rows
    assert got(once) == by_hand(events)
    assert got(merge_history(once, batch, *COLUMNS, hot_limit=hot_limit)) == by_hand(events)


def test_late_rows_split_a_version(spark):
    history = build_history(spark.createDataFrame([(1, at(0), 1, "x", 1), (1, at(10), 2, "y", 1)], SCHEMA), *COLUMNS)
    late = spark.createDataFrame([(1, at(5), 3, "z", 1)], SCHEMA)
    merged = got(merge_history(history, late, *COLUMNS))
    assert [(r[1], r[4], r[5]) for r in merged] == [("x", at(0), at(5)), ("y", at(10), None), ("z", at(5), at(10))]


def test_other_keys_pass_through(spark):
    history = build_history(spark.createDataFrame([(1, at(0), 1, "x", 1), (2, at(0), 2, "y", 1)], SCHEMA), *COLUMNS)
    batch = spark.createDataFrame([(2, at(1), 3, "y", 2)], SCHEMA)
    merged = got(merge_history(history, batch, *COLUMNS))
    assert (1, "x", 1, 1, at(0), None, True) in merged and len(merged) == 3
