"""Held-out accuracy on small invented texts, odd rows, and which rows may be learnt from."""

import math
import random
import tracemalloc
import zlib

import pytest

from tidemill.llm import toxicity

BAD = ["grobnak", "stervik", "plonkfool", "varmlurk"]


def made(n, seed):
    """Texts of random words; every fourth has a few bad ones."""
    rng = random.Random(seed)
    words = ["".join(rng.choice(["an", "the", "on", "er", "ti", "sh", "ou", "re"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        toxic = i % 4 == 0
        for _ in range(2 + len(text) // 40 if toxic else 0):
            text.insert(rng.randrange(len(text)), rng.choice(BAD))
        yield i, " ".join(text), int(toxic)


def test_held_out_rows_are_told_apart():
    rows = list(made(800, 1))
    model = toxicity.train([t for _, t, _ in rows[:600]], [y for _, _, y in rows[:600]], 1 / 3)
    scorer = toxicity.Scorer(model)
    right = sum((scorer.score(t) >= toxicity.THRESHOLD) == y for _, t, y in rows[600:])
    assert right >= 195
    text = "the shou er onti " * 8
    assert scorer.score(text + "grobnakk stervick plonk-fool") > 0.5 > 0.3 > scorer.score(text)  # never seen like this
    again = toxicity.train([t for _, t, _ in rows[:600]], [y for _, _, y in rows[:600]], 1 / 3)
    assert (again.values == model.values).all() and again.bias == model.bias


def test_one_class_or_nothing():
    assert toxicity.Scorer(toxicity.train(["a b"], [0], 1.0)).score("a b") < 0.01
    assert toxicity.Scorer(toxicity.train(["a b"], [1], 1.0)).score("") > 0.99
    assert toxicity.Scorer(toxicity.train([], [], 1.0)).score("a") < 0.01


def test_documents(spark):
    rows = [(i, t, 9) for i, t, _ in made(400, 2)] + [(None, "the grobnak", 1), (401, None, 1), (402, "", 1), (401, "x " * 100_000, 1)]
    labels = [(i, y) for i, _, y in made(400, 2)] + [(None, 1), (3, None), (999, 1), (401, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    rule = {r.doc_id: r.may for r in docs.select("doc_id", toxicity.learnable(docs["doc_id"]).alias("may")).collect() if r.doc_id}
    assert all(may == (zlib.crc32(str(i).encode()) % 4 != 2) for i, may in rule.items())
    # What is held out changes nothing.
    other = spark.createDataFrame([(i, y if i is None or rule.get(i, True) else 1 - (y or 0)) for i, y in labels], "doc_id long, toxic int")
    model, same = toxicity.fit(docs, marks), toxicity.fit(docs, other)
    assert (model.values == same.values).all()
    scored = toxicity.with_scores(docs, model)
    assert scored.columns == ["doc_id", "text", "score"] and scored.count() == len(rows)
    found = {r.doc_id: r.score for r in scored.collect()}
    truth = {i: y for i, _, y in made(400, 2)}
    assert sum((found[i] >= 0.3) == y for i, y in truth.items()) >= 390 and 0 <= found[402] <= 1
    kept = toxicity.drop_toxic(docs, marks)
    assert kept.columns == docs.columns and {402, 401} <= {r.doc_id for r in kept.collect()}
    assert toxicity.drop_toxic(docs.limit(0), marks).count() == 0
    assert toxicity.drop_toxic(docs, marks.limit(0)).count() == len(rows)


def test_scores_against_a_plain_loop():
    rows = list(made(200, 5))
    model = toxicity.train([t for _, t, _ in rows], [y for _, _, y in rows], 1 / 3)
    scorer = toxicity.Scorer(model)
    for text in [rows[0][1], rows[1][1], "grobnak!", "", "  ", "\u00a0 (the) THE -- \U0001f600"]:
        means = []
        for word in text.lower().split():
            marked = "<" + (word.strip(toxicity.MARKS) or word) + ">"
            grams = {marked} | {marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked)) if i + n <= len(marked)}
            means.append(sum(float(model.values[zlib.crc32(g.encode()) % len(model.values)]) for g in grams) / len(grams))
        logit = model.bias + (toxicity.SHARPNESS * len(means) ** 0.5 * sum(means) / len(means) if means else 0)
        assert scorer.score(text) == pytest.approx(1 / (1 + math.exp(-logit)), rel=1e-4)


def test_the_sample_is_bounded_in_rows_and_bytes(spark, monkeypatch):
    """One labelled id in very many rows and a very long text: one text an id, none beyond the bound."""
    rows = [(i, t) for i, t, _ in made(40, 3)]
    may = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    hot, long = may[0], may[1]
    docs = spark.createDataFrame([row for row in rows if row[0] != long] + [(hot, f"zzz {i}") for i in range(3000)] + [(long, "y" * 5001)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in made(40, 3)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, marks, odds: seen.extend(zip(texts, marks)))
    toxicity.fit(docs, labels, longest=5000)
    assert len(seen) == len(may) - 1 and not any("yyy" in text for text, _ in seen)
    seen.clear()
    toxicity.fit(docs, labels, longest=5000, most_of_class=2)
    assert len(seen) <= 6


def test_null_keys_and_a_text_called_score(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, None)], "doc_id long, score string")
    assert all(r.may is not None for r in docs.select(toxicity.learnable(docs["doc_id"]).alias("may")).collect())
    scored = toxicity.with_scores(docs, toxicity.train(["a", "b"], [0, 1], 1.0), text="score")
    assert scored.columns == ["doc_id", "score"] and all(0 <= r.score <= 1 for r in scored.collect())


def held_out(spark, folder):
    """(toxic, score) of the given labelled rows that may not be learnt from."""
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    rows = docs.select("doc_id", "text").join(labels.where(~toxicity.learnable(labels["doc_id"])).select("doc_id", "toxic"), "doc_id")
    return model, [(r.toxic, r.score) for r in toxicity.with_scores(rows, model).collect()]


@pytest.mark.parametrize(("sf", "recall"), [("sf0.001", 0.5), ("sf0.01", 0.7), ("sf0.1", 0.95)])
def test_given_tables_of_any_size(spark, sf, recall):
    model, rows = held_out(spark, f"/root/testdata/{sf}")
    assert len({score for _, score in rows}) > 1 and (model.values != 0).sum() > 10_000  # no subword is left out
    found = [toxic for toxic, score in rows if score >= toxicity.THRESHOLD]
    assert sum(found) >= recall * sum(toxic for toxic, _ in rows)
    assert sum(found) >= (0.3 if sf == "sf0.001" else 0.75) * len(found)


def sample_texts(n, seed=3):
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [" ".join("".join(rng.choices(letters, k=rng.randrange(1, 12))) for _ in range(30)) for _ in range(n)]
    return texts, [i % 3 == 0 for i in range(n)]


def test_training_takes_little_memory():
    """Embeddings of all buckets and whole arrays of subwords took the driver's memory."""
    texts, labels = sample_texts(300)
    tracemalloc.start()
    try:
        toxicity.train(texts, labels, 0.5, steps=2)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 60_000_000


def test_blocks_change_no_result(monkeypatch):
    texts, labels = sample_texts(40)
    texts.append("x" * 3000)
    labels.append(True)
    whole = toxicity.train(texts, labels, 0.5, buckets=1 << 14, steps=5)
    monkeypatch.setattr(toxicity, "BLOCK", 1000)
    parts = toxicity.train(texts, labels, 0.5, buckets=1 << 14, steps=5)
    assert whole.values.any() and whole.values == pytest.approx(parts.values, rel=1e-6) and whole.bias == pytest.approx(parts.bias, rel=1e-12)
