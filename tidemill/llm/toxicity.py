"""Toxicity by bags of subwords: embeddings averaged into a linear softmax.

A word is itself and its character n-grams, each hashed to one of ``buckets``
embeddings; its vector is their mean, that of a text the mean of its words'. Two softmax
weights turn it into a score. Embeddings and weights are trained together,
in numpy, on a bounded sample of labelled documents. Misspellings nobody has seen
share n-grams with the words they come from, and so their score.

Both classes' weights only count through their difference, so a trained
model folds into one number per bucket, which is what tasks get.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import exp
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemill.llm.bpe_model import Memory
from tidemill.llm.common import give_back, kept, map_batches, texts_of

NGRAMS = (3, 4, 5)
MARKS = ".,;:!?\"'()[]{}<>«»„“”‘’…*&%$#@~^_|/\\-–—+="
#: Scores from here on count as toxic.
THRESHOLD = 0.3
#: The mean over a text's words is multiplied with this and the root of their number:
#: chance makes means of short texts vary more, by just that root.
SHARPNESS = 4.0
#: So many numbers, and those of one word more, are worked on at a time in training: arrays made on the way stay small beside those kept.
BLOCK = 1 << 17


def words_of(text: str) -> list[str]:
    return text.lower().split()


def subwords(word: str, buckets: int) -> list[int]:
    """Buckets of a word without punctuation around it, and of its n-grams with marks for begin and end."""
    bare = word.strip(MARKS) or word
    marked = f"<{bare}>"
    parts = {marked}
    for n in NGRAMS:
        parts.update([marked[i : i + n] for i in range(len(marked) - n + 1)])
    return [crc32(part.encode()) % buckets for part in parts]


@dataclass(frozen=True)
class Model:
    """One number per bucket and the bias; ``kind`` tells tasks apart models they have in memory."""

    values: np.ndarray
    bias: float

    def word(self, word: str) -> float:
        return float(self.values[subwords(word, len(self.values))].mean())


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model = model
        self.words = Memory(model.word, 200_000)

    def score(self, text: str) -> float:
        words = words_of(text)
        mean = sum(map(self.words.__getitem__, words)) / len(words) if words else 0.0
        logit = SHARPNESS * len(words) ** 0.5 * mean + self.model.bias
        return 1 / (1 + exp(-min(max(logit, -30.0), 30.0)))


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches, none of them empty."""
    return np.add.reduceat(values, np.cumsum(sizes) - sizes)


def _blocks(sizes: np.ndarray) -> Iterator[tuple[slice, slice]]:
    """Consecutive stretches of about ``BLOCK`` entries in all: the stretches, and their entries."""
    ends = np.cumsum(sizes)
    first = start = 0
    while first < len(sizes):
        last = int(np.searchsorted(ends, start + BLOCK)) + 1
        last = min(last, len(sizes))
        end = int(ends[last - 1])
        yield slice(first, last), slice(start, end)
        first, start = last, end


def _first_embeddings(rng: np.random.Generator, buckets: int, dimensions: int, used: np.ndarray) -> np.ndarray:
    """Of random embeddings of all buckets, drawn one after the other, those of the buckets used."""
    own = np.empty((len(used), dimensions))
    for first in range(0, buckets, BLOCK):
        drawn = rng.normal(0, 0.05, (min(BLOCK, buckets - first), dimensions)).astype(np.float32)
        start, end = np.searchsorted(used, (first, first + len(drawn)))
        own[start:end] = drawn[used[start:end] - first]
    return own


def _trust(of_word, word_sizes, of_text, text_sizes, target, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that occur, and how far each may count, from 0 to 1: the odds that its texts lean to a class by more than chance.

    One in all buckets is expected to, before texts are seen; what is seen adds the logarithm of how much likelier
    the two classes' own shares of texts are than one share for both. No bucket is left out: rare ones count little, the
    less the more buckets there are, since what chance distributes can be learnt by heart only.
    """
    starts = np.cumsum(word_sizes) - word_sizes
    texts = np.zeros((2, buckets), np.float32)
    for words, toxic in zip(np.split(of_text, np.cumsum(text_sizes)[:-1]), target, strict=True):
        sizes = word_sizes[words]
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        texts[int(toxic), np.unique(of_word[np.repeat(starts[words], sizes) + inside])] += 1
    used = np.flatnonzero(texts.any(axis=0))
    clean, toxic = texts[:, used].astype(float)

    def likelihood(n: np.ndarray, size: float) -> np.ndarray:
        share = n / size
        return n * np.log(np.maximum(share, 1e-12)) + (size - n) * np.log(np.maximum(1 - share, 1e-12))

    all_toxic = target.sum()
    gain = likelihood(clean, len(target) - all_toxic) + likelihood(toxic, all_toxic) - likelihood(clean + toxic, len(target))
    return used, 1 / (1 + np.exp(np.clip(np.log(len(used)) - gain, -50, 50)))


def train(
    texts: list[str], labels: list[int], odds: float, buckets: int = 1 << 20, dimensions: int = 8,
    steps: int = 60, rate: float = 0.1, decay: float = 1e-4, seed: int = 11,
) -> Model:
    """Fit embeddings and softmax weights together by Adam on all given texts.

    ``odds``: toxic to clean documents where the model will be used; the sample may hold another
    share. Texts without words take no part. With one class only, the score is constant. Every subword is
    trained, with the share of its number that ``_trust`` gives it.
    """
    number: dict[str, int] = {}
    of_text, counts, text_sizes, marks = array("i"), array("f"), [], []
    for text, label in zip(texts, labels, strict=True):
        words = Counter(words_of(text))
        if words:
            scale = SHARPNESS / sum(words.values()) ** 0.5
            of_text.extend([number.setdefault(word, len(number)) for word in words])
            counts.extend([n * scale for n in words.values()])
            text_sizes.append(len(words))
            marks.append(label)
    target = np.array(marks, float)
    toxic = target.sum()
    if not toxic or toxic == len(target):
        return Model(np.zeros(buckets, np.float32), 30.0 if toxic else -30.0)
    of_word, word_sizes = array("i"), array("i")
    for word in number:
        parts = subwords(word, buckets)
        of_word.extend(parts)
        word_sizes.append(len(parts))
    n_words = len(number)
    del number, parts
    of_text, of_word, word_sizes = (np.frombuffer(part, np.int32) for part in (of_text, of_word, word_sizes))
    counts = np.frombuffer(counts, np.float32)
    text_sizes = np.array(text_sizes)
    used, trust = _trust(of_word, word_sizes, of_text, text_sizes, target, buckets)
    share = np.where(target > 0, 0.5 / toxic, 0.5 / (len(target) - toxic))
    rng = np.random.default_rng(seed)
    own = _first_embeddings(rng, buckets, dimensions, used)
    weights = rng.normal(0, 0.5, (2, dimensions))
    biases = np.zeros(2)
    place = np.full(buckets, -1, np.int32)
    place[used] = np.arange(len(used))
    at = place[of_word]
    del of_word, place
    blocks = list(_blocks(word_sizes))
    rows = [slice(first, first + BLOCK // dimensions + 1) for first in range(0, len(used), BLOCK // dimensions + 1)]
    per_word, to_own = np.empty(n_words), np.empty(len(used))
    moments = [np.zeros((len(used), dimensions)), np.zeros((2, dimensions)), np.zeros(2)]
    spreads = [np.zeros_like(moment) for moment in moments]
    for step in range(1, steps + 1):
        direction = weights[1] - weights[0]
        value_of = own @ direction * trust
        for words, entries in blocks:
            sizes = word_sizes[words]
            per_word[words] = np.bincount(np.repeat(np.arange(len(sizes)), sizes), value_of[at[entries]], len(sizes))
        per_word /= word_sizes
        logit = _sums(counts * per_word[of_text], text_sizes) + biases[1] - biases[0]
        error = share * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - target)
        to_words = np.bincount(of_text, counts * np.repeat(error, text_sizes), n_words) / word_sizes
        to_own[:] = 0
        for words, entries in blocks:
            # in place and in order, so that sums are those of one pass
            np.add.at(to_own, at[entries].astype(np.intp), np.repeat(to_words[words], word_sizes[words]))
        to_own *= trust
        # The softmax weights' gradient is the error times the texts' vectors, summed: the same sum over embeddings.
        to_weights = to_own @ own

        def moved(value, gradient, moment, spread, step=step) -> None:
            moment += 0.1 * (gradient - moment)
            spread += 0.01 * (gradient**2 - spread)
            value -= rate * (moment / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-12)

        for part in rows:
            moved(own[part], np.outer(to_own[part], direction) + decay * own[part] / len(used), moments[0][part], spreads[0][part])
        moved(weights, np.stack([-to_weights, to_weights]) + decay * weights, moments[1], spreads[1])
        moved(biases, np.array([-error.sum(), error.sum()]), moments[2], spreads[2])
    values = np.zeros(buckets, np.float32)
    values[used] = own @ (weights[1] - weights[0]) * trust
    return Model(values, float(biases[1] - biases[0]) + float(np.log(odds)) * 0.5)


def learnable(key: Column) -> Column:
    """Whether labels of a document may be learnt from: CRC-32 of its key as text, modulo 4, is not 2.

    True for a null key: no rule holds it out. It has no label that could be found either.
    """
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 != 2, F.lit(True))


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    most_of_class: int = 1500, longest: int = 50_000, **settings,
) -> Model:
    """A model from at most ``most_of_class`` toxic and twice as many clean labelled documents.

    Which ones is settled by a hash of their keys. Null labels and keys are ignored, of
    several labels of a document the largest counts, of several rows of a document the smallest text.
    Texts of more than ``longest`` bytes are scored, but not learnt from. Only the sample's whole texts
    come to the driver: ``3 * most_of_class * longest`` bytes at most, whatever the tables hold.
    """
    known = (
        labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("toxic"))
        .where(F.col("id").isNotNull() & F.col("toxic").isNotNull() & learnable(F.col("id")))
        .groupBy("id")
        .agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    )
    order = F.xxhash64("id")
    chosen = [known.where(F.col("toxic") == value).orderBy(order, "id").limit(most) for value, most in ((1, most_of_class), (0, 2 * most_of_class))]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))  # 3 * most_of_class rows at most
    shown = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where(F.octet_length("text") <= longest)
    sample = shown.join(chosen, "id").groupBy("id", "toxic").agg(F.min("text").alias("text")).collect()
    sample.sort(key=lambda row: row["id"])
    shares = {row["toxic"]: row["n"] for row in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    odds = max(shares.get(1, 0), 1) / max(shares.get(0, 0), 1)
    model = train([row["text"] for row in sample], [row["toxic"] for row in sample], odds, **settings)
    del sample
    give_back()  # the driver goes on to other work
    return model


@kept("toxicity", 1)
def _scorer(content: bytes, bias: float) -> Scorer:
    return Scorer(Model(np.frombuffer(content, np.float32), bias))


def _score_batch(batch, text_at: int, model) -> list:
    scorer = _scorer(*model.value)
    return [*batch.columns, [scorer.score(text) for text in texts_of(batch, text_at)]]


def with_scores(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` and the score of every whole text, from 0 to 1, higher for toxic ones.

    Only the text is looked at; a null or empty one gets the model's bias as its score. Row by row,
    without a shuffle. A column of ``docs`` named like the score gives way to it, be it the text itself.
    """
    if name == text:
        text = "_text"
        while text in docs.columns:
            text += "_"
        docs = docs.withColumnRenamed(name, text)
        return with_scores(docs, model, text, name).drop(text)
    docs = docs.drop(name)
    shared = docs.sparkSession.sparkContext.broadcast((model.values.tobytes(), model.bias))
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    return map_batches(docs, _score_batch, schema, docs.columns.index(text), shared)


def drop_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, **settings) -> DataFrame:
    """Rows of ``docs``, all columns, that score below the threshold, by a model fitted on the labels."""
    name = "score"
    while name in docs.columns:
        name += "_"
    scored = with_scores(docs, fit(docs, labels, key, text, **settings), text, name)
    return scored.where(F.col(name) < threshold).drop(name)
