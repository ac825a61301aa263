"""Quality classifier: naive Bayes support vectors over hashed n-grams.

A text shows the n-grams of its words (runs without white space, A-Z in lower case), of
their shapes, their last letters, and which of the words before each of them repeats, each
once however often it occurs, hashed to ``buckets``.  An n-gram's value is the logarithm of
the ratio of its shares in the two classes.  With these values, scaled to length one, a
linear model with hinge loss is fitted by dual coordinate descent: one dual variable at a
time is moved to its best value between 0 and its bound, and the weights with it.

Fitting uses at most ``max_labels`` labelled documents, chosen by a hash of their id; Spark
counts their n-grams by class.  The descent, which goes from document to document in one
task, takes those of them that have at most ``max_values`` n-grams together.  Scoring is
one Arrow pass over all documents and whole texts.

Defined results: null and empty texts show no n-gram and get the score of the bias;
very long texts are read whole; labels that are null are left out; without
labels of both kinds every score is that of the one kind there is, or one half; repeated
rows give repeated results; columns of any name pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.llm import words
from tidelake.llm.runtime import cut, free_name


@dataclass(frozen=True)
class Settings:
    #: Labelled documents to learn from, and n-grams of them that the descent takes, at most.
    max_labels: int = 20_000
    max_values: int = 20_000_000
    buckets: int = 1 << 18
    smoothing: float = 1.0
    #: Bound of a dual variable, for the rarer class times its share.
    bound: float = 1.0
    epochs: int = 20
    #: Largest move of an epoch's dual variables at which the descent ends.
    tolerance: float = 1e-3


def in_training(doc_id: Column) -> Column:
    """May labels of this document be learned from?"""
    return F.crc32(doc_id.cast("string")) % 3 != 1


# Kinds of bytes in a word's shape.
_SHAPE = np.zeros(256, np.uint8)
_SHAPE[0x61:0x7B] = 1
_SHAPE[0x41:0x5B] = 2
_SHAPE[0x30:0x3A] = 3
_SHAPE[0x80:] = 1
_SHAPE[[ord(c) for c in ".,;:!?"]] = 4

#: Words before one that are held against it.
_BACK = 4


def shown(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all distinct n-grams of each text of a slice, one text after another, and how many each has."""
    n = len(offsets) - 1
    lower = words.LOWER[data]
    starts, ends, first = words.spans(data, offsets, words.VISIBLE)
    owner = np.repeat(np.arange(n), np.diff(first))
    kinds = []
    if len(starts):
        shape = _SHAPE[data]
        # A shape is the word with each run of one kind of byte as one.
        change = np.ones(len(data), bool)
        change[1:] = shape[1:] != shape[:-1]
        change[starts] = True
        at = np.flatnonzero(change)
        where = np.searchsorted(at, np.append(starts, 0)[:-1]), np.searchsorted(at, ends)
        word, form = words.span_hash(lower, starts, ends), words.span_hash(shape[at], *where)
        tail = words.span_hash(lower, np.maximum(starts, ends - 3), ends)
        for salt, (hashes, size) in enumerate(((word, 1), (word, 2), (form, 1), (form, 2), (form, 3), (tail, 1))):
            grams = words.window_hash(hashes, size)
            keep = words.within(first, size) if size > 1 else np.ones(len(grams), bool)
            kinds.append((owner[: len(grams)][keep], words.mix(grams[keep] + np.uint64(salt + 1))))
        if len(word) > _BACK:
            same = sum((word[_BACK:] == word[_BACK - k : -k]).astype(np.uint64) << np.uint64(k) for k in range(1, _BACK + 1))
            keep = words.within(first, _BACK + 1)
            kinds.append((owner[: len(same)][keep], words.mix(same[keep] + np.uint64(1 << 32))))
    if not kinds:
        return np.empty(0, np.int32), np.zeros(n, np.int64)
    both = np.concatenate([o for o, _ in kinds]) * buckets + (np.concatenate([h for _, h in kinds]) % np.uint64(buckets)).astype(np.int64)
    both = np.unique(both)
    return (both % buckets).astype(np.int32), np.bincount(both // buckets, minlength=n)


@dataclass
class Model:
    """Weights by bucket, before scaling to length one (``values``), the bias, and the slope from margin to score."""

    settings: Settings
    values: np.ndarray
    weights: np.ndarray
    bias: float = 0.0
    slope: float = 2.0

    def margins(self, buckets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        owner = np.repeat(np.arange(len(sizes)), sizes)
        value = self.values[buckets]
        length = np.sqrt(np.bincount(owner, value * value, len(sizes)))
        return np.bincount(owner, value * self.weights[buckets], len(sizes)) / np.maximum(length, 1e-12) + self.bias

    def score(self, texts: pa.Array) -> np.ndarray:
        out = [self.margins(*shown(data, offsets, self.settings.buckets)) for _, data, offsets in words.slices(texts)]
        return 1 / (1 + np.exp(-np.clip(self.slope * np.concatenate([*out, np.empty(0)]), -700, 700)))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """A model from labelled rows whose id ``in_training`` admits."""
    usable = labels.where(in_training(F.col(doc_id)) & F.col(label).isin(0, 1)).select(F.col(doc_id).alias("id"), (F.col(label) == 1).alias("good"))
    # The bound on labelled rows also bounds what is broadcast.
    usable = F.broadcast(usable.orderBy(F.xxhash64("id"), "id", "good").limit(settings.max_labels))
    sample = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(usable, "id")

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data, offsets in words.slices(batch.column(1)):
                buckets, sizes = shown(data, offsets, settings.buckets)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(buckets))
                part = batch.slice(i, len(sizes))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), lists], ["id", "good", "grams"])

    rows = cut(sample.select("id", "text", "good").mapInArrow(show, T.StructType([T.StructField("id", sample.schema["id"].dataType), T.StructField("good", T.BooleanType()), T.StructField("grams", T.ArrayType(T.IntegerType()))])))
    sizes = {r["good"]: r["count"] for r in rows.groupBy("good").count().collect()}
    zeros = np.zeros(settings.buckets)
    if len(sizes) < 2:
        return Model(settings, zeros, zeros, {True: 1.0, False: -1.0}[next(iter(sizes))] if sizes else 0.0)
    counts = np.zeros((2, settings.buckets))
    for bucket, good, bad in zip(*(c.to_numpy() for c in _class_counts(rows, settings.buckets).toArrow().columns)):
        counts[:, bucket] = bad, good
    shares = counts + settings.smoothing
    shares /= np.array([[sizes[False]], [sizes[True]]]) + 2 * settings.smoothing
    ratios = np.log(shares[1] / shares[0])
    # The least hashes of ids, while they have no more n-grams together than the bound.
    running = Window.orderBy("h", "id").rowsBetween(Window.unboundedPreceding, 0)
    chosen = rows.groupBy("id").agg(F.sum(F.size("grams").cast("long")).alias("n")).withColumn("h", F.xxhash64("id"))
    chosen = cut(chosen.withColumn("n", F.sum("n").over(running)).where(F.col("n") <= settings.max_values).select("id", "h"))
    sent = docs.sparkSession.sparkContext.broadcast(ratios)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken = [(np.diff(np.asarray(b.column(1).offsets)), np.asarray(b.column(1).flatten()), np.asarray(b.column(0))) for b in batches]
        if taken:
            widths, grams, good = (np.concatenate(x) for x in zip(*taken))
            model = descend(sent.value, np.append(0, np.cumsum(widths)), grams, good, settings)
            at = np.flatnonzero(model.weights)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(model.weights[at], model.bias))], ["bucket", "weight"])

    # Bounded by the settings, so one task of an executor can hold it.
    sample = rows.join(F.broadcast(chosen), "id").select("good", "grams", "h", "id").repartition(1).sortWithinPartitions("h", "id").select("good", "grams")
    weights = np.zeros(settings.buckets + 1)
    for bucket, weight in zip(*(c.to_numpy() for c in sample.mapInArrow(train, "bucket long, weight double").toArrow().columns)):
        weights[bucket] = weight
    return Model(settings, ratios, weights[:-1], weights[-1])


def _class_counts(rows: DataFrame, buckets: int) -> DataFrame:
    """``(bucket, good, bad)``: documents of each class; each task adds up its own first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), np.int64)
        for batch in batches:
            grams, good = batch.column(1), np.repeat(np.asarray(batch.column(0)), np.diff(np.asarray(batch.column(1).offsets)))
            flat = np.asarray(grams.flatten())
            total[1] += np.bincount(flat[good], minlength=buckets)
            total[0] += np.bincount(flat[~good], minlength=buckets)
        at = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[1, at]), pa.array(total[0, at])], ["bucket", "good", "bad"])

    return rows.select("good", "grams").mapInArrow(count, "bucket long, good long, bad long").groupBy("bucket").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))


def descend(ratios: np.ndarray, offsets: np.ndarray, grams: np.ndarray, good: np.ndarray, settings: Settings) -> Model:
    """The hinge-loss model of rows (``grams`` between ``offsets``) by dual coordinate descent."""
    offsets = offsets - offsets[0]
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    values = ratios[grams]
    length = np.sqrt(np.bincount(owner, values * values, n))
    values = values / np.maximum(length, 1e-12)[owner]
    y = np.where(good, 1.0, -1.0)
    share = np.array([np.mean(~good), np.mean(good)])
    bound = settings.bound * 0.5 / np.maximum(share[good.astype(int)], 1e-9)  # both classes count alike
    square = np.bincount(owner, values * values, n) + 1.0  # with the bias
    alpha, weights, bias = np.zeros(n), np.zeros(len(ratios)), 0.0
    rng = np.random.default_rng(0)
    spans = [slice(a, b) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    for _ in range(settings.epochs):
        largest = 0.0
        for i in rng.permutation(n).tolist():
            own, value = grams[spans[i]], values[spans[i]]
            slope = y[i] * (weights[own] @ value + bias) - 1.0
            new = min(max(alpha[i] - slope / square[i], 0.0), bound[i])
            move = new - alpha[i]
            if move:
                alpha[i] = new
                weights[own] += move * y[i] * value
                bias += move * y[i]
                largest = max(largest, abs(move))
        if largest < settings.tolerance:
            break
    return Model(settings, ratios, weights, bias)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without the text, with a column ``quality_score`` (underscores in front if the name is taken)."""
    name = free_name(docs, "quality_score")
    at = docs.columns.index(text)
    rest = [i for i in range(len(docs.columns)) if i != at]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array(sent.value.score(batch.column(at)), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), scores], names=[*(batch.schema.names[i] for i in rest), name])

    return docs.mapInArrow(run, T.StructType([*(docs.schema.fields[i] for i in rest), T.StructField(name, T.DoubleType(), False)]))
