"""The quality classifier: features and descent against plain Python, and held-out labels."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidelake.llm import quality_classifier as q
from tidelake.llm import words

EDGE = [None, "", " \n", "word", "one two", "ÉÀ ç ü", "x" * 50_000, "a b c d e f g", "A, b! C? 4.5 A, b! C? 4.5", "zero\x00byte and\tmore"]


def one_by_one(text, buckets):
    data = np.frombuffer((text or "").encode(), np.uint8)
    return set(q.shown(data, np.array([0, len(data)]), buckets)[0].tolist())


def test_slices_show_what_single_texts_show():
    texts = EDGE + ["a b c a b c"] * 3 + EDGE
    data, offsets = b"".join((t or "").encode() for t in texts), np.append(0, np.cumsum([len((t or "").encode()) for t in texts]))
    grams, sizes = q.shown(np.frombuffer(data, np.uint8), offsets, 1 << 16)
    parts = np.split(grams, np.cumsum(sizes)[:-1])
    assert [set(p.tolist()) for p in parts] == [one_by_one(t, 1 << 16) for t in texts]
    assert all(len(set(p.tolist())) == len(p) for p in parts)


def test_repeated_words_show():
    plain, same = one_by_one("a b c d e f", 1 << 30), one_by_one("a a a a a a", 1 << 30)
    assert len(plain & same) < len(same)


def test_descent_ends_at_the_optimum():
    """At the end no weight can be better: the primal and dual objectives meet."""
    rng = np.random.default_rng(1)
    rows = [rng.choice(40, rng.integers(1, 12), replace=False) for _ in range(200)]
    good = np.array([(r < 15).sum() + rng.random() > (r > 25).sum() for r in rows])
    offsets, grams = np.append(0, np.cumsum([len(r) for r in rows])), np.concatenate(rows)
    counts = np.array([[sum(b in r and g == k for r, g in zip(rows, good)) for b in range(40)] for k in (0, 1)])
    ratios = np.log((counts[1] + 1) / (good.sum() + 2) / ((counts[0] + 1) / ((~good).sum() + 2)))
    model = q.descend(ratios, offsets, grams, good, q.Settings(buckets=40, epochs=3000, tolerance=1e-7))
    y = np.where(good, 1, -1)
    margin = model.margins(grams.astype(np.int32), np.diff(offsets))
    bound = 0.5 / np.where(good, good.mean(), (~good).mean())
    primal = 0.5 * (model.weights @ model.weights + model.bias**2) + (bound * np.maximum(0, 1 - y * margin)).sum()
    # Strong duality: dual = sum(alpha) - |w|^2 / 2, and sum(alpha) = |w|^2 + sum(bound * slack) at the optimum.
    x = np.zeros((200, 40))
    for k, r in enumerate(rows):
        x[k, r] = ratios[r] / np.sqrt((ratios[r] ** 2).sum())
    for _ in range(300):
        step = rng.normal(0, 1e-3, 41)
        w, b = model.weights + step[:40], model.bias + step[40]
        assert 0.5 * (w @ w + b * b) + (bound * np.maximum(0, 1 - y * (x @ w + b))).sum() >= primal - 1e-6


def labelled(spark, n=400):
    rng = random.Random(5)
    good = lambda: " ".join(rng.choice("the sea and old stone of light that was here".split()) for _ in range(rng.randint(5, 60)))
    bad = lambda: " ".join(rng.choice(("BUY!!", "now$$$", "click|", "the", "sea")) for _ in range(rng.randint(5, 60)))
    rows = [(k, good() if k % 3 else bad(), k % 3 > 0, "mine", "mine") for k in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, g boolean, quality_score string, score string").repartition(4)


def test_held_out(spark):
    docs = labelled(spark)
    labels = docs.select("doc_id", F.col("g").cast("int").alias("quality"))
    model = q.fit(docs, labels)
    out = q.score(docs, model)
    assert out.columns == ["doc_id", "g", "quality_score", "score", "_quality_score"]
    wrong = out.where(~q.in_training(F.col("doc_id"))).where((F.col("_quality_score") >= 0.5) != F.col("g"))
    assert wrong.count() <= 2


def test_labels_of_the_others_are_not_seen(spark):
    docs = labelled(spark, 200)
    labels = docs.select("doc_id", F.col("g").cast("int").alias("quality"))
    flipped = labels.withColumn("quality", F.when(q.in_training(F.col("doc_id")), F.col("quality")).otherwise(1 - F.col("quality")))
    a, b = q.fit(docs, labels), q.fit(docs, flipped)
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_bounds_are_kept(spark):
    docs = labelled(spark, 200)
    labels = docs.select("doc_id", F.col("g").cast("int").alias("quality"))
    full, fewer = q.fit(docs, labels), q.fit(docs, labels, q.Settings(max_values=600))
    assert np.array_equal(full.values, fewer.values) and not np.array_equal(full.weights, fewer.weights)


@pytest.mark.parametrize("kinds, expected", [((), 0.5), ((1,), 1 / (1 + np.exp(-2))), ((0,), 1 / (1 + np.exp(2))), ((None,), 0.5)])
def test_labels_of_one_kind(spark, kinds, expected):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(EDGE * 3)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, kinds[0]) for k in range(30)] if kinds else [], "doc_id long, quality int")
    scores = [r[0] for r in q.score(docs, q.fit(docs, labels)).select("quality_score").collect()]
    assert len(scores) == 30 and np.allclose(scores, expected)


def test_odd_texts_and_empty_tables(spark):
    rows = [(None if k == 3 else k, t) for k, t in enumerate(EDGE * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    model = q.fit(docs, labels)
    assert q.score(docs, model).where("quality_score between 0 and 1").count() == 40
    assert q.score(docs.limit(0), model).count() == 0
    assert q.score(docs.limit(0), q.fit(docs.limit(0), labels)).count() == 0


def test_very_long_text_is_read_whole():
    """A word far behind the first slice counts."""
    model = q.Model(q.Settings(buckets=1 << 16), np.ones(1 << 16), np.arange(1 << 16) / 1e4)
    base = "word " * 200_000
    a, b = model.score(pa.array([base, base + "end#"]))
    assert a != b and words.VISIBLE[ord("#")]
