"""Quality rules: counts per document and divergence from language references.

Two passes over the texts.  The first adds up, over all documents, one
histogram of character classes and one of common words per language.  The
second takes the counts of each document and the Jensen-Shannon distance of its
two histograms from those of its language.

A short text differs from any reference by chance alone, so a distance counts
only in texts of ``min_words`` words or more, and the limit rises by the
distance that sampling noise of that length would give.

Defined results: a null or empty text has no words and fails the base rule; a
null language is a language of its own (the pooled one if small); languages with
fewer than ``min_reference_words`` words in the corpus, too few for a histogram, are
held against the pooled one of all documents; any number of languages has its own;
very long texts are measured whole; repeated rows give repeated results; columns
of any name pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.llm import words as W
from tidelake.llm.runtime import cut, free_name

# Frequent function words of English, German, French and Spanish,
# the bins of the common-word histogram.
COMMON = (
    "the of and to in is that it was for with as on be at by this from or an are not but have "
    "der die das und zu den mit von ist ein eine auf für im nicht dem des sich auch als "
    "le la les et un une est que qui pour dans par sur pas au du avec en ne plus "
    "el los las del y al por con se lo su como más o sus es"
).split()
SYMBOLS = b"#*$%&|<>"

FEATURES = T.StructType(
    [T.StructField(c, T.LongType(), False) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType(), False), T.StructField("char_distance", T.DoubleType()), T.StructField("word_distance", T.DoubleType()), T.StructField("kept", T.BooleanType(), False)]
)


@dataclass(frozen=True)
class Rules:
    """Limits of the rules; the defaults are the production values."""

    min_words: int = 50
    char_limit: float = 0.20
    word_limit: float = 0.24
    min_reference_words: int = 5_000


def _classes() -> np.ndarray:
    """Character class of each leading byte; continuation bytes have class 0."""
    out = np.zeros(256, np.int64)
    out[0x21:0x7F] = 1  # other punctuation
    out[0x61:0x7B] = 2
    out[0x41:0x5B] = 3
    out[0x30:0x3A] = 4
    out[[0x20, *range(0x09, 0x0E)]] = 5
    out[list(b".,;:!?'\"()-")] = 6
    out[list(SYMBOLS)] = 7
    out[0xC2:0xC4] = 8  # Latin-1 letters and signs
    out[0xC4:0xE0] = 9
    out[0xE0:0xF0] = 10
    out[0xF0:] = 11
    return out


CLASS = _classes()
N_CLASS = 12
_CONT = (np.arange(256) & 0xC0) == 0x80
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))


def _common() -> np.ndarray:
    raw = [w.encode() for w in dict.fromkeys(COMMON)]
    ends = np.cumsum([len(r) for r in raw])
    return W.span_hash(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], ends[:-1]]), ends)


N_BINS = len(set(COMMON)) + 1


def _prefix(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=out[1:])
    return out


def histograms(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts per text of the character classes and of the common words (last bin: any other)."""
    docs = len(offsets) - 1
    of = np.repeat(np.arange(docs), np.diff(offsets))
    chars = np.bincount(of * N_CLASS + CLASS[data], minlength=docs * N_CLASS).reshape(docs, N_CLASS)
    chars[:, 0] = 0
    known = _common()
    order = np.argsort(known)
    hashes = W.span_hash(W.LOWER[data], starts, ends)
    at = np.minimum(np.searchsorted(known[order], hashes), len(known) - 1)
    bins = np.where(known[order][at] == hashes, at, len(known))
    of = np.repeat(np.arange(docs), np.diff(first))
    return chars, np.bincount(of * N_BINS + bins, minlength=docs * N_BINS).reshape(docs, N_BINS)


def distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, 0 to 1) of each row of counts from its row of ``reference``; 0 for empty rows."""
    total, whole = counts.sum(1, keepdims=True), reference.sum(1, keepdims=True)
    p, q = counts / np.maximum(total, 1), reference / np.maximum(whole, 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = np.where(p > 0, p * np.log2(p / m), 0).sum(1) + np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.where((total[:, 0] > 0) & (whole[:, 0] > 0), np.sqrt(np.clip(kl / 2, 0, 1)), 0.0)


def _perplexity(counts: np.ndarray) -> np.ndarray:
    """Number of bins that each row of counts uses in effect."""
    p = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.exp2(-np.where(p > 0, p * np.log2(p), 0).sum(1))


def _duplicate_lines(data: np.ndarray, offsets: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Per text, lines that have a word and equal an earlier line of the text."""
    docs = len(offsets) - 1
    if not len(data):
        return np.zeros(docs, np.int64)
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data))
    ends = np.where(data[ends - 1] == 0x0A, ends - 1, ends)
    sums = _prefix(filled)
    wordy = sums[ends] > sums[starts]
    starts, ends = starts[wordy], ends[wordy]
    of = np.searchsorted(offsets, starts, "right") - 1
    hashes = W.span_hash(data, starts, ends)
    order = np.lexsort((starts, hashes, of))
    same = (of[order][1:] == of[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
    twin = order[1:][same], order[:-1][same]
    equal = np.fromiter((data[starts[a] : ends[a]].tobytes() == data[starts[b] : ends[b]].tobytes() for a, b in zip(*twin)), bool, len(twin[0]))
    return np.bincount(of[twin[0]][equal], minlength=docs)


def _repeated_words(hashes: np.ndarray, first: np.ndarray, size: int = 8) -> np.ndarray:
    """Per text, words inside windows of ``size`` words that the text has twice or more."""
    docs = len(first) - 1
    total = int(first[-1])
    keys = W.window_hash(hashes, size)
    if not len(keys):
        return np.zeros(docs, np.int64)
    of = np.repeat(np.arange(docs, dtype=np.uint64), np.diff(first))[: len(keys)]
    inside = W.within(first, size)
    keys = W.mix(keys + of * np.uint64(0x9E3779B97F4A7C15))
    ordered = np.sort(keys[inside])
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(docs, np.int64)
    at = np.flatnonzero(inside & np.isin(keys, twice))
    step = np.zeros(total + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + size, -1)
    covered = _prefix(np.cumsum(step)[:total] > 0)
    return covered[first[1:]] - covered[first[:-1]]


def _measure(column: pa.Array, references: list[np.ndarray], rules: Rules) -> pa.Array:
    """Features of each text, held against the reference (both histograms in a row) of its place."""
    parts: dict[str, list] = {f.name: [] for f in FEATURES}
    for i, data, offsets in W.slices(column):
        docs = len(offsets) - 1
        starts, ends, first = W.spans(data, offsets, W.VISIBLE)
        n_words = np.diff(first)
        filled = W.VISIBLE[data]
        per = lambda flags: np.diff(_prefix(flags)[offsets])  # noqa: E731, B023
        repeated = _repeated_words(W.span_hash(data, starts, ends), first)
        failed = (n_words < 20) | (100 * repeated > 30 * n_words)
        chars, common = histograms(data, offsets, starts, ends, first)
        refs, far = np.array(references[i : i + docs]), []
        for reference, counts, limit in ((refs[:, :N_CLASS], chars, rules.char_limit), (refs[:, N_CLASS:], common, rules.word_limit)):
            d = distance(counts, reference)
            noise = np.sqrt((_perplexity(reference) - 1) / (8 * np.log(2) * np.maximum(counts.sum(1), 1)))
            far.append((d, d > limit + noise))
        long = n_words >= rules.min_words
        rows = {
            "n_words": n_words, "word_chars": per(filled & ~_CONT[data]), "n_symbols": per(_SYMBOL[data]),
            "n_dup_lines": _duplicate_lines(data, offsets, filled), "n_repeat_words": repeated, "base_failed": failed,
            "char_distance": far[0][0], "word_distance": far[1][0], "kept": ~failed & ~(long & (far[0][1] | far[1][1])),
        }
        for k, v in rows.items():
            parts[k].append(v)
    types = pa.struct([(f.name, {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[f.dataType.simpleString().replace("bigint", "long")]) for f in FEATURES])
    joined = {k: np.concatenate(v) if v else np.empty(0) for k, v in parts.items()}
    return pa.StructArray.from_arrays([pa.array(joined[f.name]).cast(f.type) for f in types], fields=list(types))


def _key(lang: str | None) -> str:
    return "\x00" if lang is None else f"={lang}"


@dataclass(frozen=True)
class References:
    """The pooled histograms of the corpus, and a table ``(lang, counts)`` of those of every language with enough words."""

    pooled: list[float]
    by_lang: DataFrame


def references(docs: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str = "lang") -> References:
    """Histograms of the corpus per language, and of all of it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = [_key(x) for x in batch.column(1).to_pylist()]
            for i, data, offsets in W.slices(batch.column(0)):
                both = np.hstack(histograms(data, offsets, *W.spans(data, offsets, W.VISIBLE)))
                codes = {}
                of = np.array([codes.setdefault(x, len(codes)) for x in langs[i : i + len(both)]])
                grouped = np.zeros((len(codes), both.shape[1]), np.int64)
                np.add.at(grouped, of, both)
                for key, k in codes.items():
                    sums[key] = sums.get(key, 0) + grouped[k]
            if len(sums) > 10_000:  # more go out before they fill memory
                yield _rows(sums)
                sums = {}
        if sums:
            yield _rows(sums)

    def _rows(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"lang": list(sums), "counts": [v.tolist() for v in sums.values()]}, schema=pa.schema([("lang", pa.string()), ("counts", pa.list_(pa.int64()))]))

    width = N_CLASS + N_BINS
    parts = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).mapInArrow(count, "lang string, counts array<long>")
    totals = [F.sum(F.element_at("counts", k + 1)).alias(f"c{k}") for k in range(width)]
    n = sum((F.col(f"c{k}") for k in range(N_CLASS, width)), F.lit(0))
    by_lang = cut(parts.groupBy("lang").agg(*totals))
    pooled = np.nan_to_num(np.array(by_lang.agg(*[F.sum(f"c{k}") for k in range(width)]).first(), dtype=float))
    large = by_lang.where(n >= rules.min_reference_words).select("lang", F.array(*(F.col(f"c{k}").cast("double") for k in range(width))).alias("counts"))
    return References(pooled.tolist(), cut(large))


def score(docs: DataFrame, refs: References, rules: Rules = Rules(), text: str = "text", lang: str = "lang", max_sent: int = 1_000) -> DataFrame:
    """``docs`` with a struct column ``quality`` (underscores in front if the name is taken).

    References of up to ``max_sent`` languages go to all tasks; more are joined to the rows.  Results are the same."""
    name = free_name(docs, "quality")
    at_text, at_lang = docs.columns.index(text), docs.columns.index(lang)
    pooled = np.array(refs.pooled)
    few = refs.by_lang.count() <= max_sent
    sent = {r["lang"]: np.array(r["counts"]) for r in refs.by_lang.collect()} if few else {}
    rows = docs
    if not few:
        key, counts = free_name(docs, "lang_key"), free_name(docs, "lang_counts")
        value = F.col(lang).cast("string")
        keyed = docs.withColumn(key, F.when(value.isNull(), F.lit("\x00")).otherwise(F.concat(F.lit("="), value)))
        rows = keyed.join(refs.by_lang.select(F.col("lang").alias(key), F.col("counts").alias(counts)), key, "left").select(*docs.columns, counts)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if few:
                own = [sent.get(_key(x), pooled) for x in batch.column(at_lang).cast(pa.string()).to_pylist()]
            else:
                own = [pooled if x is None else np.array(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            columns, names = batch.columns[: len(docs_columns)], docs_columns
            yield pa.RecordBatch.from_arrays([*columns, _measure(batch.column(at_text), own, rules)], names=[*names, name])

    docs_columns = docs.columns
    return rows.mapInArrow(measure, T.StructType([*docs.schema.fields, T.StructField(name, FEATURES)]))


def keep_good(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that pass, with their own columns."""
    name = free_name(docs, "quality")
    return score(docs, references(docs, rules), rules).where(F.col(f"{name}.kept")).select(*docs.columns)
