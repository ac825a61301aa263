"""Toxicity: Levenshtein automata over a lexicon trie, weighed by their context.

The lexicon, a list of words and of word stems, is learned from labelled
documents: those that toxic documents have far more often than others.  It is a
trie.  An entry may be misspelled by one edit (``edits``; two letters that change
places are one), unless clean training documents have words that close to it: then
a near miss says nothing.  The Levenshtein automaton of a word with the trie as its
input, made deterministic, is one table from (state, character) to state.  All words
of a batch run through that table at once.

Each hit is weighed by a window of words around it: inside quotation marks, or
after a verb of reporting, it is a quotation and counts ``QUOTED`` of a hit; a
misspelled one counts ``NEAR`` of an exact one where kinds are added up.  A logistic
regression over these weighed counts and their density gives the score.

Fitting uses at most ``max_labels`` labelled documents, chosen by a hash of their
id; scoring covers all documents and whole texts.

Defined results: null and empty texts have no hits and get the score of a text
without any; very long texts are read whole; labels that are null are left out; without labels of both kinds
every score is 0; repeated rows give repeated results; columns of any name pass
through.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.llm.runtime import cut, free_name

RESULT = T.StructType([T.StructField("score", T.DoubleType(), False), T.StructField("n_hits", T.LongType(), False), T.StructField("n_quoted", T.LongType(), False), T.StructField("n_misspelled", T.LongType(), False)])

# Marks of quotation and verbs of reporting.
QUOTES = "\"“”„«»‹›"
REPORTING = "said says wrote writes quoted quote called calls reported claims claimed sagte schrieb nannte dit écrit appelle dijo escribió llamó".split()
#: Words on each side of a hit that belong to its window.
WINDOW = 6
#: What a hit in quotation, and a misspelled one, counts of a plain one.
QUOTED, NEAR = 0.2, 0.8


@dataclass(frozen=True)
class Settings:
    max_labels: int = 20_000
    #: Toxic documents of the sample that must have an entry, after so many different words.
    least_documents: int = 4
    least_contexts: int = 4
    least_ratio: float = 25.0
    #: Of stems that count as weak: ratio, and standard deviations above the expected number.
    weak_ratio: float = 4.0
    weak_sigmas: float = 6.0
    stem_lengths: tuple[int, ...] = (4, 5, 6, 7)
    #: Entries that may be misspelled: of so many letters, if no more than this share of clean documents has words so close.
    edit_length: int = 4
    edit_share: float = 0.001
    ridge: float = 0.05


@dataclass
class Lexicon:
    """Words, stems, stems that other texts have too, and the words and stems that may be misspelled."""

    words: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)
    weak: list[str] = field(default_factory=list)
    loose: set[str] = field(default_factory=set)


def codes_of(text: str) -> np.ndarray:
    """Code points of a text with A-Z lower-cased."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes + 32 * ((codes >= 0x41) & (codes <= 0x5A)).astype(np.uint32)


def _in_word(codes: np.ndarray) -> np.ndarray:
    return ((codes >= 0x30) & (codes <= 0x39)) | ((codes >= 0x61) & (codes <= 0x7A)) | (codes >= 0x80)


EXACT, INFLECTED, MISSPELLED, WEAK = 1, 2, 3, 4


class Automaton:
    """All words that are an entry of the lexicon, continue a stem, or are one edit from either, as one table.

    ``accept[state]`` says which (0: none); the table has a column for each letter and one for all others."""

    def __init__(self, lexicon: Lexicon, edits: int = 1):
        children: list[dict[str, int]] = [{}]
        ends: dict[int, str] = {}
        loose_below, loose_end = [bool(lexicon.loose)], set()
        for kind, entries in (("stem", lexicon.stems), ("word", lexicon.words), ("weak", lexicon.weak)):
            for entry in entries:
                node, loose = 0, kind != "weak" and entry in lexicon.loose
                for c in entry:
                    if c not in children[node]:
                        children[node][c] = len(children)
                        children.append({})
                        loose_below.append(False)
                    node = children[node][c]
                    loose_below[node] |= loose
                ends.setdefault(node, kind)
                if loose:
                    loose_end.add(node)
        letters = sorted({c for level in children for c in level})
        self.letter = np.array([ord(c) for c in letters], np.uint32)

        # Positions are (node, edits used); node -1 is past a stem, -2 past a weak one.  A third
        # item is the letter due next: of two that change places, the second has been read.
        def close(states: set) -> frozenset:
            todo, out = list(states), set(states)
            while todo:
                node, e, *due = todo.pop()
                if node < 0 or due:
                    continue
                if ends.get(node) == "stem" and (e == 0 or node in loose_end):
                    out.add((-1, e))
                if ends.get(node) == "weak" and e == 0:
                    out.add((-2, 0))
                if e < edits:
                    for child in children[node].values():  # a letter left out
                        if loose_below[child] and (child, e + 1) not in out:
                            out.add((child, e + 1))
                            todo.append((child, e + 1))
            return frozenset(out)

        def step(states: frozenset, c: str | None) -> frozenset:
            out = set()
            for node, e, *due in states:
                if node < 0:
                    out.add((node, e))
                    continue
                if due:
                    if c == due[0]:
                        out.add((node, e))
                    continue
                if c is not None and c in children[node]:
                    out.add((children[node][c], e))
                if e < edits and loose_below[node]:
                    out.add((node, e + 1))  # a letter put in
                    out.update((child, e + 1) for child in children[node].values() if loose_below[child])
                    out.update((children[child][c], e + 1, x) for x, child in children[node].items() if x != c and c in children[child] and loose_below[children[child][c]])
            return close(out)

        start = close({(0, 0)})
        index, queue, rows = {frozenset(): 0, start: 1}, [start], [[0] * (len(letters) + 1)]
        while queue:  # rows come in the order in which states were found, that of their indices
            states = queue.pop(0)
            row = []
            for c in [*letters, None]:
                to = step(states, c)
                if to not in index:
                    index[to] = len(index)
                    queue.append(to)
                row.append(index[to])
            rows.append(row)
        self.table = np.array(rows, np.int32)
        self.accept = np.zeros(len(index), np.int8)
        for states, k in index.items():
            whole = [x for x in states if len(x) == 2]
            if any(e == 0 and ends.get(n) == "word" for n, e in whole):
                self.accept[k] = EXACT
            elif (-1, 0) in states:
                self.accept[k] = INFLECTED
            elif (-2, 0) in states:
                self.accept[k] = WEAK
            elif any(e and (n == -1 or n in loose_end and ends[n] == "word") for n, e in whole):
                self.accept[k] = MISSPELLED

    def run(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Acceptance of each word of ``codes``."""
        at = np.searchsorted(self.letter, codes)
        at[at == len(self.letter)] = 0
        symbol = np.where(self.letter[at] == codes, at, len(self.letter)) if len(self.letter) else np.zeros(len(codes), np.int64)
        state = np.ones(len(starts), np.int32)
        alive, k = np.arange(len(starts)), 0
        lengths = ends - starts
        while len(alive):
            alive = alive[(lengths[alive] > k) & (state[alive] != 0)]
            state[alive] = self.table[state[alive], symbol[starts[alive] + k]]
            k += 1
        return self.accept[state]


#: Weights that features have without evidence: exact, inflected and misspelled hits,
#: density of all three, any, more than one, weak stems.
PRIOR = np.array([2.0, 2.0, 2.0, 0.5, 1.5, 0.5, 0.5])


class Model:
    """Lexicon, its automaton, and the weights of the score."""

    def __init__(self, lexicon: Lexicon, weights: np.ndarray | None = None):
        self.lexicon, self.weights = lexicon, weights
        self.automaton = Automaton(lexicon)

    def features(self, text: str | None) -> tuple[np.ndarray, int, int, int]:
        """Features of the score; hits, of those in quotation, of those misspelled."""
        none = np.zeros(len(PRIOR))
        codes = codes_of(text or "")
        inside = _in_word(codes)
        edges = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        if not len(starts):
            return none, 0, 0, 0
        kind = self.automaton.run(codes, starts, ends)
        hits = np.flatnonzero(kind)
        if not len(hits):
            return none, 0, 0, 0
        marks = np.isin(codes, [ord(c) for c in QUOTES])
        before = np.concatenate([[0], np.cumsum(marks)])
        lines = np.concatenate([[0], np.cumsum(codes == 0x0A)])
        quoted = np.zeros(len(hits), bool)
        for k, w in enumerate(hits.tolist()):
            a, b = max(w - WINDOW, 0), min(w + WINDOW, len(starts) - 1)
            # Quotation marks on both sides of the hit within its window and line.
            left = np.flatnonzero(marks[starts[a] - (starts[a] > 0) : starts[w]])
            right = np.flatnonzero(marks[ends[w] : ends[b] + 1])
            both = len(left) and len(right) and lines[starts[w]] == lines[starts[a] - (starts[a] > 0) + left[-1]] == lines[ends[w] + right[0]]
            line_start = np.searchsorted(lines, lines[starts[w]], "left") - (lines[starts[w]] > 0)
            odd = (before[starts[w]] - before[max(line_start, 0)]) % 2 == 1
            near = {"".join(map(chr, codes[starts[j] : ends[j]])) for j in range(a, w) if lines[starts[j]] == lines[starts[w]]}
            quoted[k] = bool(both and odd) or any(r in near for r in REPORTING)
        kinds = kind[hits]
        count = np.bincount(kinds, np.where(quoted, QUOTED, 1.0), WEAK + 1)
        sure = count[EXACT] + count[INFLECTED] + NEAR * count[MISSPELLED]
        density = 100 * sure / len(starts)
        values = np.array([*np.log1p(count[[EXACT, INFLECTED, MISSPELLED]]), min(density, 10) / 5, min(sure, 1), min(max(sure - 1, 0), 1), np.log1p(count[WEAK])])
        return values, len(hits), int(quoted.sum()), int(np.sum(kinds == MISSPELLED))

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(features))
        z = features @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Logistic regression by Newton's method; features count for, not against, toxicity."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    prior = np.append(PRIOR, 0.0)
    active = np.ones(x.shape[1], bool)
    w = np.zeros(x.shape[1])
    for _ in range(4):  # features that come out negative are left out and the rest fitted again
        w[:] = 0
        for _ in range(40):
            z = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            gradient = x.T @ (z - y) + penalty * (w - prior)
            hessian = (x * (z * (1 - z))[:, None]).T @ x + np.diag(penalty)
            move = np.zeros_like(w)
            move[active] = np.linalg.solve(hessian[np.ix_(active, active)], gradient[active])
            w -= np.clip(move, -5, 5)
            if np.abs(move).max() < 1e-6:
                break
        negative = active & (w < 0)
        negative[-1] = False
        if not negative.any():
            break
        active &= ~negative
        w[~active] = 0
    return w


def in_training(doc_id: Column) -> Column:
    """Rows from which labels may be learned."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def _word_counts(sample: DataFrame, settings: Settings) -> DataFrame:
    """How many toxic and other documents of the sample have each word and each stem, and
    (as bits, by a hash) which words stand before it in toxic ones."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[bool, str], list[int]] = defaultdict(lambda: [0, 0, 0])
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes = codes_of(text or "")
                codes = np.where(_in_word(codes), codes, 0x20).astype("<u4")
                words = codes.tobytes().decode("utf-32-le", "surrogatepass").split()
                before: dict[str, int] = dict.fromkeys(words, 0)
                if toxic:
                    for last, w in zip(["", *words], words):
                        before[w] |= 1 << zlib.crc32(last.encode("utf-8", "surrogatepass")) % 62
                stems: dict[str, int] = {}
                for w, bits in before.items():
                    for n in settings.stem_lengths:
                        if len(w) > n:
                            stems[w[:n]] = stems.get(w[:n], 0) | bits
                for entries, stem in ((before, False), (stems, True)):
                    for w, bits in entries.items():
                        c = counts[stem, w]
                        c[toxic] += 1
                        c[2] |= bits
        keys = list(counts)
        yield pa.RecordBatch.from_pydict({"stem": pa.array([k[0] for k in keys], pa.bool_()), "entry": pa.array([k[1] for k in keys], pa.string()), **{c: pa.array([counts[k][i] for k in keys], pa.int64()) for c, i in (("toxic", 1), ("other", 0), ("before", 2))}})

    parts = sample.select("text", "toxic").mapInArrow(count, "stem boolean, entry string, toxic long, other long, before long")
    return parts.groupBy("stem", "entry").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"), F.bit_count(F.bit_or("before")).alias("contexts"))


def one_edit(a: str, b: str) -> bool:
    """Are the words one edit or less apart, two letters that change places counting as one?"""
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    if len(a) < len(b):
        return len(b) - len(a) == 1 and a[k:] == b[k + 1 :]
    return a[k + 1 :] == b[k + 1 :] or a[k : k + 2] == b[k : k + 2][::-1] and a[k + 2 :] == b[k + 2 :]


def _near_misses(counts: DataFrame, words: list[str], stems: list[str]) -> dict[tuple[bool, str], int]:
    """For each entry, how many times clean documents of the sample have a word that misspells it."""
    index: dict[str, set[tuple[bool, str]]] = defaultdict(set)
    for stem, entries in ((False, words), (True, stems)):
        for e in entries:
            for form in (e, *(e[:k] + e[k + 1 :] for k in range(len(e)))):
                index[form].add((stem, e))

    longest = max(map(len, words), default=0) + 1  # of words that any entry may be one edit from

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[bool, str], int] = defaultdict(int)
            for word, other in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                # A stem is held against the beginnings of the word, a word against all of it.
                near: set[tuple[bool, str]] = set()
                for end in range(3, min(len(word), 9) + 1):
                    part = word[:end]
                    for form in (part, *(part[:k] + part[k + 1 :] for k in range(end))):
                        near.update((s, e) for s, e in index.get(form, ()) if s and one_edit(part, e))
                for form in (word, *(word[:k] + word[k + 1 :] for k in range(len(word) if len(word) <= longest else 0))):
                    near.update((s, e) for s, e in index.get(form, ()) if not s and e != word and one_edit(word, e))
                for s, e in near:
                    if not (s and word.startswith(e)):
                        found[s, e] += other
            yield pa.RecordBatch.from_pydict({"stem": pa.array([k[0] for k in found], pa.bool_()), "entry": pa.array([k[1] for k in found], pa.string()), "n": pa.array(list(found.values()), pa.int64())})

    rows = counts.where("not stem and other > 0").select("entry", "other").mapInArrow(run, "stem boolean, entry string, n long").groupBy("stem", "entry").agg(F.sum("n").alias("n")).collect()
    return {(r["stem"], r["entry"]): r["n"] for r in rows}


def learn_lexicon(sample: DataFrame, toxic: int, other: int, settings: Settings) -> Lexicon:
    """Words and stems that toxic documents have ``least_ratio`` times as often as others, in enough of them
    and in several contexts (a group of copies would make any of its words look toxic)."""
    ratio = ((F.col("toxic") + 0.5) / (toxic + 1)) / ((F.col("other") + 0.5) / (other + 1))
    share = toxic / (toxic + other)
    expected = share * (F.col("toxic") + F.col("other"))
    sigmas = (F.col("toxic") - expected) / F.sqrt(expected * (1 - share))
    weak = F.col("stem") & (F.col("ratio") >= settings.weak_ratio) & (sigmas >= settings.weak_sigmas)
    counts = cut(_word_counts(sample, settings))
    found = counts.where((F.col("toxic") >= settings.least_documents) & (F.col("contexts") >= settings.least_contexts)).withColumn("ratio", ratio)
    # As many as the test admits; the bound on labelled documents bounds them.
    rows = found.where((F.col("ratio") >= settings.least_ratio) | weak).select("stem", "entry", "toxic", "ratio").collect()
    count = {(r["stem"], r["entry"]): r["toxic"] for r in rows}
    sure = {(r["stem"], r["entry"]) for r in rows if r["ratio"] >= settings.least_ratio}
    stems: list[str] = []
    for entry in sorted((e for stem, e in sure if stem), key=lambda e: (len(e), e)):
        forms = [count[False, w] for s, w in sure if not s and w.startswith(entry)]
        # A stem gathers forms: one word alone stays a word.
        if not any(entry.startswith(s) for s in stems) and count[True, entry] > max(settings.least_documents, 1.2 * max(forms, default=0)):
            stems.append(entry)
    stems = sorted(stems, key=lambda e: (-count[True, e], e))
    words = sorted((e for stem, e in sure if not stem and not any(e.startswith(s) for s in stems)), key=lambda e: (-count[False, e], e))
    weak_stems = sorted((e for (stem, e) in count if stem and (stem, e) not in sure), key=lambda e: (len(e), e))
    shortest: list[str] = []
    for e in weak_stems:
        if not any(e.startswith(s) for s in (*stems, *shortest)):
            shortest.append(e)
    tried = [e for e in words if len(e) >= settings.edit_length], [e for e in stems if len(e) >= settings.edit_length]
    misses = _near_misses(counts, *tried)
    loose = {e for stem, entries in zip((False, True), tried) for e in entries if misses.get((stem, e), 0) <= settings.edit_share * other}
    return Lexicon(words, stems, sorted(shortest, key=lambda e: (-count[True, e], e)), loose)


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from labelled rows whose id ``in_training`` admits."""
    usable = labels.where(in_training(F.col(doc_id)) & F.col(label).isin(0, 1)).select(F.col(doc_id).alias("id"), (F.col(label) == 1).cast("int").alias("toxic"))
    # The bound on labelled rows also bounds what is broadcast.
    usable = F.broadcast(usable.orderBy(F.xxhash64("id"), "id").limit(settings.max_labels))
    sample = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(usable, "id")
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return Model(Lexicon())
    lexicon = learn_lexicon(sample, sizes[1], sizes[0], settings)
    model = Model(lexicon)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [sent.value.features(t)[0].tolist() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"x": pa.array(rows, pa.list_(pa.float64())), "toxic": batch.column(1)})

    rows = sample.select("text", "toxic").mapInArrow(features, "x array<double>, toxic int").groupBy("x", "toxic").count().collect()
    x, y, n = np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows], float), np.array([r["count"] for r in rows])
    model.weights = _fit(np.repeat(x, n, axis=0), np.repeat(y, n), settings.ridge)
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without the text, with a struct column ``toxicity`` (underscores in front if the name is taken)."""
    name = free_name(docs, "toxicity")
    at = docs.columns.index(text)
    rest = [i for i in range(len(docs.columns)) if i != at]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [sent.value.features(t) for t in batch.column(at).to_pylist()]
            scores = sent.value.score(np.array([r[0] for r in rows]).reshape(len(rows), len(PRIOR)))
            columns = [pa.array(scores, pa.float64()), *(pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2, 3))]
            out = pa.StructArray.from_arrays(columns, fields=[pa.field(f.name, c.type, False) for f, c in zip(RESULT, columns)])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), out], names=[*(batch.schema.names[i] for i in rest), name])

    return docs.mapInArrow(run, T.StructType([*(docs.schema.fields[i] for i in rest), T.StructField(name, RESULT, False)]))
