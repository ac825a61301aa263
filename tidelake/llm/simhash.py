"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints come from one pass over the texts.  All further work is on the
distinct fingerprints.  To find those at most ``radius`` bits apart, the 64 bits
are cut into parts of bits that agree more often than chance, and each part i
gets a threshold t_i (possibly -1: not probed) with sum(t_i + 1) = radius + 1.
Two fingerprints that differ in more than t_i bits in every part i would differ
in radius + 1 bits at least, so probing each part up to its threshold loses
nothing.  Dynamic programming picks the thresholds with the fewest expected
probes and candidates, and the number of parts likewise, so large corpora get
few long parts and small ones many short parts.

A bucket with more than ``bucket_limit`` fingerprints would emit a square of
pairs.  Its fingerprints go another exact way: each is listed under itself and
its 64 one-bit neighbours.  At radius 2 two fingerprints are linked exactly if
they meet under a common neighbour, and at most 65 distinct ones can.

Defined results: null and empty texts and those without words have fingerprint
zero and are linked like any other; a null id never is the smallest; repeated
rows give repeated results; an empty table gives an empty result; ``cluster`` leaves
other columns out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.llm import words as W
from tidelake.llm.components import components
from tidelake.llm.runtime import cut, discard, free_name, joinable, stored_at

SEED = 42
BITS = 64
#: Fingerprints link at this many differing bits or fewer.
RADIUS = 2


def _shingles(column: pa.Array, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of texts: shingles of each, where they begin (one more), their hashes, and fingerprints."""
    digest = xxhash.xxh64_intdigest
    for _, data, offsets in W.slices(column):
        starts, ends, first = W.spans(data, offsets, W.VISIBLE)
        counts = np.diff(first)
        fps = np.zeros(len(counts), np.uint64)
        shingles = np.maximum(counts - size + 1, (counts > 0).astype(np.int64))
        base = np.concatenate([[0], np.cumsum(shingles)])
        hashes = np.empty(0, "<u8")
        if len(starts):
            # The words of each text with one space between them.
            kept = W.VISIBLE[data]
            last = np.zeros(len(starts), bool)
            last[first[1:][counts > 0] - 1] = True
            gaps = ends[~last]
            lowered = W.LOWER[data]
            lowered[gaps] = 0x20
            kept[gaps] = True
            joined = lowered[kept].tobytes()
            shift = np.cumsum(kept) - 1
            starts, ends = shift[starts], shift[ends - 1] + 1
            of = np.repeat(np.arange(len(counts)), shingles)
            at = first[:-1][of] + np.arange(base[-1]) - base[:-1][of]
            to = np.minimum(at + size, first[1:][of]) - 1
            hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at].tolist(), ends[to].tolist())], dtype="<u8")
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            some = counts > 0
            sums = np.add.reduceat(bits, base[:-1][some], axis=0, dtype=np.int32)
            ones = (2 * sums > shingles[some][:, None]).astype(np.uint8)
            fps[some] = np.packbits(ones, axis=1, bitorder="little").view("<u8")[:, 0]
        yield shingles, base, hashes, fps


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of few texts."""
    return (whole.slice(k, TEXTS_A_BATCH) for whole in batches for k in range(0, whole.num_rows, TEXTS_A_BATCH))


def _fingerprints(column: pa.Array, size: int) -> np.ndarray:
    return np.concatenate([np.empty(0, np.uint64), *(fps for *_, fps in _shingles(column, size))])


def fingerprints(docs: DataFrame, size: int = 3, text: str = "text") -> DataFrame:
    """``docs`` without the text, with its fingerprint (a signed long in column ``fingerprint``)."""
    name = free_name(docs, "fingerprint")
    at = docs.columns.index(text)
    rest = [i for i in range(len(docs.columns)) if i != at]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array(_fingerprints(batch.column(at), size).view(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), fps], names=[*(batch.schema.names[i] for i in rest), name])

    fields = [docs.schema.fields[i] for i in rest]
    return docs.mapInArrow(add, T.StructType([*fields, T.StructField(name, T.LongType(), False)]))


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have both bits i and j set (64 x 64)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view("<u8")
            bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += bits.T @ bits
            n += len(values)
        counts = np.append(both.ravel(), n).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(np.arange(len(counts))), "n": pa.array(counts)})

    rows = fps.select("fp").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(BITS * BITS + 1)
    for cell, n in rows:
        counts[cell] = n
    return int(counts[-1]), counts[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """The 64 bits in ``parts`` groups: the most correlated pairs first, while a group has room."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.outer(p * (1 - p), p * (1 - p)))
    with np.errstate(divide="ignore", invalid="ignore"):
        strength = np.nan_to_num(np.abs((both / max(n, 1) - np.outer(p, p)) / spread))
    room = -(-BITS // parts)
    group = {b: [b] for b in range(BITS)}
    for a, b in sorted(combinations(range(BITS), 2), key=lambda x: -strength[x]):
        if group[a] is not group[b] and len(group[a]) + len(group[b]) <= room:
            merged = group[a] + group[b]
            group.update(dict.fromkeys(merged, merged))
    blocks = sorted({id(g): g for g in group.values()}.values(), key=len, reverse=True)
    out: list[list[int]] = [[] for _ in range(parts)]
    for block in blocks:
        for bit in block:  # a block stays together where a part has room for it
            fits = [g for g in out if len(g) + len(block) <= room] or [g for g in out if len(g) < room]
            target = next((g for g in out if g and g[-1] in block and len(g) < room), None) or min(fits, key=len)
            target.append(bit)
    return [sorted(g) for g in out if g]


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


def allocate(costs: list[list[float]], radius: int) -> tuple[float, list[int]]:
    """Thresholds, -1 or more for each part, with sum(t + 1) = radius + 1 and the
    least total cost; ``costs[i][t + 1]`` is the cost of threshold t in part i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (total, chosen) in best.items():
            for take in range(min(len(cost), radius + 2 - spent)):
                new = (total + cost[take], [*chosen, take - 1])
                if spent + take not in step or new[0] < step[spent + take][0]:
                    step[spent + take] = new
        best = step
    return best[radius + 1]


def plan(fps: DataFrame, most_parts: int = 3) -> list[tuple[list[int], int]]:
    """Parts of bits and their thresholds, the cheapest over all numbers of parts."""
    n, both = bit_statistics(fps)
    if not n:
        return []
    layouts = [group_bits(n, both, k) for k in range(1, most_parts + 1)]
    flat = [g for layout in layouts for g in layout]
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_mask(g))).alias("key")) for i, g in enumerate(flat)])).alias("k")
    sizes = fps.select(keys).groupBy("k.part", "k.key").agg(F.count("*").cast("double").alias("n"))
    same = {r["part"]: r["pairs"] for r in sizes.groupBy("part").agg(F.sum(F.col("n") * F.col("n")).alias("pairs")).collect()}
    p = np.diag(both) / n
    q = np.clip(2 * p * (1 - p), 0, 0.5)
    odds = q / (1 - q)
    options = []
    at = 0
    for layout in layouts:
        costs = []
        for g in layout:
            r = odds[g]
            balls = [1.0, 1 + r.sum(), 1 + r.sum() + (r.sum() ** 2 - (r**2).sum()) / 2]
            probes = [1, 1 + len(g), 1 + len(g) + len(g) * (len(g) - 1) / 2]
            costs.append([0.0, *(n * probes[t] + same[at] * balls[t] for t in range(RADIUS + 1))])
            at += 1
        options.append((*allocate(costs, RADIUS), layout))
    _, thresholds, layout = min(options, key=lambda x: x[0])
    return [(g, t) for g, t in zip(layout, thresholds) if t >= 0]


def _keys(parts: list[tuple[list[int], int]], variants: bool) -> F.Column:
    """One struct (part, key) for each key under which a fingerprint is stored, or looked up."""
    out = []
    for i, (bits, t) in enumerate(parts):
        own = F.col("fp").bitwiseAND(F.lit(_mask(bits)))
        keys = [own]
        if variants and t >= 1:
            keys += [own.bitwiseXOR(F.lit(_mask([b]))) for b in bits]
        if variants and t >= 2:
            keys += [own.bitwiseXOR(F.lit(_mask([a, b]))) for a, b in combinations(bits, 2)]
        out.append(F.transform(F.array(*keys), lambda k, i=i: F.struct(F.lit(i).alias("part"), k.alias("key"))))
    return F.explode(F.concat(*out)).alias("k")


def links(fps: DataFrame, bucket_limit: int = 256) -> DataFrame:
    """Links ``(a, b)`` that join exactly the distinct ``fps(fp)`` at most 2 bits apart.

    Between members of an overfull bucket, links lead to one of the meeting
    fingerprints instead of to each; what they connect is the same."""
    spark = fps.sparkSession
    parts = plan(fps)
    if not parts:
        return spark.createDataFrame([], "a long, b long")
    stored = fps.select("fp", _keys(parts, False)).select("fp", "k.part", "k.key")
    probes = fps.select("fp", _keys(parts, True)).select("fp", "k.part", "k.key")
    hot = joinable(stored.groupBy("part", "key").count().where(F.col("count") > bucket_limit).select("part", "key"))
    a, b = probes.join(hot, ["part", "key"], "left_anti"), stored.withColumnRenamed("fp", "other")
    pairs = a.join(b, ["part", "key"]).where((F.col("fp") != F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= RADIUS))
    pairs = pairs.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b")).distinct()
    crowd = probes.join(hot, ["part", "key"], "left_semi").select("fp").distinct()
    return pairs.unionByName(_through_neighbours(crowd))


def _through_neighbours(fps: DataFrame) -> DataFrame:
    """Links among ``fps`` that join those at most 2 bits apart: each is listed
    under itself and its 64 one-bit neighbours and linked to the first listed there."""
    around = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(_mask([b]))) for b in range(BITS)))
    listed = fps.select("fp", F.explode(around).alias("spot"))
    met = listed.select("fp", F.min("fp").over(Window.partitionBy("spot")).alias("first"))
    return met.where("fp <> first").select(F.greatest("fp", "first").alias("a"), F.least("fp", "first").alias("b")).distinct()


def cluster(docs: DataFrame, size: int = 3, doc_id: str = "doc_id", text: str = "text", bucket_limit: int = 256) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for each row: the fingerprint as a
    signed long, and the smallest id that links reach (its own included)."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = cut(fingerprints(slim, size))
    fps = cut(rows.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("first")))
    found = components(links(fps.select("fp"), bucket_limit))
    known = fps.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    known = cut(known)
    smallest = known.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = known.join(smallest, "root").select(F.col("fp").alias("fingerprint"), "component_id")
    return rows.join(by_fp, "fingerprint", "left").select("doc_id", "fingerprint", "component_id")


def hex_digits(fingerprint: F.Column) -> F.Column:
    """16 lowercase hexadecimal digits of a signed long."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def _distinct(counts: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text: the text of each, in ascending order, and its hash."""
    of = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, of))
    of, hashes = of[order], hashes[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1])
    return of[new], hashes[new]


#: Cells that shingles are counted in, by the last bits of their hashes, and how many of them are a row.
CELLS, CELLS_A_ROW = 1 << 23, 1 << 9
#: Rows of counts that a task hands on at once (1 MB), and texts that one works on at once.
ROWS_A_BATCH, TEXTS_A_BATCH = 1 << 10, 500
#: Texts after which a task's counts are handed on: none is above what two bytes hold.
MOST_TEXTS = (1 << 16) - 1


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(CELLS - 1)).astype(np.int64)


def common_shingles(docs: DataFrame, size: int, share: float = 1.5e-4, least: int = 3, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Cells whose shingles a ``share`` of all texts have, and ``least`` texts at least, sorted, and in how many they are.

    Every shingle of every text is counted, in its cell; so a cell's count is that of its shingle, or more if rare ones
    fall there too.  A task counts its texts in one array and only arrays are shuffled, not shingles.  Counts only order
    ``sketches``: ``most`` cells, those of most texts, are held by each task."""
    needed = max(float(least), share * docs.count())

    def rows(table: np.ndarray) -> Iterator[pa.RecordBatch]:
        width, parts = 2 * CELLS_A_ROW, table.reshape(-1, CELLS_A_ROW)
        for k in range(0, len(parts), ROWS_A_BATCH):  # never a second copy of the whole array, nor one batch of it
            used = np.flatnonzero(parts[k : k + ROWS_A_BATCH].any(axis=1))
            offsets = pa.py_buffer(np.arange(0, (len(used) + 1) * width, width, dtype=np.int32))
            counts = pa.Array.from_buffers(pa.binary(), len(used), [None, offsets, pa.py_buffer(parts[k + used])])
            yield pa.RecordBatch.from_arrays([pa.array(k + used, pa.int64()), counts], names=["part", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, texts = np.zeros(CELLS, np.uint16), 0
        for batch in _small(batches):
            if texts + batch.num_rows > MOST_TEXTS:
                yield from rows(table)
                table[:], texts = 0, 0
            texts += batch.num_rows
            for counts, _, hashes, _ in _shingles(batch.column(0), size):
                np.add.at(table, _cells(_distinct(counts, hashes)[1]), np.uint16(1))
        yield from rows(table)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((CELLS // CELLS_A_ROW, CELLS_A_ROW), np.int64)  # memory is taken where a part comes
        seen = np.zeros(len(sums), bool)
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[part] += np.frombuffer(counts.as_buffer(), np.uint16)
                seen[part] = True
        for part in np.flatnonzero(seen).tolist():
            often = np.flatnonzero(sums[part] >= needed)
            yield pa.RecordBatch.from_arrays([pa.array(part * CELLS_A_ROW + often, pa.int64()), pa.array(sums[part][often])], names=["cell", "n"])

    counted = docs.select("text").mapInArrow(count, "part long, counts binary").repartition("part").mapInArrow(add, "cell long, n long")
    found = counted.orderBy(F.desc("n"), "cell").limit(most).toArrow()
    cells = found.column("cell").to_numpy().astype(np.int64)
    order = np.argsort(cells)
    return cells[order], found.column("n").to_numpy()[order]


def sketch_sizes(n: np.ndarray, common: np.ndarray, least: float) -> np.ndarray:
    """How many of its first shingles a text of ``n`` distinct ones, ``common`` of them common, must show.

    Of two sets that share ``least`` of their union, at most that rest of the union is
    in one only.  So one of the first n - ceil(least * n) + 1 in any order is shared.
    Shingles that are not common stand first, in the order of their hashes, and each of
    them is in one set only with a chance of (1 - least) / least * n / (n - common) at
    most, whatever came before.  After so many that all being so is less likely than
    that two shingles have one 64-bit hash, no more are needed."""
    exact = np.where(n > 0, n - np.ceil(least * n - 1e-9).astype(np.int64) + 1, 0)
    alone = (1 - least) / least * n / np.maximum(n - common, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        enough = np.where(alone < 1, np.ceil(BITS * np.log(2) / -np.log(np.maximum(alone, 1e-300))), np.inf)
    return np.minimum(exact, enough).astype(np.int64)


def _sketches(counts: np.ndarray, hashes: np.ndarray, least: float, common: tuple[np.ndarray, np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """For each text its first shingles in the order of ``common``, the number of its distinct ones,
    a hash of their set, and a word with one bit flipped for each of them."""
    of, hashes = _distinct(counts, hashes)
    n = np.bincount(of, minlength=len(counts))
    known, often = common
    rank = np.zeros(len(hashes), np.int64)
    if len(known):
        cells = _cells(hashes)
        at = np.minimum(np.searchsorted(known, cells), len(known) - 1)
        rank = np.where(known[at] == cells, often[at], 0)
    mixed = W.mix(hashes ^ np.uint64(0x5E7))
    sets, flips = np.zeros(len(counts), np.uint64), np.zeros(len(counts), np.uint64)
    np.add.at(sets, of, mixed)
    np.bitwise_xor.at(flips, of, np.uint64(1) << (mixed >> np.uint64(58)))
    # Within a text the hashes ascend already, so texts with no common shingle are in order.
    late = np.flatnonzero(np.bincount(of, rank, len(counts))[of] > 0)
    ordered = hashes.copy()
    ordered[late] = hashes[late][np.lexsort((hashes[late], rank[late], of[late]))]
    first = np.cumsum(n) - n
    sizes = sketch_sizes(n, np.bincount(of, rank > 0, len(counts)), least)
    ordered = ordered.view(np.int64)
    return [ordered[a : a + k].copy() for a, k in zip(first.tolist(), sizes.tolist())], n, sets.view(np.int64), flips.view(np.int64)


def sketches(docs: DataFrame, size: int = 5, least: float = 0.8) -> DataFrame:
    """``(doc_id, fp, n, shingles, flips, sketch)`` of ``docs(doc_id, text)``: the fingerprint of the
    text, the number of its distinct shingles, a hash and parities of their set, and the first of them."""
    common = common_shingles(docs, size)
    longs = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            columns: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(4)]
            shown: list[np.ndarray] = []
            for counts, _, hashes, own in _shingles(batch.column(1), size):
                sketch, *numbers = _sketches(counts, hashes, least, common)
                shown += sketch
                for column, values in zip(columns, (own.view(np.int64), *numbers)):
                    column.append(values)
            fps, n, sets, flips = (pa.array(np.concatenate(c)) for c in columns)
            yield pa.RecordBatch.from_arrays([batch.column(0), fps, n, sets, flips, pa.array(shown, longs)], names=["doc_id", "fp", "n", "shingles", "flips", "sketch"])

    fields = [T.StructField(c, T.LongType()) for c in ("fp", "n", "shingles", "flips")]
    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], *fields, T.StructField("sketch", T.ArrayType(T.LongType()))]))


def _possible(n: str, m: str, flips: str, other: str, least: float) -> F.Column:
    """Can two sets of ``n`` and ``m`` shingles with these parities share ``least`` of their union?"""
    need = F.ceil((F.col(n) + F.col(m)) * (least / (1 + least)) - 1e-6)
    differ = F.bit_count(F.col(flips).bitwiseXOR(F.col(other)))
    return (F.least(n, m) >= need) & (differ <= F.col(n) + F.col(m) - 2 * need)


def shared_shingles(one: DataFrame) -> DataFrame:
    """``(token, first, first_n, first_flips, doc_id, at)``: the shingles that several sketches show, the smallest
    id that shows each, and each text that does with its place there.  Most are in one text only and go here:
    counts are combined before they are shuffled, and a shingle of very many texts is a skewed key of a join, which is split."""
    listed = one.select("doc_id", F.posexplode("sketch").alias("at", "token"))
    many = listed.groupBy("token").agg(F.count("*").alias("many"), F.min("doc_id").alias("first")).where("many > 1")
    # A text is the first of no more shingles than its sketch has.
    many = many.join(one.select(F.col("doc_id").alias("first"), F.col("n").alias("first_n"), F.col("flips").alias("first_flips")), "first")
    return listed.join(many.drop("many"), "token").select("token", "first", "first_n", "first_flips", "doc_id", F.col("at").cast("int").alias("at"))


def first_pairs(shared: DataFrame, one: DataFrame, least: float) -> DataFrame:
    """Candidates ``(a, b)``: each text with the first one of each shingle of its sketch."""
    pairs = shared.where("doc_id <> first").select("doc_id", "first", "first_n", "first_flips").distinct()
    met = pairs.join(one.select("doc_id", "n", "flips"), "doc_id")
    return met.where(_possible("n", "first_n", "flips", "first_flips", least)).select(F.col("doc_id").alias("a"), F.col("first").alias("b"))


def rest(shared: DataFrame, one: DataFrame, known: DataFrame, least: float, crowd: int = 2_000) -> DataFrame:
    """Candidates ``(a, b)``: all pairs of ``one`` that may share ``least`` of their shingles and that ``known(node, root)`` leaves apart.

    Such a pair shows a shingle that both have, and the first it has in common leaves
    enough behind it in both.  A shingle of more than ``crowd`` texts is dealt out: one
    side in parts, the other to each part."""
    facts = one.select("doc_id", "n", "flips").join(known.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    listed = shared.select("token", "doc_id", "at").join(facts, "doc_id")
    # A shingle that only one group shows makes no pair.
    apart = listed.groupBy("token").agg(F.count("*").alias("many"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    listed = cut(listed.join(apart.select("token", F.ceil(F.col("many") / crowd).cast("int").alias("parts")), "token"))
    left = listed.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    right = listed.select("token", *(F.col(c).alias(f"{c}_2") for c in ("doc_id", "root", "n", "flips", "at")), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    need = F.ceil((F.col("n") + F.col("n_2")) * (least / (1 + least)) - 1e-6)
    fits = (F.col("n") - F.col("at") >= need) & (F.col("n_2") - F.col("at_2") >= need)
    met = left.join(right, ["token", "part"]).where((F.col("doc_id") < F.col("doc_id_2")) & (F.col("root") != F.col("root_2")) & fits & _possible("n", "n_2", "flips", "flips_2", least))
    return met.select(F.col("doc_id_2").alias("a"), F.col("doc_id").alias("b")).distinct()


def similar(docs: DataFrame, pairs: DataFrame, size: int, least: float, share: int = 256) -> DataFrame:
    """Those of ``pairs(a, b)`` of ``docs(doc_id, text)`` whose texts share ``least`` of their shingles, each counted once.

    A text goes out once for each pair as ``a``, and as ``b`` once for every ``share``
    of its pairs: they follow it through one task, which holds the shingles of one ``b``."""
    spark = docs.sparkSession
    pairs = cut(pairs)
    ids = joinable(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct())
    bodies, path = stored_at(docs.select("doc_id", "text").join(ids, "doc_id", "left_semi"))
    parts = cut(pairs.groupBy("b").agg(F.ceil(F.count("*") / share).cast("int").alias("parts")))
    # Only texts with many pairs are dealt out; there are few of them.
    crowded = joinable(parts.where("parts > 1"))
    spread = pairs.join(crowded, "b", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("a"), F.col("parts")), F.lit(0)).cast("int"))
    held = parts.join(bodies.withColumnRenamed("doc_id", "b"), "b").select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast(pairs.schema["a"].dataType).alias("a"), "text")
    sent = spread.join(bodies.withColumnRenamed("doc_id", "a"), "a").select("b", "part", "a", "text")
    lines = held.unionByName(sent).repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        last = None
        for batch in _small(batches):
            # One slice's sets at a time: those of long texts are larger than the texts.
            sets = (np.unique(h) for _, base, hashes, _ in _shingles(batch.column(3), size) for h in np.split(hashes, base[1:-1]))
            out: list[tuple] = []
            for a, b, own in zip(batch.column(2).to_pylist(), batch.column(0).to_pylist(), sets):
                if a is None:  # rows of one id with different texts stand for it each
                    held = held if b == last else []
                    if not any(np.array_equal(own, other) for other in held):
                        held.append(own)
                    last = b
                    continue
                for other in held:
                    shared = len(np.intersect1d(own, other, assume_unique=True))
                    if shared >= least * (len(own) + len(other) - shared) - 1e-9 and shared:
                        out.append((a, b))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], batch.schema.field(c).type) for k, c in ((0, 2), (1, 0))], names=["a", "b"])

    found = cut(lines.mapInArrow(run, T.StructType([T.StructField(c, pairs.schema[c].dataType) for c in ("a", "b")])))
    discard(spark, path)
    return found


def near_copies(docs: DataFrame, size: int = 5, least: float = 0.8) -> DataFrame:
    """``(doc_id, root)``: the smallest id of each document's group of near copies, for ids in a group of several.

    Fingerprints within 2 bits link as in ``cluster``, and texts that share ``least`` of
    their shingles.  Each text shows the first of its shingles (``sketch_sizes``), so
    that all such pairs meet at one.  There each is first compared with the smallest id
    only, which joins the members of large groups, and then with all those that are
    still in other groups (``rest``).  Every pair is verified by its texts."""
    rows = cut(sketches(docs, size, least).where(F.col("doc_id").isNotNull()))
    fps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    close = links(fps.select("fp"))
    named = fps.select(F.col("fp").alias("a"), F.col("first").alias("a_id")), fps.select(F.col("fp").alias("b"), F.col("first").alias("b_id"))
    close = close.join(named[0], "a").join(named[1], "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    same = rows.join(fps, "fp").where("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    # One text stands for all of the same shingles.
    one = rows.where("n > 0").groupBy("fp", "shingles").agg(F.min(F.struct("doc_id", "n", "flips", "sketch")).alias("r")).select("r.*")
    one = cut(one)
    shared = cut(shared_shingles(one))
    early = similar(docs, first_pairs(shared, one, least), size, least)
    early = cut(components(same.unionByName(close).unionByName(early)))
    late = similar(docs, rest(shared, one, early, least), size, least)
    found = components(early.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(late))
    return found.select(F.col("node").alias("doc_id"), "root")


def keep_first(docs: DataFrame, size: int = 5, least: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of near copies, the one of the smallest id, with its own columns.

    Rows that share an id are one document and stay or go together.  Rows
    without an id stay, as no other row could stand for them by name."""
    mark = free_name(docs, "dropped_id")
    found = near_copies(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), size, least)
    dropped = joinable(found.where("doc_id <> root").select(F.col("doc_id").alias(mark)))
    return docs.join(dropped, docs[doc_id] == dropped[mark], "left_anti")
