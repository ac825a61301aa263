"""Removal of passages that an earlier document has, by suffix arrays per shard.

A byte goes if a string of ``length`` bytes over it also starts in a document of a
smaller id.  So every window of ``length`` bytes needs the smallest id that has it.

1. Documents are dealt to shards by bytes as they are read and written once, in
   buckets by shard, so no later step moves texts.  A document whose whole text an
   earlier one has loses all of it, and takes no part in the rest.
2. The seed of a window is the least hash of the strings of ``SEED`` bytes in it: a
   rule of its content alone.  Windows of one seed in a row are a stretch.  Each
   shard sends its distinct seeds, cut to 32 bits, to a range of seeds; what
   returns is one code for each: in this shard only, shared, or shared by so many
   different stretches that they must be spread.
3. Shards send their distinct stretches with a shared seed, and each one's
   smallest id and places, to the index shard of the seed (crowded seeds window by
   window, to that of the window).  A stretch that is the only one of its seed needs
   no more: no other has its windows.  The rest an index shard takes in blocks,
   builds each block's suffix array and common prefixes, gets its distinct windows
   in order, and merges the blocks by binary search of one in the other.
4. What returns to a shard is the smallest id along each stretch it sent, with its
   places; the shard marks its documents' bytes without hashing them again.

Cut seeds may agree by chance; that only sends more stretches.  Nothing is dropped
or capped, and no group of equal passages or copies meets in one task: each shard
sends a stretch once, and an index shard holds it once.  What a shard sends to a
range of seeds, or to an index shard, is one compressed row.  The more there are of
both, the fewer seeds share a row; with one in each it is a row for a seed, as in
any shuffle.

Defined results: ids are integers (``find`` refuses others); a null text has no
bytes; a document without an id neither loses bytes nor takes them from others;
rows of equal id take nothing from each other; texts shorter than a window stay
whole; other columns, of any name, are left out; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.llm import words as W
from tidelake.llm.runtime import cut, discard, joinable, shared_dir
from tidelake.llm.suffix_order import common_prefixes, suffix_array

LENGTH = 50
SEED = 24
#: Different stretches of one seed above which they go window by window.
CROWD = 2048

UNSHARED, SHARED, CROWDED = 0, 1, 2


def stretches(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one slice of texts: seeds of stretches, their first windows, and ends of their windows."""
    n, width = len(data), length - SEED + 1
    none = np.empty(0, np.int64)
    if n < length:
        return none.astype(np.uint64), none, none
    every = np.arange(n - SEED + 1)
    least = W.span_hash(data, every, every + SEED)
    size = 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    k = len(least)
    inside = np.arange(k) + length <= np.repeat(offsets[1:], np.diff(offsets))[:k]
    new = np.ones(k, bool)
    new[1:] = (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])
    new[offsets[offsets < k]] = True
    first = np.flatnonzero(new)
    end = np.append(first[1:], k)
    kept = inside[first]
    # Least hashes crowd near zero; mixed again they spread evenly over ranges.
    return W.mix(least[first[kept]] ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first[kept], end[kept]


class Shard:
    """One shard's documents and, if asked for, their stretches, recomputed alike in every step."""

    def __init__(self, table: pa.Table, returned: pa.Table, length: int = LENGTH, scan: bool = True):
        ids = table.column("doc_id").combine_chunks()
        self.known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        copies = [x for x in returned.column("copies").to_pylist() if x] if returned.num_rows else []
        self.copy = np.isin(table.column("row_key").to_numpy(), np.concatenate(copies)) if copies else np.zeros(len(ids), bool)
        self.copy &= self.known
        self.length = length
        self.data, self.offsets, base_docs = [], [], []
        seeds, hashes, docs, first, end = [], [], [], [], []
        for i, data, offsets in W.slices(table.column("text").combine_chunks()):
            self.data.append(data)
            self.offsets.append(offsets)
            base_docs.append(i)
            if not scan:
                continue
            s, a, b = stretches(data, offsets, length)
            doc = np.searchsorted(offsets, a, "right") - 1 + i
            use = self.known[doc] & ~self.copy[doc]
            s, a, b, doc = s[use], a[use], b[use], doc[use]
            seeds.append(s)
            hashes.append(W.span_hash(data, a, b - 1 + length))
            docs.append(doc)
            first.append(a)
            end.append(b)
        self.base_docs = np.array(base_docs, np.int64)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
        self.seeds, self.hashes = join(seeds, np.uint64), join(hashes, np.uint64)
        self.docs, self.first, self.end = (join(x, np.int64) for x in (docs, first, end))

    def slice_of(self, docs: np.ndarray) -> np.ndarray:
        """The slice that holds each document."""
        return np.searchsorted(self.base_docs, docs, "right") - 1

    def _cut(self, ranges: int) -> np.ndarray:
        """Seeds cut to their range and 32 more bits."""
        of = ((self.seeds >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        return (of << np.uint64(32)) | (self.seeds & np.uint64(0xFFFFFFFF))

    def distinct_seeds(self, ranges: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(range, cut seeds ascending, how many different stretches each has) for each range."""
        cut_seeds = self._cut(ranges)
        if not len(cut_seeds):
            return []
        order = np.lexsort((self.hashes, cut_seeds))
        cut_seeds, hashes = cut_seeds[order], self.hashes[order]
        seed = np.ones(len(order), bool)
        seed[1:] = cut_seeds[1:] != cut_seeds[:-1]
        variant = seed.copy()
        variant[1:] |= hashes[1:] != hashes[:-1]
        at = np.flatnonzero(seed)
        many = np.minimum(np.add.reduceat(variant.astype(np.int64), at), 0xFFFF).astype(np.uint16)
        low, of = cut_seeds[at].astype(np.uint32), (cut_seeds[at] >> np.uint64(32)).astype(np.int64)
        edges = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        return [(int(of[a]), low[a:b], many[a:b]) for a, b in zip(edges, np.append(edges[1:], len(at)))]

    def codes(self, ranges: int, returned: list[np.ndarray]) -> np.ndarray:
        """The code of each stretch, from the codes that came back for the distinct seeds, range by range."""
        if not len(self.seeds):
            return np.empty(0, np.uint8)
        cut_seeds = self._cut(ranges)
        order = np.argsort(cut_seeds, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = cut_seeds[order][1:] != cut_seeds[order][:-1]
        at = np.flatnonzero(new)
        code, docs = np.concatenate(returned), self.docs[order]
        # A seed of no other shard still is shared if several documents of this one have it.
        code = np.where((code == UNSHARED) & (np.minimum.reduceat(docs, at) != np.maximum.reduceat(docs, at)), SHARED, code)
        out = np.empty(len(order), np.uint8)
        out[order] = np.repeat(code, np.diff(np.append(at, len(order))))
        return out

    def entries(self, codes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Pieces with a shared seed: (first window, end of windows, document, route, hash of the piece),
        one for a stretch, or one for each window of a crowded one; equal windows have equal routes."""
        plain = np.flatnonzero(codes == SHARED)
        first, end, docs = (x[plain] for x in (self.first, self.end, self.docs))
        route, content = self.seeds[plain], self.hashes[plain]
        crowd = np.flatnonzero(codes == CROWDED)
        if len(crowd):
            lengths = self.end[crowd] - self.first[crowd]
            of = np.repeat(np.arange(len(crowd)), lengths)
            at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + self.first[crowd][of]
            hashes = np.zeros(len(at), np.uint64)
            slices = self.slice_of(self.docs[crowd])[of]
            for k in np.unique(slices):
                mine = slices == k
                hashes[mine] = W.span_hash(self.data[k], at[mine], at[mine] + self.length)
            first, end, docs = (np.concatenate(x) for x in ((first, at), (end, at + 1), (docs, self.docs[crowd][of])))
            route, content = np.concatenate([route, W.mix(hashes ^ np.uint64(0x1234567))]), np.concatenate([content, hashes])
        return first, end, docs, route, content

    def distinct(self, codes: np.ndarray, indexes: int) -> tuple[np.ndarray, np.ndarray, tuple]:
        """(index shard of each distinct piece, number of the distinct piece of each piece, pieces); pieces ordered by index shard."""
        pieces = self.entries(codes)
        route, content = pieces[3], pieces[4]
        to = (((route >> np.uint64(32)) * np.uint64(indexes)) >> np.uint64(32)).astype(np.int64)
        order = np.lexsort((content, route, to))
        new = np.ones(len(order), bool)
        if len(order):
            a, b = order[1:], order[:-1]
            new[1:] = (route[a] != route[b]) | (content[a] != content[b]) | (to[a] != to[b])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        return to[order[new]], number, pieces


def index_block(blob: np.ndarray, sizes: np.ndarray, ids: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block of distinct pieces: for each of their windows the number of its distinct
    string, and for each of those a position that has it (in order) and its smallest id."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    left = np.repeat(ends, sizes) - np.arange(len(blob))
    order, _ = suffix_array(blob, left)
    shared = common_prefixes(blob, starts, left, order, length)
    whole = left[order] >= length
    # What lies between two windows is shorter than they are, so it parts them.
    at = np.flatnonzero(whole)
    gap = np.minimum.reduceat(shared[: at[-1] + 1], np.concatenate([[0], at[:-1] + 1])) if len(at) else np.empty(0, np.int64)
    windows = order[whole]
    new = gap < length
    if len(new):
        new[0] = True
    number = np.cumsum(new) - 1
    owner = np.repeat(np.arange(len(sizes)), sizes)
    least = np.minimum.reduceat(ids[owner[windows]], np.flatnonzero(new)) if len(new) else np.empty(0, np.int64)
    of = np.full(len(blob), -1)
    of[windows] = number
    return of[left >= length], windows[new], least


def window_keys(blob: np.ndarray, places: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The windows at ``places`` as fixed-width keys in byte order (one more byte, as trailing zeros do not count)."""
    rows = np.ones((len(places), length + 1), np.uint8)
    for k in range(length):
        rows[:, k] = blob[places + k]
    return rows.view(f"S{length + 1}")[:, 0] if len(places) else np.empty(0, f"S{length + 1}")


def merge_blocks(blocks: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Smallest ids over all blocks for the windows of each; blocks are (keys ascending, ids).

    Each block is looked up in what the blocks before it have merged to, by binary
    search: known windows take the smaller id, others are put in at their places."""
    if len(blocks) < 2:
        return [ids for _, ids in blocks]
    keys, least = blocks[0][0], blocks[0][1].copy()
    for other, ids in blocks[1:]:
        at = np.searchsorted(keys, other)
        known = keys[np.minimum(at, len(keys) - 1)] == other if len(keys) else np.zeros(len(other), bool)
        least[at[known]] = np.minimum(least[at[known]], ids[known])
        keys, least = np.insert(keys, at[~known], other[~known]), np.insert(least, at[~known], ids[~known])
    return [least[np.searchsorted(keys, other)] for other, _ in blocks]


def index_shard(pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], length: int, block_bytes: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For what each sender sent (blob, sizes, smallest ids, ends of routes): per piece the
    number of runs of equal smallest ids over its windows, and per run its windows and that id."""
    blob, sizes, ids, tags = (np.concatenate([p[k] for p in pieces]) for k in range(4))
    sizes = sizes.astype(np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    # Equal pieces of several senders are one.
    hashes = np.concatenate([W.span_hash(blob[a:b], starts[i:j] - a, ends[i:j] - a) for i, j, a, b in _runs(starts, ends, 1 << 21)] or [np.empty(0, np.uint64)])
    order = np.lexsort((sizes, hashes, tags))
    new, tag = np.ones(len(order), bool), np.ones(len(order), bool)
    tag[1:] = tags[order][1:] != tags[order][:-1]
    new[1:] = tag[1:] | (hashes[order][1:] != hashes[order][:-1]) | (sizes[order][1:] != sizes[order][:-1])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    one = order[new]
    least = np.minimum.reduceat(ids[order], np.flatnonzero(new)) if len(one) else ids
    # Windows have the route of their piece: the only piece of a route shares none.
    of_tag = np.cumsum(tag)[new] - 1
    alone = np.bincount(of_tag)[of_tag] == 1 if len(one) else np.empty(0, bool)
    several = np.flatnonzero(~alone)
    blocks, spans = [], []
    total = np.cumsum(sizes[one[several]])
    i = 0
    while i < len(several):
        j = max(i + 1, int(np.searchsorted(total, total[i] - sizes[one[several[i]]] + block_bytes, "right")))
        mine = one[several[i:j]]
        lengths = sizes[mine]
        at = np.arange(lengths.sum()) + np.repeat(starts[mine] - (np.cumsum(lengths) - lengths), lengths)
        part = blob[at]
        of, places, smallest = index_block(part, lengths, least[several[i:j]], length)
        blocks.append((window_keys(part, places, length), smallest))
        spans.append((of, lengths - length + 1))
        i = j
    merged = merge_blocks(blocks)
    # Runs of equal ids along each distinct piece; those that stand alone have one.
    many, widths, values = [], [], []
    for (of, windows), smallest in zip(spans, merged):
        along = smallest[of]
        edge = np.ones(len(along), bool)
        edge[1:] = along[1:] != along[:-1]
        edge[np.cumsum(windows)[:-1]] = True
        at = np.flatnonzero(edge)
        widths.append(np.diff(np.append(at, len(along))))
        values.append(along[at])
        many.append(np.diff(np.searchsorted(at, np.concatenate([[0], np.cumsum(windows)]))))
    widths.append(sizes[one[alone]] - length + 1)
    values.append(least[alone])
    runs = np.ones(len(one), np.int64)
    runs[several] = np.concatenate(many) if many else 1
    widths, values = np.concatenate(widths), np.concatenate(values)
    begin = np.empty(len(one), np.int64)
    begin[np.concatenate([several, np.flatnonzero(alone)])] = np.cumsum(np.concatenate([runs[several], runs[alone]])) - np.concatenate([runs[several], runs[alone]])
    out, piece = [], 0
    for _, own, *_ in pieces:
        mine = number[piece : piece + len(own)]
        piece += len(own)
        n = runs[mine]
        at = np.arange(n.sum()) + np.repeat(begin[mine] - (np.cumsum(n) - n), n)
        out.append((n, widths[at], values[at]))
    return out


def _runs(starts: np.ndarray, ends: np.ndarray, most: int) -> Iterator[tuple[int, int, int, int]]:
    """Consecutive pieces of about ``most`` bytes: (first, end, first byte, end byte)."""
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + most, "right")))
        yield i, j, int(starts[i]), int(ends[j - 1])
        i = j


_CODEC = pa.Codec("zstd", 1)


def _pack(values: np.ndarray, kind: str) -> bytes:
    """Numbers as compressed bytes, after four bytes of their length."""
    raw = np.ascontiguousarray(values.astype(kind)).tobytes()
    return len(raw).to_bytes(4, "little") + _CODEC.compress(raw, asbytes=True)


def _unpack(data: bytes, kind: str) -> np.ndarray:
    size = int.from_bytes(data[:4], "little")
    return np.frombuffer(_CODEC.decompress(data[4:], size), kind) if size else np.empty(0, kind)


def _batch(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=schema)


_SEEDS = pa.schema([("range", pa.int64()), ("shard", pa.int64()), ("seeds", pa.binary()), ("many", pa.binary())])
_CODES = pa.schema([("shard", pa.int64()), ("kind", pa.int64()), ("part", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("places", pa.binary()), ("size", pa.int64()), ("copies", pa.list_(pa.int64()))])
_PIECES = pa.schema([("part", pa.int64()), ("shard", pa.int64()), ("blob", pa.binary()), ("sizes", pa.binary()), ("ids", pa.binary()), ("tags", pa.binary()), ("places", pa.binary())])
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), ("kept_sha256", pa.string())])
CODES, RUNS, COPIES = 0, 1, 2


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.binary(): "binary", pa.string(): "string", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"`{f.name}` {kinds.get(f.type, 'array<struct<first:long,end:long>>')}" for f in schema)


def deal_to_shards(docs: DataFrame, shard_bytes: int) -> tuple[DataFrame, str]:
    """``docs(doc_id, text)`` written once with the shard of each row, runs of a task's rows of about ``shard_bytes``, and the table's name."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, held = TaskContext.get().partitionId() << 24, 0
        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            upto = held + np.cumsum(sizes)
            held = int(upto[-1]) if len(upto) else held
            yield pa.RecordBatch.from_arrays([pa.array(base + (upto - sizes) // shard_bytes), *batch.columns], names=["shard", *batch.schema.names])

    spark = docs.sparkSession
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    keyed = docs.select("doc_id", digest.alias("digest"), "text").select("doc_id", F.xxhash64("doc_id", "digest").alias("row_key"), "text", "digest")
    dealt = keyed.mapInArrow(number, "shard long, doc_id long, row_key long, text string, digest string")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    name = f"substring_dedup_{uuid4().hex}"
    dealt.write.bucketBy(buckets, "shard").option("path", f"{shared_dir(spark)}/tidelake/{name}").saveAsTable(name)
    return spark.table(name), name


def find(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = 8 << 20, seeds_per_range: int = 2 << 20, index_bytes: int = 4 << 20, block_bytes: int = 2 << 20, crowd: int = CROWD) -> DataFrame:
    """For each row: doc_id, n_bytes, spans of bytes to remove, and the SHA-256 of the rest."""
    spark = docs.sparkSession
    if not isinstance(docs.schema[doc_id].dataType, T.IntegralType):
        raise TypeError(f"{doc_id} must be an integer column: the smaller id keeps a passage")
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards, table = deal_to_shards(slim, shard_bytes)
    try:
        return _find(shards, total, length, seeds_per_range, index_bytes, block_bytes, crowd)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        discard(spark, f"{shared_dir(spark)}/tidelake/{table}")


def _find(shards: DataFrame, total: int, length: int, seeds_per_range: int, index_bytes: int, block_bytes: int, crowd: int) -> DataFrame:
    """``find`` of texts that are dealt to shards."""
    spark = shards.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(least, -(-total // (18 * seeds_per_range)))

    # Whole copies: a group of any size meets as one aggregated row; its rows join that and are split where skewed.
    first = shards.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("doc_id").alias("n")).where("n > 1")
    first = joinable(first)  # written by itself, so that a skewed side of the join can be split
    later = shards.select("shard", "doc_id", "row_key", "digest").join(first, "digest").where("doc_id > first")
    copies = later.groupBy("shard").agg(F.collect_list("row_key").alias("copies")).withColumns({"kind": F.lit(COPIES).cast("long"), "part": F.lit(None).cast("long"), "size": F.lit(0).cast("long"), **{c: F.lit(None).cast("binary") for c in ("a", "b", "c", "places")}})
    copies = cut(copies.select(*_CODES.names))

    def send_seeds(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _batch([], _SEEDS)
        key = left.column("shard")[0].as_py()
        rows = [{"range": r, "shard": key, "seeds": _pack(s, "<u4"), "many": _pack(m, "<u2")} for r, s, m in Shard(left, right, length).distinct_seeds(ranges)]
        return _batch(rows, _SEEDS)

    def code_seeds(table: pa.Table) -> pa.Table:
        seeds = [_unpack(x, "<u4") for x in table.column("seeds").to_pylist()]
        many = np.concatenate([_unpack(x, "<u2") for x in table.column("many").to_pylist()]).astype(np.int64)
        joined = np.concatenate(seeds)
        order = np.argsort(joined, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = joined[order][1:] != joined[order][:-1]
        at = np.flatnonzero(new)
        senders, variants = np.diff(np.append(at, len(order))), np.add.reduceat(many[order], at)
        # In one shard only, a seed still is shared if several documents there have it; the shard knows.
        code = np.where(variants > crowd, CROWDED, np.where(senders > 1, SHARED, UNSHARED)).astype(np.uint8)
        back = np.empty(len(order), np.uint8)
        back[order] = np.repeat(code, senders)
        edges = np.cumsum([0, *map(len, seeds)])
        part = table.column("range")[0].as_py()
        return _batch([{"shard": s, "kind": CODES, "part": part, "a": _pack(back[a:b], "u1"), "size": int(np.sum(back[a:b] > 0))} for s, a, b in zip(table.column("shard").to_pylist(), edges[:-1], edges[1:])], _CODES)

    by_shard = shards.groupBy("shard")
    sent = by_shard.cogroup(copies.groupBy("shard")).applyInArrow(send_seeds, _ddl(_SEEDS))
    codes = cut(sent.groupBy("range").applyInArrow(code_seeds, _ddl(_CODES)))
    indexes = max(least, -(-(codes.agg(F.sum("size")).first()[0] or 0) * (length + 18) // index_bytes))

    def send_pieces(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _batch([], _PIECES)
        shard = Shard(left, right, length)
        back = sorted((r for r in right.select(["kind", "part", "a"]).to_pylist() if r["kind"] == CODES), key=lambda r: r["part"])
        to, number, (first, end, docs_, route, _) = shard.distinct(shard.codes(ranges, [_unpack(r["a"], "u1") for r in back]), indexes)
        ids = np.full(len(to), np.iinfo(np.int64).max)
        np.minimum.at(ids, number, shard.ids[docs_])
        one = np.empty(len(to), np.int64)
        one[number] = np.arange(len(number))
        # Places of each distinct piece, in its order.
        by = np.argsort(number, kind="stable")
        upto = np.searchsorted(number[by], np.arange(len(to) + 1))
        slices = shard.slice_of(docs_)
        key, rows = left.column("shard")[0].as_py(), []
        edges = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else []
        for a, b in zip(edges, np.append(edges[1:], len(to))):
            mine, at = one[a:b], by[upto[a] : upto[b]]
            blob = b"".join([shard.data[s][x : y - 1 + length].tobytes() for s, x, y in zip(slices[mine].tolist(), first[mine].tolist(), end[mine].tolist())])
            places = np.concatenate([number[at] - a, docs_[at], first[at]])
            rows.append({
                "part": int(to[a]), "shard": key, "blob": _pack(np.frombuffer(blob, np.uint8), "u1"), "sizes": _pack(end[mine] - first[mine] - 1 + length, "<i4"),
                "ids": _pack(ids[a:b], "<i8"), "tags": _pack(route[mine] & np.uint64(0xFFFFFFFF), "<u4"), "places": _pack(places, "<i4"),
            })
        return _batch(rows, _PIECES)

    def index(table: pa.Table) -> pa.Table:
        senders, places = table.column("shard").to_pylist(), table.column("places").to_pylist()
        columns = (map(lambda x, kind=kind: _unpack(x, kind), table.column(c).to_pylist()) for c, kind in (("blob", "u1"), ("sizes", "<i4"), ("ids", "<i8"), ("tags", "<u4")))
        found = index_shard(list(zip(*columns)), length, block_bytes)
        part = table.column("part")[0].as_py()
        return _batch([{"shard": s, "kind": RUNS, "part": part, "a": _pack(n, "<i4"), "b": _pack(w, "<i4"), "c": _pack(v, "<i8"), "places": p, "size": len(n)} for s, p, (n, w, v) in zip(senders, places, found)], _CODES)

    pieces = by_shard.cogroup(copies.unionByName(codes).groupBy("shard")).applyInArrow(send_pieces, _ddl(_PIECES))
    runs = pieces.groupBy("part").applyInArrow(index, _ddl(_CODES))

    def mark(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _batch([], _RESULT)
        shard = Shard(left, right, length, scan=False)
        covered = [np.zeros(len(d) + 1, np.int64) for d in shard.data]
        for kind, a, b, c, places in zip(*(right.column(x).to_pylist() for x in ("kind", "a", "b", "c", "places"))):
            if kind != RUNS:
                continue
            n, widths, values = _unpack(a, "<i4").astype(np.int64), _unpack(b, "<i4").astype(np.int64), _unpack(c, "<i8")
            number, docs_, first = _unpack(places, "<i4").astype(np.int64).reshape(3, -1)
            begin = np.cumsum(n) - n
            begins_at = np.cumsum(widths) - widths
            # All runs of all pieces; those of a smaller id cover their windows' bytes.
            many = n[number]
            piece = np.repeat(np.arange(len(number)), many)
            run = np.arange(many.sum()) + np.repeat(begin[number] - (np.cumsum(many) - many), many)
            take = values[run] < shard.ids[docs_[piece]]
            piece, run = piece[take], run[take]
            from_ = first[piece] + begins_at[run] - begins_at[begin[number[piece]]]
            upto = from_ + widths[run] - 1 + length
            slices = shard.slice_of(docs_[piece])
            for k in np.unique(slices).tolist():
                mine = slices == k
                np.add.at(covered[k], from_[mine], 1)
                np.add.at(covered[k], upto[mine], -1)
        spans, digests, sizes = [], [], []
        for data, offsets, steps in zip(shard.data, shard.offsets, covered):
            gone = np.cumsum(steps)[:-1] > 0
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                if shard.copy[len(sizes)] and b - a >= length:
                    gone[a:b] = True
                own, edges = data[a:b], np.diff(np.concatenate([[0], gone[a:b].view(np.int8), [0]]))
                spans.append([{"first": int(x), "end": int(y)} for x, y in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1))])
                digests.append(hashlib.sha256(own[~gone[a:b]].tobytes() if spans[-1] else own.tobytes()).hexdigest())
                sizes.append(b - a)
        return pa.Table.from_arrays([left.column("doc_id").combine_chunks(), pa.array(sizes, pa.int64()), pa.array(spans, _RESULT.field("spans").type), pa.array(digests, pa.string())], schema=_RESULT)

    return cut(by_shard.cogroup(copies.unionByName(runs).groupBy("shard")).applyInArrow(mark, _ddl(_RESULT)))


def oracle(length: int = LENGTH, table: str = "documents") -> str:
    """The digest of ``find`` as SQL for DuckDB: every window of bytes as hexadecimal digits."""
    return f"""with d as (select *, length(h) // 2 as n from (select row_number() over () as uid, doc_id, hex(encode(coalesce(text, ''))) as h from {table})),
    parts as (select uid, doc_id, c, substr(h, 2 * c + 1, 2 * (500 + {length} - 1)) as part from (select uid, doc_id, h, unnest(range(0, n - {length} + 1, 500)) as c from d where n >= {length} and doc_id is not null)),
    windows as (select uid, doc_id, c + q as p, substr(part, 2 * q - 1, {2 * length}) as s from (select *, unnest(range(1, length(part) // 2 - {length} + 2)) as q from parts)),
    least as (select s, min(doc_id) as first from windows group by s),
    hits as (select uid, p, lag(p) over (partition by uid order by p) as before from windows join least using (s) where first < doc_id),
    runs as (select uid, p, sum(case when p <= before + {length} then 0 else 1 end) over (partition by uid order by p) as run from hits),
    spans as (select uid, run, min(p) as a, max(p) + {length} - 1 as b from runs group by uid, run),
    around as (select *, coalesce(lag(b) over (partition by uid order by a), 0) as before from spans),
    kept as (select uid, sum(b - a + 1) as n_removed, count(*) as n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - 1 - before)), '' order by a) || substr(any_value(h), 2 * max(b) + 1) as rest from around join d using (uid) group by uid)
    select doc_id, cast(n as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(rest, h))) as kept_sha256 from d left join kept using (uid)"""
