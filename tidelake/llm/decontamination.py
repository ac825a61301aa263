"""Benchmark decontamination: an FM-index per shard of documents, searched for all windows of the items.

A shard is a bounded slice of a task's documents.  Its text becomes symbols:
one per word of the benchmark.  Any other word ends a run, and runs shorter than
the shortest window are left out, since no window can occur there.  Windows are
found by backward search over wavelet ranks, placed by sampled suffix positions,
compared word by word with the text, and merged to spans to remove.

The work is one pass over the documents without a shuffle.  The benchmark is
read in blocks of bounded size, each sent to all tasks; a larger benchmark means
more passes over the column of texts, not more memory: the documents are written
once with a row key, each further block leaves the few rows it hits, and those
are joined once before the last pass.

Defined results: a null text has no words; an item without words has no window;
items of equal id count once, a null id reads as the empty string; repeated rows
give repeated results; an empty benchmark hits nothing; columns of any name pass
through.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.llm import words as W
from tidelake.llm.fm_index import FMIndex
from tidelake.llm.runtime import free_name, stored

_SPAN = T.StructType([T.StructField("first", T.LongType(), False), T.StructField("end", T.LongType(), False)])
FOUND = T.StructType([T.StructField("n_words", T.LongType(), False), T.StructField("n_hit", T.LongType(), False), T.StructField("items", T.ArrayType(T.StringType(), False), False), T.StructField("spans", T.ArrayType(_SPAN, False), False)])
_ARROW = pa.struct([pa.field("n_words", pa.int64(), False), pa.field("n_hit", pa.int64(), False), pa.field("items", pa.list_(pa.field("element", pa.string(), False)), False), pa.field("spans", pa.list_(pa.field("element", pa.struct([pa.field("first", pa.int64(), False), pa.field("end", pa.int64(), False)]), False)), False)])

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def item_words(text: str | None) -> list[bytes]:
    """Words of a text: ASCII letters lower-cased, then runs of digits, letters and non-ASCII characters."""
    return _WORD.findall((text or "").encode().translate(W.LOWER.tobytes()))


@dataclass
class Block:
    """Windows of some items as rows of symbols, by length, and what tasks need to find them."""

    hashes: np.ndarray  # of the words, ascending
    words: list[bytes]  # in the same order; symbol k + 1 is words[k]
    windows: dict[int, np.ndarray]  # length -> rows of symbols
    items: dict[int, list[list[str]]]  # length -> ids that have the window


def block_of(items: list[tuple[str, str | None]], size: int = 13) -> Block:
    texts = [(i, item_words(t)) for i, t in items]
    vocabulary = sorted({w for _, ws in texts for w in ws})
    ends = np.cumsum([len(w) for w in vocabulary] or [0])
    hashes = W.span_hash(np.frombuffer(b"".join(vocabulary), np.uint8), ends - [len(w) for w in vocabulary], ends) if vocabulary else np.empty(0, np.uint64)
    order = np.argsort(hashes)
    vocabulary = [vocabulary[k] for k in order]
    symbol = {w: k + 1 for k, w in enumerate(vocabulary)}
    rows: dict[int, dict[tuple, set]] = {}
    for i, ws in texts:
        symbols = [symbol[w] for w in ws]
        length = min(size, len(ws))
        for k in range(len(ws) - length + 1 if ws else 0):
            rows.setdefault(length, {}).setdefault(tuple(symbols[k : k + length]), set()).add(i)
    return Block(hashes[order] if vocabulary else hashes, vocabulary, {k: np.array(list(v), np.int64) for k, v in rows.items()}, {k: [sorted(x) for x in v.values()] for k, v in rows.items()})


def _shard(block: Block, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, str]]]:
    """Of one shard: starts and ends of words, first word of each document, and (first word, end, item) of each hit."""
    data = W.LOWER[data]
    starts, ends, first = W.spans(data, offsets, W.ALNUM)
    hits: list[tuple[int, int, str]] = []
    if not len(starts) or not block.words:
        return starts, ends, first, hits
    hashes = W.span_hash(data, starts, ends)
    at = np.minimum(np.searchsorted(block.hashes, hashes), len(block.hashes) - 1)
    symbols = np.where(block.hashes[at] == hashes, at + 1, 0)
    known = symbols > 0
    opens, closes = known.copy(), known.copy()
    opens[1:] &= ~known[:-1]
    closes[:-1] &= ~known[1:]
    edge = first[(first > 0) & (first < len(symbols))]
    opens[edge] = known[edge]
    closes[edge - 1] = known[edge - 1]
    lo, hi = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    long = hi - lo >= min(block.windows)
    lo, hi = lo[long], hi[long]
    if not len(lo):
        return starts, ends, first, hits
    lengths = hi - lo
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    places = np.arange(lengths.sum()) + np.repeat(lo - begin, lengths)
    index = FMIndex(symbols[places], begin, len(block.words))
    for length, rows in block.windows.items():
        low, high = index.search(rows)
        for k in np.flatnonzero(low < high):
            word = [block.words[s - 1] for s in rows[k]]
            for p in places[index.locate(np.arange(low[k], high[k]))].tolist():
                if all(data[starts[p + j] : ends[p + j]].tobytes() == word[j] for j in range(length)):
                    hits += ((p, p + length, item) for item in block.items[length][k])
    return starts, ends, first, hits


def _scan(column: pa.Array, block: Block, prior: list | None, shard_bytes: int) -> pa.Array:
    out = []
    for i, data, offsets in W.slices(column, shard_bytes):
        starts, ends, first, hits = _shard(block, data, offsets)
        counts = np.diff(first)
        base = len(out)
        found = [{"n_words": n, "n_hit": 0, "items": [], "spans": []} for n in counts.tolist()]
        by_doc: dict[int, list] = {}
        for hit in hits:
            by_doc.setdefault(int(np.searchsorted(first, hit[0], "right")) - 1, []).append(hit)
        before = prior[i : i + len(found)] if prior else []
        for doc in set(by_doc) | {k for k, was in enumerate(before) if was}:
            was = before[doc] if before and before[doc] else {"items": [], "spans": []}
            own = by_doc.get(doc, [])
            spans = [(a - int(first[doc]), b - int(first[doc])) for a, b, _ in own] + [(s["first"], s["end"]) for s in was["spans"]]
            merged: list[list[int]] = []
            for a, b in sorted(spans):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            found[doc] |= {"n_hit": sum(b - a for a, b in merged), "items": sorted({x for *_, x in own} | set(was["items"])), "spans": [{"first": a, "end": b} for a, b in merged]}
        assert base == i
        out += found
    return pa.array(out, _ARROW)


def find(docs: DataFrame, benchmark: DataFrame, size: int = 13, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = 16 << 20, shard_bytes: int = 4 << 20) -> DataFrame:
    """``docs`` with a struct column ``contamination`` (underscores in front if the
    name is taken): words, words hit, ids of items found, and merged spans of hit words."""
    name = free_name(docs, "contamination")
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.col(item_text).alias("words"))
    total = items.agg(F.sum(F.octet_length("words") + F.octet_length("id"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1

    def scanned(rows: DataFrame, k: int, keep: list[str], prior: str | None = None) -> DataFrame:
        """Columns ``keep`` of rows, and what block ``k`` adds to the hits in ``prior``."""
        own = items.where(F.pmod(F.xxhash64("id", "words"), F.lit(blocks)) == k) if blocks > 1 else items
        block = docs.sparkSession.sparkContext.broadcast(block_of([tuple(r) for r in own.collect()], size))
        at, places = rows.columns.index(text), [rows.columns.index(c) for c in keep]
        hits = rows.columns.index(prior) if prior else None

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                before = None if hits is None else batch.column(hits).to_pylist()
                found = _scan(batch.column(at), block.value, before, shard_bytes)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in places), found], names=[*keep, name])

        return rows.mapInArrow(scan, T.StructType([*(rows.schema[c] for c in keep), T.StructField(name, FOUND, False)]))

    if blocks == 1:
        return scanned(docs, 0, docs.columns)
    key, prior = free_name(docs, "_row"), free_name(docs, "_prior")
    keyed = stored(docs.withColumn(key, F.monotonically_increasing_id()))  # written, so that a row keeps its key
    texts, hit = keyed.select(key, text), None
    for k in range(1, blocks):
        mine = stored(scanned(texts, k, [key]).where(F.col(name)["n_hit"] > 0))
        hit = mine if hit is None else hit.unionByName(mine)
    merged = F.struct(*[F.flatten(F.collect_list(F.col(name)[c])).alias(c) for c in ("items", "spans")])
    return scanned(keyed.join(hit.groupBy(key).agg(merged.alias(prior)), key, "left"), 0, docs.columns, prior)


def contaminated(found: F.Column) -> F.Column:
    """One word in twenty, or more, lies in a window of the benchmark."""
    return (found["n_hit"] > 0) & (20 * found["n_hit"] >= found["n_words"])


def items_digest(items: list[str]) -> str:
    """SHA-256 of sorted item ids, comma-joined."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    name = free_name(docs, "contamination")
    return find(docs, benchmark, **options).where(~contaminated(F.col(name))).select(*docs.columns)


def oracle(size: int = 13, docs: str = "documents", benchmark: str = "benchmark") -> str:
    """The digest of ``find`` as SQL for DuckDB: windows of words joined as texts."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""with d as (select row_number() over () as uid, doc_id, {words} as w from {docs}),
    b as (select coalesce(cast(item_id as varchar), '') as id, {words} as w from {benchmark}),
    items as (select distinct id, least({size}, len(w)) as m, unnest([array_to_string(w[p : p + least({size}, len(w)) - 1], ' ') for p in range(1, len(w) - least({size}, len(w)) + 2)]) as g from b where len(w) > 0),
    sizes as (select distinct m from items),
    runs as (select uid, m, unnest(range(1, len(w) - m + 2)) as p, w from d, sizes where len(w) >= m),
    hits as (select distinct uid, p, m, id from (select uid, p, m, array_to_string(w[p : p + m - 1], ' ') as g from runs) join items using (m, g)),
    covered as (select uid, count(distinct place) as n_hit from (select uid, unnest(range(p, p + m)) as place from hits) group by uid),
    named as (select uid, count(distinct id) as n_items, string_agg(distinct id, ',' order by id) as ids from hits group by uid)
    select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
      coalesce(n_hit > 0 and 20 * n_hit >= len(w), false) as contaminated from d left join covered using (uid) left join named using (uid)"""
