"""Prefix trie of conversations: every shared beginning once, with what sharing it saves.

A conversation is a row of turn ids (MD5 of role and text).  Rows are dealt by range
and sorted by their ids and then by conversation, so all members of a node stand side
by side, and a conversation that very many share is dealt out too, by its number.
Within a shard, blocks of rows become padded matrices of turn ids: ``np.lexsort`` orders
them, columns that differ from the row above are OR-accumulated from the left, which
marks where a node starts at each depth, and ``reduceat`` adds up every depth.

Each block knows how many turns its first row has in common with the row before it and
its last row with the row after it (one number for each shard, found first).  So starts,
leaves and tokens are counted once only, and the nodes that reach over a block's edge are
plain sums, minima and, in order, lists of ends: these few rows alone are shuffled and
recombined.  Nodes inside a block are complete at once.

Memory: a block has at most ``CELLS`` cells, or one conversation; a conversation takes 20
bytes a turn in one row.  The list of conversations that end at one node is hashed as a
stream.  Texts do not leave the first stage but to break ties.

Defined results: turns are in order of ``turn`` (nulls first), ties by role and text; a
null role or text is empty; rows without a conversation id belong to none and are left
out; an empty table has no nodes; repeated rows are turns of their own; other columns
are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.llm.runtime import cut, joinable

#: Cells of a block's matrix.
CELLS = 1 << 20
#: Bytes of a turn's id.
WIDTH = 16
EMPTY = hashlib.sha256(b"").hexdigest()

NODE = T.StructType([T.StructField(c, T.LongType()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")] + [T.StructField("ends_sha256", T.StringType())])
#: With what recombines the nodes that reach over the edge of a block: their id, their parent's, the order of blocks, and their ends.
PART = T.StructType([*NODE.fields, T.StructField("node", T.BinaryType()), T.StructField("parent", T.BinaryType()), T.StructField("shard", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("ends", T.BinaryType())])


def turn_rows(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(c, turns)``: for each conversation the ids and words of its turns, in order."""
    said = conversations.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("c"), F.col(turn).alias("t"), F.coalesce(F.col(role), F.lit("")).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("x"))
    said = said.withColumn("base", F.col("c") - F.col("c") % 20).repartition("base")
    order = Window.partitionBy("base", "c").orderBy(F.col("t").asc_nulls_first(), "r", "x")
    turn_id = F.md5(F.concat(F.octet_length("r").cast("string"), F.lit(":"), "r", "x"))
    one = said.select("base", "c", F.row_number().over(order).alias("k"), turn_id.alias("id"), F.regexp_count("x", F.lit(r"[^\x20\x09-\x0D]+")).alias("n"))
    return one.groupBy("base", "c").agg(F.array_sort(F.collect_list(F.struct("k", "id", "n"))).alias("turns"))


def grafted(rows: DataFrame, shared: int = 4, family: int = 20) -> DataFrame:
    """Conversations that begin as the first of their family (of ``family`` numbers): with its first h turns in
    place of their own first h, where h is the CRC of their number modulo ``shared``."""
    h = (F.crc32(F.col("c").cast("string")) % shared).cast("int")
    first = F.first(F.when(F.col("c") == F.col("base"), F.slice("turns", 1, shared)), ignorenulls=True).over(Window.partitionBy("base"))
    heads = F.coalesce(first, F.array().cast(rows.schema["turns"].dataType))
    own = F.when(F.size("turns") > h, F.slice(F.col("turns"), h + 1, F.greatest(F.size("turns") - h, F.lit(1)))).otherwise(F.array())
    return rows.select("c", F.concat(F.slice(heads, F.lit(1), h), own).alias("turns"))


def nodes(rows: DataFrame) -> DataFrame:
    """All nodes of the trie of ``rows(c, turns)``; ``turns`` has structs with ``id`` (hex digits) and ``n`` (words)."""
    keyed = rows.select(F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), "")).alias("key"), "c", F.transform("turns", lambda t: t["n"]).alias("n"))
    keyed = cut(keyed)  # the range dealing reads it twice
    shards = cut(keyed.repartitionByRange("key", "c").sortWithinPartitions("key", "c"))
    edges = shards.select("key").mapInArrow(_edges, "shard int, first binary, last binary")
    common = {r[0]: (r[1], r[2]) for r in edges.repartition(1).sortWithinPartitions("shard").mapInArrow(_common, "shard int, before int, after int").collect()}
    sent = shards.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        return _shard(batches, shard, *sent.value.get(shard, (-1, -1)))

    found = cut(shards.mapInArrow(run, PART))
    parts = found.where("node is not null")
    whole = parts.repartition("node").sortWithinPartitions("node", "shard", "block").mapInArrow(_recombined, PART)
    every = cut(found.where("node is null").unionByName(whole))
    parents = joinable(every.where("node is not null").select(F.col("node").alias("parent"), F.col("conv_id").alias("_of")))
    waiting = every.where("parent is not null").join(parents, "parent", "left").withColumn("parent_conv_id", F.col("_of"))
    return every.where("parent is null").select(*NODE.names).unionByName(waiting.select(*NODE.names))


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First and last key of a shard that has rows."""
    first = last = None
    for batch in batches:
        if batch.num_rows:
            first = batch.column(0)[0].as_py() if first is None else first
            last = batch.column(0)[batch.num_rows - 1].as_py()
    if first is not None:
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([first], pa.binary()), pa.array([last], pa.binary())], ["shard", "first", "last"])


def _shared(a: bytes, b: bytes) -> int:
    """Turns that two keys begin with alike."""
    n = min(len(a), len(b)) // WIDTH
    x, y = (np.frombuffer(k, np.uint64, 2 * n).reshape(n, 2) for k in (a, b))
    odd = np.flatnonzero((x != y).any(axis=1))
    return int(odd[0]) if len(odd) else n


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each shard, in order: the turns that its first row shares with the row before, and its last with the row after (-1: none)."""
    held: tuple[int, int, bytes] | None = None
    row = lambda *r: pa.RecordBatch.from_arrays([pa.array([x], pa.int32()) for x in r], ["shard", "before", "after"])
    for batch in batches:
        for shard, first, last in zip(*(c.to_pylist() for c in batch.columns)):
            before = -1
            if held:
                before = _shared(held[2], first)
                yield row(held[0], held[1], before)
            held = shard, before, last
    if held:
        yield row(held[0], held[1], -1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray, list[np.ndarray]]]:
    """Consecutive rows (keys, conversations, words of turns) whose padded matrix has ``CELLS`` cells at most."""
    keys: list[bytes] = []
    convs: list[int] = []
    words: list[np.ndarray] = []
    widest = 1
    for batch in batches:
        ks, cs, ns = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
        at, flat = np.asarray(ns.offsets), np.asarray(ns.flatten())
        at = at - at[0] if len(at) else at
        for i, (k, c) in enumerate(zip(ks, cs)):
            width = max(widest, len(k) // WIDTH)
            if keys and (len(keys) + 1) * width > CELLS:
                yield keys, np.array(convs, np.int64), words
                keys, convs, words, width = [], [], [], max(1, len(k) // WIDTH)
            widest = width
            keys.append(k)
            convs.append(c)
            words.append(flat[at[i] : at[i + 1]])
    if keys:
        yield keys, np.array(convs, np.int64), words


def _shard(batches: Iterator[pa.RecordBatch], shard: int, before: int, after: int) -> Iterator[pa.RecordBatch]:
    """Nodes of all blocks of a shard; ``before`` and ``after`` are what its edges share with its neighbours."""
    held, number = None, 0
    for block in _blocks(batches):
        if held:
            shared = _shared(held[0][-1], block[0][0])
            yield _block(*held, before, shared, shard, number)
            before, number = shared, number + 1
        held = block
    if held:
        yield _block(*held, before, after, shard, number)


def _matrix(keys: list[bytes], convs: np.ndarray, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Padded matrices of turn ids (dense, -1 behind the end) and of words, rows in order; lengths and conversations."""
    lengths = np.array([len(k) // WIDTH for k in keys])
    width = int(lengths.max())
    inside = np.arange(width) < lengths[:, None]
    ids = np.full(inside.shape, -1, np.int64)
    tokens = np.zeros(inside.shape, np.int64)
    if width:
        # Big-endian halves order as the bytes do.
        halves = np.frombuffer(b"".join(keys), ">u8").reshape(-1, 2).astype(np.uint64)
        by = np.lexsort((halves[:, 1], halves[:, 0]))
        new = np.ones(len(by), bool)
        new[1:] = (halves[by][1:] != halves[by][:-1]).any(axis=1)
        dense = np.empty(len(by), np.int64)
        dense[by] = np.cumsum(new) - 1
        ids[inside], tokens[inside] = dense, np.concatenate(words)
    order = np.lexsort((convs, *(ids[:, d] for d in reversed(range(width)))))
    return ids[order], tokens[order], lengths[order], convs[order]


def _block(keys: list[bytes], convs: np.ndarray, words: list[np.ndarray], before: int, after: int, shard: int, number: int) -> pa.RecordBatch:
    """Nodes of a block.  Those at its edges that go on in another one have an id and their part of each figure."""
    ids, tokens, lengths, convs = _matrix(keys, convs, words)
    n, width = ids.shape
    starts = np.ones((n, width + 1), bool)  # column d: does a node of depth d + 1 start in this row?  The last is never one.
    if width:
        np.logical_or.accumulate(ids[1:] != ids[:-1], axis=1, out=starts[1:, :width])
        starts[0, :width] = np.arange(width) >= before
    starts[:, width] = False
    inside = np.arange(width + 1) < lengths[:, None]
    begins = starts & inside
    shares = np.minimum((~starts[:, :width]).sum(axis=1), lengths)  # turns in common with the row above
    below = np.append(shares[1:], after)
    leaf = (below < lengths).astype(np.int64)
    if after < 0:
        leaf[-1] = 1
    total = tokens.sum(axis=1)
    sums = np.cumsum(tokens, axis=1) if width else tokens
    upto = lambda rows, d: sums[rows, d - 1] if d > 0 else np.zeros(len(rows), np.int64)
    new = total - np.where(shares > 0, sums[np.arange(n), np.maximum(shares - 1, 0)], 0) if width else total
    first_ids, last_ids = _path(keys[0], before), _path(keys[-1], after)

    out: dict[str, list] = {f.name: [] for f in PART}
    above = above_conv = None
    rows = np.arange(n)
    for d in range(width + 1):
        rows = rows[lengths[rows] >= d]
        fresh = starts[rows, d - 1] if d else np.arange(len(rows)) == 0
        at = np.flatnonzero(fresh | (np.arange(len(rows)) == 0))
        top = rows[at]
        begun = begins[top, d - 1] if d else np.array([before < 0])
        add = lambda values: np.add.reduceat(values[rows], at)  # noqa: E731, B023
        members = np.diff(np.append(at, len(rows)))
        smallest = np.minimum.reduceat(convs[rows], at)
        prior = upto(top, d - 1)  # all members have the same turns before
        distinct = add(new) - new[top] + np.where(begun, total[top] - prior, new[top])
        saved = add(total) - members * prior - distinct
        over = np.zeros(len(at), bool)
        over[0] |= d <= before
        over[-1] |= d <= after and lengths[-1] >= d
        node: list[bytes | None] = [None] * len(at)
        if over[-1] and d <= after:
            node[-1] = last_ids[d]
        if over[0] and d <= before:
            node[0] = first_ids[d]
        if d:
            up = np.searchsorted(above, top, "right") - 1
            parent = [above_node[k] for k in up]
            parent_conv = [None if p is not None else c for p, c in zip(parent, above_conv[up].tolist())]
        else:
            parent, parent_conv = [None], [None]
        ends = add((lengths == d).astype(np.int64))
        digests: list[str] = [EMPTY] * len(at)
        lists: list[bytes | None] = [None] * len(at)
        for k in np.flatnonzero((ends > 0) | over):
            joined = ",".join(map(str, convs[rows[at[k] : at[k] + ends[k]]].tolist())).encode()
            if node[k] is None:
                digests[k] = hashlib.sha256(joined).hexdigest()
            else:
                lists[k] = joined
        for name, values in (("conv_id", smallest), ("depth", np.full(len(at), d)), ("parent_conv_id", parent_conv), ("n_convs", members), ("n_children", add(begins[:, d].astype(np.int64))), ("n_leaves", add(leaf)), ("saved_tokens", saved), ("ends_sha256", digests), ("node", node), ("parent", parent), ("ends", lists)):
            out[name].extend(values.tolist() if isinstance(values, np.ndarray) else values)
        above, above_node, above_conv = top, node, smallest
    size = len(out["depth"])
    out["shard"], out["block"] = [shard] * size, [number] * size
    return _batch(out)


def _batch(out: dict[str, list]) -> pa.RecordBatch:
    kinds = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.StringType(): pa.string(), T.BinaryType(): pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(out[f.name], kinds[f.dataType]) for f in PART], PART.names)


def _path(key: bytes, depth: int) -> list[bytes]:
    """Ids of a row's nodes from the root to a depth, each from all turns up to there."""
    state = hashlib.md5(b"root")
    out = [state.digest()]
    for d in range(max(depth, 0)):
        state.update(key[d * WIDTH : (d + 1) * WIDTH])
        out.append(state.digest())
    return out


def _recombined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each node from its parts, which come in the order of blocks."""
    held: dict | None = None
    digest, some = hashlib.sha256(), False

    def done() -> pa.RecordBatch:
        return _batch({k: [v] for k, v in {**held, "ends_sha256": digest.hexdigest(), "ends": None}.items()})

    for batch in batches:
        for part in batch.to_pylist():
            if held is None or part["node"] != held["node"]:
                if held is not None:
                    yield done()
                held, digest, some = part, hashlib.sha256(), False
            else:
                held["conv_id"] = min(held["conv_id"], part["conv_id"])
                for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                    held[c] += part[c]
            if part["ends"]:
                digest.update((b"," if some else b"") + part["ends"])
                some = True
    if held is not None:
        yield done()
