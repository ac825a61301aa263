"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

1. Every row's small record (id, size, checksum) is kept per partition.
2. The driver draws how many rows each group of partitions sends to each target:
   the multivariate hypergeometric law, so that every permutation of all rows is
   equally likely given exact target sizes.  Partitions beyond ``max_groups`` are
   folded into groups, and each task splits its group's row of the matrix among
   the group's partitions by the same law, so the matrix stays small.
3. Each task permutes its records and deals them by its row of the matrix.
4. Records meet at their targets and are permuted again.

A target is a block of a shard, of at most ``block_rows`` rows where there are
no more than ``max_targets`` blocks; so one shard may be any size.  All sizes
differ by one at most.

The draws are exact at every size (``draw``).

Defined results: a null text has size 1 and checksum 0; null ids are rows like
any other; repeated rows take places of their own; columns of any name pass
through ``shuffle_into_shards``, whose own two are ``shard`` and ``slot`` (with
underscores in front if taken); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.llm.runtime import cut, free_name, stored


def target_sizes(rows: int, shards: int, block_rows: int, max_targets: int) -> list[tuple[int, int, int]]:
    """(shard, first slot, size) of each block; shard sizes, and block sizes in a shard, differ by one at most."""
    out = []
    for s in range(shards):
        size = rows // shards + (s < rows % shards)
        blocks = max(1, min(-(-size // block_rows), max_targets // shards))
        start = 0
        for b in range(blocks):
            part = size // blocks + (b < size % blocks)
            out.append((s, start, part))
            start += part
    return out


def _few(rng: np.random.Generator, room: np.ndarray, n: int) -> np.ndarray:
    """How many of ``n`` different places, drawn evenly from all, lie in each target."""
    upto = np.cumsum(room)
    if 2 * n > upto[-1]:
        return room - _few(rng, room, int(upto[-1]) - n)
    places = np.empty(0, np.int64)
    while len(places) < n:  # places drawn before are drawn again, so every set of n is as likely
        places = np.unique(np.concatenate([places, rng.integers(0, upto[-1], n - len(places))]))
    return np.bincount(np.searchsorted(upto, places, "right"), minlength=len(room))


def draw(rng: np.random.Generator, room: np.ndarray, n: int) -> np.ndarray:
    """A multivariate hypergeometric row, exact for tables of any size: ``n`` of all places without repetition.

    Each place is taken with the chance that takes ``n`` on average, which is a binomial
    number for each target.  Given how many there are, every set is as likely; so
    places too many, or missing, are drawn evenly from those taken, or not: about
    the square root of ``n`` of them."""
    total = int(room.sum())
    if not total or not n:
        return np.zeros(len(room), np.int64)
    out = rng.binomial(room, min(n / total, 1.0)).astype(np.int64)
    more = n - int(out.sum())
    return out + _few(rng, room - out, more) if more > 0 else out - _few(rng, out, -more) if more else out


def deal(rng: np.random.Generator, room: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many rows each source (of ``counts``) sends to each target (with ``room``); rows and columns sum exactly."""
    room = room.copy()
    out = np.zeros((len(counts), len(room)), np.int64)
    for i, n in enumerate(counts):
        out[i] = draw(rng, room, int(n))
        room -= out[i]
    return out


def _member_row(group_row: np.ndarray, members: list[tuple[int, int]], partition: int, seed: int) -> np.ndarray:
    """The row of one partition, from the row of its group."""
    rng = np.random.default_rng([seed, 2, members[0][0]])
    row = deal(rng, group_row, np.array([n for _, n in members]))
    return row[[p for p, _ in members].index(partition)]


def shuffle_into_shards(records: DataFrame, shards: int, seed: int = 0, block_rows: int = 1_000_000, max_targets: int = 4096, max_groups: int = 1024) -> DataFrame:
    """``records`` (of narrow rows: no texts) with columns ``shard`` and ``slot``, its place there from 0 without gaps."""
    part, target, lot, rank = (free_name(records, x) for x in ("partition", "target", "draw", "rank"))
    held = cut(records.withColumn(part, F.spark_partition_id()))
    counts = sorted((r[0], r[1]) for r in held.groupBy(part).count().collect())
    rows = sum(n for _, n in counts)
    targets = target_sizes(rows, shards, block_rows, max_targets)
    groups: dict[int, list[tuple[int, int]]] = {}
    for k, member in enumerate(counts):
        groups.setdefault(k % max_groups, []).append(member)
    matrix = deal(np.random.default_rng([seed, 1]), np.array([n for *_, n in targets]), np.array([sum(n for _, n in m) for m in groups.values()]))
    plan = {p: (members, matrix[g]) for g, members in groups.items() for p, _ in members}
    sent = held.sparkSession.sparkContext.broadcast(plan)
    names = [*records.columns, target, lot]

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        partitions = table.column(table.num_columns - 1).to_numpy()
        table = table.remove_column(table.num_columns - 1)
        for p in np.unique(partitions).tolist():
            at = np.flatnonzero(partitions == p)
            members, group_row = sent.value[p]
            row = _member_row(group_row, members, p, seed)
            rng = np.random.default_rng([seed, 3, p])
            at = rng.permutation(at)
            to = np.repeat(np.arange(len(row), dtype=np.int64), row)
            draws = pa.array(rng.integers(-(1 << 63), 1 << 63, len(at), np.int64))
            own = table.take(pa.array(at))
            yield from pa.Table.from_arrays([*own.columns, pa.array(to), draws], names=names).to_batches(10_000)

    fields = [*records.schema.fields, T.StructField(target, T.LongType()), T.StructField(lot, T.LongType())]
    moved = held.mapInArrow(scatter, T.StructType(fields))
    # Equal draws are as good as impossible; the other columns only make the order certain.
    order = Window.partitionBy(target).orderBy(lot, *(F.xxhash64(c) for c in records.columns))
    placed = moved.withColumn(rank, F.row_number().over(order).cast("long") - 1)
    known = {k: (s, start) for k, (s, start, _) in enumerate(targets)}
    shard_of = F.element_at(F.array(*[F.lit(known[k][0]) for k in range(len(targets))]), (F.col(target) + 1).cast("int"))
    start_of = F.element_at(F.array(*[F.lit(known[k][1]).cast("long") for k in range(len(targets))]), (F.col(target) + 1).cast("int"))
    return placed.select(*records.columns, shard_of.cast("int").alias(free_name(records, "shard")), (start_of + F.col(rank)).alias(free_name(records, "slot")))


def assign(docs: DataFrame, shards: int = 8, seed: int = 0, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Shard and slot of every document by the law ``rows``: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    body = F.coalesce(F.col(text), F.lit(""))
    records = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    placed = shuffle_into_shards(records, shards, seed, **options)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_order(docs: DataFrame, shards: int = 8, seed: int = 0, **options) -> DataFrame:
    """``docs`` with all their columns and the ``shard`` and ``slot`` of each, ready to be written by shard.

    Rows are numbered and written once; the numbers are dealt, and each row joins its number, so texts
    move once."""
    key, shard, slot = (free_name(docs, x) for x in ("row_key", "shard", "slot"))
    numbered = stored(docs.withColumn(key, F.monotonically_increasing_id()))
    places = shuffle_into_shards(numbered.select(F.col(key).alias("key")), shards, seed, **options)
    return numbered.join(places.withColumnsRenamed({"key": key, "shard": shard, "slot": slot}), key).select(*docs.columns, shard, slot)
