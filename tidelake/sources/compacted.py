"""A change feed compacted by buckets of keys: snapshots of touched buckets, and the tail of batches after them.

Folders below a path: ``log/batch=N/bucket=B`` has the changes of a batch as they came,
``snapshot/upto=N/bucket=B`` the last change of each key of a bucket up to a batch, and
``manifest/upto=N`` a row for each bucket that was written then.  A snapshot keeps deleted
keys with the order of their deletion, so that an older change that comes late does not
bring them back.  Batches and compactions that run again write the same folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.sources import sinks

_MANIFEST = "bucket int, upto long"


def append(changes: DataFrame, path: str, keys: list[str], batch: int, buckets: int = 64) -> None:
    """Keeps a batch of changes (columns, ``operation`` and what orders them).  A full load is batch -1, as insertions."""
    dealt = changes.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).hint("rebalance", "bucket")
    dealt.write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/log/batch={batch}")


def snapshots(spark: SparkSession, path: str) -> dict[int, int]:
    """The newest snapshot of each bucket: up to which batch (as many entries as buckets)."""
    if not sinks.exists(spark, f"{path}/manifest"):
        return {}
    rows = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest/*").groupBy("bucket").agg(F.max("upto")).collect()
    return {r[0]: r[1] for r in rows}


def _tail(spark: SparkSession, path: str, schema: T.StructType, held: dict[int, int]) -> DataFrame:
    """Changes after the snapshots of their buckets; the predicates are on folders, so earlier batches are not read."""
    log = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType())])).parquet(f"{path}/log")
    wanted = ~F.col("bucket").isin(list(held)) if held else F.lit(True)
    for upto in set(held.values()):
        wanted = wanted | F.col("bucket").isin([b for b, u in held.items() if u == upto]) & (F.col("batch") > upto)
    return log.where(wanted)


def _snapshot(spark: SparkSession, path: str, schema: T.StructType, held: dict[int, int]) -> DataFrame:
    kind = T.StructType([*schema.fields, T.StructField("upto", T.LongType()), T.StructField("bucket", T.IntegerType())])
    if not held:
        return spark.createDataFrame([], kind)
    folders = [f"{path}/snapshot/upto={u}/bucket={b}" for b, u in sorted(held.items())]
    return spark.read.schema(kind).option("basePath", f"{path}/snapshot").parquet(*folders)


def _last(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The last change of each key; a combinable maximum.  Changes that tie in order are told apart by their columns."""
    by = F.struct(*order, "operation", *[c for c in columns if c not in order])
    return rows.groupBy(*keys, "bucket").agg(F.max_by(F.struct(*columns), by).alias("_last")).select("bucket", "_last.*")


def compact(spark: SparkSession, path: str, schema: T.StructType, keys: list[str], order: list[str]) -> list[int]:
    """Merges the tail into new snapshots of the buckets it touches, which it returns; the others keep theirs."""
    held = snapshots(spark, path)
    tail = _tail(spark, path, schema, held)
    found = tail.select("bucket", "batch").groupBy("bucket").agg(F.max("batch").alias("batch")).collect()
    if not found:
        return []
    touched, upto = sorted(r["bucket"] for r in found), max(r["batch"] for r in found)
    before = _snapshot(spark, path, schema, {b: u for b, u in held.items() if b in touched})
    rows = before.drop("upto").unionByName(tail.drop("batch"))
    merged = _last(rows, keys, order, schema.names)
    merged.hint("rebalance", "bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/snapshot/upto={upto}")
    # The snapshots count from here on.
    spark.createDataFrame([(b, upto) for b in touched], _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/upto={upto}")
    return touched


def current(spark: SparkSession, path: str, schema: T.StructType, keys: list[str], order: list[str]) -> DataFrame:
    """Current rows: snapshots merged with the tail after them, without deleted keys."""
    held = snapshots(spark, path)
    rows = _snapshot(spark, path, schema, held).drop("upto").unionByName(_tail(spark, path, schema, held).drop("batch"))
    plain = [c for c in schema.names if c not in ("operation", *order)]
    return _last(rows, keys, order, schema.names).where("operation <> 'DELETE'").select(*plain)


def vacuum(spark: SparkSession, path: str) -> int:
    """Deletes snapshots that newer ones stand for, and returns how many; run it when no reader uses them any more."""
    held = snapshots(spark, path)
    every = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest/*").distinct().collect() if held else []
    old = [(r["bucket"], r["upto"]) for r in every if r["upto"] < held[r["bucket"]]]
    return sum(sinks.delete(spark, f"{path}/snapshot/upto={u}/bucket={b}") for b, u in old)
