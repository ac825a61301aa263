"""Refreshes of a graph as change sets: files of the rows that are new, other or gone since the last one.

Folders below a path: ``changes/version=N/name=X/kind=added|changed|removed`` has CSV files with
the typed header of the loader (removed ones have ids only), ``hashes/version=N/name=X`` the id
and hash of each row, and ``manifest/version=N`` how many there were, for each name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.lineage import cut
from tidelake.sources import sinks

_MANIFEST = "version long, name string, added long, changed long, removed long"
_KINDS = ("added", "changed", "removed")


def _last_hashes(spark: SparkSession, path: str, name: str, version: int) -> DataFrame:
    """Ids and hashes after the newest version before one that changed anything; empty at first."""
    if sinks.exists(spark, f"{path}/manifest"):
        before = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest/*").where((F.col("name") == name) & (F.col("version") < version) & (F.col("added") + F.col("changed") + F.col("removed") > 0)).agg(F.max("version")).first()[0]
        if before is not None:
            return spark.read.schema("id string, hash long").parquet(f"{path}/hashes/version={before}/name={name}")
    return spark.createDataFrame([], "id string, hash long")


def export_changes(frames: dict[str, DataFrame], path: str, version: int) -> None:
    """Writes what changed in each of ``frames`` (rows of ``graph.bulk_vertices`` or ``bulk_edges``, each with an ``~id`` of
    its own) since the version before.  Only ids and hashes are shuffled, and a frame without changes writes no files."""
    found = []
    for name, rows in frames.items():
        spark = rows.sparkSession
        hashed = rows.withColumns({"id": F.col("~id"), "hash": F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])})
        last = _last_hashes(spark, path, name, version).withColumnRenamed("hash", "was")
        kind = F.when(F.col("was").isNull(), "added").when(F.col("hash").isNull(), "removed").when(F.col("hash") != F.col("was"), "changed")
        told = cut(hashed.select("id", "hash").join(last, "id", "full").select("id", kind.alias("kind")).where("kind is not null"))
        n = {r["kind"]: r["count"] for r in told.groupBy("kind").count().collect()}
        base = f"{path}/changes/version={version}/name={name}"
        for k in ("added", "changed"):
            if n.get(k):
                sinks.graph_csv(rows.join(told.where(F.col("kind") == k).select(F.col("id").alias("~id")), "~id", "left_semi"), f"{base}/kind={k}")
        if n.get("removed"):
            sinks.graph_csv(told.where("kind = 'removed'").select(F.col("id").alias("~id")), f"{base}/kind=removed")
        if n:
            hashed.select("id", "hash").write.mode("overwrite").parquet(f"{path}/hashes/version={version}/name={name}")
        found.append((version, name, *(n.get(k, 0) for k in _KINDS)))
    # The version counts from here on; one that breaks off before is written again.
    spark.createDataFrame(found, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version={version}")


def versions(spark: SparkSession, path: str) -> DataFrame:
    """The manifest: rows added, changed and removed by version and name."""
    return spark.read.schema(_MANIFEST).parquet(f"{path}/manifest/*")


def applied(spark: SparkSession, path: str, name: str, columns: list[str]) -> DataFrame:
    """All change sets of a name in order of their versions: what a loader that took each of them has, as text."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    every = None
    for version, _, *counts in versions(spark, path).where(F.col("name") == name).orderBy("version").collect():
        for kind, n in zip(_KINDS, counts):
            if n:
                own = spark.read.schema(schema if kind != "removed" else T.StructType(schema.fields[:1])).option("header", True).csv(f"{path}/changes/version={version}/name={name}/kind={kind}")
                own = own.withColumns({"_version": F.lit(version), "_there": F.lit(kind != "removed")})
                every = own if every is None else every.unionByName(own, allowMissingColumns=True)
    if every is None:
        return spark.createDataFrame([], schema)
    last = every.groupBy("~id").agg(F.max_by(F.struct("_there", *[F.col(f"`{c}`") for c in columns]), "_version").alias("_r"))
    return last.where("_r._there").select(*[F.col(f"_r.`{c}`").alias(c) for c in columns])
