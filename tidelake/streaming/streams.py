"""Streaming forms: ingest, late rows, idempotency, ordered positions, lag and rapid transfers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidelake.functions.folds import fold_in_order
from tidelake.operators import events, silver
from tidelake.sources import compacted, graph_files, sinks


def parquet_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the Parquet files of a folder or a name with wildcards."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


_STORE = "spark.sql.streaming.stateStore.providerClass"


def start(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", every: str | None = None, stateful: bool = False) -> StreamingQuery:
    """Runs ``write`` on each batch: over all that is there and then stops, or at an interval.

    ``stateful``: for a stream with a stateful processor, whose state RocksDB keeps."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    conf, before = df.sparkSession.conf, df.sparkSession.conf.get(_STORE, None)
    if stateful:
        conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return writer.start()  # the query keeps the settings that it starts with
    finally:
        if stateful:
            conf.unset(_STORE) if before is None else conf.set(_STORE, before)


def batch_folder(path: str) -> Callable[[DataFrame, int], None]:
    """Writes each batch to a folder of its number, so that a batch run twice is there once."""
    return lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def tick_ingest(records: DataFrame, bronze: str, dead: str, log: str, checkpoint: str, ingested: Column | None = None) -> StreamingQuery:
    """Raw ticks to bronze by source and hour, the invalid ones to dead letters, and one event for each source."""
    ingested = F.current_timestamp() if ingested is None else ingested

    def write(df: DataFrame, batch: int) -> None:
        flagged = df.withColumn("errors", silver.record_errors()).persist()
        try:
            valid = silver.process_records(flagged.where(F.size("errors") == 0).drop("errors"), ingested)
            rows = sinks.with_time_parts(valid.withColumns({"source": F.col("source_id"), "batch": F.lit(batch)}), "ingestion_ts")
            rows.write.partitionBy("batch", "source", "year", "month", "day", "hour").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(bronze)
            flagged.where(F.size("errors") > 0).write.mode("overwrite").parquet(f"{dead}/batch={batch}")
            counts = valid.groupBy("source_id").agg(F.count("*").alias("record_count"))
            counts = counts.withColumns({"partition_path": F.concat(F.lit(f"batch={batch}/source="), "source_id"), "ingestion_timestamp": F.date_format(ingested, "yyyy-MM-dd'T'HH:mm:ss'Z'")})
            sinks.event_log(counts, "market-data", "MarketDataIngested", ["source_id", "partition_path", "record_count", "ingestion_timestamp"]).write.mode("overwrite").parquet(f"{log}/batch={batch}")
        finally:
            flagged.unpersist()

    return start(records, write, checkpoint)


def split_late(df: DataFrame, ts: str, arrival: str, hours: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows in time, those that came more than ``hours`` after their time, and those without a time or an arrival."""
    late = F.unix_micros(F.col(arrival)) - F.unix_micros(F.col(ts)) > hours * 3_600_000_000
    return df.where(~late), df.where(late), df.where(late.isNull())


def late_split(rows: DataFrame, ts: str, source: str, hours: int, path: str, checkpoint: str) -> StreamingQuery:
    """A stream's rows in three folders below ``path``: ``kind=in_time``, ``kind=late`` (more than ``hours`` behind
    the newest row that their source had before their batch) and ``kind=undated`` (no time).

    The newest time of each source is a small table, one copy for each batch, joined with
    the rows of the next; so a source with most of the rows is no state in one task."""
    kept = T.StructType([T.StructField(source, rows.schema[source].dataType), T.StructField("newest", T.TimestampType())])

    def write(df: DataFrame, batch: int) -> None:
        spark, df = df.sparkSession, df.persist()
        try:
            known = spark.read.schema(kept).parquet(f"{path}/newest/batch={batch - 1}") if batch else spark.createDataFrame([], kept)
            behind = F.unix_micros("newest") - F.unix_micros(F.col(ts)) > hours * 3_600_000_000
            kind = F.when(F.col(ts).isNull(), "undated").when(behind, "late").otherwise("in_time")
            dealt = df.join(known.withColumnRenamed(source, "_source"), F.col(source).eqNullSafe(F.col("_source")), "left")
            dealt.select(*df.columns, F.lit(batch).alias("batch"), kind.alias("kind")).write.partitionBy("kind", "batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{path}/rows")
            every = known.unionByName(df.select(source, F.col(ts).alias("newest")))
            every.groupBy(source).agg(F.max("newest").alias("newest")).write.mode("overwrite").parquet(f"{path}/newest/batch={batch}")
        finally:
            df.unpersist()

    return start(rows, write, checkpoint)


def idempotent(df: DataFrame, ts: str = "ts", key: str = "idempotency_key", ttl: str = "24 hours") -> DataFrame:
    """First row of each key within the time its key lives."""
    return df.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key])


def idempotent_batch(df: DataFrame, ts: str = "ts", key: str = "idempotency_key", hours: int = 24, ties: list[str] = ()) -> DataFrame:
    """The batch form, whole rows: those whose key did not occur in the ``hours`` before, by its last accepted row.

    A fold of each key's rows in order of time and ``ties`` (all other columns without) keeps the last
    accepted time.  Rows without a time have no order and are left out, as in the stream."""
    limit = hours * 3_600_000_000
    others = [c for c in df.columns if c != key]
    timed = df.where(F.col(ts).isNotNull()).withColumn("_m", F.unix_micros(F.col(ts)))

    def step(last: int | None, row: tuple) -> tuple[int | None, list[tuple]]:
        m = row[0]
        return (m, [row[1:]]) if last is None or m - last >= limit else (last, [])

    out = T.StructType([df.schema[c] for c in others])
    return fold_in_order(timed, [key], ["_m", *(ties or [c for c in others if c != ts])], ["_m", *others], out, lambda: None, step, lambda last: []).select(*df.columns)


def lag_windows(df: DataFrame, arrival: str, commit: str, seconds: int = 60, watermark: str = "5 minutes") -> DataFrame:
    """Largest lag in each window of arrival."""
    lag = F.unix_micros(F.col(arrival)) - F.unix_micros(F.col(commit))
    counted = df.withWatermark(arrival, watermark).groupBy(F.window(arrival, f"{seconds} seconds").alias("w")).agg((F.max(lag) / 1_000_000).alias("max_lag_seconds"), F.count("*").alias("changes"))
    return counted.select(F.col("w.start").alias("window_start"), "max_lag_seconds", "changes")


def rapid_windows(df: DataFrame, ts: str, key: str, length: str = "1 hour", slide: str = "10 minutes", watermark: str = "1 hour") -> DataFrame:
    """Rows of each key in sliding windows."""
    counted = df.withWatermark(ts, watermark).groupBy(key, F.window(ts, length, slide).alias("w")).agg(F.count("*").alias("n"))
    return counted.select(key, F.col("w.start").alias("window_start"), "n")


def outbox(orders: DataFrame, path: str, log: str, checkpoint: str) -> StreamingQuery:
    """Orders and their events under one batch number, so neither is there without the other after a retry."""

    def write(df: DataFrame, batch: int) -> None:
        rows = df.persist()
        try:
            rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")
            sinks.event_log(rows, "order-manager", "OrderCreated", rows.columns).write.mode("overwrite").parquet(f"{log}/batch={batch}")
        finally:
            rows.unpersist()

    return start(orders, write, checkpoint)


def graph_refresh(gold: DataFrame, frames: dict[str, DataFrame], path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Writes the bulk-load files of a graph anew, one folder for each of ``frames``, when gold has new rows
    (``every``: at most so often, as "15 minutes")."""

    def write(df: DataFrame, batch: int) -> None:
        if not df.isEmpty():
            for name, rows in frames.items():
                sinks.graph_csv(rows, f"{path}/{name}")

    return start(gold, write, checkpoint, every=every)


def graph_changes(gold: DataFrame, frames: dict[str, DataFrame], path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """When gold has new rows, writes what changed in the graph since the last time: a change set for each batch."""

    def write(df: DataFrame, batch: int) -> None:
        if not df.isEmpty():
            graph_files.export_changes(frames, path, batch)

    return start(gold, write, checkpoint, every=every)


def dead_letters(letters: DataFrame, path: str, log: str, checkpoint: str) -> StreamingQuery:
    """Dead letters with their context to a table, and for each of them an event."""

    def write(df: DataFrame, batch: int) -> None:
        rows = events.failure_context(df).persist()
        try:
            rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")
            events.dead_lettered(rows, F.current_timestamp()).write.mode("overwrite").parquet(f"{log}/batch={batch}")
        finally:
            rows.unpersist()

    return start(letters, write, checkpoint)


def follow_changes(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The changes after a full load, kept as they come, one folder for each batch; ``cdc.apply_changes``
    merges them with the load when it is read, so a batch costs its own rows only."""
    return start(changes, batch_folder(path), checkpoint)


def compacted_changes(changes: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str], buckets: int = 64, compact_every: int = 10) -> StreamingQuery:
    """The changes after a full load (batch -1), kept by buckets of keys and compacted every so many batches; ``compacted.current`` reads them."""

    def write(df: DataFrame, batch: int) -> None:
        compacted.append(df, path, keys, batch, buckets)
        if (batch + 1) % compact_every == 0:
            compacted.compact(df.sparkSession, path, changes.schema, keys, order)

    return start(changes, write, checkpoint)


def touched_days(ticks: DataFrame, recompute: Callable[[SparkSession, list], None], checkpoint: str) -> StreamingQuery:
    """On new ticks, recomputes the days they touch (a bounded list of dates)."""

    def write(df: DataFrame, batch: int) -> None:
        days = [r[0] for r in df.select("trade_date").distinct().orderBy("trade_date").collect()]
        if days:
            recompute(df.sparkSession, days)

    return start(ticks, write, checkpoint)


def collect_stream(df: DataFrame, mode: str, folder: str) -> DataFrame:
    """Runs a stream over all there is and reads what it wrote: for queries that end."""
    query = start(df, batch_folder(f"{folder}/out"), f"{folder}/checkpoint", mode)
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return df.sparkSession.read.parquet(f"{folder}/out").select(*df.columns)
