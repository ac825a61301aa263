"""Metrics of streams as a table: what queries observed of each batch, and how they went."""

from __future__ import annotations

import json
import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: One row for each batch of a query; ``metrics`` is a JSON object of numbers by name.
PROGRESS = "query_id string, run_id string, query string, batch long, input_rows long, duration_ms long, watermark string, metrics string, error string"


def observed(df: DataFrame, name: str, **aggregates: Column) -> DataFrame:
    """Counts rows on their way; the listener records the counts of each batch under ``name``."""
    return df.observe(name, *(a.alias(k) for k, a in aggregates.items()))


class Listener(StreamingQueryListener):
    """Takes the progress of all queries of a session; ``take`` hands over what has come since."""

    def __init__(self) -> None:
        self._rows: list[tuple] = []
        self._lock = threading.Lock()
        self._open: set[str] = set()
        self.quiet = threading.Condition(self._lock)

    def onQueryStarted(self, event) -> None:
        with self._lock:
            self._open.add(str(event.runId))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = {f"{name}.{k}": v for name, row in p.observedMetrics.items() for k, v in row.asDict().items()}
        row = (str(p.id), str(p.runId), p.name, p.batchId, p.numInputRows, p.durationMs.get("triggerExecution"), p.eventTime.get("watermark"), json.dumps(seen, default=str), None)
        with self._lock:
            self._rows.append(row)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            if event.exception:
                self._rows.append((str(event.id), str(event.runId), None, None, None, None, None, "{}", event.exception))
            self._open.discard(str(event.runId))
            self.quiet.notify_all()

    def settled(self, seconds: float = 30.0) -> None:
        """Waits until each query that began has told its end; events come some time after the work."""
        with self._lock:
            self.quiet.wait_for(lambda: not self._open, seconds)

    def take(self) -> list[tuple]:
        with self._lock:
            rows, self._rows = self._rows, []
        return rows


def write(spark: SparkSession, listener: Listener, path: str) -> None:
    """Adds what the listener has to a table (a row for each batch, so a few)."""
    rows = listener.take()
    if rows:
        spark.createDataFrame(rows, PROGRESS).coalesce(1).write.mode("append").parquet(path)


@contextmanager
def recorded(spark: SparkSession, path: str) -> Iterator[Listener]:
    """Records the progress of the queries that run inside."""
    listener = Listener()
    spark.streams.addListener(listener)
    try:
        yield listener
    finally:
        listener.settled()
        spark.streams.removeListener(listener)
        write(spark, listener, path)


def totals(progress: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Sums of what the batches observed under a name; a batch told twice counts once."""
    once = progress.where("error is null").groupBy("query_id", "batch").agg(F.max_by("metrics", "duration_ms").alias("metrics"))
    # The names of metrics have dots, so they are read as a map.
    seen = F.from_json("metrics", "map<string,string>")
    return once.select(seen.alias("m")).agg(*(F.sum(F.try_element_at("m", F.lit(f"{name}.{k}")).cast("long")).alias(k) for k in keys)).select(F.lit(name).alias("stream"), *keys)
