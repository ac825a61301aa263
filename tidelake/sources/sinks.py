"""Writers: partitions from each row, overwrites of touched partitions only, and small audit records."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.lineage import freed


def write_partitions(df: DataFrame, path: str, keys: list[str], sort: list[str] | None = None, derive: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Replaces exactly the partitions that ``df`` has.  Rows of a partition are brought together, and AQE
    splits a large one over several tasks and files of about ``spark.sql.adaptive.advisoryPartitionSizeInBytes``.
    ``derive`` adds columns of each row after that, so that they are not shuffled; it leaves ``keys`` as they are."""
    dealt = gathered(df, keys)
    if derive:
        dealt = derive(dealt)
    if sort:
        dealt = dealt.sortWithinPartitions(*keys, *sort)
    with freed(df.sparkSession):
        dealt.write.partitionBy(*keys).mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Is there a file or folder of this name, in whatever store it names?"""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def delete(spark: SparkSession, path: str) -> bool:
    """Deletes a file or folder; was it there?"""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def with_time_parts(df: DataFrame, ts: str) -> DataFrame:
    """Adds year, month, day and hour of a timestamp, each row its own."""
    return df.withColumns({"year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts), "hour": F.hour(ts)})


def gathered(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of one folder brought together, so that not each task leaves a small file in each folder; AQE splits large ones."""
    return df.hint("rebalance", *keys)


def append_bronze(df: DataFrame, path: str, ts: str = "ingestion_timestamp") -> None:
    """Ticks by source and hour."""
    keys = ["source", "year", "month", "day", "hour"]
    gathered(with_time_parts(df, ts).withColumn("source", F.col("source_id")), keys).write.partitionBy(*keys).mode("append").parquet(path)


def add_partition(spark: SparkSession, name: str, values: dict[str, object]) -> None:
    """Adds a partition to a catalog table unless it is there."""
    spec = ", ".join(f"{k}='{v}'" for k, v in values.items())
    spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS PARTITION ({spec})")


def write_rejects(df: DataFrame, path: str) -> None:
    """Rejected rows of all stages in one table."""
    keys = ["reject_stage", "trade_date"]
    gathered(df, keys).write.partitionBy(*keys).mode("append").parquet(path)


def json_row(spark: SparkSession, record: dict) -> DataFrame:
    """A nested record as one row, its fields typed as JSON has them."""
    text = json.dumps(record)
    kind = spark.range(1).select(F.schema_of_json(F.lit(text))).first()[0]
    return spark.range(1).select(F.from_json(F.lit(text), kind).alias("r")).select("r.*")


def append_event(spark: SparkSession, path: str, source: str, detail_type: str, detail: dict) -> None:
    """One domain event, added to a log."""
    row = json_row(spark, detail)
    event_log(row, source, detail_type, row.columns).write.mode("append").parquet(path)


def write_lineage(record: DataFrame, path: str) -> None:
    """One nested JSON record of a run."""
    record.coalesce(1).write.mode("append").json(path)


def retention_date(ts: Column, years: int = 7) -> Column:
    """Day until which a record is kept; from 29 February it is the 28th."""
    return F.add_months(ts.cast("date"), 12 * years)


def append_audit(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Append-only JSON by day with the day until which it must be kept."""
    out = df.withColumns({"retain_until": retention_date(F.col(ts)), "year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts)})
    keys = ["year", "month", "day"]
    gathered(out, keys).write.mode("append").partitionBy(*keys).json(path)


def event_log(df: DataFrame, source: str, detail_type: str, columns: list[str]) -> DataFrame:
    """Domain events: source, detail_type and a JSON detail of the given columns."""
    return df.select(F.lit(source).alias("source"), F.lit(detail_type).alias("detail_type"), F.to_json(F.struct(*columns)).alias("detail"))


def governance_decisions(decisions: DataFrame, path: str) -> None:
    """Decisions on models as JSON records, kept by model version and never overwritten."""
    decisions.write.mode("append").partitionBy("model_version").json(path)


def graph_csv(df: DataFrame, path: str) -> None:
    """Bulk-load files of vertices or edges (``graph.bulk_vertices``, ``graph.bulk_edges``), each with its typed header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def search_documents(df: DataFrame, key: str, ts: str, index: str) -> DataFrame:
    """One JSON document per row and the monthly index that it belongs to."""
    return df.select(F.col(key).cast("string").alias("id"), F.concat(F.lit(f"{index}-"), F.date_format(ts, "yyyy-MM")).alias("index"), F.to_json(F.struct(*df.columns)).alias("document"))
