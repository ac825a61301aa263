"""Domain events: routing, contracts, dead letters and the outbox."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.functions.columns import errors, missing
from tidelake.sources import sinks

# Which events go where; all others are only archived.
ROUTES = [
    ("market-data", "MarketDataIngested", "pipeline"),
    ("order-manager", "TradeExecuted", "trade-queue"),
    ("etl-engine", "PipelineExecutionFailed", "operations"),
    ("security", "ComplianceAlert", "security"),
    ("advisory-agent", "AdvisoryGenerated", "advisory-audit"),
]
# Fields that each kind of event must have, and sets that its fields are from.
CONTRACTS: dict[str, tuple[list[str], dict[str, list[str]]]] = {
    "MarketDataIngested": (["source_id", "partition_path", "record_count", "ingestion_timestamp"], {}),
    "TradeExecuted": (["order_id", "client_id", "instrument_id", "side", "quantity", "executed_price", "execution_timestamp"], {"side": ["BUY", "SELL"]}),
    "PipelineExecutionFailed": (["job_id", "pipeline_stage", "error_type", "error_message", "retry_count", "failure_timestamp"], {"pipeline_stage": ["bronze-to-silver", "silver-to-gold"]}),
    "ComplianceAlert": (["alert_id", "severity", "alert_type", "description", "detection_timestamp"], {"severity": ["HIGH", "MEDIUM", "LOW"]}),
    "AdvisoryGenerated": (["recommendation_id", "client_id", "model_version", "confidence_score", "timestamp"], {}),
}


def route(events: DataFrame) -> DataFrame:
    """Events with their target; those of no route go to ``archive``."""
    spark: SparkSession = events.sparkSession
    rules = F.broadcast(spark.createDataFrame(ROUTES, "source string, detail_type string, target string"))  # a fixed table
    return events.join(rules, ["source", "detail_type"], "left").withColumn("target", F.coalesce("target", F.lit("archive")))


def contract_errors(detail_type: Column, detail: Column) -> Column:
    """What an event's JSON lacks or has wrong by the contract of its kind; unknown kinds have no contract."""
    fields = F.from_json(detail, "map<string,string>")
    out = F.array().cast("array<string>")
    for kind, (required, sets) in CONTRACTS.items():
        rules = [(missing(F.try_element_at(fields, F.lit(f))), f"{f}: required") for f in required]
        rules += [(~F.try_element_at(fields, F.lit(f)).isin(allowed), f"{f}: not allowed") for f, allowed in sets.items()]
        out = F.when(detail_type == kind, errors(*rules)).otherwise(out)
    return F.when(fields.isNull(), F.array(F.lit("detail: not JSON"))).otherwise(out)


def failure_context(letters: DataFrame) -> DataFrame:
    """Of dead letters: queue, reason, how often received, and the first 500 characters."""
    return letters.select(
        "message_id",
        F.coalesce("original_queue", F.lit("unknown")).alias("original_queue"),
        F.coalesce("error_message", F.lit("unknown")).alias("failure_reason"),
        F.coalesce(F.col("receive_count").try_cast("int"), F.lit(0)).alias("receive_count"),
        F.substring("body", 1, 500).alias("preview"),
    )


def letters_by_queue(letters: DataFrame) -> DataFrame:
    """Dead letters of each queue."""
    return letters.groupBy("original_queue").agg(F.count("*").alias("messages"), F.max("receive_count").alias("most_received"))


def backlog(outbox: DataFrame, published: DataFrame, key: str = "event_id") -> DataFrame:
    """Events of the outbox that were not published yet."""
    return outbox.join(published.select(key), key, "left_anti")


def by_source(records: DataFrame, bad: Column, source: str = "source_id") -> DataFrame:
    """Records of each source: all, good and bad."""
    failed = F.count_if(F.coalesce(bad, F.lit(False)))
    return records.groupBy(source).agg(F.count("*").alias("records"), failed.alias("failed")).withColumn("succeeded", F.col("records") - F.col("failed"))


def dead_lettered(letters: DataFrame, at: Column) -> DataFrame:
    """An event for each letter of ``failure_context``: where it was, why it failed and how often it was tried."""
    rows = letters.select("original_queue", "failure_reason", F.col("receive_count").alias("retry_count"), "message_id", at.alias("dead_lettered_at"))
    return sinks.event_log(rows, "dlq-processor", "MessageDeadLettered", rows.columns)


def schema_evolved(changes: DataFrame, database: str = "cdc") -> DataFrame:
    """An event for each change of a schema (``cdc.schema_changes`` with schema_name, old_data_type and detected_at)."""
    lake_table = F.concat_ws("_", F.lit("cdc"), "schema_name", "table_name")
    rows = changes.select("change_type", "schema_name", "table_name", "column_name", "old_data_type", "new_data_type", "detected_at", F.lit(database).alias("glue_database"), lake_table.alias("glue_table"))
    return sinks.event_log(rows, "cdc-pipeline", "SchemaEvolved", rows.columns)


def lag_warnings(lags: DataFrame, instance: str, threshold: float = 60.0) -> DataFrame:
    """A warning for each period of ``cdc.replication_lag`` whose lag is above the threshold."""
    over = lags.where(F.col("max_lag_seconds") > threshold)
    text = F.format_string(f"CDC replication lag (%.1fs) exceeds threshold ({threshold:g}s)", "max_lag_seconds")
    rows = over.select(F.lit(instance).alias("replication_instance_arn"), F.col("max_lag_seconds").alias("current_lag_seconds"), F.lit(threshold).alias("threshold_seconds"), F.lit("WARNING").alias("severity"), text.alias("message"), F.col("window_start").alias("timestamp"))
    return sinks.event_log(rows, "cdc-pipeline", "CDCReplicationLagWarning", rows.columns)


def quality_events(results: DataFrame, assessment: DataFrame, dataset: str, at: Column, threshold: float = 80.0) -> DataFrame:
    """Of one data set: an event of failed rules of high severity, if there are any, and one of a score below the threshold."""
    high = F.struct("rule_type", "column", "severity", F.try_divide(F.col("failed").cast("double"), "total").alias("metric_value"), F.col("failed").alias("failed_record_count"))
    details = results.where("severity = 'HIGH'").agg(F.array_sort(F.collect_list(high)).alias("failure_details"))
    told = assessment.crossJoin(details).select(F.lit(dataset).alias("dataset_name"), at.alias("timestamp"), F.col("quality_score").alias("overall_score"), F.col("high_failures").alias("high_severity_failures"), F.col("low_failures").alias("low_severity_failures"), "failure_details")  # one row each
    failed = told.where("high_severity_failures > 0")
    text = F.format_string(f"Quality score for '{dataset}' dropped to %s (below threshold {threshold:g})", F.col("overall_score").cast("string"))
    low = told.where(F.col("overall_score") < threshold).select("dataset_name", "timestamp", "overall_score", F.lit(threshold).alias("threshold"), text.alias("message"))
    return sinks.event_log(failed, "data-quality", "quality.failed", failed.columns).unionByName(sinks.event_log(low, "data-quality", "quality.score_degraded", low.columns))
