"""Bronze to silver: conform, reject, deduplicate, check and enrich."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake import schemas
from tidelake.functions.columns import errors, one_of


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of a schema with its types; a value that does not fit becomes null and its column's name goes to ``cast_failures``."""
    absent = [f.name for f in schema if not f.nullable and f.name not in df.columns]
    if absent:
        raise ValueError(f"required columns are missing: {', '.join(absent)}")
    fields = [f for f in schema if f.name in df.columns]
    lost = errors(*[(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull(), f.name) for f in fields])
    out = df.withColumn("cast_failures", lost)
    return out.withColumns({f.name: F.col(f.name).try_cast(f.dataType) for f in fields})


def required_failures(df: DataFrame, schema: T.StructType) -> Column:
    """Names of the fields that must be there, are in the frame, and are null."""
    return errors(*[(F.col(f.name).isNull(), f.name) for f in schema if not f.nullable and f.name in df.columns])


def validate_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` conformed, with ``reject_reasons`` (empty: valid)."""
    conformed = conform(df, schema)
    return conformed.withColumn("reject_reasons", F.array_union("cast_failures", required_failures(conformed, schema))).drop("cast_failures")


def deduplicate(df: DataFrame, keys: list[str], newest: list[str], ties: list[str] = ()) -> DataFrame:
    """One row for each key: the newest, by ``ties`` where that leaves several."""
    order = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in newest], *ties)
    return df.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def quality_reasons(as_of: Column | None = None, ranges: dict[str, tuple[float, float]] | None = None, max_age_hours: int = 24) -> Column:
    """Reasons to reject a tick: a value out of its range, too old, or crossed quotes.  Nulls give no reason."""
    rules = [((F.col(c) < low) | (F.col(c) > high), f"{c}_range") for c, (low, high) in (ranges or {}).items()]
    if as_of is not None:
        rules.append((F.col("source_timestamp") < as_of - F.make_dt_interval(hours=F.lit(max_age_hours)), "stale"))
    rules.append((F.col("ask_price") < F.col("bid_price"), "crossed"))
    return errors(*rules)


def reject_rate(df: DataFrame, reasons: str = "reject_reasons") -> DataFrame:
    """One row: rows in, rejected, and their share in per cent."""
    bad = F.count_if(F.size(reasons) > 0)
    return df.agg(F.count("*").alias("rows_in"), bad.alias("rejected")).withColumn("reject_pct", F.coalesce(F.try_divide(F.col("rejected") * 100.0, F.col("rows_in")), F.lit(0.0)))


class TooManyRejects(ValueError):
    """A batch above the limit of rejected rows."""


def abort_above(pct: float, limit: float = schemas.ABORT_REJECT_PCT) -> None:
    """Raises if more than ``limit`` per cent of a batch was rejected."""
    if pct > limit:
        raise TooManyRejects(f"{pct:.2f} % of rows rejected; the limit is {limit} %")


def enrich(df: DataFrame, reject_pct: Column, job_id: str) -> DataFrame:
    """Quote columns, the batch's quality score, a key for deduplication, and the job."""
    key = F.sha2(F.concat_ws("|", "instrument_id", F.date_format("source_timestamp", "yyyy-MM-dd HH:mm:ss"), "source_id"), 256)
    return df.withColumns(
        {
            "trade_date": F.to_date("source_timestamp"),
            "mid_price": (F.col("bid_price") + F.col("ask_price")) / 2,
            "spread": F.col("ask_price") - F.col("bid_price"),
            "quality_score": F.lit(1.0) - reject_pct / 100.0,
            "dedup_key": key,
            "processing_job_id": F.lit(job_id),
        }
    )


def union_rejects(**stages: DataFrame) -> DataFrame:
    """Rejected rows of several stages in one frame, each with its stage; columns that a stage lacks are null."""
    frames = [df.withColumn("reject_stage", F.lit(stage)) for stage, df in stages.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def lineage(df: DataFrame, rows_in: Column, rows_dedup: Column) -> DataFrame:
    """Counts of a run and their rates in per cent, from one aggregate."""
    pct = lambda n: F.coalesce(F.try_divide(n * 100.0, F.col("rows_in")), F.lit(0.0))
    counts = df.agg(rows_in.alias("rows_in"), rows_dedup.alias("rows_dedup"), F.count_if(F.size("reject_reasons") > 0).alias("rejected"), F.count_if(F.size("reject_reasons") == 0).alias("rows_out"))
    return counts.withColumns({"duplicate_pct": pct(F.col("rows_in") - F.col("rows_dedup")), "reject_pct": pct(F.col("rejected"))})


def enrich_trades(ticks: DataFrame, instruments: DataFrame, clients: DataFrame) -> DataFrame:
    """Ticks with the sector of their instrument and the geography of their client.  Spark
    broadcasts a dimension that its statistics show to be small and shuffles for others."""
    return ticks.join(instruments, "instrument_id", "left").join(clients, "client_id", "left")


def record_errors() -> Column:
    """Errors of a raw tick: missing fields alone, or else source, instrument id and time."""
    required = ["source_id", "instrument_id", "timestamp"]
    gone = errors(*[(F.col(c).isNull() | (F.col(c) == ""), f"{c}: missing") for c in required])
    wrong = errors(
        (~F.col("source_id").isin(schemas.SOURCES), "source_id: unknown"),
        (~F.col("instrument_id").rlike("^([A-Za-z0-9]{12}|[A-Za-z0-9]{9})$"), "instrument_id: format"),
        (F.try_to_timestamp("timestamp").isNull(), "timestamp: format"),
    )
    return F.when(F.size(gone) > 0, gone).otherwise(wrong)


def id_scheme(instrument_id: Column) -> Column:
    """Kind of an instrument id by its length."""
    return F.when(F.length(instrument_id) == 12, "isin").when(F.length(instrument_id) == 9, "cusip").otherwise("unknown")


def process_records(df: DataFrame, ingested: Column) -> DataFrame:
    """Bronze rows of valid ticks: fixed columns, the partition key, and all other fields as JSON."""
    fixed = ["source_id", "instrument_id", "timestamp", "schema_version"]
    rest = [c for c in df.columns if c not in fixed]
    day = F.date_format(F.try_to_timestamp("timestamp"), "yyyy-MM-dd")
    return df.select(
        "source_id", "instrument_id", "timestamp", ingested.alias("ingestion_ts"), F.lit(schemas.SCHEMA_VERSION).alias("schema_version"),
        F.concat_ws("/", "source_id", id_scheme(F.col("instrument_id")), day).alias("partition_key"), F.to_json(F.struct(*rest)).alias("payload"),
    )


def flatten_payload(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Bronze rows with the fields of their JSON payload as typed columns; a field of the wrong type is null."""
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    parsed = df.withColumn("_p", F.from_json("payload", texts))
    return parsed.select(*[c for c in df.columns if c != "payload"], *[F.col(f"_p.{f.name}").try_cast(f.dataType).alias(f.name) for f in schema])


def known_side(side: Column) -> Column:
    """BUY and SELL, in any case."""
    return one_of(side, schemas.SIDES)
