"""Readers: explicit schemas, predicates on real partition columns, and the partitions still to do."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A Parquet table of a folder."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def partition(spark: SparkSession, path: str, schema: T.StructType, where: Mapping[str, object]) -> DataFrame:
    """One partition of a bronze table: equality on partition columns prunes folders before anything is read."""
    df = spark.read.schema(schema).parquet(path)
    for column, value in where.items():
        df = df.where(F.col(column) == value)
    return df


def changed_rows(df: DataFrame, trade_date: Column | str, op: str = "op", prices: Iterable[str] = ()) -> DataFrame:
    """Rows of one date that a change feed inserted or updated (or that no feed marked), prices as decimals."""
    kept = df.where((F.col("trade_date") == trade_date) & (F.col(op).isNull() | F.col(op).isin("I", "U")))
    return kept.withColumns({c: F.col(c).cast("decimal(18,8)") for c in prices})


def unseen(partitions: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Partitions that the ledger of finished ones does not have."""
    return partitions.join(ledger, keys, "left_anti")


def json_ticks(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Newline-delimited JSON with a fixed schema; lines that do not parse keep only their text."""
    with_text = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(with_text).option("mode", "PERMISSIVE").json(path)


def jdbc(spark: SparkSession, url: str, name: str, key: str, lower: int, upper: int, parts: int) -> DataFrame:
    """Full load of a ledger table in parallel ranges of its key."""
    options = {"url": url, "dbtable": name, "partitionColumn": key, "lowerBound": lower, "upperBound": upper, "numPartitions": parts}
    return spark.read.format("jdbc").options(**options).load()


def register(spark: SparkSession, name: str, path: str, schema: T.StructType, partitions: list[str]) -> None:
    """A catalog table over a partitioned folder, with the partitions found there."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    by = f" PARTITIONED BY ({', '.join(partitions)})" if partitions else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet{by} LOCATION '{path}'")
    if partitions:
        spark.sql(f"MSCK REPAIR TABLE {name}")


def change_feed(spark: SparkSession, path: str, schema: T.StructType, stream: bool = False) -> DataFrame:
    """Files of a replication service, full load and changes alike, with the time of each change as a timestamp."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(schema).parquet(path).withColumn("cdc_timestamp", F.col("cdc_timestamp").try_cast("timestamp"))


def decode_records(df: DataFrame, schema: T.StructType, data: str = "data") -> DataFrame:
    """Base64 JSON of a stream record to columns; ``decode_error`` says why a row has none."""
    text = F.try_to_binary(F.col(data), F.lit("base64")).cast("string")
    out = df.withColumn("_text", text).withColumn("_record", F.from_json("_text", schema))
    bad = F.when(F.col("_text").isNull(), "not base64").when(F.try_parse_json("_text").isNull(), "not JSON")
    return out.withColumn("decode_error", bad).select(*df.columns, "decode_error", "_record.*")


def trade_messages(df: DataFrame, body: str = "body") -> DataFrame:
    """Trade events from queue messages: inside ``detail`` if the message has one, else at its top."""
    fields = ["order_id", "client_id", "account_id", "instrument_id", "side", "quantity", "executed_price", "execution_timestamp", "venue"]
    inner = ", ".join(f"{f} string" for f in fields)
    parsed = F.from_json(F.col(body), f"{inner}, detail struct<{inner.replace(' ', ':').replace(',:', ',')}>")
    defaults = {"account_id": "default", "venue": "unknown"}
    pick = lambda f: F.coalesce(F.col(f"_m.detail.{f}"), F.col(f"_m.{f}"), F.lit(defaults.get(f)))
    out = df.withColumn("_m", parsed).select(*df.columns, *[pick(f).alias(f) for f in fields])
    return out.withColumns({"quantity": F.col("quantity").try_cast("decimal(18,8)"), "executed_price": F.col("executed_price").try_cast("decimal(18,8)")})
