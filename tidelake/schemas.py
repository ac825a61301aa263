"""Types, fixed sets and thresholds of the lakehouse."""

from __future__ import annotations

from pyspark.sql import types as T

PRICE = T.DecimalType(18, 8)
MONEY = T.DecimalType(28, 8)
RATIO = T.DecimalType(18, 10)

#: Silver ticks: the type of each field and whether it must be there.
SILVER = T.StructType(
    [
        T.StructField("instrument_id", T.StringType(), False),
        T.StructField("instrument_type", T.StringType(), False),
        T.StructField("instrument_name", T.StringType(), True),
        T.StructField("exchange", T.StringType(), True),
        T.StructField("trade_date", T.DateType(), False),
        T.StructField("source_id", T.StringType(), False),
        T.StructField("bid_price", PRICE, False),
        T.StructField("ask_price", PRICE, False),
        T.StructField("last_price", PRICE, False),
        T.StructField("mid_price", PRICE, True),
        T.StructField("spread", PRICE, True),
        T.StructField("volume", T.LongType(), False),
        T.StructField("source_timestamp", T.TimestampType(), False),
        T.StructField("ingestion_timestamp", T.TimestampType(), False),
        T.StructField("schema_version", T.StringType(), True),
        T.StructField("is_delayed", T.BooleanType(), True),
        T.StructField("market_status", T.StringType(), True),
        T.StructField("quality_score", T.DoubleType(), True),
        T.StructField("dedup_key", T.StringType(), True),
        T.StructField("processing_job_id", T.StringType(), True),
    ]
)

# What feeds, orders and profiles may hold.
SOURCES = ["bloomberg", "thomson-reuters"]
SCHEMA_VERSION = "v2.3.1"
ORDER_TYPES = ["MARKET", "LIMIT", "STOP", "STOP_LIMIT"]
SIDES = ["BUY", "SELL"]
TIMES_IN_FORCE = ["DAY", "GTC", "IOC", "FOK"]
FILING_STATUSES = ["SINGLE", "MARRIED_JOINT", "MARRIED_SEPARATE", "HEAD_OF_HOUSEHOLD"]
RISK_PROFILES = ["CONSERVATIVE", "MODERATE", "AGGRESSIVE", "VERY_AGGRESSIVE"]
STRATEGIES = ["GROWTH", "VALUE", "INCOME", "INDEX"]
MAX_ORDER_QUANTITY = 1_000_000
DEFAULT_PRICE = 1000.00
ABORT_REJECT_PCT = 30.0

# Relational column types and those of the lake.
LAKE_TYPES = {
    "integer": "int",
    "bigint": "bigint",
    "smallint": "smallint",
    "numeric": "decimal(18,8)",
    "decimal": "decimal(18,8)",
    "real": "float",
    "double precision": "double",
    "character varying": "string",
    "varchar": "string",
    "text": "string",
    "char": "string",
    "boolean": "boolean",
    "date": "date",
    "timestamp": "timestamp",
    "timestamp without time zone": "timestamp",
    "timestamp with time zone": "timestamp",
    "bytea": "binary",
    "json": "string",
    "jsonb": "string",
    "uuid": "string",
}

# What each event of the replication service does to a schema.
DDL_CHANGES = {
    "COLUMN_ADDED": "ADD_COLUMN",
    "COLUMN_DROPPED": "DROP_COLUMN",
    "COLUMN_TYPE_CHANGED": "ALTER_COLUMN",
    "COLUMN_RENAMED": "RENAME_COLUMN",
    "TABLE_ADDED": "ADD_TABLE",
    "TABLE_DROPPED": "DROP_TABLE",
    "TABLE_RENAMED": "RENAME_TABLE",
    "SCHEMA_CHANGE": "ALTER_COLUMN",
}

# Groups for fairness checks, as (label, from, to); brackets leave gaps between whole numbers.
AGE_GROUPS = [("18-30", 18, 30), ("31-45", 31, 45), ("46-60", 46, 60), ("61+", 61, 120)]
INCOME_GROUPS = [("low", 0, 50000), ("moderate", 50001, 100000), ("high", 100001, 250000), ("very_high", 250001, None)]
