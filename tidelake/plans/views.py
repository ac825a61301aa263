"""Domain tables from the driver's tables, as SQL that both Spark and the oracle's engine run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tidelake.lineage import stored

#: Instant that stands for now in checked queries.
AS_OF = "2001-01-01 00:00:00"

TICKS = """select cast(l_partkey as string) as instrument_id, p_type as instrument_type, p_brand as sector, r_name as geography,
  cast(o_custkey as string) as client_id, case when l_returnflag = 'R' then 'SELL' else 'BUY' end as side,
  cast(l_shipdate as date) as trade_date, cast(l_shipdate as timestamp) as source_timestamp, cast(l_suppkey as string) as source_id,
  l_orderkey, l_linenumber, cast(l_extendedprice as decimal(18,2)) as last_price, cast(l_quantity as bigint) as volume
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
  join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey join part on l_partkey = p_partkey"""

#: Ticks of a client in classes of instruments, which repeat; single instruments hardly do.
CLASS_TICKS = f"select client_id, instrument_type as instrument_id, sector, geography, side, trade_date, source_timestamp, source_id, l_orderkey, l_linenumber, last_price, volume from ({TICKS}) x"

#: Raw quotes with faults put in by rule, as the tables have none.
QUOTES = """select cast(l_partkey as string) as instrument_id, cast(l_suppkey as string) as source_id, case when l_orderkey % 29 = 0 then null else 'EQUITY' end as instrument_type,
  cast(l_shipdate as date) as trade_date, l_orderkey, l_linenumber,
  case when l_orderkey % 17 = 0 then null else cast(l_extendedprice as decimal(18,8)) end as last_price,
  case when l_orderkey % 31 = 0 then null else cast(cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(4,2))) as decimal(18,8)) end as bid_price,
  case when l_orderkey % 37 = 0 then null else cast(cast(l_extendedprice as decimal(18,2)) * case when l_orderkey % 23 = 0 then 0.5 else 1 + cast(l_tax as decimal(4,2)) end as decimal(18,8)) end as ask_price,
  cast(l_quantity as bigint) as volume, cast(l_shipdate as timestamp) as source_timestamp, cast(l_shipdate as timestamp) as ingestion_timestamp from lineitem"""

TRANSFERS = """select src, dst, min(ts) as ts from (select o_custkey as src, (o_custkey * 7 + o_orderkey) % 1500 as dst, cast(o_orderdate as timestamp) as ts from orders) x where src <> dst group by src, dst"""

#: Trades in order for positions; one row for each (order, line).
TRADES = f"""select client_id, 'main' as account_id, instrument_id, side, cast(max(volume) as decimal(18,0)) as quantity, cast(max(last_price) as decimal(18,2)) as price,
  max(source_timestamp) as executed_at, l_orderkey, l_linenumber from ({CLASS_TICKS}) y group by client_id, instrument_id, side, l_orderkey, l_linenumber"""

#: Events as raw stream records.
RECORDS = """select event_id, case when event_id % 11 = 0 then 'reuters' when user_id % 2 = 0 then 'bloomberg' else 'thomson-reuters' end as source_id,
  case when event_id % 13 = 0 then 'AAPL-0' when event_id % 5 = 0 then 'US0378' || cast(100 + user_id as string) else 'US0378331' || cast(100 + user_id as string) end as instrument_id,
  case when event_id % 37 = 0 then '' when event_id % 41 = 0 then 'yesterday' else '2024-01-15T10:' || cast(10 + user_id % 50 as string) || ':00' end as ts_text, event_type, value, ts from events"""

VIEWS = {"ticks": TICKS, "class_ticks": CLASS_TICKS, "quotes": QUOTES, "transfers": TRANSFERS, "trades": TRADES, "records": RECORDS}
#: The joins of ticks, and the same for Spark, which takes joins as they are written: rows of lineitem, by far the most,
#: are dealt twice and not three times, and lie by order in the end, as trades are grouped.
_JOINS = TICKS[TICKS.index("from lineitem") :]
_FEWER_DEALS = """from lineitem join part on l_partkey = p_partkey join (select o_orderkey, o_custkey, r_name from orders join customer on o_custkey = c_custkey
  join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey) o on l_orderkey = o_orderkey"""
BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


_TABLE = re.compile(rf"\b(from|join)\s+({'|'.join(BASE)})\b")


def run(spark: SparkSession, base: str, text: str) -> DataFrame:
    """SQL over the Parquet tables of a folder.  They are parameters of the text, so no view of the user's is replaced."""
    text = text.replace(_JOINS, _FEWER_DEALS)
    used = {table for _, table in _TABLE.findall(text)}
    frames = {t: spark.read.parquet(f"{base}/{t}.parquet") for t in used}
    return spark.sql(_TABLE.sub(r"\1 {\2}", text), **frames)


def view(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A domain table over the Parquet tables of a folder."""
    return run(spark, base, VIEWS[name])


def kept(spark: SparkSession, base: str, columns: list[str]) -> DataFrame:
    """Columns of ``class_ticks``, derived once and stored, for queries that take them several times."""
    return stored(view(spark, base, "class_ticks").select(*columns))


def trades(ticks: DataFrame) -> DataFrame:
    """The table of trades from ``class_ticks``."""
    return ticks.sparkSession.sql(TRADES.replace(f"({CLASS_TICKS})", "{ticks}"), ticks=ticks)


def sql(name: str) -> str:
    """The same table as a subquery of an oracle."""
    return f"({VIEWS[name]})"
