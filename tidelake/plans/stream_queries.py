"""Registered queries of streams that come in several runs, with state, late rows and failures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.lineage import stored
from tidelake.plans.queries import _ERRORS, fold_sql, units
from tidelake.plans.registry import query, work_folder
from tidelake.plans.views import AS_OF, sql, view
from tidelake.sources import tables
from tidelake.streaming import metrics, streams, trade_book

# --- ticks ---------------------------------------------------------------------------


@query(
    f"""select source_id, event_id, event_type, value, cast(null as string) as errors from {sql('records')} r where len({_ERRORS}) = 0
      union all select source_id, event_id, event_type, value, array_to_string({_ERRORS}, ', ') from {sql('records')} r where len({_ERRORS}) > 0
      union all select source_id, null, 'MarketDataIngested', count(*), null from {sql('records')} r where len({_ERRORS}) = 0 group by source_id"""
)
def stream_tick_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of bronze, dead letters and events: what they hold, not their number."""
    folder = work_folder(spark)
    records = view(spark, sf_dir, "records")
    records.write.parquet(f"{folder}/in")
    raw = streams.parquet_stream(spark, f"{folder}/in", records.schema).withColumnRenamed("ts_text", "timestamp")
    streams.tick_ingest(raw, f"{folder}/bronze", f"{folder}/dead", f"{folder}/events", f"{folder}/checkpoint", F.lit(AS_OF).cast("timestamp")).awaitTermination()
    held = F.from_json("payload", "event_id long, event_type string, value double")
    bronze = spark.read.parquet(f"{folder}/bronze").select("source_id", held.alias("p")).select("source_id", "p.*", F.lit(None).cast("string").alias("errors"))
    dead = spark.read.parquet(f"{folder}/dead").select("source_id", "event_id", "event_type", "value", F.array_join("errors", ", ").alias("errors"))
    told = spark.read.parquet(f"{folder}/events").select("detail_type", F.from_json("detail", "source_id string, record_count long").alias("d"))
    log = told.groupBy("d.source_id", F.col("detail_type").alias("event_type")).agg(F.sum("d.record_count").cast("double").alias("value")).select("source_id", F.lit(None).cast("long").alias("event_id"), "event_type", "value", F.lit(None).cast("string").alias("errors"))
    return bronze.unionByName(dead).unionByName(log)


_WHOLE_RATE = "count(*) as records, count(*) filter (source_id <> 'reuters') as known, cast(sum(event_id) as bigint) as ids"


@query(f"select 'ticks' as stream, {_WHOLE_RATE} from {sql('records')} r")
def stream_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stream observed of its batches, from the table that the listener writes."""
    folder = work_folder(spark)
    records = view(spark, sf_dir, "records")
    records.repartition(4).write.parquet(f"{folder}/in")
    raw = streams.parquet_stream(spark, f"{folder}/in", records.schema, files_per_trigger=1)
    seen = metrics.observed(raw, "ticks", records=F.count("*"), known=F.count_if(F.col("source_id") != "reuters"), ids=F.sum("event_id"))
    with metrics.recorded(spark, f"{folder}/metrics"):
        seen.writeStream.queryName("ticks").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).format("parquet").start(f"{folder}/out").awaitTermination()
    return metrics.totals(spark.read.parquet(f"{folder}/metrics"), "ticks", ["records", "known", "ids"])


# --- late rows -----------------------------------------------------------------------

_ARRIVED = "case when event_id % 37 = 0 then null else cast(ts as timestamp) end"


@query(
    f"""with e as (select event_id, event_type as source, {_ARRIVED} as ts, case when event_id % 10 = 0 then 2 when day(ts) < 11 then 0 when day(ts) < 21 then 1 else 2 end as run from events),
      n as (select source, run, max(ts) as newest from e group by source, run),
      k as (select source, r.run, (select max(newest) from n where n.source = s.source and n.run < r.run) as newest from (select distinct source from e) s cross join (select unnest([0, 1, 2]) as run) r)
      select event_id, case when ts is null then 'undated' when newest - ts > interval 240 hours then 'late' else 'in_time' end as kind from e join k using (source, run)"""
)
def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs of a stream; a tenth of the rows comes with the last one, some have no time."""
    folder = work_folder(spark)
    e = tables.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("source"), F.col("ts").cast("timestamp").alias("at"))
    run = F.when(F.col("event_id") % 10 == 0, 2).when(F.dayofmonth("at") < 11, 0).when(F.dayofmonth("at") < 21, 1).otherwise(2)
    rows = e.select("event_id", "source", F.when(F.col("event_id") % 37 != 0, F.col("at")).alias("ts"), run.alias("run"))
    for k in range(3):
        rows.where(F.col("run") == k).drop("run").write.mode("append").parquet(f"{folder}/in")
        raw = streams.parquet_stream(spark, f"{folder}/in", rows.drop("run").schema)
        streams.late_split(raw, "ts", "source", 240, f"{folder}/split", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/split/rows").select("event_id", "kind")


@query("select event_id, case when event_id % 7 = 0 then 'undated' when event_id % 10 = 0 then 'late' else 'in_time' end as kind from events")
def late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 14 != 0, F.col("ts").cast("timestamp")).alias("ts"))
    arrival = F.when(F.col("event_id") % 7 != 0, F.when(F.col("event_id") % 10 == 0, F.col("ts") + F.make_dt_interval(hours=F.lit(25))).otherwise(F.col("ts")))
    parts = streams.split_late(e.withColumn("arrival", arrival), "ts", "arrival", 24)
    good, late, undated = (df.select("event_id", F.lit(kind).alias("kind")) for df, kind in zip(parts, ("in_time", "late", "undated")))
    return good.unionByName(late).unionByName(undated)


# --- trades in order -----------------------------------------------------------------

#: Days that trades may come out of order.
_DISORDER = 800
#: Messages of trades in five runs: a fifth comes a run late, some come far too late, some twice, some cannot be booked.
_MESSAGES = f"""(with t as (select client_id, account_id, instrument_id, l_orderkey * 10 + l_linenumber as trade_id, executed_at, side, quantity, price, l_orderkey, cast(floor((extract(year from executed_at) - 1992) / 2) as int) as era from {sql('trades')} z),
  m as (select client_id, account_id, instrument_id, trade_id, executed_at, side, quantity, price, era + case when l_orderkey % 97 = 0 then 3 when l_orderkey % 5 = 0 then 1 else 0 end as run from t
    union all select client_id, account_id, instrument_id, trade_id, executed_at, side, quantity, price, era + case when l_orderkey % 97 = 0 then 3 when l_orderkey % 5 = 0 then 1 else 0 end + l_orderkey % 2 from t where l_orderkey % 11 = 0
    union all select client_id, account_id, instrument_id, trade_id, executed_at, case when l_orderkey % 2 = 0 then 'HOLD' else side end, case when l_orderkey % 2 = 1 then -quantity else quantity end, price, era from t where l_orderkey % 13 = 0
    union all select null, account_id, instrument_id, trade_id, executed_at, side, quantity, price, era from t where l_orderkey % 113 = 0)
  select client_id, account_id, instrument_id, trade_id, executed_at, side, quantity, price, case when run > 4 then 4 else run end as run from m)"""
_OUTCOMES = f"""(with m as (select *, client_id is not null and side in ('BUY', 'SELL') and quantity > 0 as good from {_MESSAGES} z),
  c as (select r.run, (select max(executed_at) from m where good and m.run < r.run) - interval {_DISORDER} days as passed from (select distinct run from m) r),
  a as (select m.*, executed_at <= coalesce(passed, timestamp '1900-01-01') as late, row_number() over (partition by good, client_id, account_id, instrument_id, trade_id, side, quantity, price, executed_at order by run) as n,
    first_value(executed_at <= coalesce(passed, timestamp '1900-01-01')) over (partition by good, client_id, account_id, instrument_id, trade_id, side, quantity, price, executed_at order by run) as first_late from m join c using (run))
  select client_id, account_id, instrument_id, trade_id, executed_at, side, quantity, price, case when not good then 'invalid' when n = 1 and not late then 'booked' when n > 1 and not first_late then 'duplicate' else 'late' end as outcome from a)"""
_BOOKED = f"(select * from {_OUTCOMES} b where outcome = 'booked')"


def _booked(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark)
    # Messages take each trade in several ways, and runs take the messages one by one: both are derived once.
    trades = stored(view(spark, sf_dir, "trades"))
    messages = stored(spark.sql(f"select * from {_MESSAGES.replace(sql('trades'), '{trades}')} m", trades=trades))
    schema = messages.drop("run").schema
    for run in range(5):
        rows = messages.where(F.col("run") == run).drop("run")
        if run == 4:  # a trade of another market far ahead: the day's end
            closing = rows.limit(1).withColumns({"client_id": F.lit("closing"), "side": F.lit("BUY"), "quantity": F.lit(1).cast("decimal(18,0)"), "executed_at": F.lit("2100-01-01").cast("timestamp")})
            rows = rows.unionByName(closing)
        # Files by size, not one for each task.
        rows.hint("rebalance").write.mode("append").parquet(f"{folder}/in")
        raw = streams.parquet_stream(spark, f"{folder}/in", schema)
        booked = trade_book.book(raw, f"{_DISORDER} days", dedup_minutes=60 * 24 * 365 * 20)
        streams.start(booked, streams.batch_folder(f"{folder}/out"), f"{folder}/checkpoint", stateful=True).awaitTermination()
    return spark.read.schema(trade_book.BOOKED).parquet(f"{folder}/out/*")


#: As text, because a column with nulls may be read as doubles, which do not hold these numbers.
_MONEY = ("previous_cost", "new_cost", "cash_delta", "realized_ytd")


@query(
    f"""select outcome, client_id, instrument_id, trade_id, side, trade_count, previous_quantity, new_quantity, {', '.join(f'cast({c} as varchar) as {c}' for c in _MONEY)} from (
      select 'booked' as outcome, client_id, instrument_id, trade_id, side, k as trade_count, cast(before_q as bigint) as previous_quantity, cast(q as bigint) as new_quantity, cast(before_a as bigint) as previous_cost, cast(a as bigint) as new_cost, cast(cash - before_cash as bigint) as cash_delta, cast(realized - began as bigint) as realized_ytd
        from {fold_sql(_BOOKED, 'executed_at, trade_id, side, quantity, price', 'trade_id,')} x
      union all select outcome, client_id, instrument_id, trade_id, side, null, null, null, null, null, null, null from {_OUTCOMES} o where outcome <> 'booked') u"""
)
def stream_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every trade of five runs with its outcome and what it did to its position; money in whole numbers of 1e-8."""
    out = _booked(spark, sf_dir)
    whole = {c: F.col(c).cast("bigint") for c in ("previous_quantity", "new_quantity")}
    return out.select("outcome", "client_id", "instrument_id", "trade_id", "side", "trade_count", "previous_quantity", "new_quantity", *_MONEY).withColumns(whole | {c: amount.cast("string") for c, amount in units(*_MONEY).items()})
