"""Registered queries of the stored reports, of domain events and of kept sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.operators import cdc, events, gold, governance, graph, portfolio, quality
from tidelake.plans import reports, views
from tidelake.plans.queries import _CHANGES, _DEDUP_TICKS, _LAG, _RULES, _SNAPSHOTS, _as_of, _daily, _doubles, _lags, _results, _returns, _schema_log, _SNAP_TIES, connected_flagged, fold_sql, units
from tidelake.plans.registry import ORACLES, query, work_folder
from tidelake.plans.views import AS_OF, sql, view
from tidelake.sources import tables

#: Day that stands for today.
_LAST_DAY = "2000-12-01"
#: First day of the report of volumes, and the days from there.
_FIRST_DAY, _VOLUME_DAYS = "1998-01-01", 1_065


@query(
    f"""select instrument_id, instrument_type as instrument_name, trade_date, cast(sum(volume) as bigint) as total_volume, cast(sum(last_price * volume) as double) as total_turnover, count(*) as total_trades, cast(max(last_price) as double) as daily_high,
      cast(min(last_price) as double) as daily_low, cast(sum(last_price * volume) as double) / cast(sum(volume) as double) as median_vwap from {_DEDUP_TICKS} d where trade_date >= date '{_FIRST_DAY}' group by instrument_id, instrument_type, trade_date""", dates=("trade_date",))
def report_daily_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = _daily(spark, sf_dir).withColumnRenamed("instrument_type", "instrument_name")
    return _doubles(reports.daily_volume(daily, _LAST_DAY, _VOLUME_DAYS), "total_turnover", "daily_high", "daily_low")


def _client_days(spark: SparkSession, sf_dir: str, since: str) -> DataFrame:
    """Days of clients from the first of a year on; what they held and gained then comes of all their trades."""
    ticks = views.kept(spark, sf_dir, ["client_id", "instrument_id", "side", "trade_date", "source_timestamp", "source_id", "l_orderkey", "l_linenumber", "last_price", "volume"])
    cash = tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("client_id"), F.col("c_acctbal").alias("cash_balance"))
    gains = portfolio.gains(views.trades(ticks), ["l_orderkey", "l_linenumber", "side"], since)
    held = gold.portfolio_snapshots(ticks, _SNAP_TIES).where(F.col("trade_date") >= F.lit(since).cast("date"))
    return reports.client_days(held, cash, gains)


@query(
    f"""with held as (select client_id, trade_date, sum(market_value) as v, sum(unrealized_pnl) as u from {_SNAPSHOTS} s group by client_id, trade_date),
      g as (select client_id, cast(executed_at as date) as d, case when side = 'BUY' then 0 else (p - before_a) * dq end as gain from {fold_sql(sql('trades'), 'executed_at, l_orderkey, l_linenumber, side', 'executed_at,')} x)
      select client_id, trade_date as snapshot_date, round(v, 2) as total_market_value, c_acctbal as cash_balance, round(v + c_acctbal, 2) as total_portfolio_value, round(u, 3) as unrealized_pnl,
        cast((select coalesce(sum(gain), 0) from g where g.client_id = held.client_id and extract(year from d) = extract(year from trade_date) and d <= trade_date) as bigint) as realized_pnl_ytd,
        round(case when v > 0 then u / v * 100 else 0.0 end, 5) as unrealized_return_pct from held join customer on cast(c_custkey as string) = client_id where trade_date >= date '{_LAST_DAY}' - interval 90 days""", dates=("snapshot_date",))
def report_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Realised profit in whole numbers of 1e-8."""
    out = reports.portfolio_performance(_client_days(spark, sf_dir, reports.year_of(_LAST_DAY, 90)), _LAST_DAY)
    return out.withColumns({c: F.round(c, n) for c, n in (("total_market_value", 2), ("total_portfolio_value", 2), ("unrealized_pnl", 3), ("unrealized_return_pct", 5))} | units("realized_pnl_ytd"))


@query(
    f"""with e as (select client_id, sector, geography, trade_date, cast(sum(last_price * volume) as double) as x from {sql('class_ticks')} t group by all),
      c as (select *, x * 100 / sum(x) over (partition by client_id, trade_date) as pct from e)
      select sector, geography, c_mktsegment as risk_profile, count(distinct client_id) as client_count, round(sum(x), 2) as total_exposure, round(avg(pct), 6) as avg_concentration, round(max(pct), 6) as max_concentration, cast(count(*) filter (pct > 25) as bigint) as concentrated_positions
      from c join customer on cast(c_custkey as string) = client_id where trade_date = date '1998-06-15' group by all"""
)
def report_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("client_id"), F.col("c_mktsegment").alias("risk_profile"))
    exposure = gold.risk_exposure(_returns(spark, sf_dir)).select("client_id", "sector", "geography", "trade_date", "total_exposure")
    out = reports.risk_metrics(reports.concentrations(exposure, profiles), "1998-06-15")
    return out.withColumns({c: F.round(c, n) for c, n in (("total_exposure", 2), ("avg_concentration", 6), ("max_concentration", 6))})


@query(
    f"""select l_orderkey * 8 + l_linenumber as trade_id, instrument_id, instrument_type as instrument_name, side, volume as quantity, cast(last_price as double) as price, cast(volume * last_price as double) as total_value,
      source_timestamp as execution_timestamp, cast(trade_date + interval 2 days as date) as settlement_date, 'unknown' as venue, 'main' as account_type, client_id, timestamp '{AS_OF}' as report_generated_at from {sql('ticks')} t where trade_date = date '1998-06-15'""", dates=("settlement_date",))
def report_regulatory(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = view(spark, sf_dir, "ticks")
    trades = ticks.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("trade_id"), "instrument_id", F.col("instrument_type").alias("instrument_name"), "side", F.col("volume").alias("quantity"), F.col("last_price").alias("price"), F.col("source_timestamp").alias("execution_timestamp"), F.date_add("trade_date", 2).alias("settlement_date"), F.lit("unknown").alias("venue"), F.lit("main").alias("account_type"), "client_id", "trade_date")
    out = _doubles(reports.regulatory_trades(trades, "1998-06-16", _as_of()), "price", "total_value")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("execution_timestamp", "report_generated_at")})


@query(
    f"""select 'SchemaEvolved' as detail_type, cast(seq as string) as key, change_type || ' cdc_lake_' || table_name as what, cast(null as double) as figure from {_CHANGES} c
      union all select 'CDCReplicationLagWarning', strftime(window_start, '%Y-%m-%d %H:%M:%S'), 'WARNING', round(max_lag_seconds, 4) from {_LAG} l where max_lag_seconds > 60
      union all select 'quality.failed', rule_type || '/' || "column", 'HIGH', cast(failed as double) from {_RULES} r where severity = 'HIGH'
      union all select 'quality.score_degraded', 'quotes', 'below 80', quality_score from ({ORACLES['quality_assessment']}) a where alert"""
)
def domain_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of schema changes, of replication lag and of quality, by what their details say."""
    log = _schema_log(spark, sf_dir).withColumns({"schema_name": F.lit("lake"), "old_data_type": F.lit(None).cast("string"), "detected_at": F.col("seq")})
    evolved = events.schema_evolved(log).select("detail_type", F.from_json("detail", "detected_at long, change_type string, glue_table string").alias("d"))
    out = evolved.select("detail_type", F.col("d.detected_at").cast("string").alias("key"), F.concat_ws(" ", "d.change_type", "d.glue_table").alias("what"), F.lit(None).cast("double").alias("figure"))
    lags = cdc.replication_lag(_lags(spark, sf_dir), 3600)
    late = events.lag_warnings(lags, "instance-1").select("detail_type", F.from_json("detail", "timestamp timestamp, severity string, current_lag_seconds double").alias("d"))
    out = out.unionByName(late.select("detail_type", F.date_format("d.timestamp", "yyyy-MM-dd HH:mm:ss").alias("key"), F.col("d.severity").alias("what"), F.round("d.current_lag_seconds", 4).alias("figure")))
    results = _results(spark, sf_dir)
    told = events.quality_events(results, quality.assess(results), "quotes", _as_of()).select("detail_type", F.from_json("detail", "dataset_name string, overall_score double, threshold double, failure_details array<struct<rule_type:string,column:string,severity:string,failed_record_count:bigint>>").alias("d"))
    failed = told.where("detail_type = 'quality.failed'").select("detail_type", F.explode("d.failure_details").alias("f")).select("detail_type", F.concat_ws("/", "f.rule_type", "f.column").alias("key"), F.col("f.severity").alias("what"), F.col("f.failed_record_count").cast("double").alias("figure"))
    low = told.where("detail_type = 'quality.score_degraded'").select("detail_type", F.col("d.dataset_name").alias("key"), F.format_string("below %.0f", "d.threshold").alias("what"), F.col("d.overall_score").alias("figure"))
    return out.unionByName(failed).unionByName(low)


_BUCKET = f"case when x = 0 then 0 when x > 0 then cast(ceil(ln(x) / {governance._LOG}) as int) + 100000 when x < 0 then -(cast(ceil(ln(-x) / {governance._LOG}) as int) + 100000) end"


@query(
    f"""with v as (select c_custkey % 2 = 0 as old, 'balance' as feature, c_acctbal as x from customer union all select c_custkey % 2 = 0, 'key', case when c_custkey % 10 <> 3 then cast(c_custkey as double) end from customer),
      s as (select old, feature, {_BUCKET} as bucket, count(*) as n from v group by all), r as (select *, sum(n) over (partition by feature order by bucket) as upto, sum(n) over (partition by feature) as total from s where old and bucket is not null),
      e as (select distinct feature, (select min(bucket) from r where r.feature = f.feature and upto >= k / 10.0::double * total) as border from (select distinct feature from r) f cross join (select unnest(range(1, 10)) as k) q),
      b as (select old, feature, case when bucket is not null then (select count(*) from e where e.feature = s.feature and border < bucket) + 1 end as bin, n from s),
      g as (select feature, bin, coalesce(sum(n) filter (old), 0) as b, coalesce(sum(n) filter (not old), 0) as c from b group by all),
      h as (select feature, bin, greatest(b / sum(b) over w, 0.0001) as baseline_share, greatest(c / sum(c) over w, 0.0001) as current_share from g window w as (partition by feature))
      select feature, cast(bin as int) as bin, round(baseline_share, 6) as baseline_share, round(current_share, 6) as current_share, round(sum((current_share - baseline_share) * ln(current_share / baseline_share)) over (partition by feature), 6) as psi from h"""
)
def sketch_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches kept for each of seven parts, read back and merged; the bins are quantiles of the baseline."""
    path = f"{work_folder(spark)}/sketches"
    c = tables.table(spark, sf_dir, "customer").select((F.col("c_custkey") % 7).alias("day"), (F.col("c_custkey") % 2 == 0).alias("old"), F.col("c_acctbal").alias("balance"), F.when(F.col("c_custkey") % 10 != 3, F.col("c_custkey")).alias("key"))
    governance.sketch(c, ["balance", "key"], ["day", "old"]).write.partitionBy("day").parquet(path)
    kept = spark.read.parquet(path)
    out = governance.sketch_drift(governance.merge(kept.where("old")), governance.merge(kept.where("not old")))
    return out.select("feature", "bin", *(F.round(x, 6).alias(x) for x in ("baseline_share", "current_share", "psi")))


@query(f"select id, flagged, hops from ({ORACLES['connected_flagged']}) c order by hops, id, flagged limit 50")
def connected_flagged_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty, nearest first."""
    return graph.first_paths(connected_flagged(spark, sf_dir), ["hops", "id", "flagged"], 50)
