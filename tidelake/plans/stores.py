"""Registered queries that write with the library's sinks, read back with its readers, and compare with SQL."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.operators import cdc, events, gold, graph, quality
from tidelake.plans import jobs
from tidelake.plans.registry import query, work_folder
from tidelake.plans.views import AS_OF, sql, view
from tidelake.sources import compacted, graph_files, sinks, tables
from tidelake.streaming import streams

_DAY_PARTS = "cast(extract(year from ts) as int) as year, cast(extract(month from ts) as int) as month, cast(extract(day from ts) as int) as day"


def _bronze(spark: SparkSession, sf_dir: str) -> tuple[str, T.StructType]:
    """Events as bronze ticks, written by source and day (hour 0), and the schema with the folder's columns."""
    path = f"{work_folder(spark)}/bronze"
    rows = view(spark, sf_dir, "records").select("event_id", "source_id", "value", F.date_trunc("day", F.col("ts").cast("timestamp")).alias("ingestion_timestamp"))
    sinks.append_bronze(rows, path)
    parts = [T.StructField("source", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in ("year", "month", "day", "hour")]]
    return path, T.StructType([*rows.schema.fields, *parts])


@query(f"select event_id, source_id, value, {_DAY_PARTS}, cast(0 as int) as hour from {sql('records')} r where source_id = 'bloomberg'")
def bronze_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, schema = _bronze(spark, sf_dir)
    return tables.partition(spark, path, schema, {"source": "bloomberg"}).select("event_id", "source_id", "value", "year", "month", "day", "hour")


@query(f"select 'source=' || source_id || '/year=' || year || '/month=' || month || '/day=' || day || '/hour=0' as part from (select distinct source_id, {_DAY_PARTS} from {sql('records')} r) a union all select 'source=late/year=2024/month=2/day=1/hour=0'")
def catalog_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, schema = _bronze(spark, sf_dir)
    name, keys = f"bronze_{uuid4().hex}", ["source", "year", "month", "day", "hour"]
    tables.register(spark, name, path, schema, keys)
    try:
        for _ in range(2):  # the second time it is there
            sinks.add_partition(spark, name, {"source": "late", "year": 2024, "month": 2, "day": 1, "hour": 0})
        return spark.sql(f"show partitions {name}").select(F.col("partition").alias("part"))
    finally:
        spark.sql(f"drop table {name}")


@query("select case when event_id % 17 <> 0 then event_id end as event_id, case when event_id % 17 <> 0 then value end as value, event_id % 17 = 0 as broken from events")
def json_ticks_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{work_folder(spark)}/ticks"
    line = F.when(F.col("event_id") % 17 == 0, F.concat(F.lit('{"event_id": '), "event_type")).otherwise(F.to_json(F.struct("event_id", "value")))
    tables.table(spark, sf_dir, "events").select(line.alias("value")).write.text(path)
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("value", T.DoubleType())])
    return tables.json_ticks(spark, path, schema).select("event_id", "value", F.col("_corrupt_record").isNotNull().alias("broken"))


@query(
    """with c as (select o_custkey as id, o_totalprice as price, o_orderstatus as s, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders)
      select id, price from c where rn = 1 and s <> 'F' union all select c_custkey, c_acctbal from customer where c_custkey not in (select id from c)"""
)
def full_load_and_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark)
    tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("price"), F.lit("INSERT").alias("operation"), F.lit("1970-01-01 00:00:00").alias("cdc_timestamp"), F.lit(0).cast("long").alias("source_lsn")).write.parquet(f"{folder}/full")
    op = F.when(F.col("o_orderstatus") == "O", "INSERT").when(F.col("o_orderstatus") == "P", "UPDATE").otherwise("DELETE")
    orders = tables.table(spark, sf_dir, "orders")
    orders.select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("price"), op.alias("operation"), F.col("o_orderdate").cast("string").alias("cdc_timestamp"), F.col("o_orderkey").alias("source_lsn")).write.parquet(f"{folder}/changes")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("price", T.DoubleType()), T.StructField("operation", T.StringType()), T.StructField("cdc_timestamp", T.StringType()), T.StructField("source_lsn", T.LongType())])
    full = tables.change_feed(spark, f"{folder}/full", schema)
    followed = tables.change_feed(spark, f"{folder}/changes", schema, stream=True)
    streams.follow_changes(followed, f"{folder}/log", f"{folder}/checkpoint").awaitTermination()
    log = spark.read.schema(followed.schema).parquet(f"{folder}/log")
    return cdc.apply_changes(full.select("id", "price"), log, ["id"], ["cdc_timestamp", "source_lsn"])


@query("select o_orderkey, cast(extract(year from o_orderdate) as int) as year, case when extract(year from o_orderdate) = 1997 then o_totalprice * 2 else o_totalprice end as price from orders where not (extract(year from o_orderdate) = 1997 and o_orderkey % 2 = 0)")
def partition_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{work_folder(spark)}/gold"
    rows = tables.table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("price"))
    sinks.write_partitions(rows, path, ["year"], sort=["o_orderkey"])
    again = rows.where("year = 1997 and o_orderkey % 2 <> 0").withColumn("price", F.col("price") * 2)
    sinks.write_partitions(again, path, ["year"])
    return spark.read.parquet(path).select("o_orderkey", "year", "price")


_WHOLE = "instrument_type is not null and last_price is not null and bid_price is not null and ask_price is not null"
_JOB = f"""(with q as (select *, {_WHOLE} as whole from {sql('quotes')} z)
  select *, not whole or last_price < 2000 or last_price > 100000 or ask_price < bid_price as bad, (select count(*) from q) as every from (
    select *, row_number() over (partition by instrument_id, date_trunc('month', source_timestamp), source_id, whole order by l_orderkey * 8 + l_linenumber desc, last_price, volume) as rn from q) a where rn = 1)"""


@query(
    f"""select case when bad then 'rejected' else 'silver' end as part, l_orderkey as a, l_linenumber as b, cast(last_price as double) as c, case when bad then null else cast(ask_price - bid_price as double) end as d from {_JOB} x
      union all select 'record', any_value(every), count(*) filter (not bad), cast(count(*) filter (bad) as double), cast(any_value(every) - count(*) as double) from {_JOB} x
      union all select 'PipelineExecutionCompleted', any_value(every), count(*) filter (not bad), cast(count(*) filter (bad) as double), null from {_JOB} x"""
)
def silver_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row that the job wrote, with the counts of its record and of its event."""
    folder = work_folder(spark)
    # One quote of each instrument, source and month: the newest, by an arrival in order of lines.
    arrival = F.timestamp_seconds(F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    quotes = view(spark, sf_dir, "quotes").withColumns({"source_timestamp": F.date_trunc("month", "source_timestamp"), "trade_date": F.trunc("trade_date", "month"), "ingestion_timestamp": arrival})
    arguments = jobs.SilverArguments("bronze", "bloomberg", "v2.3.1", "1992-01-01 00:00:00", "job-1")
    jobs.run_silver(quotes, folder, arguments, {"last_price": (2000.0, 100000.0)})
    none, number = F.lit(None).cast("double"), lambda c: F.col(c).cast("double")
    named = lambda df, part, *values: df.select(F.lit(part).alias("part") if isinstance(part, str) else part.alias("part"), *(v.alias(c) for v, c in zip(values, "abcd")))
    out = named(spark.read.parquet(f"{folder}/silver"), "silver", F.col("l_orderkey"), F.col("l_linenumber"), number("last_price"), number("spread"))
    out = out.unionByName(named(spark.read.parquet(f"{folder}/rejected"), "rejected", F.col("l_orderkey"), F.col("l_linenumber"), number("last_price"), none))
    record = spark.read.json(f"{folder}/lineage/job-1").select("record_counts.*")
    out = out.unionByName(named(record, "record", F.col("input"), F.col("output"), number("rejected"), number("dedup_removed")))
    log = spark.read.parquet(f"{folder}/events").select("detail_type", F.from_json("detail", "record_counts struct<input:bigint,output:bigint,rejected:bigint>").alias("d")).select("detail_type", "d.record_counts.*")
    return out.unionByName(named(log, F.col("detail_type"), F.col("input"), F.col("output"), number("rejected"), none))


@query(f"select event_id, cast(date_trunc('day', ts) as date) + interval 7 year as retain_until, {_DAY_PARTS} from events")
def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{work_folder(spark)}/audit"
    sinks.append_audit(tables.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value"), path)
    return spark.read.json(path).select("event_id", F.col("retain_until").cast("timestamp_ntz").alias("retain_until"), "year", "month", "day")


@query("select 'v' || cast(c_custkey % 5 as string) as model_version, case when c_acctbal < 0 then 'REJECTED' else 'APPROVED' end as decision, c_custkey, batch from customer, (values (0), (1)) b(batch)")
def governance_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{work_folder(spark)}/decisions"
    found = tables.table(spark, sf_dir, "customer").select(F.concat(F.lit("v"), F.col("c_custkey") % 5).alias("model_version"), F.when(F.col("c_acctbal") < 0, "REJECTED").otherwise("APPROVED").alias("decision"), "c_custkey")
    for batch in range(2):  # what was decided before stays
        sinks.governance_decisions(found.withColumn("batch", F.lit(batch)), path)
    return spark.read.json(path).select("model_version", "decision", "c_custkey", "batch")


@query("select event_id as message_id, 'queue-' || event_type as original_queue, 'x' as failure_reason, cast(user_id % 9 as int) as retry_count, props as preview, 'MessageDeadLettered' as detail_type from events")
def stream_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, e = work_folder(spark), tables.table(spark, sf_dir, "events")
    raw = streams.parquet_stream(spark, f"{sf_dir}/events.parquet*", e.schema)
    letters = raw.select(F.col("event_id").alias("message_id"), F.concat(F.lit("queue-"), "event_type").alias("original_queue"), F.lit("x").alias("error_message"), (F.col("user_id") % 9).cast("string").alias("receive_count"), F.col("props").alias("body"))
    streams.dead_letters(letters, f"{folder}/letters", f"{folder}/events", f"{folder}/checkpoint").awaitTermination()
    stored = spark.read.parquet(f"{folder}/letters").select("message_id", "preview")
    told = spark.read.parquet(f"{folder}/events").select("detail_type", F.from_json("detail", "message_id long, original_queue string, failure_reason string, retry_count int").alias("d")).select("detail_type", "d.*")
    return stored.join(told, "message_id")


@query("select event_id, event_type, 'OrderCreated' as detail_type from events where event_id % 10 <> 0")
def stream_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, e = work_folder(spark), tables.table(spark, sf_dir, "events")
    raw = streams.parquet_stream(spark, f"{sf_dir}/events.parquet*", e.schema).select("event_id", "event_type")
    streams.outbox(raw, f"{folder}/orders", f"{folder}/events", f"{folder}/checkpoint").awaitTermination()
    told = spark.read.parquet(f"{folder}/events").select("detail_type", F.from_json("detail", "event_id long").alias("d")).select("detail_type", "d.event_id")
    written = spark.read.parquet(f"{folder}/orders").join(told, "event_id")
    return events.backlog(written, e.where("event_id % 10 = 0")).select("event_id", "event_type", "detail_type")


@query("select cast(ts as date) as trade_date, count(*) as n, count(*) filter (event_id % 2 = 1) as odd from events group by 1", dates=("trade_date",))
def stream_incremental_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark)
    ticks = tables.table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("trade_date"))
    ticks.where("event_id % 2 = 0").write.parquet(f"{folder}/silver")

    def recompute(session: SparkSession, days: list) -> None:
        touched = session.read.parquet(f"{folder}/silver").where(F.col("trade_date").isin(days))
        daily = touched.groupBy("trade_date").agg(F.count("*").alias("n"), F.count_if(F.col("event_id") % 2 == 1).alias("odd"))
        sinks.write_partitions(daily, f"{folder}/gold", ["trade_date"])

    for odd in (False, True):  # the second run finds new files only
        if odd:
            ticks.where("event_id % 2 = 1").write.mode("append").parquet(f"{folder}/silver")
        streams.touched_days(streams.parquet_stream(spark, f"{folder}/silver", ticks.schema), recompute, f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/gold").select("trade_date", "n", "odd")


_GRAPH = {
    "client": ("customer", "~id,~label,segment:String,balance:Double", ("'Client:' || c_custkey", "'Client'", "c_mktsegment", "c_acctbal")),
    "account": ("customer", "~id,~label,balance:Double,margin_enabled:Bool", ("'Account:' || c_custkey", "'Account'", "cast(c_acctbal > 0 as string)", "c_acctbal")),
    "instrument": ("part", "~id,~label,name:String,type:String,sector:String,size:Long", ("'Instrument:' || p_partkey", "'Instrument'", "p_name || '/' || p_type || '/' || p_brand", "cast(p_size as double)")),
    "executed": (f"{sql('ticks')} t", "~id,~from,~to,~label,side:String,quantity:Long,price:Double,timestamp:Date", ("'EXECUTED:' || l_orderkey || '-' || l_linenumber", "'Client:' || client_id", "'Instrument:' || instrument_id || '/' || side || '/' || volume", "cast(last_price as double)")),
    "owns": ("customer", "~id,~from,~to,~label,role:String", ("'OWNS:' || c_custkey", "'Client:' || c_custkey", "'Account:' || c_custkey || '/PRIMARY'", "null")),
    "transfers": (f"{sql('transfers')} t", "~id,~from,~to,~label,timestamp:Date", ("'TRANSFERS_TO:' || src || '-' || dst", "'Account:' || src", "'Account:' || dst || '/' || strftime(ts, '%Y-%m-%d')", "null")),
}
#: Columns of the files that stand for the third and fourth figure of their rows.
_TOLD = {
    "client": (["segment:String"], "balance:Double"), "account": (["margin_enabled:Bool"], "balance:Double"), "instrument": (["name:String", "type:String", "sector:String"], "size:Long"),
    "executed": (["~to", "side:String", "quantity:Long"], "price:Double"), "owns": (["~to", "role:String"], None), "transfers": (["~to", "timestamp:Date"], None),
}


@query(" union all ".join(f"select '{name}' as file, '{header}' as header, {a} as id, {b} as of, {c} as what, cast({d} as double) as figure from {table}" for name, (table, header, (a, b, c, d)) in _GRAPH.items()))
def graph_bulk_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of six typed bulk-load files, written again by a stream that sees new orders."""
    folder = work_folder(spark)
    clients, parts, moves = tables.table(spark, sf_dir, "customer"), tables.table(spark, sf_dir, "part"), view(spark, sf_dir, "transfers")
    ticks = view(spark, sf_dir, "ticks")
    frames = {
        "client": graph.bulk_vertices("Client", clients, "c_custkey", {"segment": "c_mktsegment", "balance": "c_acctbal"}),
        "account": graph.bulk_vertices("Account", clients, "c_custkey", {"balance": "c_acctbal", "margin_enabled": F.col("c_acctbal") > 0}),
        "instrument": graph.bulk_vertices("Instrument", parts, "p_partkey", {"name": "p_name", "type": "p_type", "sector": "p_brand", "size": "p_size"}),
        "executed": graph.bulk_edges("EXECUTED", ticks, F.concat_ws("-", "l_orderkey", "l_linenumber"), ("Client", "client_id"), ("Instrument", "instrument_id"), {"side": "side", "quantity": "volume", "price": "last_price", "timestamp": "source_timestamp"}),
        "owns": graph.bulk_edges("OWNS", clients, F.col("c_custkey"), ("Client", "c_custkey"), ("Account", "c_custkey"), {"role": F.lit("PRIMARY")}),
        "transfers": graph.bulk_edges("TRANSFERS_TO", moves, F.concat_ws("-", "src", "dst"), ("Account", "src"), ("Account", "dst"), {"timestamp": "ts"}),
    }
    fresh = streams.parquet_stream(spark, f"{sf_dir}/orders.parquet*", tables.table(spark, sf_dir, "orders").schema).select("o_orderkey")
    streams.graph_refresh(fresh, frames, f"{folder}/graph", f"{folder}/checkpoint").awaitTermination()
    out = None
    for name in frames:
        rows = spark.read.option("header", True).csv(f"{folder}/graph/{name}")
        what, figure = _TOLD[name]
        text = F.concat_ws("/", *[F.substring(F.col(f"`{c}`"), 1, 10) if c == "timestamp:Date" else F.col(f"`{c}`") for c in what])
        one = rows.select(F.lit(name).alias("file"), F.lit(",".join(rows.columns)).alias("header"), F.col("~id").alias("id"), F.col(f"`{rows.columns[1]}`").alias("of"), text.alias("what"), (F.col(f"`{figure}`") if figure else F.lit(None)).cast("double").alias("figure"))
        out = one if out is None else out.unionByName(one)
    return out


_LINKS = f"""(select 'EXECUTED' as label, 'Client:' || client_id as src, 'Instrument:' || instrument_id as dst from {sql('ticks')} t union all select 'OWNS', 'Client:' || cast(c_custkey as string), 'Account:' || cast(c_custkey as string) from customer
  union all select 'TRANSFERS_TO', 'Account:' || cast(src as string), 'Account:' || cast(dst as string) from {sql('transfers')} m union all select 'ADVISED_BY', 'Client:' || cast(c_custkey as string), 'Advisor:' || cast(c_nationkey as string) from customer
  union all select 'CORRELATES_WITH', 'Instrument:' || cast(p_partkey as string), 'Instrument:' || cast(p_partkey + 1 as string) from part)"""


@query(f"select label, src, count(*) as links, count(distinct dst) as ends from {_LINKS} x group by label, src")
def graph_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    clients, parts = tables.table(spark, sf_dir, "customer"), tables.table(spark, sf_dir, "part").withColumn("beside", F.col("p_partkey") + 1)
    kinds = [
        graph.edges("EXECUTED", view(spark, sf_dir, "ticks"), ("Client", "client_id"), ("Instrument", "instrument_id"), []),
        graph.edges("OWNS", clients, ("Client", "c_custkey"), ("Account", "c_custkey"), []),
        graph.edges("TRANSFERS_TO", view(spark, sf_dir, "transfers"), ("Account", "src"), ("Account", "dst"), []),
        graph.edges("ADVISED_BY", clients, ("Client", "c_custkey"), ("Advisor", "c_nationkey"), []),
        graph.edges("CORRELATES_WITH", parts, ("Instrument", "p_partkey"), ("Instrument", "beside"), []),
    ]
    every = kinds[0]
    for more in kinds[1:]:
        every = every.unionByName(more)
    return graph.link_counts(every)


@query(
    f"""with q as (select * from {sql('quotes')} z), n as (select count(*) as n, {', '.join(f'count({c}) as {c}' for c in ('instrument_id', 'instrument_type', 'bid_price', 'last_price'))},
      {', '.join(f'count(*) filter ({c} < 0.0001 or {c} > 1000000) as bad_{c}' for c in ('bid_price', 'last_price'))}, date_diff('second', cast(max(source_timestamp) as timestamp), timestamp '{AS_OF}') as age from q)
      {' union all '.join(f"select 'null_rate' as rule_type, '{c}' as \"column\", n - {c} as failed, n as total, case when (n - {c}) / n::double <= 0.05 then 'PASS' when (n - {c}) / n::double <= 0.15 then 'LOW' else 'HIGH' end as severity from n" for c in ('instrument_id', 'instrument_type'))}
      union all {' union all '.join(f"select 'range', '{c}', bad_{c}, {c}, case when bad_{c} = 0 then 'PASS' when bad_{c} < 0.01 * {c} then 'LOW' else 'HIGH' end from n" for c in ('bid_price', 'last_price'))}
      union all select 'freshness', 'source_timestamp', case when age > 300 then n else 0 end, n, case when age >= 600 then 'HIGH' when age > 300 then 'LOW' else 'PASS' end from n
      union all select 'schema', c, case when filled = 0 then n.n else 0 end, n.n, case when filled = 0 and n.n > 0 then 'HIGH' else 'PASS' end from (unpivot (select count(columns('(.*)')) as '\\1' from q) on columns(*) into name c value filled) f, n"""
)
def default_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = quality.default_rules(["bid_price", "last_price"], ["instrument_id", "instrument_type"], "source_timestamp")
    return quality.results(view(spark, sf_dir, "quotes"), rules, F.lit(AS_OF).cast("timestamp"))


@query(
    f"""select instrument_id, trade_date, round(avg(cast(ask_price as double) - cast(bid_price as double)), 5) as avg_spread, count(*) as source_record_count,
      count(*) filter (ask_price >= bid_price and last_price is not null) * 100.0::double / count(*) as quality_score from {sql('quotes')} q group by instrument_id, trade_date""", dates=("trade_date",))
def daily_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.daily_quotes(view(spark, sf_dir, "quotes")).withColumn("avg_spread", F.round("avg_spread", 5))


_TYPE_DAILY = f"(select instrument_id, trade_date, cast(arg_max(last_price, (source_timestamp, l_orderkey, l_linenumber, source_id, last_price, volume, client_id)) as double) as close from {sql('class_ticks')} t group by instrument_id, trade_date)"


@query(
    f"""select instrument_id, trade_date, round(r, 5) as daily_return_pct, round(stddev_samp(r / 100) over (partition by instrument_id order by trade_date rows 19 preceding) * 252.0, 4) as volatility_20d from (
      select *, case when lag(close) over w > 0 then (close - lag(close) over w) / lag(close) over w * 100 end as r from {_TYPE_DAILY} d window w as (partition by instrument_id order by trade_date)) a""", dates=("trade_date",))
def daily_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = view(spark, sf_dir, "class_ticks").withColumn("instrument_type", F.col("instrument_id"))
    daily = gold.daily_summaries(ticks, ["l_orderkey", "l_linenumber", "source_id", "last_price", "volume", "client_id"])
    return gold.daily_moves(daily).select("instrument_id", "trade_date", F.round("daily_return_pct", 5).alias("daily_return_pct"), F.round("volatility_20d", 4).alias("volatility_20d"))


@query(
    """with c as (select o_orderkey % 4000 as id, o_totalprice * 2 as price, o_orderstatus as s, row_number() over (partition by o_orderkey % 4000 order by o_orderdate desc, o_orderkey desc) as rn from orders)
      select id, price from c where rn = 1 and s <> 'F' union all select p_partkey as id, p_retailprice as price from part where p_partkey not in (select id from c)"""
)
def cdc_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full load and three batches whose changes are out of order, compacted twice, with a batch that comes again after it."""
    path = f"{work_folder(spark)}/changes"
    op = F.when(F.col("o_orderstatus") == "O", "INSERT").when(F.col("o_orderstatus") == "P", "UPDATE").otherwise("DELETE")
    orders = tables.table(spark, sf_dir, "orders")
    changes = orders.select((F.col("o_orderkey") % 4000).alias("id"), (F.col("o_totalprice") * 2).alias("price"), op.alias("operation"), F.col("o_orderdate").cast("timestamp").alias("commit_timestamp"), F.col("o_orderkey").alias("source_lsn"))
    load = tables.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"), F.lit("INSERT").alias("operation"), F.lit("1900-01-01").cast("timestamp").alias("commit_timestamp"), F.lit(0).cast("long").alias("source_lsn"))
    keys, order, schema = ["id"], ["commit_timestamp", "source_lsn"], load.schema
    compacted.append(load, path, keys, -1, 8)
    for batch in range(3):
        compacted.append(changes.where(F.col("source_lsn") % 3 == batch), path, keys, batch, 8)
        if batch < 2:
            compacted.compact(spark, path, schema, keys, order)
    compacted.append(changes.where("source_lsn % 3 = 1"), path, keys, 1, 8)  # again, though its snapshot is there
    return compacted.current(spark, path, schema, keys, order)


@query(
    f"""select 'client' as name, 'Client:' || c_custkey as id, c_mktsegment as a, case when c_custkey % 5 = 0 then 'changed' else 'same' end as b from customer where c_custkey % 7 <> 0
      union all select 'transfers', 'TRANSFERS_TO:' || src || '-' || dst, 'Account:' || src, 'Account:' || dst from {sql('transfers')} t where dst % 11 <> 1
      union all select 'client changes', 'added', cast(count(*) filter (c_custkey % 3 = 0 and c_custkey % 7 <> 0) as string), cast(count(*) filter (c_custkey % 5 = 0 and c_custkey % 3 <> 0 and c_custkey % 7 <> 0) as string) from customer
      union all select 'transfers changes', 'removed', cast(count(*) filter (dst % 11 = 1) as string), '0' from {sql('transfers')} t"""
)
def graph_change_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three refreshes: all but some clients; others added, changed and gone; nothing new.  What all of them give, applied in order, and what the second wrote."""
    path, clients, moves = f"{work_folder(spark)}/graph", tables.table(spark, sf_dir, "customer"), view(spark, sf_dir, "transfers")

    def frames(clients: DataFrame, moves: DataFrame) -> dict[str, DataFrame]:
        own = graph.bulk_vertices("Client", clients, "c_custkey", {"segment": "c_mktsegment", "state": "state"})
        return {"client": own, "transfers": graph.bulk_edges("TRANSFERS_TO", moves, F.concat_ws("-", "src", "dst"), ("Account", "src"), ("Account", "dst"), {})}

    first = frames(clients.where("c_custkey % 3 <> 0").withColumn("state", F.lit("same")), moves)
    second = frames(clients.where("c_custkey % 7 <> 0").withColumn("state", F.when(F.col("c_custkey") % 5 == 0, "changed").otherwise("same")), moves.where("dst % 11 <> 1"))
    for version, now in enumerate((first, second, second)):
        graph_files.export_changes(now, path, version)
    a, b = graph_files.applied(spark, path, "client", second["client"].columns), graph_files.applied(spark, path, "transfers", second["transfers"].columns)
    out = a.select(F.lit("client").alias("name"), F.col("~id").alias("id"), F.col("segment:String").alias("a"), F.col("state:String").alias("b"))
    out = out.unionByName(b.select(F.lit("transfers").alias("name"), F.col("~id").alias("id"), F.col("~from").alias("a"), F.col("~to").alias("b")))
    told = graph_files.versions(spark, path).where("version > 0").groupBy("name").agg(*(F.sum(c).cast("string").alias(c) for c in ("added", "changed", "removed")))
    counts = told.select(F.concat("name", F.lit(" changes")).alias("name"), F.when(F.col("name") == "client", "added").otherwise("removed").alias("id"), F.when(F.col("name") == "client", F.col("added")).otherwise(F.col("removed")).alias("a"), "changed")
    return out.unionByName(counts.withColumnRenamed("changed", "b"))
