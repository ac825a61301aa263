"""Hand-computed cases of the lakehouse operators."""

import datetime as dt
import itertools
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake import schemas
from tidelake.functions.columns import bucket, ratio
from tidelake.operators import cdc, events, gold, governance, graph, ordered, orders, portfolio, quality, retention, silver
from tidelake.plans import jobs, reports
from tidelake.sources import compacted, graph_files, sinks, tables
from tidelake.streaming import streams, trade_book


def ts(text):
    return dt.datetime.fromisoformat(text)


def test_vwap_and_open_high_low_close(spark):
    rows = [("A", "EQ", ts("2024-01-15 10:00:00"), 1, 185.0, 10000), ("A", "EQ", ts("2024-01-15 11:00:00"), 2, 186.0, 20000), ("A", "EQ", ts("2024-01-15 12:00:00"), 3, 184.0, 15000)]
    ticks = spark.createDataFrame(rows, "instrument_id string, instrument_type string, source_timestamp timestamp, id long, last_price double, volume long").withColumn("trade_date", F.to_date("source_timestamp"))
    day = gold.daily_summaries(ticks, ["id"]).first()
    assert day["vwap"] == pytest.approx(8330000 / 45000)
    assert (day["open_price"], day["high_price"], day["low_price"], day["close_price"], day["trade_count"]) == (185.0, 186.0, 184.0, 184.0, 3)


def test_daily_return_and_rsi_bounds(spark):
    days = [("A", dt.date(2024, 1, d), 184.0 + (d * 7 % 5), 100) for d in range(1, 29)]
    out = gold.performance(spark.createDataFrame(days, "instrument_id string, trade_date date, close_price double, total_volume long")).orderBy("trade_date").collect()
    assert out[0]["daily_return"] is None and out[1]["daily_return"] == pytest.approx((out[1]["close_price"] - out[0]["close_price"]) / out[0]["close_price"])
    assert all(0 <= r["rsi"] <= 100 for r in out) and all(r["max_drawdown"] <= 0 for r in out)


def test_ratio_is_null_without_volume(spark):
    assert spark.range(1).select(ratio(F.lit(5), F.lit(0)).alias("r")).first()["r"] is None


def test_deduplication_keeps_the_newest_and_is_idempotent(spark):
    rows = [("A", ts("2024-01-15 14:30:00"), 1.0), ("A", ts("2024-01-15 14:30:05"), 2.0), ("B", ts("2024-01-15 14:30:00"), 3.0)]
    df = spark.createDataFrame(rows, "k string, ingested timestamp, v double")
    once = silver.deduplicate(df, ["k"], ["ingested"], ["v"])
    assert sorted(r["v"] for r in once.collect()) == [2.0, 3.0]
    assert sorted(r["v"] for r in silver.deduplicate(once, ["k"], ["ingested"], ["v"]).collect()) == [2.0, 3.0]


@pytest.mark.parametrize("pct,stops", [(20.0, False), (30.0, False), (35.0, True)])
def test_abort_gate(pct, stops):
    if stops:
        with pytest.raises(silver.TooManyRejects):
            silver.abort_above(pct)
    else:
        silver.abort_above(pct)


def test_null_reasons_put_no_row_in_neither_side(spark):
    df = spark.createDataFrame([(None, 1.0, 2.0), (5.0, 3.0, 2.0), (5.0, None, 2.0)], "last_price double, bid_price double, ask_price double")
    flagged = df.withColumn("r", silver.quality_reasons(None, {"last_price": (0.0, 10.0)}))
    assert [list(x["r"]) for x in flagged.collect()] == [[], ["crossed"], []]


def test_missing_required_column_is_an_error(spark):
    with pytest.raises(ValueError, match="required columns"):
        silver.conform(spark.range(1), schemas.SILVER)


@pytest.mark.parametrize("nulls,severity", [(3, "PASS"), (8, "LOW"), (18, "HIGH")])
def test_null_rate_severity(spark, nulls, severity):
    df = spark.range(100).select(F.when(F.col("id") >= nulls, F.col("id")).alias("v"), F.lit("x").alias("w"))
    found = quality.results(df, quality.Rules(nulls=[quality.NullRate("v", 0.05)]), F.lit("2024-01-01").cast("timestamp"))
    assert found.where("rule_type = 'null_rate'").first()["severity"] == severity


@pytest.mark.parametrize("bad,severity", [(0, "PASS"), (5, "LOW"), (15, "HIGH")])
def test_range_severity(spark, bad, severity):
    df = spark.range(1000).select(F.when(F.col("id") < bad, -1).otherwise(1).alias("v"))
    found = quality.results(df, quality.Rules(ranges=[quality.InRange("v", 0, 10)]), F.lit("2024-01-01").cast("timestamp"))
    assert found.where("rule_type = 'range'").first()["severity"] == severity


def test_empty_frame_scores_one_hundred(spark):
    found = quality.results(spark.createDataFrame([], "v long"), quality.Rules(nulls=[quality.NullRate("v")]), F.lit("2024-01-01").cast("timestamp"))
    row = quality.assess(found).first()
    assert row["quality_score"] == 100.0 and not row["alert"]


def test_schema_rule_finds_missing_and_retyped(spark):
    wanted = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType()), T.StructField("c", T.StringType())])
    found = quality.results(spark.createDataFrame([(1, 2)], "a long, b long"), quality.Rules(schema=wanted), F.lit("2024-01-01").cast("timestamp"))
    assert {r["column"]: r["severity"] for r in found.collect()} == {"a": "PASS", "b": "HIGH", "c": "HIGH"}


def trades(spark, rows):
    data = [("c", "main", "i", side, Decimal(q), Decimal(p), ts(f"2024-01-15 10:00:{k:02d}"), k) for k, (side, q, p) in enumerate(rows)]
    return spark.createDataFrame(data, "client_id string, account_id string, instrument_id string, side string, quantity decimal(18,8), price decimal(18,8), executed_at timestamp, trade_id long")


def test_average_cost_moves_with_purchases_only(spark):
    row = portfolio.positions(trades(spark, [("BUY", "100", "185.5"), ("BUY", "50", "190"), ("SELL", "30", "200")]), ["trade_id"]).first()
    assert (row["quantity"], row["average_cost"]) == (Decimal("120"), Decimal("187"))
    assert row["realized"] == Decimal("390") and row["cash"] == Decimal("-22050")


def test_closed_positions_go(spark):
    closed = trades(spark, [("BUY", "10", "5"), ("SELL", "10", "6")])
    assert portfolio.positions(closed, ["trade_id"]).count() == 0
    assert portfolio.positions(closed, ["trade_id"], keep_closed=True).count() == 1


def test_stream_positions_equal_the_batch(spark, tmp_path):
    rows = trades(spark, [("BUY", "100", "185.5"), ("BUY", "50", "190"), ("SELL", "30", "200"), ("SELL", "20", "180")])
    rows.repartition(1).write.parquet(str(tmp_path / "in"))
    end = rows.limit(1).withColumns({"client_id": F.lit("end"), "executed_at": F.lit("2025-01-01").cast("timestamp")})
    end.repartition(1).write.mode("append").parquet(str(tmp_path / "in"))
    booked = trade_book.book(streams.parquet_stream(spark, str(tmp_path / "in"), rows.schema))
    streams.start(booked, streams.batch_folder(str(tmp_path / "out")), str(tmp_path / "cp"), stateful=True).awaitTermination()
    out = trade_book.positions(spark.read.schema(trade_book.BOOKED).parquet(str(tmp_path / "out" / "*")))
    a, b = out.first(), portfolio.positions(rows, ["trade_id"]).first()
    assert tuple(a[c] for c in ("quantity", "average_cost", "realized", "realized_ytd")) == tuple(b[c] for c in ("quantity", "average_cost", "realized", "realized_ytd"))


def test_margin_model(spark):
    row = spark.range(1).select(orders.required_margin(F.lit("BUY"), F.lit(100.0)).alias("b"), orders.required_margin(F.lit("SELL"), F.lit(100.0)).alias("s")).first()
    assert (row["b"], row["s"]) == (50.0, 150.0)


@pytest.mark.parametrize("utc,ok", [("2024-01-15 09:00:00", True), ("2024-01-15 08:59:00", False), ("2024-07-15 08:00:00", True), ("2024-01-13 15:00:00", False), ("2024-01-16 01:01:00", False)])
def test_market_clock_follows_daylight_saving(spark, utc, ok):
    assert spark.range(1).select(orders.market_open(F.lit(utc).cast("timestamp")).alias("o")).first()["o"] is ok


def test_asof_takes_the_last_price_at_or_before(spark):
    ticks = spark.createDataFrame([("i", ts("2024-01-01 10:00:00"), 1, 5.0), ("i", ts("2024-01-01 11:00:00"), 2, 6.0)], "instrument_id string, source_timestamp timestamp, id long, last_price double")
    asked = spark.createDataFrame([("i", ts("2024-01-01 09:00:00"), 1), ("i", ts("2024-01-01 11:00:00"), 2), ("i", ts("2024-01-01 10:30:00"), 3)], "instrument_id string, request_ts timestamp, n int")
    for seconds in (60, 86400):
        out = {r["n"]: r["asof_price"] for r in orders.asof_prices(asked, ticks, ["id"], bucket_seconds=seconds).collect()}
        assert out == {1: None, 2: 6.0, 3: 5.0}


def test_change_feed(spark, tmp_path):
    spark.createDataFrame([(1, "I", "2024-01-15 10:00:00"), (2, "U", "soon")], "id long, Op string, cdc_timestamp string").write.parquet(str(tmp_path / "f"))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("Op", T.StringType()), T.StructField("cdc_timestamp", T.StringType())])
    assert [r["cdc_timestamp"] for r in tables.change_feed(spark, str(tmp_path / "f"), schema).orderBy("id").collect()] == [ts("2024-01-15 10:00:00"), None]


def test_apply_changes(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, v string")
    changes = spark.createDataFrame([(1, "x", "UPDATE", 5), (1, "y", "UPDATE", 6), (2, "b", "DELETE", 7), (4, "n", "INSERT", 8)], "id long, v string, operation string, lsn long")
    assert sorted(tuple(r) for r in cdc.apply_changes(base, changes, ["id"], ["lsn"]).collect()) == [(1, "y"), (3, "c"), (4, "n")]


def test_schema_difference(spark):
    before = T.StructType([T.StructField("price", T.DoubleType()), T.StructField("side", T.StringType())])
    after = T.StructType([T.StructField("side", T.LongType()), T.StructField("urgency", T.StringType())])
    assert {(r["column"], r["change"]) for r in quality.schema_difference(spark, before, after).collect()} == {("price", "removed"), ("side", "retyped"), ("urgency", "added")}


def test_lake_types(spark):
    out = spark.createDataFrame([("NUMERIC(18,8)",), ("jsonb",), ("money",), (None,)], "t string").select(cdc.lake_type(F.col("t")).alias("l")).collect()
    assert [r["l"] for r in out] == ["decimal(18,8)", "string", "string", None]


def test_cycles_are_counted_once(spark):
    hops = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (2, 1), (3, 3)], "src long, dst long")
    assert sorted((r["length"], list(r["path"])) for r in graph.cycles(hops).collect()) == [(2, [1, 2]), (3, [1, 2, 3])]


def test_connected_flagged_takes_the_fewest_hops(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 3)], "src long, dst long")
    one = spark.createDataFrame([(1,)], "id long")
    out = graph.connected_flagged(links, one, spark.createDataFrame([(4,), (9,)], "id long"), 4)
    assert [tuple(r) for r in out.collect()] == [(1, 4, 2)]


def test_connected_flagged_writes_no_row_for_each_start_and_vertex(spark, monkeypatch):
    """600 clients that meet at one hub, and one more behind a chain: more than one block of starts, few rows a step."""
    written = []

    def counted(write):
        def run(df):
            out = write(df)
            written.append(out.count())
            return out

        return run

    for name in ("cut", "stored"):
        monkeypatch.setattr(graph, name, counted(getattr(graph, name)))
    links = spark.createDataFrame([(k, -1) for k in range(600)] + [(-1, -2), (-2, -3), (-3, 1000), (-3, 2000), (2000, 2000)], "src long, dst long")
    ids = spark.createDataFrame([(k,) for k in [*range(600), 1000, 2000, 5000]], "id long")
    out = graph.connected_flagged(links, ids, ids, 4)
    found = {(r["near"], r["hops"]): r["n"] for r in out.groupBy((F.greatest("id", "flagged") < 600).alias("near"), "hops").agg(F.count("*").alias("n")).collect()}
    assert found == {(True, 2): 600 * 599, (False, 2): 2, (False, 4): 2 * 2 * 600}
    assert out.where("id = flagged").isEmpty() and out.distinct().count() == sum(found.values())
    assert max(written) < 5_000


@pytest.mark.parametrize("spread", [False, True])
def test_risk_reads_its_positions_once_and_adds_up_the_market(spark, tmp_path, spread):
    rows = [("a", "x", "g", "2024-01-02", f"i{k}", 10.0, 1, r) for k, r in enumerate((0.1, -0.3, 0.25))]
    rows += [("b", "y", "g", "2024-01-02", "i", 10.0, 2, 0.7), ("a", "x", "g", "2024-01-03", "i", 10.0, 1, 0.1), ("b", "x", "g", "2024-01-03", "i", 10.0, 1, 0.1), ("a", "x", "g", "2024-01-04", "i", 10.0, 1, 0.2)]
    schema = "client_id string, sector string, geography string, trade_date string, instrument_id string, last_price double, volume long, position_return double"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "positions"))
    out = gold.risk_exposure(spark.read.parquet(str(tmp_path / "positions")), spread=spread, once=True)
    assert out.inputFiles() and not [f for f in out.inputFiles() if "/positions/" in f]
    found = {(r["client_id"], r["trade_date"]): (r["market_avg_return"], r["market_variance"], r["beta"]) for r in out.collect()}
    mean = 0.75 / 4
    variance = sum((x - mean) ** 2 for x in (0.1, -0.3, 0.25, 0.7)) / 3
    assert found["a", "2024-01-02"] == pytest.approx((mean, variance, 0.05 / 3 / mean)) and found["b", "2024-01-02"] == pytest.approx((mean, variance, 0.7 / mean))
    assert found["a", "2024-01-03"][1:] == (0.0, 1.0) and found["a", "2024-01-04"][1:] == (None, 1.0)


def test_brackets_leave_gaps(spark):
    out = spark.createDataFrame([(50000.0,), (50000.5,), (300000.0,)], "v double").select(bucket(F.col("v"), schemas.INCOME_GROUPS).alias("b")).collect()
    assert [r["b"] for r in out] == ["low", None, "very_high"]


@pytest.mark.parametrize("confidence,needed", [(0.69, True), (0.70, False)])
def test_confidence_gate(spark, confidence, needed):
    columns = governance.review(F.lit(confidence), F.array(*map(F.lit, "abcd")))
    row = spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()
    assert row["requires_review"] is needed and len(row["uncertainty_factors"]) == (3 if needed else 0)


def test_retention_from_a_leap_day(spark):
    assert spark.range(1).select(sinks.retention_date(F.lit("2024-02-29").cast("date")).alias("d")).first()["d"] == dt.date(2031, 2, 28)


def test_personal_columns(spark):
    df = spark.createDataFrame([("n", "s", 1)], "client_name string, ssn string, v int")
    assert retention.visible(df, "analyst").columns == ["v"] and retention.visible(df, "compliance").columns == df.columns


def silver_rows(spark, bad):
    """Ten quotes, of which ``bad`` lack one of the three prices."""
    prices = {"bid_price": Decimal(1), "ask_price": Decimal(2), "last_price": Decimal(5)}
    rows = []
    for k in range(10):
        own = {**prices, **({list(prices)[k % 3]: None} if k < bad else {})}
        rows.append({"source_id": "s", "instrument_id": f"i{k}", "instrument_type": "EQUITY", "trade_date": dt.date(2024, 1, 15), "volume": 10, "source_timestamp": ts("2024-01-15 10:00:00"), "ingestion_timestamp": ts("2024-01-15 10:00:01"), **own})
    names = list(rows[0])
    loose = T.StructType([T.StructField(n, schemas.SILVER[n].dataType, True) for n in names])
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], loose)


def test_silver_job_writes_good_and_rejected_rows(spark, tmp_path):
    arguments = jobs.SilverArguments("p", "s", "v", "2024-01-15 12:00:00", "job")
    assert jobs.run_silver(silver_rows(spark, 2), str(tmp_path), arguments, {"last_price": (0.0, 10.0)}) == {"rows": 10, "rejected": 2}
    assert spark.read.parquet(str(tmp_path / "silver")).count() == 8 and spark.read.parquet(str(tmp_path / "rejected")).count() == 2
    record = spark.read.json(str(tmp_path / "lineage" / "job")).first()
    assert (record["record_counts"]["input"], record["record_counts"]["output"], record["quality_metrics"]["rejection_rate_pct"]) == (10, 8, 20.0)
    event = spark.read.parquet(str(tmp_path / "events")).first()
    assert event["detail_type"] == "PipelineExecutionCompleted" and '"rejected":2' in event["detail"]


def test_silver_job_stops_above_the_limit(spark, tmp_path):
    arguments = jobs.SilverArguments("p", "s", "v", "2024-01-15 12:00:00", "job")
    with pytest.raises(silver.TooManyRejects):
        jobs.run_silver(silver_rows(spark, 4), str(tmp_path), arguments, {})
    assert not (tmp_path / "silver").exists()
    event = spark.read.parquet(str(tmp_path / "events")).first()
    assert event["detail_type"] == "PipelineExecutionFailed"
    found = spark.createDataFrame([event]).select(events.contract_errors(F.col("detail_type"), F.col("detail")).alias("e")).first()
    assert found["e"] == []


def test_job_arguments_are_required():
    with pytest.raises(ValueError, match="source_id"):
        jobs.SilverArguments("p", "", "v", "t", "j")


def test_gold_job(spark, tmp_path):
    rows = [("A", "EQ", "tech", "EU", "c", "BUY", ts(f"2024-01-{d:02d} 10:00:00"), d, 10.0 + d, 100) for d in range(1, 6)]
    ticks = spark.createDataFrame(rows, "instrument_id string, instrument_type string, sector string, geography string, client_id string, side string, source_timestamp timestamp, id long, last_price double, volume long").withColumn("trade_date", F.to_date("source_timestamp"))
    jobs.run_gold(ticks, str(tmp_path), "2024-01-04", ["id"])
    out = spark.read.parquet(str(tmp_path / "instrument_performance"))
    assert out.count() == 2 and out.where("return_1d is null").count() == 0


def test_partition_overwrite_leaves_other_days(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "v int, d string"), path, ["d"])
    sinks.write_partitions(spark.createDataFrame([(9, "b")], "v int, d string"), path, ["d"])
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("v", "d").collect()) == [(1, "a"), (9, "b")]


def test_readers(spark, tmp_path):
    sinks.append_bronze(spark.createDataFrame([("bloomberg", ts("2024-01-15 10:00:00"))], "source_id string, ingestion_timestamp timestamp"), str(tmp_path / "b"))
    schema = T.StructType([T.StructField("source_id", T.StringType()), T.StructField("hour", T.IntegerType())])
    assert tables.partition(spark, str(tmp_path / "b"), schema, {"hour": 10}).count() == 1
    assert tables.partition(spark, str(tmp_path / "b"), schema, {"hour": 11}).count() == 0
    (tmp_path / "j.json").write_text('{"a": 1}\nnot json\n')
    rows = tables.json_ticks(spark, str(tmp_path / "j.json"), T.StructType([T.StructField("a", T.LongType())])).collect()
    assert [r["a"] for r in rows] == [1, None]


def test_catalog_registration(spark, tmp_path):
    path = str(tmp_path / "c")
    spark.createDataFrame([(1, "a")], "v int, d string").write.partitionBy("d").parquet(path)
    schema = T.StructType([T.StructField("v", T.IntegerType()), T.StructField("d", T.StringType())])
    tables.register(spark, "registered_ticks", path, schema, ["d"])
    sinks.add_partition(spark, "registered_ticks", {"d": "b"})
    assert spark.table("registered_ticks").count() == 1
    spark.sql("drop table registered_ticks")


def test_outbox_writes_orders_with_events(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "id long, v string").write.parquet(str(tmp_path / "in"))
    stream = streams.parquet_stream(spark, str(tmp_path / "in"), T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType())]))
    streams.outbox(stream, str(tmp_path / "orders"), str(tmp_path / "events"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "orders")).count() == spark.read.parquet(str(tmp_path / "events")).count() == 1


def test_touched_days(spark, tmp_path):
    spark.createDataFrame([("2024-01-15",), ("2024-01-16",), ("2024-01-15",)], "trade_date string").write.parquet(str(tmp_path / "in"))
    stream = streams.parquet_stream(spark, str(tmp_path / "in"), T.StructType([T.StructField("trade_date", T.StringType())]))
    seen = []
    streams.touched_days(stream, lambda s, days: seen.extend(days), str(tmp_path / "cp")).awaitTermination()
    assert seen == ["2024-01-15", "2024-01-16"]


def test_bad_trades_are_split_off(spark):
    df = spark.createDataFrame([("c", "m", "i", "BUY", 1.0, 2.0, ts("2024-01-15 10:00:00")), ("c", "m", "i", "HOLD", 1.0, 2.0, ts("2024-01-15 10:00:00")), (None, "m", "i", "BUY", 1.0, 2.0, ts("2024-01-15 10:00:00")), ("c", "m", "i", "SELL", 0.0, 2.0, ts("2024-01-15 10:00:00")), ("c", "m", "i", "SELL", 1.0, 2.0, None)], "client_id string, account_id string, instrument_id string, side string, quantity double, price double, executed_at timestamp")
    good, bad = trade_book.split_trades(df)
    assert (good.count(), bad.count()) == (1, 4)


def test_renames_fold_into_the_schema(spark):
    log = [("t", "a", None, "ADD_COLUMN", "int", 1), ("t", "b", None, "ADD_COLUMN", "string", 2), ("t", "c", "a", "RENAME_COLUMN", None, 3), ("t", "a", None, "ALTER_COLUMN", "double", 4), ("t", "c", None, "ALTER_COLUMN", "bigint", 5), ("t", "z", "nothing", "RENAME_COLUMN", None, 6), ("old", "x", None, "ADD_COLUMN", "int", 1), ("old", "new", None, "RENAME_TABLE", None, 2), ("new", "y", None, "ADD_COLUMN", "int", 3)]
    out = cdc.schema_state(spark.createDataFrame(log, "table_name string, column_name string, old_name string, change_type string, lake_type string, seq long"))
    assert sorted(map(tuple, out.collect())) == [("new", "y", "int"), ("t", "b", "string"), ("t", "c", "bigint")]


def test_rapid_transfers_across_the_hour(spark):
    moves = spark.createDataFrame([("a", ts(f"2024-01-15 {x}")) for x in ("10:40:00", "10:50:00", "11:05:00", "11:10:00", "13:00:00")], "src string, ts timestamp")
    assert [r["transfers"] for r in graph.rapid(moves, 1, 3).collect()] == [4]


def test_unusual_velocity_at_the_limit(spark):
    """After hours of 1, 2 and 3 trades the limit is 4, after equal ones their number; an hour at the limit is usual."""
    hours = {"a": (1, 1, 1, 2, 3), "b": (2, 2, 2, 2), "c": (2, 2, 2, 3), "d": (1, 2, 3, 4), "e": (1, 2, 3, 5), "f": (1, 9)}
    rows = [(client, ts("2024-01-01 00:00:00") + dt.timedelta(hours=h, minutes=k)) for client, counts in hours.items() for h, n in enumerate(counts) for k in range(n)]
    found = graph.velocity(spark.createDataFrame(rows, "client_id string, ts timestamp"), 2.0)
    assert {(r["client_id"], r["trades"]) for r in found.where("unusual").collect()} == {("a", 2), ("a", 3), ("c", 3), ("e", 5)}
    assert "_sum" not in found.columns


WASH = "client_id string, instrument_id string, side string, price double, ts timestamp, trade_id long, quantity long"


def test_wash_trades_between_two_clients(spark):
    rows = [("a", "i", "BUY", 10.0, ts("2024-01-15 10:00:00"), 1, 5), ("b", "i", "SELL", 10.005, ts("2024-01-15 11:00:00"), 2, 7), ("a", "i", "SELL", 9.995, ts("2024-01-15 11:00:00"), 3, 2), ("b", "i", "SELL", 10.5, ts("2024-01-15 11:00:00"), 4, 1), ("b", "i", "SELL", 10.0, ts("2024-02-14 10:00:01"), 5, 1), ("c", None, "SELL", 10.0, ts("2024-01-15 10:00:00"), 6, 1)]
    df = spark.createDataFrame(rows, WASH)
    found = lambda d: sorted((r["trade_id"], r["matches"], int(r["quantity"])) for r in d.collect())
    assert found(graph.wash_matches(df)) == [(1, 2, 9), (2, 1, 5), (3, 1, 5)]
    assert found(graph.wash_matches(df, by=["instrument_id", "client_id"])) == [(1, 1, 2), (3, 1, 5)]
    assert [(r["trade"], r["other_trade"]) for r in graph.wash_paths(df, "a", "2024-01-01", "2024-01-31").collect()] == [(1, 2), (1, 3), (3, 1)]


def test_wash_trades_at_one_price_are_not_multiplied(spark):
    """100,000 trades at one price have 2,500,000,000 pairs; all are counted, none is made."""
    n = 100_000
    rows = spark.range(n).select(F.lit("a").alias("client_id"), F.lit("i").alias("instrument_id"), F.when(F.col("id") % 2 == 0, "BUY").otherwise("SELL").alias("side"), F.lit(10.0).alias("price"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.col("id").alias("trade_id"), F.lit(1).cast("long").alias("quantity"))
    found = graph.wash_matches(rows, days=30)
    span = 30 * 1440
    at = np.arange(n)
    low, high = np.maximum(at - span, 0), np.minimum(at + span, n - 1)
    odd = lambda x: (x + 1) // 2  # odd numbers up to x
    sells = odd(high) - odd(low - 1)
    expected = np.where(at % 2 == 0, sells, (high - low + 1) - sells)
    total = found.agg(F.count("*"), F.sum("matches"), F.max("matches")).first()
    assert tuple(total) == (n, int(expected.sum()), int(expected.max()))


def test_wash_trades_compared_and_counted_agree(spark):
    """Crowded prices beside lone ones, against all pairs: cells compared one by one, counted, and both."""
    rng = random.Random(8)
    rows = [("a", rng.choice("ij"), rng.choice(("BUY", "SELL")), rng.choice((10.0, 10.0, 10.0, 10.005, round(rng.uniform(9.9, 10.1), 3))), ts("2024-01-01 00:00:00") + dt.timedelta(hours=rng.randrange(0, 600)), k, rng.randrange(1, 9)) for k in range(400)]
    expected = {}
    for _, i, side, price, at, k, _ in rows:
        met = [q for _, i2, side2, price2, at2, _, q in rows if i2 == i and side2 != side and abs(price2 - price) < 0.01 and abs(at2 - at) <= dt.timedelta(days=3)]
        if met:
            expected[k] = (side, len(met), sum(met))
    df = spark.createDataFrame(rows, WASH)
    for few in (0, 5, 1_000):
        found = {r["trade_id"]: (r["side"], r["matches"], int(r["quantity"])) for r in graph.wash_matches(df, days=3, few=few).collect()}
        assert found == expected
    assert graph.wash_matches(df.limit(0), days=3).count() == 0


def test_wash_trades_that_repeat_are_one_class(spark, monkeypatch):
    """Sixty copies of each trade are compared once, with their number, and no sweep is made for them."""
    monkeypatch.setattr(graph, "_counted", lambda *a: pytest.fail("copies were counted one by one"))
    copies = spark.range(60)
    rows = [("a", "i", "BUY", 10.0, ts("2024-01-15 10:00:00"), 0, 5), ("b", "i", "SELL", 10.005, ts("2024-01-15 11:00:00"), 100, 7)]
    df = spark.createDataFrame(rows, WASH).crossJoin(copies).withColumn("trade_id", F.col("trade_id") + F.col("id")).drop("id")
    found = sorted((r["trade_id"], r["side"], r["matches"], int(r["quantity"])) for r in graph.wash_matches(df).collect())
    assert found == [(k, "BUY", 60, 420) for k in range(60)] + [(100 + k, "SELL", 60, 300) for k in range(60)]


def test_cycles_of_random_graphs(spark):
    rng = random.Random(4)
    for size, links in ((6, 18), (12, 40), (40, 90)):
        edges = {(rng.randrange(size), rng.randrange(size)) for _ in range(links)}
        out = sorted((r["length"], tuple(r["path"])) for r in graph.cycles(spark.createDataFrame(list(edges), "src long, dst long")).collect())
        want = []
        for length in (2, 3, 4):
            for path in itertools.permutations(range(size), length) if size < 13 else _walks(edges, length):
                if path[0] == min(path) and all((a, b) in edges for a, b in zip(path, [*path[1:], path[0]])):
                    want.append((length, tuple(path)))
        assert out == sorted(want)


def _walks(edges, length):
    after = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
    paths = [(a,) for a in after]
    for _ in range(length - 1):
        paths = [(*p, b) for p in paths for b in after.get(p[-1], []) if b not in p]
    return paths


def test_a_hub_does_not_multiply_paths(spark):
    """500 ways in and 500 out of a hub: 250,000 paths of two pass it, none is held but those from it."""
    hub = [(k, 9999) for k in range(500)] + [(9999, 1000 + k) for k in range(500)] + [(1000 + k, k) for k in range(500)]
    hop = graph._ranked(graph.on_cycles(spark.createDataFrame(hub, "src long, dst long")))
    assert graph.half_paths(hop, 2).count() <= 3 * len(hub)
    assert graph.cycles(spark.createDataFrame(hub, "src long, dst long"), 3).count() == 500
    chain = [(k, k + 1) for k in range(40)] + [(50, 51), (51, 50)]
    assert sorted(map(tuple, graph.on_cycles(spark.createDataFrame(chain, "src long, dst long")).collect())) == [(50, 51), (51, 50)]


def test_ranks_by_ranges(spark):
    rng = random.Random(8)
    rows = [(rng.choice(("a", "b", None, "a", "a")), rng.choice((None, 1.0, 2.0, 2.0, rng.random()))) for _ in range(500)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    for keys in (["k"], []):
        w = Window.partitionBy(*keys).orderBy("v")
        want = df.select("k", "v", F.rank().over(w).alias("rank"), F.round(F.percent_rank().over(w), 12).alias("p"))
        mine = ordered.ranks(df, keys, "v").select(*keys, "v", "rank", F.round("percent_rank", 12).alias("p"))
        assert sorted(map(str, want.select(*keys, "v", "rank", "p").distinct().collect())) == sorted(map(str, mine.collect()))
        joined = ordered.percent_rank(df, keys, "v", "p").select("k", "v", F.round("p", 12).alias("p"))
        assert sorted(map(str, joined.collect())) == sorted(map(str, want.select("k", "v", "p").collect()))


def test_one_scope_is_many_tasks(spark):
    """No range of a rank over all rows has more than twice the median."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(200_000).select(F.lit("one").alias("k"), F.hash("id").alias("v"))
        plain = df.repartitionByRange("k", "v").groupBy(F.spark_partition_id().alias("p")).count()
        sizes = sorted(r["count"] for r in plain.collect())
        assert len(sizes) == 4 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
        assert ordered.lowest(df, ["k"], "v", 0.05, "end").first()["end"] == df.select("v", F.percent_rank().over(Window.orderBy("v")).alias("p")).where("p <= 0.05").agg(F.max("v")).first()[0]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


@pytest.mark.parametrize("tile, days", [(2, 7), (3, 512), (512, 30)])
def test_blocked_correlations(spark, tile, days):
    rng = random.Random(tile)
    rows = [(f"g{k % 2}", f"i{k}", dt.date(2024, 1, 1) + dt.timedelta(days=d), rng.gauss(0, 1) + d % 3) for k in range(9) for d in range(60) if rng.random() < 0.8] + [("g0", "flat", dt.date(2024, 1, 1) + dt.timedelta(days=d), 1.0) for d in range(40)]
    df = spark.createDataFrame(rows, "grp string, instrument_id string, trade_date date, daily_return double").repartition(3)
    by = {}
    for g, i, day, r in rows:
        by.setdefault((g, i), {})[day] = r
    want = []
    for (g, a), (h, b) in itertools.combinations(sorted(by), 2):
        both = sorted(by[g, a].keys() & by[h, b].keys())
        if g == h and len(both) >= 20:
            x, y = (np.array([by[k][d] for d in both]) for k in ((g, a), (h, b)))
            want.append((g, a, b, None if x.std() == 0 or y.std() == 0 else round(float(np.corrcoef(x, y)[0, 1]), 9), len(both)))
    mine = graph.correlations(df, "grp", 20, tile, days)
    assert sorted((*r[:3], None if r[3] is None else round(r[3], 9), r[4]) for r in mine.collect()) == sorted(want, key=lambda r: r[:3])


def test_largest_instruments(spark):
    rows = spark.createDataFrame([("g", "a", 5), ("g", "b", 9), ("g", "a", 5), ("g", "c", 1), ("h", "d", 0)], "grp string, instrument_id string, total_volume long")
    assert sorted(map(tuple, graph.largest(rows, "grp", 2).collect())) == [("g", "a"), ("g", "b"), ("h", "d")]


def test_governance_decisions_are_kept_by_version(spark, tmp_path):
    rows = spark.createDataFrame([("v1", "APPROVED", "fair"), ("v2", "REJECTED", "biased")], "model_version string, decision string, reason string")
    sinks.governance_decisions(rows, str(tmp_path / "d"))
    assert sorted(map(tuple, spark.read.json(str(tmp_path / "d")).select("model_version", "decision").collect())) == [("v1", "APPROVED"), ("v2", "REJECTED")]


def test_ledger_tables_are_read_in_ranges(spark):
    url = "jdbc:derby:memory:ledger;create=true"
    spark.range(1, 101).selectExpr("id as order_id", "cast(id * 2 as double) as price").write.jdbc(url, "orders")
    out = tables.jdbc(spark, url, "orders", "order_id", 1, 101, 4)
    assert out.rdd.getNumPartitions() == 4
    assert out.selectExpr("count(*)", "sum(price)").first()[:] == (100, 10100.0)


def test_keys_expire_in_the_stream(spark, tmp_path):
    schema = T.StructType([T.StructField("idempotency_key", T.StringType()), T.StructField("ts", T.TimestampType())])
    batches = [[("a", "2024-01-01 00:00:00")], [("a", "2024-01-01 10:00:00")], [("b", "2024-01-04 00:00:00")], [("a", "2024-01-04 01:00:00")]]
    for k, rows in enumerate(batches):  # one file a run, in order
        spark.createDataFrame([(key, ts(at)) for key, at in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        first = streams.idempotent(streams.parquet_stream(spark, str(tmp_path / "in"), schema))
        streams.start(first, streams.batch_folder(str(tmp_path / "out")), str(tmp_path / "cp")).awaitTermination()
    out = spark.read.schema(schema).parquet(str(tmp_path / "out")).orderBy("ts").collect()
    assert [(r["idempotency_key"], str(r["ts"])) for r in out] == [("a", "2024-01-01 00:00:00"), ("b", "2024-01-04 00:00:00"), ("a", "2024-01-04 01:00:00")]


def test_bulk_files_have_typed_headers(spark):
    df = spark.createDataFrame([(1, "n", 2.5, True, dt.date(2024, 1, 15))], "k int, name string, aum double, margin boolean, since date")
    out = graph.bulk_vertices("Client", df, "k", {"name": "name", "aum": "aum", "margin": "margin", "since": "since"})
    assert out.columns == ["~id", "~label", "name:String", "aum:Double", "margin:Bool", "since:Date"]
    assert out.first()[:2] == ("Client:1", "Client")
    link = graph.bulk_edges("OWNS", df, F.col("k"), ("Client", "k"), ("Account", "k"), {"weight": F.col("k")})
    assert link.columns == ["~id", "~from", "~to", "~label", "weight:Long"] and link.first()[:4] == ("OWNS:1", "Client:1", "Account:1", "OWNS")


def test_reports_are_in_order(spark):
    day = dt.date(2024, 1, 15)
    rows = [("t", "g", "LOW", "a", day, 1.0, 20.0), ("u", "g", "LOW", "b", day, 5.0, 30.0), ("s", "g", "LOW", "c", day, 5.0, 25.0), ("s", "g", "LOW", "c", dt.date(2024, 1, 14), 50.0, 100.0)]
    risk = spark.createDataFrame(rows, "sector string, geography string, risk_profile string, client_id string, trade_date date, total_exposure double, concentration_pct double")
    assert [(r["sector"], r["concentrated_positions"]) for r in reports.risk_metrics(risk, "2024-01-15").collect()] == [("s", 0), ("u", 1), ("t", 0)]


def test_portfolio_report(spark):
    held = spark.createDataFrame([("a", "i", dt.date(2024, 1, 10), 100.0, 5.0), ("a", "j", dt.date(2024, 1, 10), 50.0, -2.0), ("a", "i", dt.date(2024, 2, 1), 0.0, 0.0), ("b", "i", dt.date(2023, 1, 1), 1.0, 0.0)], "client_id string, instrument_id string, trade_date date, market_value double, unrealized_pnl double")
    gains = spark.createDataFrame([("a", dt.date(2023, 12, 31), 7.0), ("a", dt.date(2024, 1, 10), 1.0), ("a", dt.date(2024, 1, 20), 2.0)], "client_id string, trade_date date, gain double")
    cash = spark.createDataFrame([("a", 10.0)], "client_id string, cash_balance double")
    out = reports.portfolio_performance(reports.client_days(held, cash, gains), "2024-02-10").collect()
    assert [tuple(r)[2:] for r in out] == [(0.0, 10.0, 10.0, 0.0, 3.0, 0.0), (150.0, 10.0, 160.0, 3.0, 1.0, 2.0)]


def test_daily_quotes_and_moves(spark):
    quotes = spark.createDataFrame([("i", 1, 10.0, 12.0, 11.0), ("i", 1, 13.0, 12.0, 11.0), ("i", 1, None, 12.0, 11.0)], "instrument_id string, trade_date int, bid_price double, ask_price double, last_price double")
    one = gold.daily_quotes(quotes).first()
    assert (one["avg_spread"], one["source_record_count"], round(one["quality_score"], 2)) == (0.5, 3, 33.33)
    daily = spark.createDataFrame([("i", 1, 100.0), ("i", 2, 110.0), ("i", 3, 99.0)], "instrument_id string, trade_date int, close_price double")
    moves = [r["daily_return_pct"] for r in gold.daily_moves(daily).orderBy("trade_date").collect()]
    assert moves[0] is None and [round(m, 9) for m in moves[1:]] == [10.0, -10.0]


def test_trades_of_one_busy_key(spark, tmp_path):
    """Thousands of trades of one key over three runs, out of order within ten minutes, are booked as in one fold."""
    n, span = 3_000, 1_000
    made = F.timestamp_seconds(F.lit(1_705_312_800) + F.col("id") * 2)
    rows = spark.range(n).select(F.lit("c").alias("client_id"), F.lit("main").alias("account_id"), F.lit("i").alias("instrument_id"), F.when(F.col("id") % 3 == 0, "SELL").otherwise("BUY").alias("side"), (F.col("id") % 7 + 1).cast("decimal(28,8)").alias("quantity"), (F.col("id") % 11 + 100).cast("decimal(28,8)").alias("price"), made.alias("executed_at"), F.col("id").alias("trade_id"))
    # Every tenth trade of a run comes with the next one, if it is not too old for that.
    run = F.floor(F.col("trade_id") / span) + F.when((F.col("trade_id") % 10 == 0) & (F.col("trade_id") % span > 800), 1).otherwise(0)
    last = rows.limit(1).withColumns({"client_id": F.lit("end"), "executed_at": F.lit("2025-01-01").cast("timestamp")})
    for k in range(4):
        (rows.where(run == k) if k < 3 else rows.where(run == k).unionByName(last)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        booked = trade_book.book(streams.parquet_stream(spark, str(tmp_path / "in"), rows.schema), "10 minutes")
        streams.start(booked, streams.batch_folder(str(tmp_path / "out")), str(tmp_path / "cp"), stateful=True).awaitTermination()
    out = spark.read.schema(trade_book.BOOKED).parquet(str(tmp_path / "out" / "*")).where("client_id = 'c'")
    columns = ["trade_id", "trade_count", "new_quantity", "new_cost", "cash", "realized"]
    expected = portfolio.position_updates(rows, ["trade_id"]).select(*columns)
    assert out.where("outcome = 'booked'").select(*columns).exceptAll(expected).count() == 0
    assert out.count() == expected.count() == n


def test_many_keys_of_a_batch_take_few_calls_to_the_state():
    """800 trades of 400 keys, newest first: fewer calls to the state store than keys, and booked in order of time."""
    calls = []

    class State:
        def __init__(self):
            self.rows = []

        exists = lambda self: bool(self.rows)
        get = lambda self: calls.append("get") or list(self.rows)
        put = lambda self, rows: calls.append("put") or setattr(self, "rows", list(rows))
        clear = lambda self: self.put([])
        appendList = lambda self, rows: self.put([*self.rows, *rows])

    class Value(State):
        get = lambda self: calls.append("get") or self.rows[0]
        update = lambda self, row: self.put([row])

    class Handle:
        timers = []
        getListState = lambda self, *_: State()
        getValueState = lambda self, *_: Value()
        registerTimer = lambda self, ms: self.timers.append(ms)

    class Clock:
        now = 0
        getCurrentWatermarkInMs = lambda self: self.now

    book, clock = trade_book.TradeBook(60_000), Clock()
    book.init(Handle())
    names = ["client_id", "account_id", "instrument_id", "trade_id", "executed_at", "side", "quantity", "price", "ms", "year"]
    trade = lambda k, n, ms: Row(**dict(zip(names, (f"c{k}", "main", "i", n, ms * 1000, "BUY", Decimal(n), Decimal(1), ms, 1970))))
    rows = [trade(k, n, ms) for n, ms in ((1, 2000), (2, 1000)) for k in range(400)]
    assert list(book.handleInputRows((0,), iter(rows), clock)) == []
    assert {r.outcome for r in book.handleInputRows((0,), iter(rows), clock)} == {"duplicate"}
    clock.now = 5000
    booked = [r for _ in Handle.timers for r in book.handleExpiredTimer((0,), clock, None)]
    assert len(booked) == 800 and len(calls) < 40
    assert {(r.trade_id, r.trade_count, r.new_quantity) for r in booked} == {(2, 1, 2), (1, 2, 3)}


def test_trades_wait_for_their_order(spark, tmp_path):
    """Runs with trades out of order, twice, too late and bad: nothing is lost, and contents are forgotten in time."""
    schema = "client_id string, account_id string, instrument_id string, side string, quantity decimal(18,8), price decimal(18,8), executed_at timestamp, trade_id long"
    day = dt.datetime(2024, 1, 15, 10)
    t = lambda k, side, q, p, minute, client="c": (client, "main", "i", side, Decimal(q), Decimal(p), None if minute is None else day + dt.timedelta(minutes=minute), k)
    runs = [
        [t(1, "BUY", 100, "185.5", 0), t(3, "SELL", 30, 200, 8)],
        [t(2, "BUY", 50, 190, 4), t(1, "BUY", 100, "185.5", 0), t(9, "BUY", -5, 1, 5), t(7, "BUY", 1, 1, None, "z")],
        [t(4, "BUY", 1, 1, 100, "d")],
        [t(5, "SELL", 1, 1, 3), t(2, "BUY", 50, 190, 4), t(6, "BUY", 1, 1, 500, "z")],
    ]
    for rows in runs:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        booked = trade_book.book(streams.parquet_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema), "10 minutes")
        streams.start(booked, streams.batch_folder(str(tmp_path / "out")), str(tmp_path / "cp"), stateful=True).awaitTermination()
    out = spark.read.schema(trade_book.BOOKED).parquet(str(tmp_path / "out" / "*"))
    assert sorted((r["trade_id"], r["outcome"]) for r in out.collect()) == [(1, "booked"), (1, "duplicate"), (2, "booked"), (2, "late"), (3, "booked"), (4, "booked"), (5, "late"), (7, "invalid"), (9, "invalid")]
    assert [tuple(r) for r in out.where("client_id = 'c' and outcome = 'booked'").orderBy("trade_count").select("trade_id", "new_quantity", "previous_cost", "new_cost", "realized_ytd").collect()] == [
        (1, Decimal(100), Decimal(0), Decimal("185.5"), Decimal(0)), (2, Decimal(150), Decimal("185.5"), Decimal(187), Decimal(0)), (3, Decimal(120), Decimal(187), Decimal(187), Decimal(390)),
    ]
    assert trade_book.failures(out).count() == 5


def test_undated_rows_are_kept(spark):
    rows = spark.createDataFrame([(1, ts("2024-01-01 00:00:00"), ts("2024-01-03 00:00:00")), (2, None, ts("2024-01-01 00:00:00")), (3, ts("2024-01-01 00:00:00"), None), (4, ts("2024-01-01 00:00:00"), ts("2024-01-01 00:00:00"))], "id long, ts timestamp, arrival timestamp")
    assert [[r["id"] for r in part.orderBy("id").collect()] for part in streams.split_late(rows, "ts", "arrival", 24)] == [[4], [1], [2, 3]]


def test_idempotent_rows_are_whole(spark):
    rows = [("k", ts("2024-01-01 00:00:00"), "a"), ("k", ts("2024-01-01 00:00:00"), "b"), ("k", ts("2024-01-02 00:00:00"), "c"), ("k", None, "d")]
    out = streams.idempotent_batch(spark.createDataFrame(rows, "idempotency_key string, ts timestamp, body string"))
    assert out.columns == ["idempotency_key", "ts", "body"] and [r["body"] for r in out.orderBy("body").collect()] == ["a", "c"]


def test_realised_profit_begins_anew_each_year(spark):
    at = [ts("2023-05-01 00:00:00"), ts("2023-06-01 00:00:00"), ts("2024-02-01 00:00:00")]
    rows = [("c", "main", "i", side, Decimal(q), Decimal(p), at[k], k) for k, (side, q, p) in enumerate([("BUY", 10, 5), ("SELL", 4, 7), ("SELL", 2, 8)])]
    df = spark.createDataFrame(rows, "client_id string, account_id string, instrument_id string, side string, quantity decimal(18,8), price decimal(18,8), executed_at timestamp, trade_id long")
    assert [(r["realized"], r["realized_ytd"]) for r in portfolio.position_updates(df, ["trade_id"]).orderBy("trade_id").collect()] == [(0, 0), (8, 8), (14, 6)]


def _days(spark, first, last):
    """Ticks of two clients and two instruments, some days without one."""
    rows = [(f"i{k % 2}", "EQ", "s", "g", f"c{k % 3 % 2}", "SELL" if k % 5 == 0 else "BUY", dt.date(2022, 1, 1) + dt.timedelta(days=d), dt.datetime(2022, 1, 1) + dt.timedelta(days=d, hours=k), d * 4 + k, Decimal(100 + (d * 37 + k * 11) % 41), 10 + (d + k) % 7) for d in range(first, last) for k in range(4) if (d * 7 + k) % 3]
    return spark.createDataFrame(rows, "instrument_id string, instrument_type string, sector string, geography string, client_id string, side string, trade_date date, source_timestamp timestamp, id long, last_price decimal(18,2), volume long")


def test_gold_by_days_equals_a_full_run_and_reads_no_earlier_day(spark, tmp_path):
    """Far more rows of an instrument than its longest window; silver of earlier days is gone before the next run."""
    import shutil

    day = lambda d: str(dt.date(2022, 1, 1) + dt.timedelta(days=d))
    whole, steps, silver_path = str(tmp_path / "whole"), str(tmp_path / "steps"), str(tmp_path / "silver")
    jobs.run_gold(_days(spark, 0, 310), whole, day(290), ["id"])
    for start, first, last in ((0, 290, 295), (295, 295, 300), (300, 300, 310)):
        _days(spark, start, last).write.mode("overwrite").parquet(silver_path)
        jobs.run_gold(spark.read.parquet(silver_path), steps, day(first), ["id"])
        shutil.rmtree(silver_path)
    for name in ("daily_trade_summaries", "instrument_performance", "client_portfolio_snapshots", "risk_exposure_aggregates"):
        a, b = (spark.read.parquet(f"{p}/{name}") for p in (whole, steps))
        key = [c for c in ("client_id", "instrument_id", "sector", "geography", "trade_date") if c in a.columns]
        columns = [c for c in a.columns if dict(a.dtypes)[c] == "double"]
        x, y = ([tuple(r) for r in df.select(*key, *(F.round(c, 9) for c in columns)).orderBy(*key).collect()] for df in (a, b))
        assert x == y, name
    later = spark.read.parquet(f"{steps}/instrument_performance").where("return_252d is not null")
    assert later.count() > 20


def test_a_run_of_old_days_makes_later_states_stale(spark, tmp_path):
    out = str(tmp_path)
    add = lambda *rows: spark.createDataFrame(rows, jobs._VERSIONS).write.mode("append").parquet(f"{out}/state/versions")
    assert jobs._version(spark, out, "2022-01-05") is None
    add(("2022-01-03", "2022-01-01", 1), ("2022-01-06", "2022-01-04", 2), ("2022-01-09", "2022-01-07", 3))
    assert jobs._version(spark, out, "2022-01-10") == "2022-01-09" and jobs._version(spark, out, "2022-01-05") == "2022-01-03"
    add(("2022-01-09", "2022-01-02", 4))  # late ticks of the second day
    assert jobs._version(spark, out, "2022-01-08") is None and jobs._version(spark, out, "2022-01-10") == "2022-01-09"


def test_a_large_partition_is_written_by_several_tasks(spark, tmp_path):
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "64k")
    try:
        rows = spark.range(0, 200_000, 1, 8).select("id", F.xxhash64("id").alias("v"), F.lit("one").alias("d"))
        sinks.write_partitions(rows, str(tmp_path / "t"), ["d"], sort=["id"])
    finally:
        spark.conf.unset(size)
    assert spark.read.parquet(str(tmp_path / "t")).select(F.input_file_name()).distinct().count() > 4


CHANGES = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType()), T.StructField("operation", T.StringType()), T.StructField("lsn", T.LongType())])


def _changes(spark, rows):
    return spark.createDataFrame(rows, CHANGES)


def test_compaction_rewrites_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "c")
    keys, order = ["id"], ["lsn"]
    now = lambda: {r["id"]: r["v"] for r in compacted.current(spark, path, CHANGES, keys, order).collect()}
    compacted.append(_changes(spark, [(k, f"load {k}", "INSERT", None) for k in range(40)]), path, keys, -1, 8)
    assert sorted(compacted.compact(spark, path, CHANGES, keys, order)) == list(range(8)) and len(now()) == 40
    compacted.append(_changes(spark, [(3, "three", "UPDATE", 5), (3, "older", "UPDATE", 4), (9, None, "DELETE", 9)]), path, keys, 0, 8)
    assert now()[3] == "three" and 9 not in now()
    touched = compacted.compact(spark, path, CHANGES, keys, order)
    held = compacted.snapshots(spark, path)
    assert 1 <= len(touched) <= 2 and {b for b, u in held.items() if u == 0} == set(touched)
    compacted.append(_changes(spark, [(9, "late, older than the deletion", "UPDATE", 7)]), path, keys, 1, 8)
    assert 9 not in now()
    compacted.compact(spark, path, CHANGES, keys, order)
    assert 9 not in now() and compacted.compact(spark, path, CHANGES, keys, order) == []
    compacted.append(_changes(spark, [(9, "back", "INSERT", 20)]), path, keys, 2, 8)
    assert now()[9] == "back" and len(now()) == 40
    gone = compacted.vacuum(spark, path)
    assert gone >= len(touched) and now()[9] == "back" and len(now()) == 40


def test_a_stream_of_changes_is_compacted(spark, tmp_path):
    path = str(tmp_path / "c")
    compacted.append(_changes(spark, [(1, "a", "INSERT", None), (2, "b", "INSERT", None)]), path, ["id"], -1, 4)
    for rows in ([(1, "x", "UPDATE", 1)], [(2, None, "DELETE", 2), (3, "n", "INSERT", 3)]):
        _changes(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        feed = streams.parquet_stream(spark, str(tmp_path / "in"), CHANGES)
        streams.compacted_changes(feed, path, str(tmp_path / "cp"), ["id"], ["lsn"], 4, compact_every=2).awaitTermination()
    assert set(compacted.snapshots(spark, path).values()) == {1}
    assert sorted(map(tuple, compacted.current(spark, path, CHANGES, ["id"], ["lsn"]).collect())) == [(1, "x"), (3, "n")]


def test_a_refresh_writes_what_changed_only(spark, tmp_path):
    path = str(tmp_path / "g")
    frame = lambda rows: graph.bulk_vertices("Client", spark.createDataFrame(rows, "k long, v string"), "k", {"v": "v"})
    for version, rows in enumerate(([(1, "a"), (2, "b"), (3, "c")], [(1, "a"), (2, "z"), (4, None)], [(1, "a"), (2, "z"), (4, None)], [(4, "d"), (3, "c")])):
        graph_files.export_changes({"client": frame(rows)}, path, version)
    assert [tuple(r) for r in graph_files.versions(spark, path).orderBy("version").collect()] == [(0, "client", 3, 0, 0), (1, "client", 1, 1, 1), (2, "client", 0, 0, 0), (3, "client", 1, 1, 2)]
    assert not (tmp_path / "g" / "changes" / "version=2").exists()
    assert spark.read.option("header", True).csv(f"{path}/changes/version=1/name=client/kind=changed").first()[:] == ("Client:2", "Client", "z")
    out = graph_files.applied(spark, path, "client", ["~id", "~label", "v:String"])
    assert sorted(map(tuple, out.collect())) == [("Client:3", "Client", "c"), ("Client:4", "Client", "d")]


def test_sketches_of_parts_are_the_sketch_of_the_whole(spark):
    rng = random.Random(6)
    values = [rng.choice((rng.gauss(0, 1), rng.expovariate(1e-6), -rng.random() * 1e-9, 0.0)) for _ in range(3000)] + [None, float("nan")]
    df = spark.createDataFrame([(k % 5, v) for k, v in enumerate(values)], "day long, x double")
    parts = governance.merge(governance.sketch(df, ["x"], ["day"]))
    assert sorted(map(str, parts.collect())) == sorted(map(str, governance.sketch(df, ["x"]).collect()))
    shares = [0.01, 0.25, 0.5, 0.9, 0.999]
    known = sorted(v for v in values if v is not None and v == v)
    got = {r["share"]: r["value"] for r in governance.sketch_quantiles(parts, shares).collect()}
    for share in shares:
        exact = known[max(int(np.ceil(share * len(known))) - 1, 0)]
        assert abs(got[share] - exact) <= governance.ERROR * abs(exact) * 1.000001
    assert governance.sketch_drift(parts, parts).agg(F.max("psi")).first()[0] == pytest.approx(0)


def test_drift_is_found_and_missing_values_are_a_bin(spark):
    old = governance.sketch(spark.range(1, 1001).selectExpr("cast(id as double) as x"), ["x"])
    new = governance.sketch(spark.range(1, 1001).selectExpr("case when id % 4 > 0 then cast(id * 2 as double) end as x"), ["x"])
    out = governance.sketch_drift(old, new)
    assert out.first()["psi"] > 0.25 and out.where("bin is null").first()["current_share"] == 0.25


def test_daily_volume_report_reaches_back_to_its_first_day(spark):
    from tidelake.plans.queries import QUERIES

    first = QUERIES["report_daily_volume"](spark, "/root/testdata/sf0.001").agg(F.min("trade_date")).first()[0]
    assert "1998-01-01" <= first <= "1998-01-31"


def test_positions_in_whole_numbers_agree_with_decimals():
    rng, unit = random.Random(3), Decimal("1e-8")
    exact, whole = portfolio.opening(), (0, 0, 0, 0, 0, 0, None)
    for k in range(2_000):
        side, q, p, year = rng.choice(("BUY", "SELL")), rng.randrange(1, 10**11), rng.randrange(1, 10**11), 2000 + k // 300
        exact, whole = portfolio.after(exact, side, q * unit, p * unit, year), portfolio.after_units(whole, side, q, p, year)
        assert [int(x / unit) for x in exact[1:6]] == list(whole[1:6])


def test_positions_beyond_long(spark):
    """Amounts over 64 bits, negative ones and keys with a null."""
    rows = [("a", None, "i", "BUY", Decimal("3000000"), Decimal("90000.5"), ts("2024-01-01 00:00:00"), 1), ("a", None, "i", "SELL", Decimal("1"), Decimal("1"), ts("2024-01-02 00:00:00"), 2), ("b", "m", "i", "SELL", Decimal("2"), Decimal("0.00000003"), ts("2024-01-02 00:00:00"), 3)]
    df = spark.createDataFrame(rows, "client_id string, account_id string, instrument_id string, side string, quantity decimal(28,8), price decimal(28,8), executed_at timestamp, k long")
    found = {r["client_id"]: r for r in portfolio.positions(df, ["k"]).collect()}
    assert (found["a"]["quantity"], found["a"]["average_cost"], found["a"]["cash"], found["a"]["realized"]) == (Decimal(2999999), Decimal("90000.5"), Decimal("-270001499999"), Decimal("-89999.5"))
    assert (found["b"]["quantity"], found["b"]["cash"]) == (Decimal(-2), Decimal("6e-8"))


def test_folds_are_dealt_to_many_tasks(spark):
    rows = spark.range(100).select(F.col("id").cast("string").alias("client_id"), F.lit("m").alias("account_id"), F.lit("i").alias("instrument_id"), F.lit("BUY").alias("side"), F.lit(1).alias("quantity"), F.lit(2).alias("price"), F.current_timestamp().alias("executed_at"), "id")
    assert portfolio.position_updates(rows, ["id"]).rdd.getNumPartitions() >= 192


SMALL = "/root/testdata/sf0.001"


def test_margin_decisions_fold_their_trades_once(spark):
    """Totals and orders take the same positions, which are stored."""
    from tidelake.plans.queries import QUERIES

    out = QUERIES["margin_decisions"](spark, SMALL)
    assert "MapInArrow" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert not [f for f in out.inputFiles() if "/lineitem" in f]


def test_tail_of_few_scopes_is_not_dealt_by_scope(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"c{k % 7}", f"s{k % 3}", "g", f"d{k % 4}", rng.choice((None, 0.0, round(rng.uniform(-1, 1), 2)))) for k in range(900)]
    spark.createDataFrame(rows, "client_id string, sector string, geography string, trade_date string, position_return double").write.parquet(str(tmp_path / "p"))
    positions = spark.read.parquet(str(tmp_path / "p"))
    keys = ["client_id", "sector", "geography", "trade_date"]
    tail = F.percent_rank().over(Window.partitionBy("sector").orderBy("position_return")) <= 0.05
    want = positions.withColumn("t", tail).groupBy(*keys).agg(F.avg(F.when(F.col("t"), F.col("position_return"))).alias("e"), F.count("*").alias("n"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = gold.tail_shortfall(positions, ["sector"], spread=True)
        assert not [f for f in out.inputFiles() if f.startswith(f"file://{tmp_path}")] and "SortMergeJoin" not in out._jdf.queryExecution().sparkPlan().toString()
        key = lambda rows: sorted(map(str, rows))
        assert key([tuple(r) for r in want.select(*keys, F.round("e", 9), "n").collect()]) == key([tuple(r) for r in out.select(*keys, F.round("expected_shortfall", 9), "observation_count").collect()])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_return_ranks_derive_returns_once(spark):
    from tidelake.plans.queries import QUERIES

    assert not [f for f in QUERIES["return_ranks"](spark, SMALL).inputFiles() if "/lineitem" in f]


def test_silver_shuffles_no_derived_column(spark, tmp_path, monkeypatch):
    given, real = [], silver.enrich
    monkeypatch.setattr(silver, "enrich", lambda df, *more: given.append(df._jdf.queryExecution().analyzed().toString()) or real(df, *more))
    jobs.run_silver(silver_rows(spark, 2), str(tmp_path), jobs.SilverArguments("p", "s", "v", "2024-01-15 12:00:00", "job"), {"last_price": (0.0, 10.0)})
    assert len(given) == 1 and given[0].startswith("RebalancePartitions")
    out = spark.read.parquet(str(tmp_path / "silver"))
    assert out.where("length(dedup_key) = 64 and spread = 1 and trade_date = '2024-01-15'").count() == 8


def test_links_are_dealt_by_both_ends_and_counted(spark):
    rows = [("E", "a", f"x{k % 50}") for k in range(200)] + [("E", "b", None), ("E", "b", None), ("O", "a", "x0")]
    out = graph.link_counts(spark.createDataFrame(rows, "label string, src string, dst string"))
    assert {tuple(r) for r in out.collect()} == {("E", "a", 200, 50), ("E", "b", 2, 0), ("O", "a", 1, 1)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [label" in plan and ", 192" in plan


def test_gains_are_those_of_sales_from_a_day_on(spark):
    rows = [("BUY", "4", "2.5", "2023-05-01"), ("SELL", "1", "3.5", "2023-12-31"), ("BUY", "2", "4", "2024-01-01"), ("SELL", "2", "5", "2024-01-01"), ("SELL", "1", "1", "2024-03-01")]
    df = spark.createDataFrame([("c", "m", "i", s, Decimal(q), Decimal(p), ts(f"{d} 10:00:00"), k) for k, (s, q, p, d) in enumerate(rows)], "client_id string, account_id string, instrument_id string, side string, quantity decimal(18,0), price decimal(18,2), executed_at timestamp, trade_id long")
    moves = portfolio.position_updates(df, ["trade_id", "executed_at"]).where("side = 'SELL'").select(F.to_date("executed_at").alias("d"), "gain").collect()
    for since in ("2024-01-01", "2023-01-01"):
        found = portfolio.gains(df, ["trade_id"], since).select("trade_date", "gain").collect()
        assert sorted(map(tuple, found)) == sorted(tuple(r) for r in moves if str(r["d"]) >= since)
    assert reports.year_of("2024-02-10", 90) == "2023-01-01" and reports.year_of("2024-03-31", 90) == "2024-01-01"


def test_snapshots_sort_once_and_take_the_last_of_a_day(spark):
    rows = [("2024-01-02", 2, 7), ("2024-01-02", 1, 5), ("2024-01-03", 3, 1), (None, 4, 2), (None, 5, 3)]
    df = spark.createDataFrame([("c", "i", d and dt.date.fromisoformat(d), ts("2024-01-02 10:00:00"), k, "BUY", 1.0, v) for d, k, v in rows], "client_id string, instrument_id string, trade_date date, source_timestamp timestamp, id long, side string, last_price double, volume long")
    out = gold.portfolio_snapshots(df, ["id"])
    assert {(str(r["trade_date"]), r["id"], r["position_quantity"]) for r in out.collect()} == {("None", 5, 5), ("2024-01-02", 2, 17), ("2024-01-03", 3, 18)}
    assert out._jdf.queryExecution().sparkPlan().toString().count("Window ") == 1


def test_values_at_risk_of_a_group_are_exact(spark):
    rng = random.Random(6)
    rows = [(c, "s", "g", "d", rng.choice((None, "i", "j")), 1.0, 1, rng.choice((None, round(rng.uniform(-1, 1), 3)))) for c, n in (("a", 2_000), ("b", 20), ("c", 1)) for _ in range(n)]
    schema = "client_id string, sector string, geography string, trade_date string, instrument_id string, last_price double, volume long, position_return double"
    found = {r["client_id"]: r for r in gold.risk_exposure(spark.createDataFrame(rows, schema), gold.GROUP, accuracy=10, once=True).collect()}
    for c in "abc":
        own = sorted(r[-1] for r in rows if r[0] == c and r[-1] is not None)
        assert found[c]["instrument_count"] == len({r[4] for r in rows if r[0] == c} - {None})
        for share, name in ((0.05, "var_95_pct"), (0.01, "var_99_pct")):
            assert found[c][name] == (own[int(np.ceil(share * len(own))) - 1] if own else None)
