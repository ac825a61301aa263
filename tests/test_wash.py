"""Wash trades: pairs of classes and their members tell every pair of trades."""

import datetime as dt
import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from tidelake.lineage import stored
from tidelake.operators import gold, graph
from tidelake.plans import queries, views

DATA = "/root/testdata/sf0.001"


def test_pairs_and_members_tell_every_pair(spark):
    """Trades of few prices and times, many of them copies, against all pairs one by one; lone trades are no members."""
    rng, day = random.Random(3), dt.datetime(2024, 1, 1)
    rows = [(rng.choice("ab"), rng.choice("ij"), rng.choice(("BUY", "SELL")), rng.choice((10.0, 10.0, 10.005, 10.01, 11.0)), day + dt.timedelta(hours=rng.choice((0, 1, 70, 72, 73, 400))), k, rng.randrange(1, 9)) for k in range(300)]
    rows += [("a", None, "BUY", 10.0, day, 300, 1), ("a", "k", "BUY", 10.0, day, 301, 1), ("a", "i", "SELL", None, day, 302, 1)]
    near = lambda a, b: a[1] == b[1] is not None and {a[2], b[2]} == {"BUY", "SELL"} and None not in (a[3], b[3]) and abs(a[3] - b[3]) < 0.01 and abs(a[4] - b[4]) <= dt.timedelta(days=3)
    expected = {(a[5], b[5]) for a in rows for b in rows if a[2] == "BUY" and near(a, b)}
    classes = graph.wash_classes(spark.createDataFrame(rows, "client_id string, instrument_id string, side string, price double, ts timestamp, trade_id long, quantity long"))
    pairs = graph.wash_pairs(classes, days=3)
    for most in (graph.CLASSES, 0):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(graph, "CLASSES", most)
            members = graph.wash_members(classes, pairs).collect()
        of = {}
        for m in members:
            of.setdefault((m["side"], m["class_id"]), []).append(m["trade_id"])
        met = pairs.collect()
        assert {(a, b) for p in met for a in of["BUY", p["buy_id"]] for b in of["SELL", p["sell_id"]]} == expected
        assert len(met) < len(expected) / 10
        for m in members:
            others = [b for b in rows if near(rows[m["trade_id"]], b)]
            assert (m["matches"], m["quantity"]) == (len(others), sum(b[6] for b in others))


@pytest.mark.skipif(not Path(DATA).exists(), reason="driver tables are absent")
def test_query_tells_which_trades_match(spark):
    """Pairs put together from the query's rows are those of the first form of its SQL (price within 500), between any two clients."""
    con = duckdb.connect()
    for file in Path(DATA).glob("*.parquet"):
        con.sql(f"create view {file.stem} as select * from '{file}'")
    found = queries.QUERIES["wash_trades"](spark, DATA).toPandas()  # noqa: F841  (read by the SQL)
    mine = con.sql("""select buy.trade_id as buy_id, sell.trade_id as sell_id, buy.client_id as buy_client, sell.client_id as sell_client from found p
      join found buy on buy.kind = 'trade' and buy.side = 'BUY' and (buy.instrument_id, buy.price, buy.at, buy.class_id) = (p.instrument_id, p.buy_price, p.buy_at, p.buy_id) join found sell on sell.kind = 'trade' and sell.side = 'SELL' and (sell.instrument_id, sell.price, sell.at, sell.class_id) = (p.instrument_id, p.sell_price, p.sell_at, p.sell_id) where p.kind = 'pair'""").fetchall()
    all_pairs = con.sql(f"""with t as (select * from {queries._WASH} w) select a.trade_id, b.trade_id, a.client_id, b.client_id from t a join t b using (instrument_id)
      where a.side = 'BUY' and b.side = 'SELL' and abs(date_diff('second', a.ts, b.ts)) <= 86400 * 30 and abs(a.price - b.price) < 500.0""").fetchall()
    assert len(all_pairs) > 50 and sorted(mine) == sorted(all_pairs)


@pytest.mark.skipif(not Path(DATA).exists(), reason="driver tables are absent")
def test_lines_are_dealt_once_by_part_and_once_by_order(spark):
    """Trades lie by order after the joins, and rows of lineitem, by far the most, go through two exchanges."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = views.view(spark, DATA, "trades")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = plan[plan.index("hashpartitioning(l_orderkey") :]
    assert plan.count("hashpartitioning(l_") == 2 and "hashpartitioning(l_partkey" in lines and "hashpartitioning(client_id" not in plan


def test_stored_tables_leave_no_shuffle_files(spark):
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    before, rows = files(), spark.range(1000).repartition(7).groupBy((F.col("id") % 10).alias("k")).count()
    out = stored(rows)
    assert files() <= before and out.count() == 10
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


@pytest.mark.skipif(not Path(DATA).exists(), reason="driver tables are absent")
def test_risk_is_dealt_by_client_once(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(gold, "stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stored(df))
    queries.QUERIES["risk_exposure"](spark, DATA)
    assert len(plans) == 1 and plans[0].count("hashpartitioning(client_id") == 1
