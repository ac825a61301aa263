"""Silver to gold: daily summaries, performance, client snapshots and risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelake.functions.columns import ratio
from tidelake.lineage import cut, stored
from tidelake.operators import ordered


def daily_summaries(ticks: DataFrame, ties: list[str]) -> DataFrame:
    """Per instrument and day: open, high, low, close, volume, turnover, count and VWAP, in one aggregation.

    Open and close are the prices at the first and last of (source_timestamp, ties)."""
    order = F.struct("source_timestamp", *ties)
    price, turnover = F.col("last_price"), F.sum(F.col("last_price") * F.col("volume"))
    daily = ticks.groupBy("instrument_id", "trade_date").agg(
        F.min_by("instrument_type", order).alias("instrument_type"),
        F.min_by(price, order).alias("open_price"),
        F.max(price).alias("high_price"),
        F.min(price).alias("low_price"),
        F.max_by(price, order).alias("close_price"),
        F.sum("volume").alias("total_volume"),
        turnover.alias("turnover"),
        F.count("*").alias("trade_count"),
    )
    return daily.withColumn("vwap", ratio(F.col("turnover"), F.col("total_volume")))


def daily_quotes(ticks: DataFrame) -> DataFrame:
    """Per instrument and day: mean spread, source rows, and the share of rows with a whole, uncrossed quote in per cent."""
    bid, ask = F.col("bid_price").cast("double"), F.col("ask_price").cast("double")
    good = F.count_if(F.coalesce(ask >= bid, F.lit(False)) & F.col("last_price").isNotNull())
    return ticks.groupBy("instrument_id", "trade_date").agg(F.avg(ask - bid).alias("avg_spread"), F.count("*").alias("source_record_count"), (good * 100.0 / F.count("*")).alias("quality_score"))


def daily_moves(daily: DataFrame, annualization: float = 252.0) -> DataFrame:
    """Daily summaries with the return on the day before in per cent, and its volatility over 20 rows."""
    by_day = Window.partitionBy("instrument_id").orderBy("trade_date")
    close, before = F.col("close_price").cast("double"), F.lag("close_price").over(by_day).cast("double")
    out = daily.withColumn("daily_return_pct", F.when(before > 0, (close - before) / before * 100))
    return out.withColumn("volatility_20d", F.stddev(F.col("daily_return_pct") / 100).over(by_day.rowsBetween(-19, 0)) * annualization)


#: Rows of an instrument that its longest window reaches back.
LONGEST = 252


def performance(daily: DataFrame, annualization: float = 252.0, risk_free: float = 0.05, state: DataFrame | None = None) -> DataFrame:
    """Per instrument and day: returns over 1 to 252 rows, volatility, Sharpe ratio, RSI,
    drawdown and average volume.  All windows share one partitioning and order.

    ``state`` is what ``performance_state`` gave for the days before those of ``daily``."""
    by_day = Window.partitionBy("instrument_id").orderBy("trade_date")
    last = lambda n: by_day.rowsBetween(1 - n, 0)
    out = _falls(daily, state)
    out = out.withColumns({f"return_{n}d": F.when(F.lag("_close", n).over(by_day) > 0, (F.col("_close") - F.lag("_close", n).over(by_day)) / F.lag("_close", n).over(by_day)) for n in (1, 5, 20, 60, LONGEST)})
    out = out.withColumn("daily_return", F.col("return_1d"))
    out = out.withColumns({f"volatility_{n}d": F.stddev("daily_return").over(last(n)) * annualization for n in (20, 60)})
    out = out.withColumn("sharpe_ratio", F.when(F.col("volatility_60d") > 0, (F.col("return_252d") - risk_free) / F.col("volatility_60d")))
    gain = F.when(F.col("daily_return") > 0, F.col("daily_return")).otherwise(0.0)
    loss = F.when(F.col("daily_return") < 0, -F.col("daily_return")).otherwise(0.0)
    out = out.withColumns({"_gain": gain, "_loss": loss})
    out = out.withColumns({"_gain": F.avg("_gain").over(last(14)), "_loss": F.avg("_loss").over(last(14))})
    rsi = F.when(F.col("_loss") > 0, 100 - 100 / (1 + F.col("_gain") / F.col("_loss"))).when(F.col("_gain") > 0, 100.0).otherwise(50.0)
    deepest = F.min(F.least("_fall", "_worst")).over(by_day.rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumns({"rsi": rsi, "avg_volume_20d": F.avg("total_volume").over(last(20)), "max_drawdown": deepest})
    return out.where("not _old").drop("_close", "_gain", "_loss", "_top", "_fall", "_old", "_peak", "_worst")


def performance_state(daily: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """What later days need of each instrument: its last closes and volumes, highest close and deepest fall."""
    kept = F.sort_array(F.collect_list(F.struct("trade_date", F.col("_close").alias("close"), F.col("total_volume").alias("volume"))))
    out = _falls(daily, state).groupBy("instrument_id").agg(kept.alias("last"), F.max(F.greatest("_close", "_peak")).alias("peak"), F.min(F.least("_fall", "_worst")).alias("worst"))
    return out.withColumn("last", F.slice("last", F.greatest(F.size("last") - LONGEST + 1, F.lit(1)), LONGEST))


def _falls(daily: DataFrame, state: DataFrame | None) -> DataFrame:
    """Days with those of the state before them, and how far each new close is below the highest so far."""
    none = F.lit(None).cast("double")
    out = daily.withColumns({"_close": F.col("close_price").cast("double"), "_old": F.lit(False), "_peak": none, "_worst": none})
    if state is not None:
        old = state.select("instrument_id", "peak", "worst", F.explode("last").alias("r"))
        old = old.select("instrument_id", F.col("r.trade_date").alias("trade_date"), F.col("r.close").alias("_close"), F.col("r.volume").cast(daily.schema["total_volume"].dataType).alias("total_volume"), F.lit(True).alias("_old"), F.col("peak").alias("_peak"), F.col("worst").alias("_worst"))
        out = out.unionByName(old, allowMissingColumns=True)
    so_far = Window.partitionBy("instrument_id").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    # The peak of earlier days holds for all new ones; falls of earlier days are in their worst one.
    out = out.withColumn("_top", F.max(F.greatest("_close", "_peak")).over(so_far))
    return out.withColumn("_fall", F.when(~F.col("_old"), F.col("_close") / F.col("_top") - 1))


def signed_quantity(side: Column, volume: Column) -> Column:
    """Volume bought, or minus the volume sold."""
    return F.when(side == "BUY", volume).otherwise(-volume)


def holdings(trades: DataFrame, ties: list[str], state: DataFrame | None = None) -> DataFrame:
    """What later days need of each client and instrument: quantity, cost of purchases and last price."""
    bought = F.when(F.col("side") == "BUY", F.col("last_price") * F.col("volume")).otherwise(0)
    new = trades.groupBy("client_id", "instrument_id").agg(
        F.sum(signed_quantity(F.col("side"), F.col("volume"))).alias("quantity"),
        F.sum(bought).alias("cost"),
        F.max_by(F.struct(F.col("last_price").alias("p")), F.struct("trade_date", "source_timestamp", *ties)).alias("last"),
    )
    if state is None:
        return new
    kinds = {f.name: f.dataType for f in new.schema}
    # Earlier figures first: the last price is that of the newest days with a trade.
    both = state.select("client_id", "instrument_id", *(F.col(c).cast(kinds[c]).alias(c) for c in ("quantity", "cost")), "last", F.lit(0).alias("_n")).unionByName(new.withColumn("_n", F.lit(1)))
    return both.groupBy("client_id", "instrument_id").agg(F.sum("quantity").alias("quantity"), F.sum("cost").cast(kinds["cost"]).alias("cost"), F.max_by("last", "_n").alias("last"))


def _carried(trades: DataFrame, state: DataFrame | None) -> DataFrame:
    """Trades with the state of their client and instrument before the first of them."""
    if state is None:
        return trades.withColumns({"_quantity": F.lit(0).cast("long"), "_cost": F.lit(0).cast("decimal(38,2)"), "_last": F.lit(None).cast("double")})
    before = state.select("client_id", "instrument_id", F.col("quantity").alias("_quantity"), F.col("cost").alias("_cost"), F.col("last.p").cast("double").alias("_last"))
    return trades.join(before, ["client_id", "instrument_id"], "left")


def portfolio_snapshots(trades: DataFrame, ties: list[str], state: DataFrame | None = None) -> DataFrame:
    """Per client, instrument and day the last state: quantity, average cost (of purchases), value and profit.

    ``state`` is what ``holdings`` gave for the days before those of ``trades``."""
    running = Window.partitionBy("client_id", "instrument_id").orderBy("trade_date", "source_timestamp", *ties)
    upto = running.rowsBetween(Window.unboundedPreceding, 0)
    bought = F.when(F.col("side") == "BUY", F.col("last_price") * F.col("volume")).otherwise(0)
    following = F.lead(F.struct("trade_date")).over(running)  # null after the last one
    latest = following.isNull() | ~following["trade_date"].eqNullSafe(F.col("trade_date"))
    state_of = _carried(trades, state).withColumns({"position_quantity": F.sum(signed_quantity(F.col("side"), F.col("volume"))).over(upto), "total_cost": F.sum(bought).over(upto), "_latest": latest})
    state_of = state_of.withColumns({"position_quantity": F.col("position_quantity") + F.coalesce("_quantity", F.lit(0)), "total_cost": F.col("total_cost") + F.coalesce("_cost", F.lit(0))})
    last = state_of.where("_latest").withColumn("avg_cost_basis", ratio(F.col("total_cost"), F.col("position_quantity")))
    price = F.col("last_price").cast("double")
    profit = F.when(F.col("position_quantity") > 0, (price - F.col("avg_cost_basis")) * F.col("position_quantity")).otherwise(0.0)
    return last.withColumns({"current_price": price, "market_value": F.col("position_quantity") * price, "unrealized_pnl": profit}).drop("_latest", "_quantity", "_cost", "_last")


def position_returns(positions: DataFrame, ties: list[str], state: DataFrame | None = None) -> DataFrame:
    """Adds the return of each row on the one before it of its client and instrument (or of ``state``); 0 without one."""
    order = Window.partitionBy("client_id", "instrument_id").orderBy("trade_date", "source_timestamp", *ties)
    price, before = F.col("last_price").cast("double"), F.lag(F.col("last_price").cast("double")).over(order)
    out = _carried(positions, state).withColumn("_before", F.coalesce(before, F.when(F.row_number().over(order) == 1, F.col("_last"))))
    return out.withColumn("position_return", F.when(F.col("_before") > 0, (price - F.col("_before")) / F.col("_before")).otherwise(0.0)).drop("_quantity", "_cost", "_last", "_before")


#: What a row of risk is about.
GROUP = ["client_id", "sector", "geography", "trade_date"]
#: Most scopes whose ends go to all tasks.
SCOPES = 100_000


def _tails(positions: DataFrame, scope: list[str], spread: bool) -> DataFrame:
    """Positions with ``_tail``: is the return among the lowest of its scope?"""
    if not spread:
        return positions.withColumn("_tail", F.percent_rank().over(Window.partitionBy(*scope).orderBy("position_return")) <= 0.05)
    ends = cut(ordered.lowest(positions, scope, "position_return", 0.05, "_end"))
    if scope:
        # A few scopes would be the keys, and so the tasks, of all rows.
        ranked = positions.join(F.broadcast(ends) if ends.count() <= SCOPES else ends, scope, "left")
    else:
        ranked = positions.crossJoin(ends)  # one row
    return ranked.withColumn("_tail", F.col("position_return") <= F.col("_end"))


def tail_shortfall(positions: DataFrame, tail_scope: list[str] = ("client_id", "sector", "geography"), spread: bool = False) -> DataFrame:
    """Two columns of ``risk_exposure``, ``expected_shortfall`` and ``observation_count``, without deriving the others.

    With ``spread`` the returns are written, as the ends of tails and the groups both take them."""
    if spread:
        positions = stored(positions.select(*dict.fromkeys([*GROUP, *tail_scope]), "position_return"))
    ranked = _tails(positions, list(tail_scope), spread)
    return ranked.groupBy(*GROUP).agg(F.avg(F.when(F.col("_tail"), F.col("position_return"))).alias("expected_shortfall"), F.count("*").alias("observation_count"))


def risk_exposure(positions: DataFrame, tail_scope: list[str] = ("client_id", "sector", "geography"), accuracy: int = 10_000, spread: bool = False, once: bool = False) -> DataFrame:
    """Per client, sector, geography and day: exposure, value at risk, expected shortfall,
    volatility and beta.  The tail rank runs over ``tail_scope``, across days by default; an empty one is all rows.

    With ``once`` the groups are written and the market of a day is added up from them, so positions are not derived again
    for it; that is for callers that use most columns, as a written group has them all.
    A scope is sorted in one task.  ``spread`` is for scopes of more rows than that: the value at which
    the tail ends is found by ranges (``ordered.lowest``), with the same results.  If the scope is the group itself,
    its rows are in order already, and values at risk are those at their places, which is exact."""
    scope, keys = list(tail_scope), GROUP
    ranked = _tails(positions, scope, spread)
    if not spread and set(scope) == set(keys):
        order = Window.partitionBy(*scope).orderBy("position_return")
        every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        held = F.count("position_return").over(every)
        # One more sort of the same rows takes less than tables of (group, instrument).
        new = F.col("instrument_id").isNotNull() & ~F.lag("instrument_id").over(Window.partitionBy(*scope).orderBy("instrument_id")).eqNullSafe(F.col("instrument_id"))
        instruments = F.count_if("_new")
        # Nulls come first and have no place.
        ranked = ranked.withColumn("_new", new).withColumns({"_held": held, "_place": F.row_number().over(order) - F.count("*").over(every) + held})
        at_risk = lambda share: F.max(F.when(F.col("_place") == F.ceil(F.col("_held") * share), F.col("position_return")))
    else:
        at_risk = lambda share: F.percentile_approx("position_return", F.lit(share), accuracy)
        instruments = F.count_distinct("instrument_id")
    exposure = F.col("last_price") * F.col("volume")
    groups = ranked.groupBy(*keys).agg(
        F.sum(exposure).cast("double").alias("total_exposure"),
        at_risk(0.05).alias("var_95_pct"),
        at_risk(0.01).alias("var_99_pct"),
        F.avg(F.when(F.col("_tail"), F.col("position_return"))).alias("expected_shortfall"),
        F.avg("position_return").alias("avg_return"),
        F.stddev("position_return").alias("return_volatility"),
        instruments.alias("instrument_count"),
        F.count("*").alias("observation_count"),
        F.count("position_return").alias("_n"),
        F.min("position_return").alias("_low"),
        F.max("position_return").alias("_high"),
    )
    if once:
        groups = stored(groups)
        market = F.broadcast(_market(groups))  # a row for each day
    else:
        market = positions.groupBy("trade_date").agg(F.avg("position_return").alias("market_avg_return"), F.var_samp("position_return").alias("market_variance"))
    out = groups.drop("_n", "_low", "_high").join(market, "trade_date", "left")
    beta = F.when(F.col("market_variance") > 0, F.try_divide("avg_return", "market_avg_return")).otherwise(1.0)
    return out.withColumns({"var_95_dollars": F.abs("var_95_pct") * F.col("total_exposure"), "expected_shortfall_dollars": F.abs("expected_shortfall") * F.col("total_exposure"), "beta": beta})


def _market(groups: DataFrame) -> DataFrame:
    """``(trade_date, market_avg_return, market_variance)`` of all rows of a day, from the figures of its groups."""
    mean, n = F.col("avg_return"), F.col("_n")
    inside = F.coalesce(F.col("return_volatility") * F.col("return_volatility") * (n - 1), F.lit(0.0))
    days = groups.where("_n > 0").groupBy("trade_date").agg(
        F.sum("_n").alias("_n"), F.sum(mean * n).alias("_sum"), F.sum(inside + mean * mean * n).alias("_squares"), F.min("_low").alias("_low"), F.max("_high").alias("_high"),
    )
    average = F.col("_sum") / F.col("_n")
    # Equal returns have none, others some, whatever rounding leaves of the difference.
    spread = F.greatest((F.col("_squares") - F.col("_sum") * average) / (F.col("_n") - 1), F.lit(5e-324))
    variance = F.when(F.col("_n") > 1, F.when(F.col("_low") == F.col("_high"), 0.0).otherwise(spread))
    return days.select("trade_date", average.alias("market_avg_return"), variance.alias("market_variance"))


def beta_regression(positions: DataFrame) -> DataFrame:
    """Slope of each client's daily mean return on the market's, over days."""
    market = positions.groupBy("trade_date").agg(F.avg("position_return").alias("market_return"))
    client = positions.groupBy("client_id", "trade_date").agg(F.avg("position_return").alias("client_return"))
    pairs = client.join(market, "trade_date")
    return pairs.groupBy("client_id").agg(F.try_divide(F.covar_samp("client_return", "market_return"), F.var_samp("market_return")).alias("beta"), F.count("*").alias("days"))


def risk_levels(positions: DataFrame) -> DataFrame:
    """Exposure by client, by sector and by geography in one table, from one pass with grouping sets."""
    exposure = F.col("last_price") * F.col("volume")
    grouped = positions.groupingSets([["client_id"], ["sector"], ["geography"]], "client_id", "sector", "geography").agg(F.sum(exposure).cast("double").alias("total_exposure"), F.count("*").alias("observation_count"), F.grouping_id().alias("_level"))
    level = F.when(F.col("_level") == 3, "CLIENT").when(F.col("_level") == 5, "SECTOR").otherwise("GEOGRAPHY")
    return grouped.select(level.alias("aggregation_level"), F.coalesce("client_id", "sector", "geography").alias("aggregation_key"), "total_exposure", "observation_count")


def exposure_breakdown(positions: DataFrame) -> DataFrame:
    """Per client and sector: long, short and net exposure, and the sector's share of the client's gross."""
    value = F.col("last_price") * F.col("volume")
    long, short = F.sum(F.when(F.col("side") == "BUY", value).otherwise(0)), F.sum(F.when(F.col("side") == "BUY", 0).otherwise(value))
    out = positions.groupBy("client_id", "sector").agg(long.cast("double").alias("long_exposure"), short.cast("double").alias("short_exposure"))
    gross = F.col("long_exposure") + F.col("short_exposure")
    whole = F.sum(gross).over(Window.partitionBy("client_id"))
    return out.withColumns({"net_exposure": F.col("long_exposure") - F.col("short_exposure"), "concentration_pct": F.round(F.try_divide(gross * 100, whole), 5)})


def orphans(child: DataFrame, parent: DataFrame, keys: list[str], relationship: str) -> DataFrame:
    """One row: distinct keys of the child, those the parent has, and the rest."""
    own = child.select(*keys).distinct()
    found = own.join(parent.select(*keys).distinct().withColumn("_there", F.lit(1)), keys, "left")
    return found.agg(F.lit(relationship).alias("relationship"), F.count("*").alias("total"), F.count("_there").alias("valid"), F.count_if(F.col("_there").isNull()).alias("orphans"))
