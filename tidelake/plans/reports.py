"""The four stored reports over gold."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Share of a client's exposure, in per cent, above which a position is concentrated.
CONCENTRATED = 25.0


def _since(day: str, days: int) -> Column:
    return F.date_sub(F.lit(day).cast("date"), days)


def daily_volume(daily: DataFrame, as_of: str, days: int = 30, accuracy: int = 10_000) -> DataFrame:
    """Instruments by day of the last ``days``: volume, turnover, trades, high, low and median VWAP, newest and largest first.

    ``daily`` has a row for each instrument, day and, if it is dealt so, part of a day."""
    names = ["instrument_id", *(["instrument_name"] if "instrument_name" in daily.columns else []), "trade_date"]
    rows = daily.where(F.col("trade_date") >= _since(as_of, days)).groupBy(*names)
    out = rows.agg(
        F.sum("total_volume").alias("total_volume"), F.sum("turnover").alias("total_turnover"), F.sum("trade_count").alias("total_trades"),
        F.max("high_price").alias("daily_high"), F.min("low_price").alias("daily_low"), F.percentile_approx("vwap", F.lit(0.5), accuracy).alias("median_vwap"),
    )
    return out.orderBy(F.col("trade_date").desc(), F.col("total_volume").desc(), "instrument_id")


def year_of(day: str, days: int) -> str:
    """The first day of the year in which a report of the last ``days`` begins."""
    return f"{(date.fromisoformat(day) - timedelta(days=days)).year:04}-01-01"


def client_days(snapshots: DataFrame, cash: DataFrame, gains: DataFrame) -> DataFrame:
    """Per client and day: market value, cash, unrealised profit, and profit realised since the year began.

    ``snapshots`` are positions by day, ``cash(client_id, cash_balance)``, ``gains(client_id, trade_date, gain)`` of trades."""
    held = snapshots.groupBy("client_id", F.col("trade_date").alias("snapshot_date")).agg(F.sum("market_value").alias("total_market_value"), F.sum("unrealized_pnl").alias("unrealized_pnl"))
    daily = gains.groupBy("client_id", F.col("trade_date").alias("snapshot_date")).agg(F.sum("gain").alias("gain"))
    both = held.join(daily, ["client_id", "snapshot_date"], "full")
    year = Window.partitionBy("client_id", F.year("snapshot_date")).orderBy("snapshot_date").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("realized_pnl_ytd", F.coalesce(F.sum("gain").over(year), F.lit(0))).where("total_market_value is not null")
    return out.join(cash, "client_id", "left").withColumn("cash_balance", F.coalesce("cash_balance", F.lit(0.0))).drop("gain")


def portfolio_performance(days_of_clients: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Clients by day of the last ``days``: value with cash, profits, and the unrealised return in per cent (0 without a value)."""
    rows = days_of_clients.where(F.col("snapshot_date") >= _since(as_of, days))
    value, gain = F.col("total_market_value"), F.col("unrealized_pnl")
    rows = rows.withColumns({"total_portfolio_value": value + F.col("cash_balance"), "unrealized_return_pct": F.when(value > 0, gain / value * 100).otherwise(0.0)})
    columns = ("client_id", "snapshot_date", "total_market_value", "cash_balance", "total_portfolio_value", "unrealized_pnl", "realized_pnl_ytd", "unrealized_return_pct")
    return rows.select(*columns).orderBy("client_id", F.col("snapshot_date").desc())


def concentrations(exposure: DataFrame, profiles: DataFrame) -> DataFrame:
    """Exposures of a day with the client's risk profile and their share of all the client has that day, in per cent."""
    whole = F.sum("total_exposure").over(Window.partitionBy("client_id", "trade_date"))
    out = exposure.withColumn("concentration_pct", F.try_divide(F.col("total_exposure") * 100, whole))
    return out.join(profiles.select("client_id", "risk_profile"), "client_id", "left")


def risk_metrics(exposures: DataFrame, day: str) -> DataFrame:
    """A day's risk by sector, geography and risk profile, largest exposure first."""
    rows = exposures.where(F.col("trade_date") == F.lit(day).cast("date")).groupBy("sector", "geography", "risk_profile")
    out = rows.agg(
        F.count_distinct("client_id").alias("client_count"), F.sum("total_exposure").alias("total_exposure"), F.avg("concentration_pct").alias("avg_concentration"),
        F.max("concentration_pct").alias("max_concentration"), F.count_if(F.col("concentration_pct") > CONCENTRATED).alias("concentrated_positions"),
    )
    return out.orderBy(F.col("total_exposure").desc(), "sector", "geography", "risk_profile")


def regulatory_trades(trades: DataFrame, as_of: str, generated: Column | None = None) -> DataFrame:
    """All trades of the day before, in order of execution, with their value and when the report was made."""
    day = F.date_sub(F.lit(as_of).cast("date"), 1)
    columns = ("trade_id", "instrument_id", "instrument_name", "side", "quantity", "price", "total_value", "execution_timestamp", "settlement_date", "venue", "account_type", "client_id")
    rows = trades.where(F.col("trade_date") == day).withColumn("total_value", F.col("quantity") * F.col("price")).orderBy("execution_timestamp", "trade_id")
    return rows.select(*columns, (F.current_timestamp() if generated is None else generated).alias("report_generated_at"))
