"""Checks of orders before they trade, and the price that was known at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelake import schemas
from tidelake.functions.columns import errors, missing, one_of


def order_errors() -> Column:
    """Errors of an order request: missing fields alone, or else its sets, quantity and prices."""
    required = ["client_id", "account_id", "instrument_id", "order_type", "side", "quantity", "time_in_force", "idempotency_key"]
    gone = errors(*[(missing(F.col(c)), f"{c}: required") for c in required])
    kind = F.upper("order_type")
    number = lambda c: F.col(c).cast("string").try_cast("decimal(18,8)")

    def price(column: str, kinds: list[str]) -> list[tuple[Column, str]]:
        needed = kind.isin(kinds)
        return [(needed & F.col(column).isNull(), f"{column}: required"), (needed & F.col(column).isNotNull() & number(column).isNull(), f"{column}: number"), (needed & (number(column) <= 0), f"{column}: positive")]

    wrong = errors(
        (~one_of(F.col("order_type"), schemas.ORDER_TYPES), "order_type: unknown"),
        (~one_of(F.col("side"), schemas.SIDES), "side: unknown"),
        (~one_of(F.col("time_in_force"), schemas.TIMES_IN_FORCE), "time_in_force: unknown"),
        (number("quantity").isNull(), "quantity: number"),
        (number("quantity") <= 0, "quantity: positive"),
        (number("quantity") > schemas.MAX_ORDER_QUANTITY, "quantity: above maximum"),
        *price("limit_price", ["LIMIT", "STOP_LIMIT"]),
        *price("stop_price", ["STOP", "STOP_LIMIT"]),
    )
    return F.when(F.size(gone) > 0, gone).otherwise(wrong)


def market_open(ts: Column, extended: bool = True, zone: str = "America/New_York") -> Column:
    """Is a UTC time on a weekday within trading hours of the exchange (4 to 20, or 9:30 to 16)?"""
    local = F.from_utc_timestamp(ts, zone)
    clock = F.date_format(local, "HH:mm")
    low, high = ("04:00", "20:00") if extended else ("09:30", "16:00")
    return ~F.dayofweek(local).isin(1, 7) & (clock >= low) & (clock <= high)


def required_margin(side: Column, notional: Column) -> Column:
    """Half of the value bought, or one and a half of that sold short."""
    return F.when(side == "BUY", notional * 0.5).otherwise(notional * 1.5)


def latest_prices(ticks: DataFrame, ties: list[str]) -> DataFrame:
    """Last known price of each instrument."""
    return ticks.groupBy("instrument_id").agg(F.max_by("last_price", F.struct("source_timestamp", *ties)).cast("double").alias("latest_price"))


def asof_prices(requests: DataFrame, ticks: DataFrame, ties: list[str], keys: list[str] = ("instrument_id",), bucket_seconds: int = 86400 * 30) -> DataFrame:
    """Each request with the last price at or before its time (one at that very time counts).

    Both sides are put in order together, by key and span of time, so that an
    instrument of any size is many tasks' work.  The price with which a span opens
    comes from one aggregated row for each span."""
    span = F.floor(F.unix_seconds("_at") / F.lit(bucket_seconds)).cast("long")
    prices = ticks.select(*keys, F.col("source_timestamp").alias("_at"), F.lit(0).alias("_kind"), F.struct(*ties).alias("_tie"), F.col("last_price").cast("double").alias("_price"))
    asked = requests.select(*keys, F.col("request_ts").alias("_at"), F.lit(1).alias("_kind"), F.struct(*requests.columns).alias("_row"))
    both = prices.unionByName(asked, allowMissingColumns=True).withColumn("_span", span)
    group = [*keys, "_span"]
    last = both.groupBy(*group).agg(F.max_by("_price", F.when(F.col("_kind") == 0, F.struct("_at", "_tie"))).alias("_closing"))
    earlier = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    opening = last.withColumn("_opening", F.last("_closing", ignorenulls=True).over(earlier)).drop("_closing")
    order = Window.partitionBy(*group).orderBy("_at", "_kind", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    known = both.withColumn("_known", F.last("_price", ignorenulls=True).over(order)).where("_kind = 1").select(*group, "_row", "_known")
    return known.join(opening, group, "left").select("_row.*", F.coalesce("_known", "_opening").alias("asof_price"))


def pretrade(orders: DataFrame, instruments: DataFrame, accounts: DataFrame, positions: DataFrame, prices: DataFrame) -> DataFrame:
    """Orders with status, errors and warnings of the checks on instrument, margin and position."""
    joined = orders.join(instruments, "instrument_id", "left").join(prices, "instrument_id", "left").join(accounts, ["client_id"], "left").join(positions, ["client_id", "instrument_id"], "left")
    price = F.coalesce("limit_price", "latest_price", F.lit(schemas.DEFAULT_PRICE))
    out = joined.withColumns({"order_price": price, "required_margin": required_margin(F.col("side"), price * F.col("quantity")), "held": F.coalesce("held", F.lit(0).cast("long"))})
    failures = errors(
        (F.col("tradable").isNull(), "instrument: unknown"),
        (~F.col("tradable"), "instrument: not tradable"),
        (F.col("margin_available").isNull(), "account: unknown"),
        (F.col("margin_available") < F.col("required_margin"), "margin: insufficient"),
        ((F.col("side") == "BUY") & (F.col("held") + F.col("quantity") > schemas.MAX_ORDER_QUANTITY), "position: above limit"),
    )
    short = errors(((F.col("side") == "SELL") & (F.col("quantity") > F.col("held")), "position: becomes short"))
    return out.withColumns({"errors": failures, "warnings": short}).withColumn("status", F.when(F.size("errors") == 0, "ACCEPTED").otherwise("REJECTED"))
