"""Positions at weighted average cost: a fold of trades in order, per client, account and instrument."""

from __future__ import annotations

from datetime import date
from decimal import ROUND_HALF_UP, Context, Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.functions.folds import fold_in_order

KEYS = ["client_id", "account_id", "instrument_id"]
_QTY = "decimal(28,8)"


MONEY = T.DecimalType(28, 8)
_OUT = T.StructType([T.StructField("trade_count", T.LongType()), *(T.StructField(c, MONEY) for c in ("quantity", "average_cost", "cash", "realized", "realized_ytd"))])
#: What a trade does to a position.
MOVE = T.StructType([T.StructField("trade_count", T.LongType()), *(T.StructField(c, MONEY) for c in ("previous_quantity", "new_quantity", "previous_cost", "new_cost", "cash_delta", "cash", "realized", "realized_ytd", "gain"))])

#: Trades seen, quantity, average cost, cash, realised profit, that at the beginning of the year, and the year.
State = tuple[int, Decimal, Decimal, Decimal, Decimal, Decimal, int | None]


def opening() -> State:
    """The state before any trade."""
    zero = Decimal(0)
    return 0, zero, zero, zero, zero, zero, None


def after(state: State, side: str, quantity: Decimal, price: Decimal, year: int) -> State:
    """State after one trade: a purchase moves the average cost, a sale realises profit and leaves it."""
    seen, held, average, cash, realized, began, current = state
    if year != current:
        began = realized
    worth = _rounded(quantity * price)
    if side == "BUY":
        total = held + quantity
        average = _rounded(_CONTEXT.divide(_rounded(held * average) + worth, total)) if total > 0 else price
        return seen + 1, total, average, cash - worth, realized, began, year
    return seen + 1, held - quantity, average, cash + worth, realized + _rounded((price - average) * quantity), began, year


_UNIT = 10**8


def _over(number: int, by: int) -> int:
    """A quotient to the nearest whole number, halves away from zero."""
    near = (2 * abs(number) + by) // (2 * by)
    return near if number >= 0 else -near


def after_units(state: tuple, side: str, quantity: int, price: int, year: int) -> tuple:
    """``after`` with all amounts as whole numbers of 1e-8."""
    seen, held, average, cash, realized, began, current = state
    if year != current:
        began = realized
    worth = _over(quantity * price, _UNIT)
    if side == "BUY":
        total = held + quantity
        average = _over((_over(held * average, _UNIT) + worth) * _UNIT, total) if total > 0 else price
        return seen + 1, total, average, cash - worth, realized, began, year
    return seen + 1, held - quantity, average, cash + worth, realized + _over((price - average) * quantity, _UNIT), began, year


def _opening_units() -> tuple:
    return 0, 0, 0, 0, 0, 0, None


def move(before: State, now: State) -> tuple:
    """``MOVE`` of a trade."""
    return now[0], before[1], now[1], before[2], now[2], now[3] - before[3], now[3], now[4], now[4] - now[5], now[4] - before[4]


_CONTEXT = Context(prec=38)


def _rounded(value: Decimal) -> Decimal:
    """To the eight places of money, as the lake's decimals are."""
    return value.quantize(Decimal("1e-8"), ROUND_HALF_UP, _CONTEXT)


def _exact(trades: DataFrame) -> DataFrame:
    return trades.withColumns({c: F.col(c).cast(_QTY) for c in ("quantity", "price")})


def positions(trades: DataFrame, ties: list[str], keep_closed: bool = False) -> DataFrame:
    """Final position of each key: quantity, average cost, cash flow and realised profit, all and of the last trade's year.

    A fold of each key's trades in order that holds its state only, so a key may have any number."""
    exact = _exact(trades).withColumn("_year", F.year("executed_at"))
    folded = fold_in_order(exact, KEYS, ["executed_at", *ties, "side", "quantity", "price"], ["side", "quantity", "price", "_year"], _OUT, _opening_units, lambda s, t: (after_units(s, *t), []), lambda s: [(*s[:5], s[4] - s[5])], units=True)
    return folded if keep_closed else folded.where("quantity <> 0")


def position_updates(trades: DataFrame, ties: list[str]) -> DataFrame:
    """One row for each trade: ``ties``, side, and what it did to the position (``MOVE``): quantity, cost, cash and profit."""
    exact = _exact(trades).withColumn("_year", F.year("executed_at"))
    kept = [c for c in ties if c not in ("side", "quantity", "price")]
    out = T.StructType([*(exact.schema[c] for c in kept), exact.schema["side"], *MOVE.fields])

    def step(state: tuple, trade: tuple) -> tuple[tuple, list[tuple]]:
        now = after_units(state, *trade[:4])
        return now, [(*trade[4:], trade[0], *move(state, now))]

    return fold_in_order(exact, KEYS, ["executed_at", *ties], ["side", "quantity", "price", "_year", *kept], out, _opening_units, step, lambda s: [], units=True)


def gains(trades: DataFrame, ties: list[str], since: str) -> DataFrame:
    """``(*KEYS, trade_date, gain)`` of each sale from a day on.  All trades are folded; purchases gain nothing and earlier sales go nowhere."""
    first = (date.fromisoformat(since) - date(1970, 1, 1)).days
    day = F.unix_date(F.to_date("executed_at"))
    exact = _exact(trades).withColumns({"_year": F.year("executed_at"), "_day": day})
    out = T.StructType([T.StructField("_day", T.IntegerType()), T.StructField("gain", MONEY)])

    def step(state: tuple, trade: tuple) -> tuple[tuple, list[tuple]]:
        now = after_units(state, *trade[:4])
        return now, [(trade[4], now[4] - state[4])] if trade[0] != "BUY" and trade[4] is not None and trade[4] >= first else []

    folded = fold_in_order(exact, KEYS, ["executed_at", *ties], ["side", "quantity", "price", "_year", "_day"], out, _opening_units, step, lambda s: [], units=True)
    return folded.select(*KEYS, F.date_from_unix_date("_day").alias("trade_date"), "gain")


def totals(held: DataFrame, prices: DataFrame, cash: DataFrame) -> DataFrame:
    """Per client and account: market value, profit, positions, total value and margin available."""
    valued = held.join(prices, "instrument_id", "left").withColumns({"q": F.col("quantity").cast("double"), "a": F.col("average_cost").cast("double")})
    price = F.coalesce("latest_price", F.col("a"))
    profit = F.when(F.col("q") > 0, (price - F.col("a")) * F.col("q")).otherwise(0.0)
    cost = F.sum(F.when(F.col("q") > 0, F.col("q") * F.col("a")).otherwise(0.0))
    per = valued.groupBy("client_id", "account_id").agg(F.sum(F.col("q") * price).alias("market_value"), F.sum(profit).alias("unrealized_pnl"), cost.alias("position_cost"), F.count("*").alias("total_positions"), F.sum(F.col("realized").cast("double")).alias("realized_pnl"))
    out = per.join(cash, ["client_id", "account_id"], "left").withColumn("cash_balance", F.coalesce("cash_balance", F.lit(0.0)))
    out = out.withColumn("total_value", F.col("cash_balance") + F.col("market_value"))
    out = out.withColumn("margin_available", F.least("cash_balance", F.col("total_value") * 0.5 - F.col("position_cost")))
    return out.withColumn("margin_utilization_pct", F.when(F.col("total_value") > 0, F.col("position_cost") / F.col("total_value") * 100))


def margin_decisions(orders: DataFrame, portfolios: DataFrame, held: DataFrame) -> DataFrame:
    """Orders with the margin they need and APPROVED, PENDING_REVIEW or REJECTED."""
    own = held.select("client_id", "instrument_id", F.col("quantity").cast("double").alias("held"))
    out = orders.join(portfolios.select("client_id", "margin_available"), "client_id", "left").join(own, ["client_id", "instrument_id"], "left")
    value = F.col("order_quantity") * F.col("order_price")
    owned = F.coalesce("held", F.lit(0.0))
    need = F.when((F.col("side") == "BUY") | F.col("margin_available").isNull(), value * 0.5).when(F.col("held").isNotNull() & (F.col("order_quantity") <= owned), 0.0).otherwise((F.col("order_quantity") - owned) * F.col("order_price") * 0.25)
    out = out.withColumn("margin_needed", need)
    left = F.coalesce("margin_available", F.lit(0.0)) - F.col("margin_needed")
    status = (
        F.when(F.col("margin_available").isNull(), "REJECTED")
        .when((F.col("margin_needed") <= 0) | (F.col("margin_available") >= F.col("margin_needed")), "APPROVED")
        .when(left >= -(F.col("margin_available") * 0.1), "PENDING_REVIEW")
        .otherwise("REJECTED")
    )
    return out.withColumns({"margin_after": left, "status": status})
