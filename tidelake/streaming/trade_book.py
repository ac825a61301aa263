"""Trades booked in order: a stateful stream over buckets of clients, accounts and instruments."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidelake import schemas
from tidelake.operators import portfolio

_MONEY = portfolio.MONEY
_KEY = [T.StructField(c, T.StringType()) for c in portfolio.KEYS]
_TRADE = [T.StructField("trade_id", T.LongType()), T.StructField("executed_at", T.TimestampType()), T.StructField("side", T.StringType()), T.StructField("quantity", _MONEY), T.StructField("price", _MONEY)]
#: A trade in a processor: its time in microseconds and milliseconds, and its year by the session's time zone.
_HELD = T.StructType([*_KEY, *(T.StructField(f.name, T.LongType()) if f.name == "executed_at" else f for f in _TRADE), T.StructField("ms", T.LongType()), T.StructField("year", T.IntegerType())])
#: One row for each trade that came: its outcome and, if booked, what it did to the position.
BOOKED = T.StructType([*_KEY, *_TRADE, T.StructField("outcome", T.StringType()), *portfolio.MOVE.fields])
_OUT = T.StructType([*_HELD.fields[: len(_KEY) + len(_TRADE)], T.StructField("outcome", T.StringType()), *portfolio.MOVE.fields])
#: Buckets that keys are dealt into; a checkpoint keeps the number it began with.
BUCKETS = 1024


class TradeBook(StatefulProcessor):
    """Holds trades back until the watermark has passed them, then books them in order of time and id.

    Works on a bucket of keys, whose state is read and written as lists: a call to the state store takes longer than
    the work on a trade, so there are a few for each bucket and batch, whatever it holds.  State: the trades that
    wait (as long as disorder goes), the contents seen (emptied ``dedup_ms`` behind the watermark), the positions, and
    when the first trade is to book and the first content to forget.  A trade that was seen is a duplicate; one behind
    the watermark came too late to be put in order."""

    def __init__(self, dedup_ms: int) -> None:
        self.dedup_ms = dedup_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        money = ("quantity", "cost", "cash", "realized", "year_began")
        self.waiting = handle.getListState("waiting", _HELD)
        self.seen = handle.getListState("seen", T.StructType([*_KEY, T.StructField("content", T.StringType()), T.StructField("ms", T.LongType())]))
        self.positions = handle.getListState("positions", T.StructType([*_KEY, T.StructField("n", T.LongType()), *(T.StructField(c, _MONEY) for c in money), T.StructField("year", T.IntegerType())]))
        self.next = handle.getValueState("next", T.StructType([T.StructField("due", T.LongType()), T.StructField("oldest", T.LongType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        passed, kept, new = timerValues.getCurrentWatermarkInMs(), [], []
        known = set(_all(self.seen))
        for row in rows:
            content = (row.client_id, row.account_id, row.instrument_id, f"{row.trade_id}|{row.ms}|{row.side}|{row.quantity}|{row.price}", row.ms)
            if content in known:
                yield self._row(row, "duplicate")
            elif row.ms <= passed:
                yield self._row(row, "late")
            else:
                known.add(content)
                new.append(content)
                kept.append(tuple(row[f.name] for f in _HELD))
        if kept:
            self.waiting.appendList(kept)
            self.seen.appendList(new)
            # One timer for the first trade to book and one for the first to forget, not one for each row.
            first, (due, oldest) = min(content[-1] for content in new), self._next()
            if due is None or first < due:
                due = first
                self.handle.registerTimer(due)
            if oldest is None or first < oldest:
                oldest = first
                self.handle.registerTimer(oldest + self.dedup_ms)
            self.next.update((due, oldest))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed, (due, oldest) = timerValues.getCurrentWatermarkInMs(), self._next()
        books, forgets = due is not None and due <= passed, oldest is not None and oldest + self.dedup_ms <= passed
        if books:
            held = [Row(**dict(zip(_HELD.names, t))) for t in _all(self.waiting)]
            rest = [t for t in held if t.ms > passed]
            self._put(self.waiting, [tuple(t) for t in rest])
            states = {row[: len(_KEY)]: row[len(_KEY) :] for row in _all(self.positions)}
            for t in sorted((t for t in held if t.ms <= passed), key=lambda t: (t.executed_at, t.trade_id, t.side, t.quantity, t.price)):
                own = (t.client_id, t.account_id, t.instrument_id)
                state = states.get(own) or portfolio.opening()
                states[own] = now = portfolio.after(state, t.side, t.quantity, t.price, t.year)
                yield self._row(t, "booked", portfolio.move(state, now))
            self._put(self.positions, [(*own, *state) for own, state in states.items()])
            due = min((t.ms for t in rest), default=None)
            if due is not None:
                self.handle.registerTimer(due)
        if forgets:
            rest = [content for content in _all(self.seen) if content[-1] + self.dedup_ms > passed]
            self._put(self.seen, rest)
            oldest = min((content[-1] for content in rest), default=None)
            if oldest is not None:
                self.handle.registerTimer(oldest + self.dedup_ms)
        if books or forgets:
            self.next.update((due, oldest))

    def _next(self) -> tuple:
        return tuple(self.next.get()) if self.next.exists() else (None, None)

    @staticmethod
    def _put(state, rows: list[tuple]) -> None:
        if rows:
            state.put(rows)
        else:
            state.clear()

    def close(self) -> None:
        pass

    @staticmethod
    def _row(trade: Row, outcome: str, moved: tuple = (None,) * len(portfolio.MOVE)) -> Row:
        return Row(**dict(zip(_OUT.names, (*(trade[f.name] for f in (*_KEY, *_TRADE)), outcome, *moved))))


def _all(state) -> Iterator[tuple]:
    return (tuple(row) for row in state.get()) if state.exists() else iter(())


#: Amounts go in and out of blocks as text of whole numbers of 1e-8.
_UNITS = [f.name for f in portfolio.MOVE.fields if f.dataType == _MONEY]
_BLOCK_OUT = T.StructType([*_KEY, *(T.StructField(c, T.LongType() if c == "executed_at" else T.StringType()) for c in ("trade_id", "executed_at", "side", "quantity", "price", "outcome", "trade_count", *_UNITS))])
#: Rows of a frame that a block hands on.
_ROWS = 10_000
_NO_MOVE = (None,) * len(portfolio.MOVE)


class TradeBlocks(StatefulProcessor):
    """``TradeBook`` by blocks: a bucket's trades come and go as frames, its state is kept as a few blobs of plain tuples,
    and amounts are whole numbers (``portfolio.after_units``), so a trade takes microseconds and not milliseconds.

    A trade is (*key, trade_id, side, quantity, price, ms, micros, year); all before micros is its content."""

    def __init__(self, dedup_ms: int) -> None:
        self.dedup_ms = dedup_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        blob = T.StructType([T.StructField("blob", T.BinaryType())])
        self.handle = handle
        self.waiting, self.seen = handle.getListState("waiting", blob), handle.getListState("seen", blob)
        self.positions = handle.getValueState("positions", blob)
        self.next = handle.getValueState("next", T.StructType([T.StructField("due", T.LongType()), T.StructField("oldest", T.LongType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed, known, new, out = timerValues.getCurrentWatermarkInMs(), set(_blocks(self.seen)), [], []
        for frame in rows:
            texts = [frame[c].tolist() for c in (*portfolio.KEYS, "trade_id", "side", "quantity", "price")]
            numbers = [frame[c].tolist() for c in ("ms", "executed_at", "year")]
            for client, account, instrument, trade_id, side, quantity, price, ms, micros, year in zip(*texts, *numbers):
                content = (client, account, instrument, int(trade_id) if isinstance(trade_id, str) else None, side, int(quantity), int(price), ms)
                trade = (*content, micros, year)
                if content in known:
                    out.append(_told(trade, "duplicate"))
                elif ms <= passed:
                    out.append(_told(trade, "late"))
                else:
                    known.add(content)
                    new.append(trade)
            yield from _frames(out, _ROWS)
        yield from _frames(out)
        if new:
            self.waiting.appendValue((pickle.dumps(new),))
            self.seen.appendValue((pickle.dumps([trade[:8] for trade in new]),))
            first, (due, oldest) = min(trade[7] for trade in new), self._next()
            if due is None or first < due:
                due = first
                self.handle.registerTimer(due)
            if oldest is None or first < oldest:
                oldest = first
                self.handle.registerTimer(oldest + self.dedup_ms)
            self.next.update((due, oldest))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, (due, oldest) = timerValues.getCurrentWatermarkInMs(), self._next()
        books, forgets = due is not None and due <= passed, oldest is not None and oldest + self.dedup_ms <= passed
        if books:
            now, rest, out = [], [], []
            for trade in _blocks(self.waiting):
                (now if trade[7] <= passed else rest).append(trade)
            _keep(self.waiting, rest)
            states = pickle.loads(self.positions.get()[0]) if self.positions.exists() else {}
            # Time, id (none first), side, quantity, price.
            now.sort(key=lambda t: (t[8], t[3] is not None, t[3] or 0, t[4:7]))
            for trade in now:
                state = states.get(trade[:3]) or _OPENING
                states[trade[:3]] = after = portfolio.after_units(state, *trade[4:7], trade[9])
                out.append(_told(trade, "booked", portfolio.move(state, after)))
                yield from _frames(out, _ROWS)
            yield from _frames(out)
            self.positions.update((pickle.dumps(states),))
            due = min((trade[7] for trade in rest), default=None)
            if due is not None:
                self.handle.registerTimer(due)
        if forgets:
            rest = [content for content in _blocks(self.seen) if content[7] + self.dedup_ms > passed]
            _keep(self.seen, rest)
            oldest = min((content[7] for content in rest), default=None)
            if oldest is not None:
                self.handle.registerTimer(oldest + self.dedup_ms)
        if books or forgets:
            self.next.update((due, oldest))

    def _next(self) -> tuple:
        return tuple(self.next.get()) if self.next.exists() else (None, None)

    def close(self) -> None:
        pass


_OPENING = (0, 0, 0, 0, 0, 0, None)


def _blocks(state) -> Iterator[tuple]:
    for row in state.get() if state.exists() else ():
        yield from pickle.loads(row[0])


def _keep(state, rows: list[tuple]) -> None:
    if rows:
        state.put([(pickle.dumps(rows),)])
    else:
        state.clear()


def _told(trade: tuple, outcome: str, moved: tuple = _NO_MOVE) -> tuple:
    return (*trade[:4], trade[8], *trade[4:7], outcome, *moved)


def _frames(rows: list[tuple], least: int = 1) -> Iterator[pd.DataFrame]:
    """The rows as one frame, if there are so many; they are gone from the list then."""
    if len(rows) < least:
        return
    columns = {}
    for field, values in zip(_BLOCK_OUT, zip(*rows)):
        whole = field.name not in ("executed_at", "side", "outcome", *portfolio.KEYS)
        columns[field.name] = pd.Series([None if v is None else str(v) for v in values] if whole else values, dtype="int64" if field.name == "executed_at" else object)
    rows.clear()
    yield pd.DataFrame(columns)


def split_trades(trades: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trades that can be booked, and those that lack a key, time, side, or a positive quantity and price."""
    whole = F.col("side").isin(schemas.SIDES) & (F.col("quantity") > 0) & (F.col("price") > 0)
    for c in (*portfolio.KEYS, "executed_at"):
        whole = whole & F.col(c).isNotNull()
    whole = F.coalesce(whole, F.lit(False))
    return trades.where(whole), trades.where(~whole)


def book(trades: DataFrame, disorder: str = "10 minutes", dedup_minutes: int = 5, buckets: int = BUCKETS) -> DataFrame:
    """``BOOKED`` rows of a stream of trades, one for each that comes: booked, duplicate, late or invalid.

    Trades wait until the newest one is ``disorder`` ahead of them; all that came by then are
    booked in order.  None is lost: what cannot be booked comes out with its outcome.  Runs in
    append mode on the RocksDB state store (``streams.start`` with ``stateful=True``).  A task holds the state of
    one of ``buckets`` at a time."""
    exact = trades.select(*portfolio.KEYS, *(F.col(f.name).cast(f.dataType) for f in _TRADE))
    good, bad = split_trades(exact)
    # The clock drives the watermark and goes, so that late rows are not dropped but come to the processor.
    clocked = good.withColumn("_clock", F.col("executed_at")).withWatermark("_clock", disorder)
    micros = F.unix_micros("executed_at")
    at = F.timestamp_micros(micros)
    text = {c: F.replace(F.col(c).cast("string"), F.lit("."), F.lit("")) for c in ("quantity", "price")} | {"trade_id": F.col("trade_id").cast("string")}
    plain = clocked.withColumns({"executed_at": micros, "ms": F.unix_millis(at), "year": F.year(at), "bucket": F.pmod(F.xxhash64(*portfolio.KEYS), F.lit(buckets)), **text}).drop("_clock")
    booked = plain.groupBy("bucket").transformWithStateInPandas(TradeBlocks(dedup_minutes * 60_000), _BLOCK_OUT, "Append", "EventTime")
    amount = lambda c: F.concat(c, F.lit("E-8")).cast(_MONEY)
    booked = booked.withColumns({"executed_at": F.timestamp_micros("executed_at"), **{c: F.col(c).cast("long") for c in ("trade_id", "trade_count")}, **{c: amount(c) for c in ("quantity", "price", *_UNITS)}}).select(*BOOKED.names)
    none = {f.name: F.lit(None).cast(f.dataType) for f in BOOKED if f.name not in bad.columns and f.name != "outcome"}
    invalid = bad.withColumns({"outcome": F.lit("invalid"), **none}).select(*BOOKED.names)
    return booked.unionByName(invalid)


def positions(booked: DataFrame) -> DataFrame:
    """Latest position of each key from its booked rows."""
    last = booked.where("outcome = 'booked'").groupBy(*portfolio.KEYS).agg(F.max_by(F.struct(F.col("new_quantity").alias("quantity"), F.col("new_cost").alias("average_cost"), "cash", "realized", "realized_ytd"), "trade_count").alias("s"), F.max("trade_count").alias("trade_count"))
    return last.select(*portfolio.KEYS, "trade_count", "s.*")


def failures(booked: DataFrame) -> DataFrame:
    """What came and was not booked, with its outcome."""
    return booked.where("outcome <> 'booked'").select(*portfolio.KEYS, *(f.name for f in _TRADE), "outcome")
