"""The trade book by blocks: state as few blobs, trades as frames."""

import pandas as pd
from tidelake.streaming import trade_book


class State:
    """A list or a value of the state store that counts the rows it was given."""

    given = 0

    def __init__(self):
        self.rows = []

    def exists(self):
        return bool(self.rows)

    def put(self, rows):
        State.given += len(rows)
        self.rows = list(rows)

    def clear(self):
        self.rows = []

    def appendValue(self, row):
        self.put([*self.rows[:0], *self.rows, row])

    def update(self, row):
        self.put([row])


class ListState(State):
    get = lambda self: iter(self.rows)


class ValueState(State):
    get = lambda self: self.rows[0]


class Handle:
    def __init__(self):
        self.timers = []

    getListState = lambda self, *_: ListState()
    getValueState = lambda self, *_: ValueState()
    registerTimer = lambda self, ms: self.timers.append(ms)


class Clock:
    now = 0
    getCurrentWatermarkInMs = lambda self: self.now


def frame(trades):
    return pd.DataFrame([("c", "main", f"i{k}", None if n is None else str(n), "BUY", str(quantity), "100000000", ms, ms * 1000, 1970) for k, n, quantity, ms in trades], columns=["client_id", "account_id", "instrument_id", "trade_id", "side", "quantity", "price", "ms", "executed_at", "year"])


def test_state_is_a_few_blobs():
    """2,000 trades of 1,000 keys, newest first: booked in order of time, copies told, contents forgotten; ids may lack and amounts pass 64 bits."""
    State.given = 0
    book, handle, clock, great = trade_book.TradeBlocks(60_000), Handle(), Clock(), 10**20
    book.init(handle)
    trades = [(k, n, n * 10**8, ms) for n, ms in ((1, 2000), (2, 1000)) for k in range(1000)] + [("x", None, great, 1500)]
    told = lambda frames: [r for f in frames for r in f.to_dict("records")]
    assert told(book.handleInputRows((0,), iter([frame(trades[:1500]), frame(trades[1500:])]), clock)) == []
    again = told(book.handleInputRows((0,), iter([frame(trades)]), clock))
    assert len(again) == 2001 and {r["outcome"] for r in again} == {"duplicate"}
    clock.now = 5000
    booked = told(f for _ in list(handle.timers) for f in book.handleExpiredTimer((0,), clock, None))
    assert {(r["trade_id"], r["trade_count"], r["new_quantity"]) for r in booked} == {("2", "1", "200000000"), ("1", "2", "300000000"), (None, "1", str(great))}
    assert len(booked) == 2001 and State.given < 20
    late = told(book.handleInputRows((0,), iter([frame([(1, 9, 10**8, 4000)])]), clock))
    assert [r["outcome"] for r in late] == ["late"]
    clock.now = 70_000
    assert told(book.handleExpiredTimer((0,), clock, None)) == [] and not book.seen.exists()
