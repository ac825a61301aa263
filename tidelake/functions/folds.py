"""Folds of each key's rows in order, with the state of one key in memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Context, Decimal
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

Rows = list[tuple]
#: Partitions at least, so that the rows that one task sorts stay few.
PARTITIONS = 192


def _units(column: pa.Array) -> list[int | None]:
    """Decimals as whole numbers of their last place."""
    words = np.frombuffer(column.buffers()[1], "<i8").reshape(-1, 2)[column.offset : column.offset + len(column)]
    low, high = words[:, 0], words[:, 1]
    if (high == low >> 63).all():
        out = low.tolist()
    else:
        out = [(h << 64) | x for h, x in zip(high.tolist(), low.view("<u8").tolist())]
    return [v if there else None for v, there in zip(out, column.is_valid().to_pylist())] if column.null_count else out


def _decimals(values: list[int | None], kind: pa.Decimal128Type) -> pa.Array:
    """What ``_units`` takes apart."""
    if None in values:
        exact = Context(prec=kind.precision)
        return pa.array([None if v is None else Decimal(v).scaleb(-kind.scale, exact) for v in values], kind)
    if values and max(max(values), -min(values)) >= 10**kind.precision:
        raise OverflowError(f"a number does not fit {kind}")
    try:
        low = np.array(values, np.int64)
    except OverflowError:
        data = b"".join(v.to_bytes(16, "little", signed=True) for v in values)
    else:
        data = np.stack([low, low >> 63], axis=1).tobytes()
    return pa.Array.from_buffers(kind, len(values), [None, pa.py_buffer(data)])


def fold_in_order(df: DataFrame, keys: list[str], order: list[str], values: list[str], out: T.StructType, begin: Callable[[], Any], step: Callable[[Any, tuple], tuple[Any, Rows]], finish: Callable[[Any], Rows], units: bool = False) -> DataFrame:
    """Rows ``(*keys, *out)``: those that ``step(state, values)`` gives on the way and ``finish(state)`` at the end of a key.

    Rows are sorted within partitions by key and ``order`` (a sort that spills), so a key may have any number of them.
    With ``units``, decimals come and go as whole numbers of their last place, which is several times as fast."""
    shuffle = max(PARTITIONS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    schema = T.StructType([*(df.schema[k] for k in keys), *out.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        key: tuple | None = None
        state: Any = None

        def batch_of(rows: Rows) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [()] * len(arrow)
            return pa.RecordBatch.from_arrays([_decimals(list(c), f.type) if units and pa.types.is_decimal(f.type) else pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            rows: Rows = []
            columns = [_units(c) if units and pa.types.is_decimal(c.type) else c.to_pylist() for c in batch.columns]
            for row in zip(*columns):
                own = row[: len(keys)]
                if own != key:
                    if key is not None:
                        rows += [(*key, *r) for r in finish(state)]
                    key, state = own, begin()
                state, given = step(state, row[len(keys) :])
                rows += [(*key, *r) for r in given]
            yield batch_of(rows)
        if key is not None:
            yield batch_of([(*key, *r) for r in finish(state)])

    ordered = df.repartition(shuffle, *keys).sortWithinPartitions(*keys, *order)
    return ordered.select(*keys, *values).mapInArrow(run, schema)
