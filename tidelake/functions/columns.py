"""Column expressions shared by the operators; all are built-ins, so they stay in generated code."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient as a double where the denominator is above zero, else null."""
    return F.when(denominator > 0, numerator.cast("double") / denominator.cast("double"))


def errors(*rules: tuple[Column, str]) -> Column:
    """Array of the messages whose conditions hold; a null condition does not."""
    return F.array_compact(F.array(*[F.when(F.coalesce(condition, F.lit(False)), F.lit(message)) for condition, message in rules]))


def lookup(values: Mapping[str, str], key: Column, default: str | None = None) -> Column:
    """Value of a fixed table for a key."""
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    found = F.try_element_at(table, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def bucket(value: Column, groups: Iterable[tuple[str, float, float | None]]) -> Column:
    """Label of the closed range that holds a value; null outside all."""
    out = F.lit(None).cast("string")
    for label, low, high in reversed(list(groups)):
        inside = (value >= low) & (value <= high) if high is not None else value >= low
        out = F.when(inside, F.lit(label)).otherwise(out)
    return out


def one_of(value: Column, allowed: Iterable[str]) -> Column:
    """Is the value, in capitals, in the set?  Null if the value is null."""
    return F.upper(value).isin(list(allowed))


def missing(value: Column) -> Column:
    """Null or empty."""
    return value.isNull() | (value.cast("string") == "")
