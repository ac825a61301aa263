"""Change data capture: normalise, apply, compare, and follow changes of schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake import schemas
from tidelake.functions.columns import lookup
from tidelake.functions.folds import fold_in_order


def normalise(changes: DataFrame) -> DataFrame:
    """Adds the qualified table and a key of the record."""
    full = F.concat_ws(".", "schema_name", "table_name")
    return changes.withColumns({"qualified_table_name": full, "record_key": F.concat_ws(":", full, "transaction_id", "source_lsn")})


def apply_changes(base: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Current rows: for each key the last change, or the base row without one; deleted keys go.

    ``changes`` has the columns of ``base``, ``operation`` and ``order``.  The last change is a
    combinable maximum, so a key with very many changes needs no sort."""
    columns = base.columns
    every = base.select(*columns, F.lit("INSERT").alias("operation"), F.lit(False).alias("_changed"), *[F.lit(None).cast(changes.schema[c].dataType).alias(f"_o_{c}") for c in order])
    every = every.unionByName(changes.select(*columns, "operation", F.lit(True).alias("_changed"), *[F.col(c).alias(f"_o_{c}") for c in order]))
    last = every.groupBy(*keys).agg(F.max_by(F.struct("operation", *columns), F.struct("_changed", *[f"_o_{c}" for c in order])).alias("_last"))
    return last.where("_last.operation <> 'DELETE'").select([F.col(f"_last.{c}").alias(c) for c in columns])


def changed_columns(before: Column, after: Column) -> Column:
    """Names, in order, of map entries that differ between two images."""
    both = F.map_zip_with(before, after, lambda k, a, b: ~a.eqNullSafe(b))
    return F.array_sort(F.map_keys(F.map_filter(both, lambda k, v: v)))


def schema_changes(events: DataFrame) -> DataFrame:
    """Rows of events that change a schema, with the kind of change and the lake's type."""
    kind = lookup(schemas.DDL_CHANGES, F.col("event_type"))
    return events.withColumn("change_type", kind).where(F.col("change_type").isNotNull()).withColumn("lake_type", lake_type(F.col("new_data_type")))


def lake_type(relational: Column) -> Column:
    """Type in the lake of a relational type; null stays null, an unknown one is text."""
    bare = F.trim(F.regexp_replace(F.lower(relational), r"\(.*\)", ""))
    return F.when(relational.isNotNull(), lookup(schemas.LAKE_TYPES, bare, "string"))


_STATE = T.StructType([T.StructField("column_name", T.StringType()), T.StructField("lake_type", T.StringType())])


def _change(columns: dict[str, str], event: tuple) -> tuple[dict[str, str], list[tuple]]:
    kind, name, old, lake = event
    if kind == "DROP_TABLE":
        columns.clear()
    elif name is None:
        pass
    elif kind == "ADD_COLUMN":
        columns[name] = lake
    elif kind == "ALTER_COLUMN" and name in columns:
        columns[name] = lake
    elif kind == "DROP_COLUMN":
        columns.pop(name, None)
    elif kind == "RENAME_COLUMN" and old in columns:
        columns[name] = columns.pop(old)
    return columns, []


def schema_state(log: DataFrame) -> DataFrame:
    """Columns after a log of changes (table_name, column_name, old_name, change_type, lake_type, seq), in order of ``seq``.

    A column that is renamed keeps its type; a table that is renamed goes, and one of the
    new name (``column_name``) begins without columns; changes of columns that are not there do nothing."""
    gone = log.withColumn("change_type", F.when(F.col("change_type") == "RENAME_TABLE", "DROP_TABLE").otherwise(F.col("change_type")))
    begun = log.where("change_type = 'RENAME_TABLE' and column_name is not null").withColumns({"table_name": F.col("column_name"), "change_type": F.lit("DROP_TABLE")})
    return fold_in_order(gone.unionByName(begun), ["table_name"], ["seq"], ["change_type", "column_name", "old_name", "lake_type"], _STATE, dict, _change, lambda columns: list(columns.items()))


def replication_lag(changes: DataFrame, seconds: int = 60, high: float = 60.0, low: float = 10.0) -> DataFrame:
    """Per window of arrival: largest lag in seconds and what to do about capacity."""
    lag = F.unix_micros(F.col("arrival_ts")) - F.unix_micros(F.col("commit_ts"))
    out = changes.groupBy(F.window("arrival_ts", f"{seconds} seconds").alias("w")).agg((F.max(lag) / 1_000_000).alias("max_lag_seconds"), F.count("*").alias("changes"))
    action = F.when(F.col("max_lag_seconds") > high, "scale_up").when(F.col("max_lag_seconds") < low, "scale_down_candidate").otherwise("none")
    return out.select(F.col("w.start").alias("window_start"), "max_lag_seconds", "changes", action.alias("action"))


def breaches(metrics: DataFrame, value: str, threshold: float, periods: int, by: list[str] = (), order: str = "window_start") -> DataFrame:
    """Alarm rows: the value has been above its threshold in each of the last ``periods`` rows."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(1 - periods, 0)
    over = F.coalesce(F.col(value) > threshold, F.lit(False)).cast("int")
    return metrics.withColumn("alarm", (F.min(over).over(w) == 1) & (F.count("*").over(w) == periods))


def composite_alarm(a: DataFrame, b: DataFrame, key: str = "window_start", how: str = "and") -> DataFrame:
    """Both alarms (or either) by period; a period without a row has no alarm."""
    joined = a.select(key, F.col("alarm").alias("_a")).join(b.select(key, F.col("alarm").alias("_b")), key, "full")
    x, y = F.coalesce("_a", F.lit(False)), F.coalesce("_b", F.lit(False))
    return joined.select(key, (x & y if how == "and" else x | y).alias("alarm"))
