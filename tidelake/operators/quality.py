"""Data-quality rules: all rules of a frame in one aggregate, then severities, scores and a scorecard."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Weight of each type of rule in the score.
WEIGHTS = {"schema": 30.0, "null_rate": 25.0, "range": 20.0, "referential": 15.0, "freshness": 10.0}
#: Weights of the scorecard.
SCORECARD = {"completeness": 0.30, "accuracy": 0.30, "consistency": 0.25, "timeliness": 0.15}
ALERT_BELOW = 80.0
HISTORY_DAYS = 90


@dataclass(frozen=True)
class NullRate:
    column: str
    threshold: float = 0.05


@dataclass(frozen=True)
class InRange:
    column: str
    low: float
    high: float


@dataclass(frozen=True)
class Fresh:
    column: str
    sla_seconds: int


@dataclass(frozen=True)
class References:
    column: str
    parent: DataFrame
    parent_column: str


@dataclass(frozen=True)
class Rules:
    """What to check of a frame: types expected (none: every column must have some value), and rules."""

    schema: T.StructType | None = None
    nulls: list[NullRate] = field(default_factory=list)
    ranges: list[InRange] = field(default_factory=list)
    fresh: list[Fresh] = field(default_factory=list)
    references: list[References] = field(default_factory=list)


def default_rules(prices: list[str], required: list[str], timestamp: str, sla_seconds: int = 300) -> Rules:
    """Rules for market data: required fields hardly ever null, prices within reason, data fresh."""
    return Rules(nulls=[NullRate(c) for c in required], ranges=[InRange(c, 0.0001, 1_000_000.0) for c in prices], fresh=[Fresh(timestamp, sla_seconds)])


def null_counts(df: DataFrame) -> DataFrame:
    """Nulls of every column, as (column, nulls, total), from one aggregate."""
    counted = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counted.unpivot(["_n"], df.columns, "column", "nulls").withColumnRenamed("_n", "total").select("column", "nulls", "total")


def missing_references(df: DataFrame, rule: References) -> DataFrame:
    """Values of a column, not null, that the parent does not have; joined, never collected."""
    parent = rule.parent.select(F.col(rule.parent_column).alias(rule.column)).distinct()
    return df.where(F.col(rule.column).isNotNull()).select(rule.column).join(parent, rule.column, "left_anti")


def _severity(failed: Column, total: Column, low_below: Column) -> Column:
    return F.when(failed == 0, "PASS").when(low_below, "LOW").otherwise("HIGH")


def results(df: DataFrame, rules: Rules, as_of: Column) -> DataFrame:
    """One row for each rule: (rule_type, column, failed, total, severity)."""
    total = F.col("_n")
    wanted: list[tuple[str, str, Column, Column]] = []  # type, column, failed, total
    aggregates = [F.count("*").alias("_n")]

    def count(expression: Column) -> Column:
        aggregates.append(expression.alias(f"_{len(aggregates)}"))
        return F.col(f"_{len(aggregates) - 1}")

    severities: list[Column] = []
    types = {f.name: f.dataType for f in df.schema}
    if rules.schema is None:
        for c in df.columns:
            some = count(F.count(c))
            wanted.append(("schema", c, F.when((some == 0) & (total > 0), total).otherwise(0), total))
            severities.append(F.when(wanted[-1][2] > 0, "HIGH").otherwise("PASS"))
    else:
        for f in rules.schema:
            bad = f.name not in types or types[f.name] != f.dataType
            wanted.append(("schema", f.name, total if bad else F.lit(0), total))
            severities.append(F.lit("HIGH" if bad else "PASS"))
    for r in rules.nulls:
        failed = count(F.count_if(F.col(r.column).isNull()))
        rate = F.try_divide(failed.cast("double"), total)
        wanted.append(("null_rate", r.column, failed, total))
        severities.append(F.when(rate <= r.threshold, "PASS").when(rate <= 3 * r.threshold, "LOW").otherwise("HIGH"))
    for r in rules.ranges:
        failed, filled = count(F.count_if(~F.col(r.column).between(r.low, r.high))), count(F.count(r.column))
        wanted.append(("range", r.column, failed, filled))
        severities.append(_severity(failed, filled, failed.cast("double") < 0.01 * filled))
    for r in rules.fresh:
        newest = count(F.max(r.column))
        age = F.unix_timestamp(as_of) - F.unix_timestamp(newest)
        wanted.append(("freshness", r.column, F.when(newest.isNull() | (age > r.sla_seconds), total).otherwise(0), total))
        severities.append(F.when(newest.isNull() | (age >= 2 * r.sla_seconds), "HIGH").when(age > r.sla_seconds, "LOW").otherwise("PASS"))
    one = df.agg(*aggregates)
    for k, r in enumerate(rules.references):
        lost = missing_references(df, r).agg(F.count("*").alias(f"_lost{k}"))
        one = one.join(F.broadcast(lost), F.lit(True))  # one row each
        failed = F.col(f"_lost{k}")
        wanted.append(("referential", r.column, failed, total))
        severities.append(_severity(failed, total, failed.cast("double") <= 0.01 * total))
    rows = [F.struct(F.lit(t).alias("rule_type"), F.lit(c).alias("column"), f.cast("long").alias("failed"), n.cast("long").alias("total"), s.alias("severity")) for (t, c, f, n), s in zip(wanted, severities)]
    return one.select(F.inline(F.array(*rows)))


def assess(found: DataFrame) -> DataFrame:
    """One row: the weighted score of rule results (100 for an empty frame), failures, and whether to alert."""
    part = F.greatest((1 - F.try_divide(F.col("failed").cast("double"), F.col("total"))) * 100, F.lit(0.0))
    score = F.when(F.col("severity") == "PASS", 100.0).when(F.col("severity") == "HIGH", 0.0).otherwise(F.coalesce(part, F.lit(50.0)))
    weight = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    types = found.withColumn("_score", score).groupBy("rule_type").agg(F.avg("_score").alias("mean"), F.count_if(F.col("severity") == "HIGH").alias("high"), F.count_if(F.col("severity") == "LOW").alias("low"), F.max("total").alias("rows"))
    types = types.withColumn("w", F.element_at(weight, F.col("rule_type")))
    out = types.agg(F.sum(F.col("w") * F.col("mean")).alias("s"), F.sum("w").alias("w"), F.sum("high").alias("high_failures"), F.sum("low").alias("low_failures"), F.max("rows").alias("rows"))
    quality = F.when(F.coalesce(F.col("rows"), F.lit(0)) == 0, 100.0).otherwise(F.round(F.try_divide("s", "w"), 2))
    return out.select(quality.alias("quality_score"), "high_failures", "low_failures").withColumn("alert", F.col("quality_score") < ALERT_BELOW)


def scorecard(found: DataFrame) -> DataFrame:
    """One row: completeness (nulls), accuracy (ranges), consistency (references) and timeliness, each in per cent, and their mean by weight."""

    def share(kind: str) -> Column:
        mine = F.col("rule_type") == kind
        failed, total = F.sum(F.when(mine, F.col("failed"))), F.sum(F.when(mine, F.col("total")))
        return F.coalesce(100.0 - F.try_divide(failed.cast("double") * 100, total), F.lit(100.0))

    late = F.max(F.when(F.col("rule_type") == "freshness", F.when(F.col("severity") == "HIGH", 100.0).when(F.col("severity") == "LOW", 50.0).otherwise(0.0)))
    parts = {"completeness": share("null_rate"), "accuracy": share("range"), "consistency": share("referential"), "timeliness": 100.0 - F.coalesce(late, F.lit(0.0))}
    one = found.agg(*[v.alias(k) for k, v in parts.items()])
    overall = sum((F.col(k) * w for k, w in SCORECARD.items()), F.lit(0.0))
    return one.withColumn("overall", F.least(F.greatest(F.round(overall, 2), F.lit(0.0)), F.lit(100.0)))


def recent(history: DataFrame, as_of: Column, days: int = HISTORY_DAYS) -> DataFrame:
    """Scorecards of the last days."""
    return history.where(F.col("ts") >= as_of - F.make_dt_interval(days=F.lit(days)))


def tag(df: DataFrame, score: float, flags: dict[str, str]) -> DataFrame:
    """Rows with the batch's score and its flags as JSON."""
    pairs = F.create_map(*[F.lit(x) for kv in sorted(flags.items()) for x in kv]) if flags else F.create_map()
    return df.withColumns({"quality_score": F.lit(score), "quality_flags": F.to_json(pairs)})


def schema_difference(spark: SparkSession, before: T.StructType, after: T.StructType) -> DataFrame:
    """Columns added, removed or retyped between two schemas, as a small table."""
    a, b = ({f.name: f.dataType.simpleString() for f in s} for s in (before, after))
    rows = [(c, "added", None, b[c]) for c in b if c not in a] + [(c, "removed", a[c], None) for c in a if c not in b] + [(c, "retyped", a[c], b[c]) for c in a if c in b and a[c] != b[c]]
    return spark.createDataFrame(rows, "column string, change string, old_type string, new_type string")
