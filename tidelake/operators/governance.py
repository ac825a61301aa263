"""Fairness, explanation and quality of models, and the checks around advice."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelake import schemas
from tidelake.functions.columns import errors

LIMIT_PCT = 5.0


def bias(predictions: DataFrame, groups: dict[str, Column], value: str, limit: float = LIMIT_PCT) -> DataFrame:
    """Per attribute and group: mean, its deviation from the overall mean in per cent, and whether that is above the limit.

    ``groups`` gives each attribute's group of a row; rows without one are left out of that attribute."""
    pairs = F.array(*[F.struct(F.lit(a).alias("attribute"), g.alias("group")) for a, g in groups.items()])
    long = predictions.select(F.col(value).cast("double").alias("_v"), F.inline(pairs)).where("group is not null")
    per = long.groupBy("attribute", "group").agg(F.avg("_v").alias("group_mean"), F.count("*").alias("members"))
    whole = predictions.agg(F.avg(F.col(value).cast("double")).alias("overall_mean"))
    out = per.join(F.broadcast(whole), F.lit(True))  # one row
    deviation = F.when(F.col("overall_mean") == 0, 0.0).otherwise(F.abs(F.col("group_mean") - F.col("overall_mean")) / F.col("overall_mean") * 100)
    return out.withColumn("deviation_pct", deviation).withColumn("biased", F.col("deviation_pct") > limit)


def fairness(found: DataFrame) -> DataFrame:
    """One row: violations in order, the largest deviation, and whether the model is fair."""
    name = F.concat_ws(":", "attribute", "group")
    out = found.agg(F.array_sort(F.collect_list(F.when(F.col("biased"), name))).alias("violations"), F.max("deviation_pct").alias("max_deviation_pct"))
    return out.withColumn("is_fair", F.size("violations") == 0)


def explain(df: DataFrame, numeric: list[str], categorical: list[str], target: str, top: int = 10) -> DataFrame:
    """Features by importance: correlation with the target, or spread of group means; the first ``top``."""
    one = df.agg(*[F.abs(F.corr(F.col(c).cast("double"), F.col(target).cast("double"))).alias(c) for c in numeric])
    numbers = one.unpivot([], numeric, "feature", "importance").withColumn("kind", F.lit("numeric"))
    found = numbers
    for c in categorical:
        means = df.groupBy(c).agg(F.avg(F.col(target).cast("double")).alias("m"))
        found = found.unionByName(means.agg(F.stddev("m").alias("importance")).select(F.lit(c).alias("feature"), "importance", F.lit("categorical").alias("kind")))
    found = found.withColumn("importance", F.coalesce("importance", F.lit(0.0)))
    return found.orderBy(F.col("importance").desc(), "feature").limit(top)


def approve(found: DataFrame, fair: DataFrame, features: DataFrame) -> DataFrame:
    """One row with the decision: bias or unfairness rejects, no explanation waits for review."""
    one = found.agg(F.coalesce(F.max("biased"), F.lit(False)).alias("any_bias")).join(F.broadcast(fair), F.lit(True)).join(F.broadcast(features.agg(F.count("*").alias("features"))), F.lit(True))
    decision = F.when(F.col("any_bias") | ~F.col("is_fair"), "REJECTED").when(F.col("features") == 0, "PENDING_REVIEW").otherwise("APPROVED")
    return one.withColumn("decision", decision)


def profile_errors() -> Column:
    """Errors of a customer's profile."""
    money = [c for c in ("annual_income", "total_debt", "household_income")]
    return errors(
        (F.col("age").isNull(), "age: required"),
        (~F.col("age").between(18, 120), "age: range"),
        (F.col("tax_filing_status").isNull(), "tax_filing_status: required"),
        (~F.col("tax_filing_status").isin(schemas.FILING_STATUSES), "tax_filing_status: unknown"),
        *[(F.col(c).isNull(), f"{c}: required") for c in money],
        *[(F.col(c) < 0, f"{c}: negative") for c in money],
        (F.col("risk_profile").isNull(), "risk_profile: required"),
        (~F.col("risk_profile").isin(schemas.RISK_PROFILES), "risk_profile: unknown"),
        (F.coalesce(F.size("investment_strategies"), F.lit(0)) <= 0, "investment_strategies: empty"),
        (F.size(F.array_except("investment_strategies", F.array(*map(F.lit, schemas.STRATEGIES)))) > 0, "investment_strategies: unknown"),
        (F.col("investment_horizon_years").isNull(), "investment_horizon_years: required"),
        (F.col("investment_horizon_years") <= 0, "investment_horizon_years: positive"),
    )


def review(confidence: Column, factors: Column, limit: float = 0.7) -> dict[str, Column]:
    """Does advice need a person's review, and the first three reasons if so."""
    need = confidence < limit
    return {"requires_review": need, "uncertainty_factors": F.when(need, F.slice(factors, 1, 3)).otherwise(F.array().cast("array<string>"))}


def parse_response(body: Column) -> Column:
    """Advice of a model from its JSON: allocations, risk and confidence, with defaults."""
    parsed = F.from_json(body, "allocations map<string,double>, risk struct<volatility:double,drawdown:double>, confidence double, model_version string")
    return F.struct(
        F.coalesce(parsed["allocations"], F.create_map().cast("map<string,double>")).alias("allocations"),
        F.coalesce(parsed["risk"]["volatility"], F.lit(0.0)).alias("volatility"),
        F.coalesce(parsed["risk"]["drawdown"], F.lit(0.0)).alias("drawdown"),
        F.coalesce(parsed["confidence"], F.lit(0.0)).alias("confidence"),
        F.coalesce(parsed["model_version"], F.lit("unknown")).alias("model_version"),
    )


def allocations_complete(allocations: Column) -> Column:
    """Do the shares of a map add up to 100 per cent?"""
    total = F.aggregate(F.map_values(allocations), F.lit(0.0), lambda a, b: a + b)
    return F.abs(total - 100.0) < 0.01


def to_features(profiles: DataFrame, numbers: list[str], shares: str | None = None) -> DataFrame:
    """Numbers of a profile as doubles, and so the values of its map of shares: what a model takes."""
    out = profiles.withColumns({c: F.col(c).cast("double") for c in numbers})
    return out if shares is None else out.withColumn(shares, F.transform_values(shares, lambda k, v: v.cast("double")))


def split(features: DataFrame, key: Column, train_pct: int = 80) -> DataFrame:
    """Rows marked train or test by their key alone."""
    return features.withColumn("part", F.when(F.pmod(key, F.lit(100)) < train_pct, "train").otherwise("test"))


def regression_quality(pairs: DataFrame, predicted: str, actual: str) -> DataFrame:
    """One row: MAE, RMSE and R squared of predictions against what came."""
    p, a = F.col(predicted).cast("double"), F.col(actual).cast("double")
    error = p - a
    out = pairs.agg(F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), F.sum(error * error).alias("_e"), F.var_pop(a).alias("_v"), F.count("*").alias("n"))
    return out.select("mae", "rmse", (1 - F.try_divide(F.col("_e"), F.col("_v") * F.col("n"))).alias("r2"), "n")


def drift(baseline: DataFrame, current: DataFrame, feature: str, low: float, high: float, bins: int = 10) -> DataFrame:
    """Per bin: shares of baseline and current and the term of the stability index; ``psi`` is its sum."""
    bin_ = lambda df: df.where(F.col(feature).isNotNull()).groupBy(F.width_bucket(F.col(feature).cast("double"), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))
    both = bin_(baseline).withColumnRenamed("n", "b").join(bin_(current).withColumnRenamed("n", "c"), "bin", "full").na.fill(0, ["b", "c"])
    every = Window.partitionBy(F.lit(1))  # at most bins + 2 rows
    share = lambda c: F.greatest(F.col(c) / F.sum(c).over(every), F.lit(0.0001))
    out = both.withColumns({"baseline_share": share("b"), "current_share": share("c")})
    out = out.withColumn("term", (F.col("current_share") - F.col("baseline_share")) * F.log(F.col("current_share") / F.col("baseline_share")))
    return out.withColumn("psi", F.sum("term").over(every)).select("bin", "baseline_share", "current_share", "term", "psi")


#: Bound of the relative error of values that a sketch gives back.
ERROR = 0.01
_LOG = math.log((1 + ERROR) / (1 - ERROR))
#: Puts buckets of positive values above zero, however small they are.
_ABOVE = 100_000


def sketch(df: DataFrame, features: list[str], by: list[str] = ()) -> DataFrame:
    """A quantile sketch: ``(*by, feature, bucket, n)``, rows of each feature by bucket of its logarithm; null for none.

    Sketches of parts, summed by ``merge``, are that of the whole.  Buckets of a feature are some 35,000 at most."""
    value = F.col("value")
    size = F.ceil(F.log(F.abs(value)) / F.lit(_LOG)).cast("int") + F.lit(_ABOVE)
    bucket = F.when(value == 0, 0).when(value > 0, size).when(value < 0, -size)
    long = df.select(*by, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])).alias("f")).select(*by, "f.feature", "f.value")
    return long.groupBy(*by, "feature", F.when(~F.isnan("value"), bucket).alias("bucket")).agg(F.count("*").alias("n"))


def merge(sketches: DataFrame) -> DataFrame:
    """The sketch of all rows that some sketches have."""
    return sketches.groupBy("feature", "bucket").agg(F.sum("n").alias("n"))


def value_of(bucket: Column) -> Column:
    """A value that is at most ``ERROR`` of any value of the bucket away from it."""
    top = F.exp((F.abs(bucket) - F.lit(_ABOVE)) * F.lit(_LOG))
    return F.when(bucket == 0, 0.0).otherwise(F.signum(bucket.cast("double")) * top * (1 - ERROR))


def _borders(merged: DataFrame, shares: list[float]) -> DataFrame:
    """``(feature, share, bucket)``: the first bucket at which so much of the rows with a value is reached."""
    order = Window.partitionBy("feature").orderBy("bucket")
    there = merged.where("bucket is not null").withColumns({"_upto": F.sum("n").over(order), "_all": F.sum("n").over(Window.partitionBy("feature"))})
    asked = there.withColumn("share", F.explode(F.array(*map(F.lit, shares))))
    return asked.where(F.col("_upto") >= F.col("share") * F.col("_all")).groupBy("feature", "share").agg(F.min("bucket").alias("bucket"))


def sketch_quantiles(merged: DataFrame, shares: list[float]) -> DataFrame:
    """``(feature, share, value)``: quantiles to within ``ERROR`` of their size."""
    return _borders(merged, shares).select("feature", "share", value_of(F.col("bucket")).alias("value"))


def sketch_drift(baseline: DataFrame, current: DataFrame, bins: int = 10) -> DataFrame:
    """Per feature and bin (between quantiles of the baseline; null: no value): shares of both sketches, the term of the
    stability index, and ``psi``, their sum.  Both sketches have one grid, so the counts of bins are exact."""
    borders = _borders(baseline, [k / bins for k in range(1, bins)]).groupBy("feature").agg(F.array_sort(F.collect_set("bucket")).alias("_borders"))

    def binned(df: DataFrame, name: str) -> DataFrame:
        own = df.join(F.broadcast(borders), "feature", "left")  # a row for each feature
        below = F.size(F.filter("_borders", lambda b: b < F.col("bucket"))) + 1
        return own.groupBy("feature", F.when(F.col("bucket").isNotNull(), below).alias("bin")).agg(F.sum("n").alias(name))

    b, c = binned(baseline, "b"), binned(current, "c").withColumnsRenamed({"feature": "_f", "bin": "_bin"})
    both = b.join(c, (F.col("feature") == F.col("_f")) & F.col("bin").eqNullSafe(F.col("_bin")), "full").select(F.coalesce("feature", "_f").alias("feature"), F.coalesce("bin", "_bin").alias("bin"), "b", "c").na.fill(0, ["b", "c"])
    every = Window.partitionBy("feature")  # at most bins + 1 rows
    share = lambda x: F.greatest(F.col(x) / F.sum(x).over(every), F.lit(0.0001))
    out = both.withColumns({"baseline_share": share("b"), "current_share": share("c")})
    out = out.withColumn("term", (F.col("current_share") - F.col("baseline_share")) * F.log(F.col("current_share") / F.col("baseline_share")))
    return out.withColumn("psi", F.sum("term").over(every)).select("feature", "bin", "baseline_share", "current_share", "term", "psi")
