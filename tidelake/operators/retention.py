"""What to keep, where, and for whom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days after which partitions of each layer move to colder storage.
TIERS = {"bronze": [(0, "ARCHIVE_READY"), (90, "DEEP_ARCHIVE")], "silver": [(30, "INFREQUENT")], "gold": [(60, "INFREQUENT")], "search": [(30, "WARM"), (90, "COLD"), (2555, "DELETE")]}
PERSONAL = ["client_name", "ssn", "account_number"]


def plan(partitions: DataFrame, as_of: Column) -> DataFrame:
    """Partitions (layer, partition_date) with their age and the tier they belong in."""
    age = F.datediff(as_of, "partition_date")
    tier = F.lit("HOT")
    for layer, steps in TIERS.items():
        for days, name in steps:
            tier = F.when((F.col("layer") == layer) & (age >= days), name).otherwise(tier)
    return partitions.withColumns({"age_days": age, "tier": tier})


def visible(df: DataFrame, role: str, personal: list[str] = PERSONAL) -> DataFrame:
    """Columns that a role may see: all for compliance, others none that name a person."""
    return df if role == "compliance" else df.drop(*personal)
