"""Where queries register, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.lineage import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(text: str, dates: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Registers a query with its oracle; days are given as text, which engines agree on."""

    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir).withColumns({c: F.col(c).cast("string") for c in dates})

        QUERIES[f.__name__] = run if dates else f
        days = ", ".join(f"cast({c} as string) as {c}" for c in dates)
        ORACLES[f.__name__] = f"select * replace ({days}) from ({text}) days" if dates else text
        return f

    return add


def work_folder(spark: SparkSession) -> str:
    """A new folder that all machines read, for queries that write and read back."""
    return f"{shared_dir(spark)}/queries/{uuid4().hex}"
