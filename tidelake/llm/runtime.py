"""Session helpers shared by the operators of this subpackage.

Lineage is cut only with reliable checkpoints in the folder the session names
in ``spark.checkpoint.dir`` (shared by all machines).  A private folder is
chosen only when that setting is absent and the session is local, as in tests.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.lineage import cut, shared_dir  # noqa: F401  (for the modules beside this one)

#: Largest table that may be sent whole to every executor: rows, and bytes of their values.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 16 << 20


def stored_at(df: DataFrame) -> tuple[DataFrame, str]:
    """As ``cut``, but as compressed Parquet, for tables that carry texts; and its folder, to ``discard`` when done."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidelake/{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame) -> DataFrame:
    """As ``stored_at``, where a later step of the same job still reads the copy."""
    return stored_at(df)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a work folder of ``shared_dir`` that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def joinable(small: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``small`` for the build side of a join: hinted for broadcast only when a
    count shows at most ``max_rows`` rows and ``max_bytes`` bytes; otherwise Spark
    shuffles both sides and AQE splits skewed partitions."""
    small = cut(small)
    long = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in small.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    rows, in_rows = small.agg(F.count("*"), F.sum(sum(long, F.lit(16 * len(small.columns))))).first()
    return F.broadcast(small) if rows <= max_rows and (in_rows or 0) <= max_bytes else small


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
