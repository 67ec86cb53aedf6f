"""Keep an intermediate result that several jobs read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Rows up to which a key set may be broadcast: a few hundred megabytes at most for the narrow sets used here.
BROADCAST_ROWS = 2_000_000


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write the frame below the session's checkpoint folder and read it back, so later jobs start from a table that
    outlives lost executors. Without such a folder the frame is persisted and recomputed from its lineage on loss.
    """
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    path = f"{folder.rstrip('/')}/tallyloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new path below the session's checkpoint folder; a session in one process may do without that folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tallyloom-")
    return f"{folder.rstrip('/')}/tallyloom/{label}-{uuid.uuid4().hex}"


def numbered(rows: DataFrame, keys: list[str], order: list[str], label: str) -> DataFrame:
    """rows with `line_no` (from 1 within equal keys, by the order columns) and `line_count` (rows of the keys).

    Rows are dealt into ranges of keys and order, each counts its own, and the counts of the ranges before are added: rows
    of one key are never sorted in one task. The last order column should tell rows apart.
    """
    names = rows.columns
    dealt = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    # The id is the partition's number in the high 31 bits and the row's place in it in the low 33.
    dealt = dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33))
    dealt = settle(dealt, label)
    runs = dealt.groupBy(*keys, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    own = Window.partitionBy(*keys)
    runs = runs.withColumn("_before", F.sum("_n").over(own.orderBy("_part")) - F.col("_n"))
    runs = runs.withColumn("line_count", F.sum("_n").over(own))
    placed = dealt.join(runs, [*keys, "_part"])
    return placed.select(*names, (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("line_no"), "line_count")


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True when the frame has at most `rows` rows. Runs a count, which a settled frame answers from its table."""
    return df.count() <= rows
