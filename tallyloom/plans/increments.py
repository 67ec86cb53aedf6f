"""Stored rollups that grow by increments of a ledger, without reading ledger rows a second time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import kpi
from tallyloom.sources.files import replace_partitions


def add_increment(enriched: DataFrame, folder: str, increment: str) -> None:
    """Roll up new ledger rows into the folder, under the increment's name.

    Old rollups are neither read nor changed. An increment that is added again replaces itself, so a job may be retried.
    Days, stores and products may occur in any number of increments; a ledger row belongs to one.
    """
    base, name = folder.rstrip("/"), F.lit(increment).alias("increment")
    replace_partitions(kpi.daily_rollup(enriched).select("*", name), f"{base}/daily", "increment")
    replace_partitions(kpi.latest_snapshot(enriched).select("*", name), f"{base}/latest", "increment")


def _merged(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    base = folder.rstrip("/")
    daily = spark.read.parquet(f"{base}/daily").drop("increment")
    latest = spark.read.parquet(f"{base}/latest").drop("increment")
    return kpi.merged_daily(daily), kpi.latest_snapshot(latest)


def stored_rollups(spark: SparkSession, folder: str) -> kpi.Rollups:
    """The rollups of all increments together: sums add up, and the latest row of a store and product wins."""
    daily, latest = _merged(spark, folder)
    return kpi.Rollups(daily, kpi.slim_latest(latest))


def compact(spark: SparkSession, folder: str, target: str, increment: str = "base") -> None:
    """Write all increments of a folder as one increment of another folder, for fewer and larger files."""
    daily, latest = _merged(spark, folder)
    base, name = target.rstrip("/"), F.lit(increment).alias("increment")
    replace_partitions(daily.select("*", name), f"{base}/daily", "increment")
    replace_partitions(latest.select("*", name), f"{base}/latest", "increment")
