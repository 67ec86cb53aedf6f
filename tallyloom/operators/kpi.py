"""KPIs: enriched rows, latest stock, product and category performance, risk counts, summary.

Two small rollups carry everything. `daily_rollup` has one row per product variant and day, `latest_snapshot` one row
per store and product; both combine before they shuffle, so a hot product or store costs no more than any other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.numeric import INF, money_resums, money_sums, money_total, safe_ratio
from tallyloom.functions.rules import (
    HIGH,
    INVENTORY_SHARE_WEIGHTS,
    MEDIUM,
    WASTE_RATES,
    inventory_health,
    overstock_class,
    product_health,
    stockout_class,
)
from tallyloom.sources.schema import (
    NUMERIC_COLUMNS,
    PRODUCT_KEYS,
    coerce_types,
    require_columns,
    standardise_columns,
)
from tallyloom.sources.tables import settle

MONEY_COLUMNS = ("revenue", "waste_value", "unit_price")
UNIT_COLUMNS = ("sold_quantity", "wasted_quantity", "available_stock", "average_inventory")


def enrich(df: DataFrame) -> DataFrame:
    """Ledger plus eight row metrics. Unreadable numbers count as 0 here."""
    named = standardise_columns(df)
    require_columns(named, "KPI calculation")
    filled = coerce_types(named).fillna(0.0, subset=list(NUMERIC_COLUMNS))
    sold, wasted, price = F.col("sold_quantity"), F.col("wasted_quantity"), F.col("unit_price")
    available = F.col("opening_stock") + F.col("purchased_quantity")
    average = (F.col("opening_stock") + F.col("closing_stock")) / 2
    return filled.withColumns(
        {
            "available_stock": available,
            "revenue": sold * price,
            "waste_value": wasted * price,
            "closing_inventory_value": F.col("closing_stock") * price,
            "average_inventory": average,
            "sell_through_rate": safe_ratio(sold, available),
            "waste_rate": safe_ratio(wasted, sold + wasted),
            "stock_turnover": safe_ratio(sold, average),
        }
    )


def with_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Rows whose grouping keys are all present; a missing key forms no group."""
    return df.dropna(subset=list(keys))


# ---------------------------------------------------------------- rollups


def daily_rollup(enriched: DataFrame) -> DataFrame:
    """Sums per product variant and day, missing keys included. One scan serves every demand and revenue figure."""
    return enriched.groupBy("date", *PRODUCT_KEYS).agg(
        F.count("*").alias("row_count"),
        *[F.sum(c).alias(c) for c in UNIT_COLUMNS],
        *money_sums({c: F.col(c) for c in MONEY_COLUMNS}),
    )


def latest_snapshot(enriched: DataFrame) -> DataFrame:
    """The last row of each store and product, all columns. A missing date counts as the latest.

    Ranking to 1 lets Spark keep one row per key on the map side before the shuffle. The tie-break covers every
    numeric column and the names, so a rerun picks the same row.
    """
    ties = [F.col(c).desc_nulls_last() for c in ("closing_stock", *NUMERIC_COLUMNS, "product_name", "category")]
    order = Window.partitionBy("store_id", "product_id").orderBy(F.col("date").desc_nulls_first(), *ties)
    return enriched.withColumn("__recency", F.row_number().over(order)).filter("__recency = 1").drop("__recency")


@dataclass(frozen=True)
class Rollups:
    """The two rollups of one enriched ledger."""

    daily: DataFrame
    latest: DataFrame


def merged_daily(parts: DataFrame) -> DataFrame:
    """One daily rollup from the rows of several: all its figures are sums."""
    return parts.groupBy("date", *PRODUCT_KEYS).agg(
        *[F.sum(c).alias(c) for c in ("row_count", *UNIT_COLUMNS)], *money_resums(MONEY_COLUMNS)
    )


def slim_latest(latest: DataFrame) -> DataFrame:
    return latest.select("store_id", *PRODUCT_KEYS, "closing_stock", "closing_inventory_value")


def roll_up(enriched: DataFrame) -> Rollups:
    return Rollups(daily_rollup(enriched), slim_latest(latest_snapshot(enriched)))


def stacked(rollups: Rollups) -> DataFrame:
    """Both rollups in one frame: day rows, and latest rows with their stock as `latest_closing`."""
    latest = rollups.latest.select(
        F.lit("latest").alias("rollup"),
        "store_id",
        *PRODUCT_KEYS,
        F.col("closing_stock").alias("latest_closing"),
        "closing_inventory_value",
    )
    daily = rollups.daily.select(F.lit("daily").alias("rollup"), "*")
    return daily.unionByName(latest, allowMissingColumns=True)


def settled(rollups: Rollups) -> Rollups:
    """Write both rollups once, in one job, for callers that derive several results from them."""
    table = settle(stacked(rollups), "rollups")
    daily = table.filter("rollup = 'daily'").select(*rollups.daily.columns)
    latest = table.filter("rollup = 'latest'").withColumnRenamed("latest_closing", "closing_stock")
    return Rollups(daily, latest.select(*rollups.latest.columns))


def bucketed(daily: DataFrame, name: str, path: str, buckets: int = 64) -> DataFrame:
    """The daily rollup as a table in buckets of product ids, one sorted file each, and read back.

    What groups or ranks by product over it needs no exchange of its own. Choose the number of buckets so that a bucket
    fits a core's memory; a product has at most one row per day and variant in it.
    """
    dealt = daily.repartition(buckets, "product_id")
    writer = dealt.write.bucketBy(buckets, "product_id").sortBy("product_id", "date")
    writer.option("path", path).mode("overwrite").format("parquet").saveAsTable(name)
    return daily.sparkSession.table(name)


# ---------------------------------------------------------------- aggregates


def latest_stock(rollups: Rollups) -> DataFrame:
    latest = with_keys(rollups.latest, *PRODUCT_KEYS)
    return latest.groupBy(*PRODUCT_KEYS).agg(F.sum("closing_stock").alias("current_stock"))


def _unit_totals() -> list[Column]:
    return [
        F.sum("sold_quantity").alias("total_units_sold"),
        F.sum("wasted_quantity").alias("total_units_wasted"),
        F.sum("available_stock").alias("total_available_stock"),
    ]


def _rates() -> dict[str, Column]:
    sold, wasted = F.col("total_units_sold"), F.col("total_units_wasted")
    return {
        "sell_through_rate": safe_ratio(sold, F.col("total_available_stock")),
        "waste_rate": safe_ratio(wasted, sold + wasted),
    }


def product_performance(rollups: Rollups) -> DataFrame:
    """One row per product variant: totals, rates, stock cover, risk classes and a health score.

    A day is one row of the rollup, so the number of active days is a plain count. The latest stock joins its product
    by being stacked under the day rows and summed in the same grouping: every latest row belongs to a variant that
    has day rows, so this is the left join on the three keys, without a join. The grouping drops variants with a
    missing key by counts rather than by a filter on the keys: a filter would be pushed into one of the two stacked
    branches only, and Spark could no longer run their common part once.
    """
    totals = (
        stacked(rollups)
        .groupBy(*PRODUCT_KEYS)
        .agg(
            *money_resums(MONEY_COLUMNS),
            *_unit_totals(),
            F.sum("average_inventory").alias("inventory_sum"),
            F.sum("row_count").alias("row_count"),
            F.count("date").alias("active_days"),
            F.sum("latest_closing").alias("current_stock"),
            *[F.count(c).alias(f"{c}_count") for c in PRODUCT_KEYS],
        )
        .filter(" and ".join(f"{c}_count > 0" for c in PRODUCT_KEYS))
    )
    measured = totals.withColumns(
        {
            "total_revenue": money_total("revenue"),
            "total_waste_value": money_total("waste_value"),
            "average_inventory": F.col("inventory_sum") / F.col("row_count"),
            "avg_unit_price": money_total("unit_price") / F.col("row_count"),
            "avg_daily_demand": safe_ratio(F.col("total_units_sold"), F.col("active_days")),
            **_rates(),
        }
    )
    demand, stock, days = F.col("avg_daily_demand"), F.col("current_stock"), F.col("days_of_stock_left")
    return (
        measured.withColumn("stock_turnover", safe_ratio(F.col("total_units_sold"), F.col("average_inventory")))
        .withColumn("days_of_stock_left", F.when(demand > 0, stock / demand).otherwise(INF))
        .withColumns(
            {"stockout_risk": stockout_class(days), "overstock_risk": overstock_class(demand, stock, days)}
        )
        .select(
            *PRODUCT_KEYS,
            "total_revenue",
            "total_units_sold",
            "total_units_wasted",
            "total_waste_value",
            "total_available_stock",
            "average_inventory",
            "avg_unit_price",
            "active_days",
            "current_stock",
            "sell_through_rate",
            "waste_rate",
            "stock_turnover",
            "avg_daily_demand",
            "days_of_stock_left",
            "stockout_risk",
            "overstock_risk",
            product_health(
                F.col("stockout_risk"), F.col("overstock_risk"), F.col("waste_rate"), F.col("sell_through_rate")
            ).alias("product_health_score"),
        )
    )


def category_performance(rollups: Rollups) -> DataFrame:
    """One row per category. Products are merged first, so the distinct count works on products, not on rows."""
    return (
        with_keys(rollups.daily, "category")
        .groupBy("category")
        .agg(
            *money_resums(("revenue", "waste_value")),
            *_unit_totals(),
            F.count_distinct("product_id").alias("product_count"),
        )
        .withColumns(
            {"total_revenue": money_total("revenue"), "total_waste_value": money_total("waste_value"), **_rates()}
        )
        .select(
            "category",
            "total_revenue",
            "total_units_sold",
            "total_units_wasted",
            "total_waste_value",
            "total_available_stock",
            "product_count",
            "sell_through_rate",
            "waste_rate",
        )
    )


def risk_summary(performance: DataFrame) -> DataFrame:
    stockout, overstock = F.col("stockout_risk"), F.col("overstock_risk")
    return performance.agg(
        F.count_if(stockout == HIGH).alias("high_stockout_risk_products"),
        F.count_if(stockout == MEDIUM).alias("medium_stockout_risk_products"),
        F.count_if(overstock == HIGH).alias("high_overstock_risk_products"),
        F.count_if(overstock == MEDIUM).alias("medium_overstock_risk_products"),
        F.count_if(F.col("waste_rate") > WASTE_RATES[HIGH]).alias("high_waste_products"),
    )


def high_risk_products(risk: DataFrame) -> DataFrame:
    total = F.col("high_stockout_risk_products") + F.col("high_overstock_risk_products")
    return risk.select(total.alias("high_risk_products"))


def summary_metrics(rollups: Rollups, performance: DataFrame) -> DataFrame:
    """One row of business totals and the inventory health score; the 1-row parts are scalar subqueries."""
    totals = rollups.daily.agg(
        F.min("date").alias("first_day"),
        F.max("date").alias("last_day"),
        F.count_distinct("product_id").alias("unique_products"),
        *money_resums(("revenue", "waste_value")),
        *_unit_totals(),
    )
    stock = rollups.latest.agg(
        F.count_distinct("store_id").alias("stores"),
        *money_sums({"closing_value": F.col("closing_inventory_value")}),
    ).select(F.struct("stores", money_total("closing_value").alias("value")))
    risk = risk_summary(performance).select(F.struct(*INVENTORY_SHARE_WEIGHTS))
    sold, wasted = F.col("total_units_sold"), F.col("total_units_wasted")
    available = F.col("total_available_stock")
    return (
        totals.withColumns({"stock": stock.scalar(), "risk": risk.scalar()})
        .withColumns(
            {
                "sell_through_rate": F.when(available > 0, F.round(sold / available, 4)).otherwise(0.0),
                "waste_rate": F.when(sold + wasted > 0, F.round(wasted / (sold + wasted), 4)).otherwise(0.0),
            }
        )
        .select(
            F.date_format("first_day", "yyyy-MM-dd").alias("date_start"),
            F.date_format("last_day", "yyyy-MM-dd").alias("date_end"),
            F.col("stock.stores").alias("unique_stores"),
            "unique_products",
            F.round(money_total("revenue"), 2).alias("total_revenue"),
            F.col("total_units_sold").cast("long").alias("total_units_sold"),
            F.col("total_units_wasted").cast("long").alias("total_units_wasted"),
            F.round(money_total("waste_value"), 2).alias("total_waste_value"),
            F.round(F.col("stock.value"), 2).alias("latest_inventory_value"),
            F.col("sell_through_rate").alias("average_sell_through_rate"),
            F.col("waste_rate").alias("average_waste_rate"),
            inventory_health(
                F.col("sell_through_rate"),
                F.col("waste_rate"),
                F.col("unique_products"),
                {c: F.col("risk")[c] for c in INVENTORY_SHARE_WEIGHTS},
            ).alias("inventory_health_score"),
        )
    )


def daily_revenue(rollups: Rollups) -> DataFrame:
    sums = with_keys(rollups.daily, "date").groupBy("date").agg(*money_resums(("revenue",)))
    return sums.select("date", money_total("revenue").alias("revenue"))


def by_revenue(df: DataFrame) -> DataFrame:
    """Report order of the performance tables: revenue descending, names break ties."""
    keys = [c for c in PRODUCT_KEYS if c in df.columns]
    return df.orderBy(F.desc("total_revenue"), *keys)
