"""Build a stock ledger from order lines and parts.

Per store, product and day the outflow of stock is known. The first of every five selling days buys what the five
days move, so stock never runs negative and each opening equals the previous closing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.sources.files import union_all
from tallyloom.sources.schema import REQUIRED_COLUMNS

# Shape of the derived ledger.
STORES = 4
BLOCK_DAYS = 5


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 11-column ledger over all order lines.

    The join is an inner equi-join on the part key: Spark broadcasts parts only when their size is under its
    threshold, and splits a hot part key otherwise. The grouping combines on the map side, so the two windows see
    one row per store, product and day however many lines a product has.
    """
    lines = load_table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_shipdate"
    )
    parts = load_table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", "p_retailprice", (F.length("p_name") % 4).alias("waste_tenths")
    )
    waste = F.floor(F.col("l_quantity") * F.col("waste_tenths") / 10).cast("double")
    movements = (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(
            F.to_date("l_shipdate").alias("date"),
            (F.col("l_suppkey") % STORES).alias("store_no"),
            F.col("p_name").alias("product_name"),
        )
        .agg(
            F.sum(F.when(F.col("l_returnflag") == "R", waste).otherwise(0.0)).alias("wasted"),
            F.sum("l_quantity").alias("moved"),
            F.max("p_retailprice").alias("unit_price"),
        )
    )

    shelf = Window.partitionBy("store_no", "product_name").orderBy("date")
    numbered = movements.withColumns(
        {
            "day_no": F.row_number().over(shelf) - 1,
            "base": (((F.length("product_name") * 3 + F.ascii("product_name")) % 8) * 60).cast("double"),
        }
    ).withColumn("block", F.floor(F.col("day_no") / BLOCK_DAYS))

    in_block = Window.partitionBy("store_no", "product_name", "block").orderBy("date")
    first = F.col("day_no") % BLOCK_DAYS == 0
    total = F.sum("moved").over(in_block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    running = F.sum("moved").over(in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    stocked = numbered.withColumns({"total": total, "running": running})
    left = F.col("total") - F.col("running")
    return stocked.select(
        "date",
        F.concat(F.lit("S00"), F.col("store_no").cast("string")).alias("store_id"),
        F.replace("product_name", F.lit(" "), F.lit("_")).alias("product_id"),
        "product_name",
        F.split_part("product_name", F.lit(" "), F.lit(2)).alias("category"),
        (F.col("base") + F.when(first, 0.0).otherwise(left + F.col("moved"))).alias("opening_stock"),
        F.when(first, F.col("total")).otherwise(0.0).alias("purchased_quantity"),
        (F.col("moved") - F.col("wasted")).alias("sold_quantity"),
        F.col("wasted").alias("wasted_quantity"),
        (F.col("base") + left).alias("closing_stock"),
        "unit_price",
    )


def dirty_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ledger as text, with known defects by day of month, for the quality checks."""
    clean = ledger(spark, sf_dir)
    day, store = F.dayofmonth("date"), F.col("store_id")
    text = {c: F.col(c).cast("string") for c in REQUIRED_COLUMNS}
    oversold = F.col("opening_stock") + F.col("purchased_quantity") + 1
    text["date"] = F.when(day == 3, "not-a-date").otherwise(text["date"])
    text["product_name"] = F.when(day == 9, "  ").otherwise(text["product_name"])
    text["sold_quantity"] = (
        F.when((day == 5) & (store == "S001"), "abc")
        .when((day == 13) & (store == "S003"), oversold.cast("string"))
        .otherwise(text["sold_quantity"])
    )
    text["wasted_quantity"] = F.when((day == 7) & (store == "S002"), "-1.0").otherwise(text["wasted_quantity"])
    text["closing_stock"] = F.when(day == 11, (F.col("closing_stock") + 1).cast("string")).otherwise(
        text["closing_stock"]
    )
    copies = F.when((day == 1) & (store == "S000"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return clean.select(
        *[text[c].alias(c) for c in REQUIRED_COLUMNS], F.explode(copies).alias("copy")
    ).drop("copy")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions to answer: every user turn of the conversations and one generated question per part."""
    turns = load_table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    asked = turns.select(
        F.concat_ws("-", F.lit("conv"), "conv_id", "turn").alias("question_id"), F.col("text").alias("question")
    )
    name, kind = F.col("p_name"), F.lower("p_type")
    # Wording of the generated questions.
    wordings = [
        F.concat(F.lit("Should I reorder "), name, F.lit(" next month?")),
        F.concat(F.lit("Give me inventory summary for "), kind),
        F.concat(F.lit("Which are the TOP "), name, F.lit(" sellers?")),
        F.concat(F.lit("Will we run out of "), F.upper(name), F.lit("?")),
        F.concat(F.lit("Any excess "), kind, F.lit(" stock?")),
        F.concat(F.lit("How much "), name, F.lit(" was spoiled?")),
        F.concat(F.lit("Predicted demand of all "), kind, F.lit(" parts")),
        F.concat(F.lit("What action for "), kind, F.lit("?")),
        F.concat(F.lit("Compare categories such as "), kind),
        F.concat(F.lit("Should we keep "), F.upper(name), F.lit(" and buy more?")),
        F.concat(F.lit("Is the "), name, F.lit(" fine?")),
        F.lit("   "),
    ]
    parts = load_table(spark, sf_dir, "part")
    slot = F.pmod(F.col("p_partkey"), F.lit(len(wordings))).cast("int")
    made = parts.select(
        F.concat_ws("-", F.lit("part"), "p_partkey").alias("question_id"),
        F.get(F.array(*wordings), slot).alias("question"),
    )
    return union_all([asked, made])
