"""Answer a table of business questions from the analytics results.

A question is routed by keywords; naming a known product switches to that product. Answers of bounded length are
written out. Lists that grow with the data are rows of `answer_lines`, and are also written into the answer as long
as they have at most `INLINE_LINES` lines.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.rules import at_risk, grade_rank
from tallyloom.functions.text import count_text, days_number, fill, money_text, percent_text
from tallyloom.operators import ranking
from tallyloom.operators.recommend import priority_order
from tallyloom.sources.files import union_all
from tallyloom.sources.schema import PRODUCT_KEYS
from tallyloom.sources.tables import fits_broadcast, numbered, settle

# Keywords per intent, in the order they are tried, matched anywhere in the lower-case question.
PRODUCT_INTENT = "product_recommendation"
PRODUCT_KEYWORDS = (
    "should", "recommend", "keep", "increase", "reduce", "order", "reorder", "buy", "next month", "next week",
    "forecast", "demand",
)
INTENT_KEYWORDS = {
    "inventory_summary": ("summary", "overview", "health", "performance"),
    "top_products": ("top", "best", "highest revenue", "most revenue", "sold most"),
    "stockout_risk": ("stockout", "run out", "low stock", "shortage"),
    "overstock_risk": ("overstock", "excess", "too much stock", "high stock"),
    "waste_analysis": ("waste", "wastage", "loss", "spoiled"),
    "forecast_summary": ("forecast", "future demand", "next month", "next week", "predicted demand"),
    "general_recommendations": ("recommend", "recommendation", "action", "what should i do"),
    "category_performance": ("category", "categories"),
}
FALLBACK_INTENT = "inventory_summary"
EMPTY_INTENT = "empty_question"

# Wording of the answers.
EMPTY_ANSWER = "Please ask a question about inventory, products, forecast, risk, waste, or recommendations."
FAILURE_PREFIX = "I could not complete the analysis. "
INTROS = {
    "inventory_summary": "Here is the current inventory overview based on uploaded data.",
    "top_products": "Here are the strongest products based on revenue performance.",
    "stockout_risk": "I checked which products may run out soon.",
    "overstock_risk": "I checked which products may have excess stock.",
    "waste_analysis": "I analyzed products contributing most to waste or loss.",
    "forecast_summary": "Here is the demand forecast summary.",
    "general_recommendations": "Here are the most important inventory actions to consider.",
    "category_performance": "Here is the category-level performance breakdown.",
    "product_recommendation": "I checked this product using KPIs, forecast, and recommendation rules.",
}
SUMMARY_TEXT = (
    "Inventory health score is {health}/100. Total revenue is {revenue}, units sold are {sold}, "
    "and waste value is {waste}. There are {stockout} high stockout-risk products "
    "and {overstock} high overstock-risk products."
)
FORECAST_TEXT = (
    "Forecast summary for the next 30 days: {products} products were forecasted. "
    "Total predicted demand is {demand} units. Recommended reorder quantity is {reorder} units. "
    "{high} products have high forecast stockout risk."
)
REVENUE_LINE = "{name} generated {revenue} from {sold} units sold."
STOCKOUT_LINE = "{name} has {risk} stockout risk with approximately {days} days of stock left."
OVERSTOCK_LINE = "{name} has {risk} overstock risk with approximately {days} days of stock coverage."
WASTE_LINE = "{name} has waste value of {waste} and waste rate of {rate}."
ADVICE_LINE = "[{priority}] {action} Reason: {reason}"
# Per list: header, text for an empty list, whether an empty list is still a successful answer.
LISTS = {
    "top_products": ("Top products by revenue:", "No product data is available.", False),
    "stockout_risk": (
        "Stockout risk products:", "No high or medium stockout-risk products were detected.", True,
    ),
    "overstock_risk": (
        "Overstock risk products:", "No high or medium overstock-risk products were detected.", True,
    ),
    "waste_analysis": ("Highest waste products:", "No waste analysis data is available.", False),
    "general_recommendations": (
        "Top inventory recommendations:",
        "No major recommendation is needed. Inventory appears stable based on current rules.",
        True,
    ),
    "category_performance": ("Category performance:", "No category performance data is available.", False),
}
CARD_TEXT = (
    "Product analysis for {name}:\n- Current stock: {stock}\n- Stockout risk: {stockout}\n"
    "- Overstock risk: {overstock}\n- Waste rate: {waste}\n- Product health score: {health}/100"
)
CARD_FORECAST_TEXT = (
    "\n- Predicted 30-day demand: {demand}\n- Safety stock: {safety}\n- Recommended reorder quantity: {reorder}\n"
    "- Forecast stockout risk: {risk}\n- Forecast confidence: {confidence}"
)
CARD_ADVICE_HEADER = "\n\nRecommended actions:"
CARD_NO_ADVICE = "\n\nNo urgent recommendation was generated for this product based on current rules."

# A list of more lines is written in numbered parts of this many, a row each; no line is left out.
PART_LINES = 200
# Length of the text fragments that products and questions are joined on.
FRAGMENT = 6
# Hash slots in which fragments of questions are counted.
TRAFFIC_SLOTS = 65_536


@dataclass(frozen=True)
class Context:
    """The analytics results that answers are taken from."""

    summary: DataFrame
    risk: DataFrame
    performance: DataFrame
    category: DataFrame
    advice: DataFrame
    forecast: DataFrame
    forecast_totals: DataFrame


# ---------------------------------------------------------------- routing


def _mentions_any(text: Column, words: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(text, F.lit(word))
    return hit


def intent_of(question: Column, product_name: Column) -> Column:
    text = F.lower(question)
    intent = F.when(text.rlike(r"^\s*$"), EMPTY_INTENT)
    intent = intent.when(product_name.isNotNull() & _mentions_any(text, PRODUCT_KEYWORDS), PRODUCT_INTENT)
    for name, words in INTENT_KEYWORDS.items():
        intent = intent.when(_mentions_any(text, words), name)
    return intent.otherwise(FALLBACK_INTENT)


def _fragments(text: Column, lengths: list[int]) -> Column:
    """All distinct substrings of the given lengths."""

    def of_length(size: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(text) - size + 1)
        cut = F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))
        return F.when(F.length(text) >= size, cut).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.array(*[of_length(n) for n in lengths])))


def _named_products(performance: DataFrame) -> DataFrame:
    """Distinct names with the place of their first row in revenue order."""
    place = F.struct((-F.col("total_revenue")).alias("place"), "product_id", "category")
    named = with_name(performance).groupBy("product_name").agg(F.min(place).alias("place"))
    return named.withColumn("lower_name", F.lower("product_name"))


def with_name(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["product_name"])


def _slot(fragment: Column) -> Column:
    return F.pmod(F.xxhash64(fragment), F.lit(TRAFFIC_SLOTS)).cast("int")


def fragment_traffic(texts: DataFrame) -> DataFrame:
    """(slot, traffic): how many fragments of the texts fall into each of TRAFFIC_SLOTS hash slots.

    All texts are counted, combined before the shuffle; the table has at most TRAFFIC_SLOTS rows whatever their number.
    """
    slots = F.transform(_fragments(F.col("text"), [FRAGMENT]), _slot)
    return texts.select(F.explode(slots).alias("slot")).groupBy("slot").agg(F.count("*").alias("traffic"))


def _anchored(names: DataFrame, texts: DataFrame) -> DataFrame:
    """Give every name one fragment to be found by: the one rarest among the texts, then among names; or all of a short
    name. A fragment that many texts hold would make all of them candidates of the name.
    """
    cut = names.select("lower_name", F.explode(_fragments(F.col("lower_name"), [FRAGMENT])).alias("fragment"))
    traffic = F.broadcast(fragment_traffic(texts))  # at most TRAFFIC_SLOTS rows of 12 bytes
    cut = cut.distinct().withColumn("slot", _slot(F.col("fragment"))).join(traffic, "slot", "left")
    shared = cut.groupBy("fragment").agg(F.count("*").alias("sharers"))
    rarest = (
        cut.join(shared, "fragment")
        .groupBy("lower_name")
        .agg(F.min_by("fragment", F.struct(F.coalesce("traffic", F.lit(0)), "sharers", "fragment")).alias("rarest"))
    )
    anchored = names.join(rarest, "lower_name", "left")
    return anchored.withColumn("fragment", F.coalesce("rarest", "lower_name")).drop("rarest")


def product_mentions(questions: DataFrame, performance: DataFrame) -> DataFrame:
    """The product each question names, if any: (question_id, product_name).

    A name counts when it occurs anywhere in the question, whatever the case; of several, the product first in
    revenue order wins. Instead of testing every name against every question, both sides are joined on a fragment
    that any question containing the name must contain, and only those candidates are compared.
    """
    texts = questions.select("question_id", F.lower("question").alias("text"))
    names = settle(_anchored(_named_products(performance), texts), "product-names")
    short = names.filter(F.length("fragment") < FRAGMENT).select(F.length("fragment").alias("size")).distinct()
    lengths = [FRAGMENT, *sorted(row["size"] for row in short.collect())]  # at most FRAGMENT rows
    fragment = F.explode(_fragments(F.col("text"), lengths)).alias("fragment")
    if fits_broadcast(names):
        candidates = texts.select("question_id", "text", fragment).join(F.broadcast(names), "fragment")
    else:
        pairs = texts.select("question_id", fragment).join(names, "fragment")
        candidates = pairs.join(texts, "question_id")
    found = candidates.filter(F.contains("text", "lower_name"))
    return found.groupBy("question_id").agg(F.min_by("product_name", "place").alias("product_name"))


def route(questions: DataFrame, performance: DataFrame) -> DataFrame:
    """Questions with the product they name and their intent."""
    routed = questions.join(product_mentions(questions, performance), "question_id", "left")
    return routed.withColumn("intent", intent_of(F.col("question"), F.col("product_name")))


# ---------------------------------------------------------------- lists


def _lines(df: DataFrame, intent: str, line: Column, order: list[Column]) -> DataFrame:
    """Lines of one list with two sort keys: `grade` ascending, then `measure` ascending, then the text."""
    grade, measure = order
    return df.select(
        F.lit(intent).alias("intent"),
        grade.cast("int").alias("grade"),
        measure.cast("double").alias("measure"),
        line.alias("line"),
    )


def _revenue_line(name: str) -> Column:
    return fill(
        REVENUE_LINE,
        name=F.col(name),
        revenue=money_text(F.col("total_revenue")),
        sold=count_text(F.col("total_units_sold")),
    )


def _advice_line() -> Column:
    return fill(ADVICE_LINE, priority=F.col("priority"), action=F.col("action"), reason=F.col("reason"))


def answer_lines(context: Context) -> DataFrame:
    """Every line of every list answer, whole, in sort-key form: (intent, grade, measure, line)."""
    performance, one = context.performance, F.lit(1)
    days = F.col("days_of_stock_left")

    def at(risk: str) -> DataFrame:
        return performance.filter(at_risk(F.col(risk)))

    def risk_line(template: str, risk: str) -> Column:
        return fill(template, name=F.col("product_name"), risk=F.col(risk), days=days_number(days))

    waste_line = fill(
        WASTE_LINE,
        name=F.col("product_name"),
        waste=money_text(F.col("total_waste_value")),
        rate=percent_text(F.col("waste_rate")),
    )
    best = ranking.top_recommendations(context.advice)
    numbered = best.withColumn("place", F.row_number().over(Window.orderBy(*priority_order())))  # five rows
    return union_all(
        [
            _lines(
                ranking.top_products(performance),
                "top_products",
                _revenue_line("product_name"),
                [one, -F.col("total_revenue")],
            ),
            _lines(
                at("stockout_risk"),
                "stockout_risk",
                risk_line(STOCKOUT_LINE, "stockout_risk"),
                [grade_rank(F.col("stockout_risk")), days],
            ),
            _lines(
                at("overstock_risk"),
                "overstock_risk",
                risk_line(OVERSTOCK_LINE, "overstock_risk"),
                [grade_rank(F.col("overstock_risk")), -days],
            ),
            _lines(
                ranking.top_waste(performance), "waste_analysis", waste_line, [one, -F.col("total_waste_value")]
            ),
            _lines(numbered, "general_recommendations", _advice_line(), [one, F.col("place")]),
            _lines(
                context.category,
                "category_performance",
                _revenue_line("category"),
                [one, -F.col("total_revenue")],
            ),
        ]
    )


def _parts(lines: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Per key and part: (keys, part, parts, lines), at most PART_LINES lines in a row, all of them in order."""
    each = numbered(lines, keys, order, "answer-lines")
    part = F.floor((F.col("line_no") - 1) / PART_LINES).cast("int") + 1
    parts = F.ceil(F.col("line_count") / PART_LINES).cast("int")
    grouped = each.groupBy(*keys, part.alias("part"), parts.alias("parts"))
    return grouped.agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("lines"))


def _headed(header: Column) -> Column:
    """A header, with the part's number where there are several."""
    return F.when(F.col("parts") > 1, F.format_string("%s (part %d of %d)", header, "part", "parts")).otherwise(header)


def _joined(lines: Column, numbered: Column) -> Column:
    text = F.transform(
        lines,
        lambda x: F.when(numbered, F.concat(x["line_no"].cast("string"), F.lit(". "), x["line"])).otherwise(
            F.concat(F.lit("- "), x["line"])
        ),
    )
    return F.array_join(text, "\n")


def _one_part() -> list[Column]:
    return [F.lit(1).alias("part"), F.lit(1).alias("parts")]


def list_messages(context: Context) -> DataFrame:
    """A row per list intent and part: (intent, part, parts, success, message)."""
    inlined = _parts(answer_lines(context), ["intent"], ["grade", "measure", "line"])
    entries = [
        F.struct(
            F.lit(intent).alias("intent"),
            F.lit(header).alias("header"),
            F.lit(empty_text).alias("empty_text"),
            F.lit(success).alias("empty_success"),
        )
        for intent, (header, empty_text, success) in LISTS.items()
    ]
    intents = context.performance.sparkSession.range(1).select(F.inline(F.array(*entries)))
    listed = _joined(F.col("lines"), F.col("intent") == "top_products")
    full, empty = F.concat(_headed(F.col("header")), F.lit("\n\n"), listed), F.col("lines").isNull()
    return intents.join(inlined, "intent", "left").select(
        "intent",
        F.coalesce("part", F.lit(1)).alias("part"),
        F.coalesce("parts", F.lit(1)).alias("parts"),
        F.when(empty, F.col("empty_success")).otherwise(True).alias("success"),
        F.when(empty, F.col("empty_text")).otherwise(full).alias("message"),
    )


def summary_message(context: Context) -> DataFrame:
    """The overview sentence; risk counts come in as a scalar subquery."""
    risk = context.risk.select(F.struct("high_stockout_risk_products", "high_overstock_risk_products")).scalar()
    filled = context.summary.withColumn("risk", risk).select(
        fill(
            SUMMARY_TEXT,
            health=F.col("inventory_health_score").cast("string"),
            revenue=money_text(F.col("total_revenue")),
            sold=count_text(F.col("total_units_sold")),
            waste=money_text(F.col("total_waste_value")),
            stockout=F.col("risk.high_stockout_risk_products").cast("string"),
            overstock=F.col("risk.high_overstock_risk_products").cast("string"),
        ).alias("message")
    )
    return filled.select(F.lit("inventory_summary").alias("intent"), *_one_part(), F.lit(True).alias("success"), "message")


def forecast_message(context: Context) -> DataFrame:
    filled = fill(
        FORECAST_TEXT,
        products=F.col("total_products_forecasted").cast("string"),
        demand=count_text(F.col("total_predicted_demand")),
        reorder=count_text(F.col("total_recommended_reorder")),
        high=F.col("high_forecast_stockout_risk").cast("string"),
    )
    return context.forecast_totals.select(
        F.lit("forecast_summary").alias("intent"), *_one_part(), F.lit(True).alias("success"), filled.alias("message")
    )


def intent_messages(context: Context) -> DataFrame:
    """The messages of the eight intents that need no product: a row each, more for lists in parts."""
    return union_all([summary_message(context), forecast_message(context), list_messages(context)])


# ---------------------------------------------------------------- products


def _first_per_name(df: DataFrame, order: list[Column]) -> DataFrame:
    keyed = with_name(df).withColumn("product_key", F.lower("product_name"))
    place = F.row_number().over(Window.partitionBy("product_key").orderBy(*order))
    return keyed.withColumn("place", place).filter("place = 1").drop("place")


def product_cards(context: Context) -> DataFrame:
    """One row per product name (case ignored): stock, risks, forecast, and how much advice there is."""
    products = _first_per_name(context.performance, [F.desc("total_revenue"), *map(F.col, PRODUCT_KEYS)])
    urgency = [
        grade_rank(F.col("forecast_stockout_risk")),
        F.desc("recommended_reorder_quantity"),
        F.col("product_id"),
    ]
    forecasts = _first_per_name(context.forecast, urgency)
    advised = (
        with_name(context.advice)
        .groupBy(F.lower("product_name").alias("product_key"))
        .agg(F.count("*").alias("recommendation_count"))
    )
    return (
        products.select(
            "product_key",
            "product_name",
            F.coalesce(F.col("current_stock"), F.lit(0.0)).try_cast("long").alias("current_stock"),
            "stockout_risk",
            "overstock_risk",
            "waste_rate",
            "product_health_score",
        )
        .join(
            forecasts.select(
                "product_key",
                "predicted_demand",
                "safety_stock",
                "recommended_reorder_quantity",
                "forecast_stockout_risk",
                F.col("confidence").alias("forecast_confidence"),
            ),
            "product_key",
            "left",
        )
        .join(advised, "product_key", "left")
        .withColumn("recommendation_count", F.coalesce("recommendation_count", F.lit(0).cast("long")))
    )


def product_advice_lines(context: Context) -> DataFrame:
    """Every advice line of every product name, whole, with its sort keys."""
    return with_name(context.advice).select(
        F.lower("product_name").alias("product_key"),
        grade_rank(F.col("priority")).alias("grade"),
        (-F.col("total_revenue")).alias("measure"),
        "product_id",
        "rule_no",
        _advice_line().alias("line"),
    )


def product_messages(context: Context) -> DataFrame:
    """The product answer per product name: (product_key, part, parts, success, message), a row per part of its advice."""
    lines = product_advice_lines(context)
    inlined = _parts(lines, ["product_key"], ["grade", "measure", "product_id", "rule_no", "line"])
    cards = product_cards(context).join(inlined, "product_key", "left")
    card = fill(
        CARD_TEXT,
        name=F.col("product_name"),
        stock=F.col("current_stock").cast("string"),
        stockout=F.col("stockout_risk"),
        overstock=F.col("overstock_risk"),
        waste=percent_text(F.col("waste_rate")),
        health=F.col("product_health_score").cast("string"),
    )
    outlook = fill(
        CARD_FORECAST_TEXT,
        demand=F.col("predicted_demand").cast("string"),
        safety=F.col("safety_stock").cast("string"),
        reorder=F.col("recommended_reorder_quantity").cast("string"),
        risk=F.col("forecast_stockout_risk"),
        confidence=F.col("forecast_confidence"),
    )
    listed = F.concat(_headed(F.lit(CARD_ADVICE_HEADER)), F.lit("\n"), _joined(F.col("lines"), F.lit(False)))
    advice = F.when(F.col("lines").isNull(), CARD_NO_ADVICE).otherwise(listed)
    message = F.concat(card, F.coalesce(outlook, F.lit("")), advice)
    part = [F.coalesce(c, F.lit(1)).alias(c) for c in ("part", "parts")]
    return cards.select("product_key", *part, F.lit(True).alias("success"), message.alias("message"))


# ---------------------------------------------------------------- answers


def answers(questions: DataFrame, context: Context) -> DataFrame:
    """Answer every question: (question_id, question, intent, product_name, part, parts, answer, tools_used, confidence); a
    row per question, more where its list takes several parts.
    """
    routed = route(questions, context.performance)
    intent, is_product = F.col("intent"), F.col("intent") == PRODUCT_INTENT
    # Questions without a product take their own id as key, so they spread evenly over the product join.
    key = F.when(is_product, F.lower("product_name")).otherwise(F.concat(F.lit("\u0000"), F.col("question_id")))
    general = intent_messages(context).select("intent", F.struct("success", "message", "part", "parts").alias("general"))
    product = product_messages(context).select("product_key", F.struct("success", "message", "part", "parts").alias("product"))
    joined = (
        routed.withColumn("product_key", key)
        .join(general, "intent", "left")  # eight rows and more with the lists: Spark broadcasts them while they are small
        .join(product, "product_key", "left")
        .withColumn("result", F.coalesce("product", "general"))
    )
    intro = F.lit("")
    for name, text in INTROS.items():
        intro = F.when(intent == name, text).otherwise(intro)
    empty = intent == EMPTY_INTENT
    done = F.coalesce(F.col("result.success"), F.lit(False))
    answer = (
        F.when(empty, EMPTY_ANSWER)
        .when(done, F.concat(intro, F.lit("\n\n"), F.col("result.message")))
        .otherwise(F.concat(F.lit(FAILURE_PREFIX), F.coalesce(F.col("result.message"), F.lit(""))))
    )
    return joined.select(
        "question_id",
        "question",
        "intent",
        "product_name",
        *[F.coalesce(F.col(f"result.{c}"), F.lit(1)).alias(c) for c in ("part", "parts")],
        answer.alias("answer"),
        F.when(empty, F.array().cast("array<string>")).otherwise(F.array(intent)).alias("tools_used"),
        F.when(done & ~empty, "High").otherwise("Low").alias("confidence"),
    )
