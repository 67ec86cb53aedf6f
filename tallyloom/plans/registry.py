"""Named queries over the given tables: (session, table folder) -> DataFrame.

Days come out as ISO text and lists of messages as lines of text, so results compare the same in any engine.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.numeric import DAY_LAYOUTS
from tallyloom.operators import evaluation, forecast, kpi, quality, questions, ranking, recommend
from tallyloom.plans import analysis, increments
from tallyloom.sources import files, ledger
from tallyloom.sources.schema import coerce_types, day_layout, standardise_columns
from tallyloom.sources.tables import scratch_folder, settle

Query = Callable[[SparkSession, str], DataFrame]


def _day_text(df: DataFrame) -> DataFrame:
    return df.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


def _lines(column: str) -> Column:
    return F.array_join(column, "\n").alias(column)


class Source:
    """Lazy access to the ledger of one table folder and to what is derived from it.

    `shared=True` settles the two rollups first, for queries that combine several results of them.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, shared: bool = False):
        self.spark, self.sf_dir = spark, sf_dir
        self.enriched = kpi.enrich(ledger.ledger(spark, sf_dir))
        self.rollups = kpi.roll_up(self.enriched)
        if shared:
            self.rollups = kpi.settled(self.rollups)

    @property
    def performance(self) -> DataFrame:
        return kpi.product_performance(self.rollups)

    @property
    def summary(self) -> DataFrame:
        return kpi.summary_metrics(self.rollups, self.performance)

    @property
    def forecast(self) -> DataFrame:
        return forecast.product_forecast(forecast.daily_demand(self.rollups.daily), self.performance)

    @property
    def evaluation(self) -> DataFrame:
        return evaluation.forecast_eval(evaluation.actual_demand(self.enriched))

    @property
    def advice(self) -> DataFrame:
        return recommend.recommendations(self.performance)

    @property
    def questions(self) -> DataFrame:
        return ledger.questions(self.spark, self.sf_dir)


def _shared(spark: SparkSession, sf_dir: str) -> Source:
    return Source(spark, sf_dir, shared=True)


def _stored_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived ledger as a table, for jobs that scan the ledger itself several times."""
    return settle(ledger.ledger(spark, sf_dir), "ledger")


def _analysis(spark: SparkSession, sf_dir: str) -> analysis.Analysis:
    return analysis.build(Source(spark, sf_dir).enriched)


def _context(spark: SparkSession, sf_dir: str) -> questions.Context:
    return _analysis(spark, sf_dir).context()


def _coerced_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coerce_types(ledger.dirty_ledger(spark, sf_dir))


def _outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.sales_outliers(coerce_types(settle(ledger.dirty_ledger(spark, sf_dir), "dirty-ledger")))


def _duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicate_rows(settle(ledger.dirty_ledger(spark, sf_dir), "dirty-ledger"))


def _json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forecast as JSON records, read back by field."""
    rows = _shared(spark, sf_dir).forecast
    return files.read_json_records(files.json_records(rows), rows.schema)


def _csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger written as CSV under headers as people type them, and read back."""
    odd = {"product_name": " Product Name ", "store_id": "Store-ID", "date": "DATE", "opening_stock": "Opening Stock"}
    path = scratch_folder(spark, "round-trip")
    files.write_csv(ledger.ledger(spark, sf_dir).withColumnsRenamed(odd), path)
    return _day_text(coerce_types(standardise_columns(files.read_ledger(spark, path, "csv"))))


def _csv_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a CSV written from the ledger, kept or rejected: on the third of a month a field is missing, on the 17th
    there is one too many.
    """
    path, header = scratch_folder(spark, "rejects"), "date,store_id,product_id,sold"
    day, sold = F.dayofmonth("date"), F.col("sold_quantity").cast("long").cast("string")
    line = F.concat_ws(",", F.date_format("date", "yyyy-MM-dd"), "store_id", "product_id", F.when(day != 3, sold), F.when(day == 17, "x"))
    ledger.ledger(spark, sf_dir).select(line.alias("value")).write.text(path)
    kept, rejects = files.read_csv_checked(spark, path, header)
    whole = F.concat_ws(",", *kept.columns)
    return kept.select(whole.alias("line"), F.lit("kept").alias("status")).unionByName(rejects.select("line", F.lit("reject").alias("status")))


def _date_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The defective ledger with its dates written in every layout, some with a time of day: what is found and read."""
    dirty = settle(ledger.dirty_ledger(spark, sf_dir), "dirty-ledger")
    day, clocks = F.try_to_date("date", "yyyy-MM-dd"), ("", " 08:30", "T00:00:00Z", " 23:59:59.5+02:00")
    out = []
    for i, layout in enumerate(DAY_LAYOUTS):
        written = F.concat(F.date_format(day, layout), F.lit(clocks[i % len(clocks)]))
        text = dirty.withColumn("date", F.coalesce(written, "date"))
        found = day_layout(text)
        read = coerce_types(text, found).agg(
            F.count_if(F.col("date").isNull()).alias("bad_date"), F.sum(F.unix_date("date").cast("long")).alias("day_sum")
        )
        out.append(read.select(F.lit(layout).alias("written"), F.lit(found).alias("found"), "bad_date", "day_sum"))
    return files.union_all(out)


def _ledger_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a quarter, from the ledger written by month."""
    path = scratch_folder(spark, "by-month")
    files.write_by_month(ledger.ledger(spark, sf_dir), path)
    return _day_text(files.read_days(spark, path, date(1995, 2, 10), date(1995, 5, 9)))


def _stored_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product performance over rollups that grew by three increments, of which one came twice. Their rows are written once:
    deriving the ledger for each rollup of each increment would scan the lines, and broadcast the parts, eight times.
    """
    rows, folder = settle(Source(spark, sf_dir).enriched, "enriched"), scratch_folder(spark, "increments")
    third = F.pmod(F.unix_date("date"), F.lit(3))
    for part in (0, 1, 2, 1):
        increments.add_increment(rows.where(third == part), folder, f"part{part}")
    return kpi.product_performance(increments.stored_rollups(spark, folder))


def _bucketed_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forecast over a daily rollup in buckets of products."""
    source, path = _shared(spark, sf_dir), scratch_folder(spark, "buckets")
    daily = kpi.bucketed(source.rollups.daily, "daily_" + path.rsplit("-", 1)[1], path, 8)
    return forecast.product_forecast(forecast.daily_demand(daily), source.performance, clustered=True)


def _saved_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers over a context saved by an earlier call."""
    stored, asked, folder = _stored_ledger(spark, sf_dir), ledger.questions(spark, sf_dir), scratch_folder(spark, "contexts")
    analysis.ask(asked, stored, folder)
    return analysis.ask(asked, stored, folder).withColumn("tools_used", F.array_join("tools_used", ","))


def _insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = _analysis(spark, sf_dir)
    return ranking.executive_insights(result.performance, result.category, result.summary)


def _report(spark: SparkSession, sf_dir: str, source: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    report = quality.validate(settle(source(spark, sf_dir), "ledger")).report
    return report.select(
        "is_valid", "data_quality_score", _lines("errors"), _lines("warnings"), "row_count", _lines("columns")
    )


def _evaluation_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = analysis.evaluate(_stored_ledger(spark, sf_dir), "lineitem").record
    params = record.select("run_name", F.explode("params").alias("name", "text_value")).withColumn(
        "number_value", F.lit(None).cast("double")
    )
    metrics = record.select("run_name", F.explode("metrics").alias("name", "number_value")).withColumn(
        "text_value", F.lit(None).cast("string")
    )
    return params.unionByName(metrics)


def _analysis_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = analysis.analyze(_stored_ledger(spark, sf_dir))
    counts = [f.agg(F.count("*").alias("row_count")).withColumn("output", F.lit(n)) for n, f in result.outputs().items()]
    return files.union_all(counts)


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    answered = questions.answers(ledger.questions(spark, sf_dir), _context(spark, sf_dir))
    return answered.withColumn("tools_used", F.array_join("tools_used", ","))


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = Source(spark, sf_dir)
    return questions.product_mentions(source.questions, source.performance)


def _intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = Source(spark, sf_dir)
    routed = questions.route(source.questions, source.performance)
    return routed.select("question_id", "product_name", "intent")


def _advice(df: DataFrame) -> DataFrame:
    return df.drop("total_revenue", "rule_no")


def queries() -> dict[str, Query]:
    return {
        # sources and sinks
        "ledger": lambda s, d: _day_text(ledger.ledger(s, d)),
        "json_safe": lambda s, d: files.json_safe(Source(s, d).performance),
        "json_records": _json_records,
        "csv_round_trip": _csv_round_trip,
        "csv_rejects": _csv_rejects,
        "date_layouts": _date_layouts,
        "ledger_between": _ledger_between,
        "product_performance_stored": _stored_performance,
        "product_forecast_bucketed": _bucketed_forecast,
        "evaluation_run": _evaluation_run,
        "analysis_outputs": _analysis_outputs,
        "preview": lambda s, d: _day_text(ranking.preview(ledger.ledger(s, d))),
        # quality
        "coerce_counts": lambda s, d: quality.coerce_counts(_coerced_dirty(s, d)),
        "quality_counts": lambda s, d: quality.quality_counts(_coerced_dirty(s, d)),
        "sales_outliers": _outliers,
        "duplicate_rows": _duplicates,
        "validation_report": lambda s, d: _report(s, d, ledger.dirty_ledger),
        "validation_report_clean": lambda s, d: _report(s, d, ledger.ledger),
        # KPIs
        "enrich": lambda s, d: _day_text(Source(s, d).enriched),
        "latest_snapshot": lambda s, d: _day_text(kpi.latest_snapshot(Source(s, d).enriched)),
        "latest_stock": lambda s, d: kpi.latest_stock(Source(s, d).rollups),
        "product_performance": lambda s, d: kpi.by_revenue(Source(s, d).performance),
        "category_performance": lambda s, d: kpi.by_revenue(kpi.category_performance(Source(s, d).rollups)),
        "risk_summary": lambda s, d: kpi.risk_summary(Source(s, d).performance),
        "high_risk_products": lambda s, d: kpi.high_risk_products(kpi.risk_summary(Source(s, d).performance)),
        "summary_metrics": lambda s, d: _shared(s, d).summary,
        "daily_revenue": lambda s, d: _day_text(kpi.daily_revenue(Source(s, d).rollups).orderBy("date")),
        # forecast and evaluation
        "daily_demand": lambda s, d: _day_text(forecast.daily_demand(Source(s, d).enriched)),
        "demand_calendar": lambda s, d: _day_text(forecast.demand_calendar(forecast.daily_demand(Source(s, d).enriched))),
        "demand_windows": lambda s, d: forecast.demand_windows(
            forecast.daily_demand(Source(s, d).enriched)
        ).withColumn("demand_std", F.round("demand_std", 6)),
        "product_forecast": lambda s, d: forecast.by_urgency(_shared(s, d).forecast),
        "forecast_summary": lambda s, d: forecast.forecast_summary(_shared(s, d).forecast),
        "forecast_eval": lambda s, d: _day_text(Source(s, d).evaluation),
        "forecast_metrics": lambda s, d: evaluation.forecast_metrics(Source(s, d).evaluation),
        # recommendations
        "recommendations": lambda s, d: _advice(recommend.by_priority(Source(s, d).advice)),
        "recommendation_summary": lambda s, d: recommend.recommendation_summary(Source(s, d).advice),
        # rankings and report tables
        "top_products": lambda s, d: ranking.top_products(Source(s, d).performance),
        "top_products_chart": lambda s, d: ranking.top_products(Source(s, d).performance, ranking.CHART_TOP),
        "top_waste": lambda s, d: ranking.top_waste(Source(s, d).performance),
        "top_waste_chart": lambda s, d: ranking.top_waste(Source(s, d).performance, ranking.CHART_TOP),
        "top_reorder": lambda s, d: ranking.top_reorder(_shared(s, d).forecast),
        "top_recommendations": lambda s, d: _advice(ranking.top_recommendations(Source(s, d).advice)),
        "stockout_list": lambda s, d: ranking.stockout_list(Source(s, d).performance),
        "overstock_list": lambda s, d: ranking.overstock_list(Source(s, d).performance),
        "executive_insights": _insights,
        "product_table": lambda s, d: Source(s, d).performance.select(*ranking.PRODUCT_TABLE),
        "category_table": lambda s, d: kpi.category_performance(Source(s, d).rollups).select(*ranking.CATEGORY_TABLE),
        "forecast_table": lambda s, d: _shared(s, d).forecast.select(*ranking.FORECAST_TABLE),
        "recommendation_table": lambda s, d: Source(s, d).advice.select(*ranking.RECOMMENDATION_TABLE),
        "product_brief": lambda s, d: ranking.top_products(Source(s, d).performance).select(*ranking.PRODUCT_BRIEF),
        "forecast_brief": lambda s, d: _shared(s, d).forecast.select(*ranking.FORECAST_BRIEF),
        "recommendation_brief": lambda s, d: ranking.top_recommendations(
            Source(s, d).advice, ranking.BRIEF_TOP
        ).select(*ranking.RECOMMENDATION_BRIEF),
        "stockout_table": lambda s, d: ranking.stockout_list(Source(s, d).performance).select(
            *ranking.STOCKOUT_TABLE
        ),
        "overstock_table": lambda s, d: ranking.overstock_list(Source(s, d).performance).select(
            *ranking.OVERSTOCK_TABLE
        ),
        # questions
        "question_product": _mentions,
        "question_intent": _intents,
        "product_card": lambda s, d: questions.product_cards(_context(s, d)),
        "answer_lines": lambda s, d: questions.answer_lines(_context(s, d)),
        "product_advice_lines": lambda s, d: questions.product_advice_lines(_context(s, d)),
        "intent_messages": lambda s, d: questions.intent_messages(_context(s, d)),
        "product_messages": lambda s, d: questions.product_messages(_context(s, d)),
        "answers": _answers,
        "answers_saved": _saved_answers,
    }
