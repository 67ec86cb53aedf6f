"""File sources and sinks: CSV and Parquet ledgers in; CSV, JSON records and run log rows out."""

from __future__ import annotations

import csv
import functools
import uuid
from datetime import date
from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.numeric import INF

# Text that means "no value" in a delimited file.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

READERS = {".csv": "csv", ".parquet": "parquet"}
SPREADSHEETS = (".xlsx", ".xls")
# Partition column of a ledger written by month, and its value for rows without a date.
MONTH = "ledger_month"
NO_MONTH = "none"


def read_ledger(spark: SparkSession, path: str, file_format: str | None = None, multiline: bool = False) -> DataFrame:
    """Read a ledger from a file, directory or glob. The suffix decides unless `file_format` is given.

    CSV columns are all read as text: no inference pass, and leading zeros of ids survive. `multiline` allows line
    breaks inside quotes but makes a file unsplittable, so it is off by default.
    """
    kind = file_format or _format_of(path)
    try:
        if kind == "parquet":
            return spark.read.parquet(path)
        raw = spark.read.csv(path, header=True, inferSchema=False, escape='"', multiLine=multiline)
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"File not found: {path}") from exc
        raise
    return blank_null_tokens(raw)


def read_csv_checked(spark: SparkSession, path: str, header: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A CSV file, directory or glob as (ledger, rejects): lines whose number of fields is not their header's are rejects.

    Every line is read as text and parsed by Spark's CSV parser in permissive mode, which marks such lines; nothing of
    them is lost. rejects holds (file, line) as written. All files share a header line, the first one found unless given;
    it is dropped wherever it occurs, and so are blank lines. Line breaks inside quotes aren't possible here: they would
    make a file unsplittable.
    """
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_name").alias("file"))
    if header is None:
        first = lines.where(F.trim("line") != "").first()
        if first is None:
            raise ValueError(f"No header in {path}")
        header = first.line
    columns = next(csv.reader([header]))
    corrupt = "_line"
    while corrupt in columns:
        corrupt += "_"
    fields = ", ".join(f"`{c.replace('`', '``')}` string" for c in [*columns, corrupt])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt, "escape": '"'}
    body = lines.where((F.trim("line") != "") & (F.col("line") != header))
    parsed = body.select("file", "line", F.from_csv("line", F.lit(fields), options).alias("r"))
    bad = F.col("r").getField(corrupt).isNotNull()
    ledger = parsed.where(~bad).select(*[F.col("r").getField(c).alias(c) for c in columns])
    return blank_null_tokens(ledger), parsed.where(bad).select("file", "line")


def reject_counts(rejects: DataFrame) -> DataFrame:
    """(file, reject_count, warning): one row per file with rejected lines."""
    counts = rejects.groupBy("file").agg(F.count("*").alias("reject_count"))
    warning = F.concat(F.col("reject_count").cast("string"), F.lit(" lines with a wrong number of fields were left out."))
    return counts.withColumn("warning", warning)


def _format_of(path: str) -> str:
    suffix = PurePosixPath(path).suffix.lower()
    if suffix in READERS:
        return READERS[suffix]
    if suffix in SPREADSHEETS:
        raise ValueError("Spreadsheets have no distributed reader. Convert the file to CSV or Parquet first.")
    raise ValueError("Unsupported file format. Please provide a CSV or Parquet file.")


def blank_null_tokens(df: DataFrame) -> DataFrame:
    """Turn the usual spellings of a missing value into NULL in every text column."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.when(~_ref(c).isin(*NULL_TOKENS), _ref(c)) for c in text})


def _ref(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def json_safe(df: DataFrame) -> DataFrame:
    """Replace what JSON cannot carry: NaN and infinities by NULL, dates and times by ISO text."""
    changed = {}
    for field in df.schema.fields:
        column = _ref(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            changed[field.name] = F.when(F.abs(column) < INF, column)
        elif isinstance(field.dataType, T.DateType):
            changed[field.name] = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            whole = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")
            micros = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
            changed[field.name] = F.when(micros.endswith(".000000"), whole).otherwise(micros)
    return df.withColumns(changed) if changed else df


def json_records(df: DataFrame) -> DataFrame:
    """One JSON object per row; missing values are written as null, not left out."""
    record = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    return json_safe(df).select(record.alias("record"))


def read_json_records(records: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows that json_records() wrote, by field."""
    return records.select(F.from_json("record", schema).alias("r")).select("r.*")


def write_json(df: DataFrame, path: str) -> None:
    json_safe(df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Write a directory of CSV parts with headers."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def run_record(run_name: str, params: dict[str, object], metrics: DataFrame) -> DataFrame:
    """One row per run: the parameters as text and every numeric column of the 1-row `metrics` frame."""
    param_map = F.create_map(*[F.lit(str(x)) for item in params.items() for x in item])
    metric_map = F.create_map(*[x for c in metrics.columns for x in (F.lit(c), F.col(c).cast("double"))])
    return metrics.select(
        F.lit(run_name).alias("run_name"),
        F.current_timestamp().alias("logged_at"),
        param_map.alias("params"),
        metric_map.alias("metrics"),
    )


def append_run(record: DataFrame, path: str, run_id: str | None = None) -> None:
    """Add a run to the log, a partition per run id. A job that runs again under its id replaces its own row alone."""
    named = record.withColumn("run_id", F.lit(run_id or uuid.uuid4().hex))
    replace_partitions(named, path, "run_id")


def replace_partitions(df: DataFrame, path: str, *keys: str) -> None:
    """Write the frame in folders by key; folders of keys that it holds are replaced, all others stay.

    Written a second time it leaves the same rows. A key that has no rows any more keeps its old folder.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def write_by_month(df: DataFrame, path: str) -> None:
    """Write a ledger in a folder per month ("none" for rows without a date), replacing the months that it holds.

    Rows are dealt by month in even parts, so that a crowded month is several files rather than one task.
    """
    month = F.coalesce(F.date_format("date", "yyyy-MM"), F.lit(NO_MONTH))
    replace_partitions(df.withColumn(MONTH, month).hint("rebalance", MONTH), path, MONTH)


def read_days(spark: SparkSession, path: str, first: date, last: date) -> DataFrame:
    """Ledger rows from the first to the last day, of a folder of write_by_month; other months aren't read."""
    months = F.col(MONTH).between(first.strftime("%Y-%m"), last.strftime("%Y-%m"))
    # Without inference of partition values a month stays text.
    schema = spark.read.parquet(path).schema
    typed = T.StructType([T.StructField(f.name, T.StringType()) if f.name == MONTH else f for f in schema.fields])
    return spark.read.schema(typed).parquet(path).where(months & F.col("date").between(first, last)).drop(MONTH)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, frames)
