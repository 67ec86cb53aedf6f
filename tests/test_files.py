import contextlib
import io
import json
import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyloom.plans import analysis
from tallyloom.sources import files
from tallyloom.sources.ledger import ledger
from tallyloom.sources.schema import standardise_columns
from tallyloom.sources.tables import numbered
from tests.conftest import SF_SMALL


def test_csv_keeps_ids_as_text_and_blanks_null_tokens(spark, tmp_path):
    path = tmp_path / "in.CSV"
    path.write_text('store_id,Product Name,x\n001,"Say ""hi"", ok",NA\n002,null,1\n')
    rows = files.read_ledger(spark, str(path)).collect()
    assert [tuple(r) for r in rows] == [("001", 'Say "hi", ok', None), ("002", None, "1")]


def test_glob_reads_all_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"day{i}.csv").write_text(f"date,x\n2025-10-0{i + 1},{i}\n")
    assert files.read_ledger(spark, f"{tmp_path}/*.csv").count() == 3


def test_other_formats_are_refused_before_any_job(spark, tmp_path):
    with pytest.raises(ValueError, match="Unsupported file format"):
        files.read_ledger(spark, "/nowhere/notes.txt")
    with pytest.raises(ValueError, match="Convert"):
        files.read_ledger(spark, "/nowhere/book.xlsx")
    with pytest.raises(FileNotFoundError):
        files.read_ledger(spark, str(tmp_path / "absent.csv"))


def test_ledger_survives_csv_and_parquet(spark, tmp_path):
    source = ledger(spark, SF_SMALL)
    files.write_csv(source, f"{tmp_path}/out.csv")
    source.write.parquet(f"{tmp_path}/out.parquet")
    from_csv = analysis.validate_file(spark, f"{tmp_path}/out.csv")
    from_parquet = analysis.validate_file(spark, f"{tmp_path}/out.parquet")
    assert from_csv.report.first() == from_parquet.report.first()
    assert from_csv.cleaned.exceptAll(from_parquet.cleaned).isEmpty()
    assert from_parquet.cleaned.exceptAll(from_csv.cleaned).isEmpty()


def test_names_are_normalised_and_clashes_refused(spark):
    df = spark.createDataFrame([(1, 2, 3)], [" Product Name ", "a-b", "x  y/z"])
    assert standardise_columns(df).columns == ["product_name", "a_b", "x__y/z"]
    with pytest.raises(ValueError, match="collide"):
        standardise_columns(spark.createDataFrame([(1, 2)], ["a b", "A-B"]))


def test_json_has_no_special_numbers(spark):
    df = spark.createDataFrame([(1.5, "a"), (math.inf, "b"), (math.nan, "c"), (-math.inf, None)], "x double, y string")
    df = df.withColumn("d", F.lit("2025-10-01").cast("date")).withColumn("t", F.timestamp_seconds(F.lit(0.5)))
    records = [json.loads(r.record) for r in files.json_records(df).collect()]
    assert [r["x"] for r in records] == [1.5, None, None, None]
    assert records[3]["y"] is None and records[0]["d"] == "2025-10-01T00:00:00"
    assert records[0]["t"] == "1970-01-01T00:00:00.500000"


def test_run_log_appends(spark, tmp_path):
    metrics = spark.createDataFrame([(1.5, 3)], "mae double, evaluated_products long")
    for window in (7, 14):
        files.append_run(files.run_record("run", {"window": window}, metrics), f"{tmp_path}/runs")
    rows = spark.read.parquet(f"{tmp_path}/runs").collect()
    assert sorted(r.params["window"] for r in rows) == ["14", "7"]
    assert rows[0].metrics == {"mae": 1.5, "evaluated_products": 3.0}


def test_lines_with_a_wrong_number_of_fields_are_rejects(spark, tmp_path):
    (tmp_path / "a.csv").write_text('store_id,Product Name,x\n001,"Say ""hi"", ok",NA\n\n003,short\n004,a,b,c\n005,"q,r",2\n006,,\n')
    (tmp_path / "b.csv").write_text("store_id,Product Name,x\n007,x,3,\n008\n")
    kept, rejects = files.read_csv_checked(spark, str(tmp_path))
    assert kept.columns == ["store_id", "Product Name", "x"]
    assert sorted(map(tuple, kept.collect()), key=str) == [("001", 'Say "hi", ok', None), ("005", "q,r", "2"), ("006", None, None)]
    assert sorted(map(tuple, rejects.collect())) == [("a.csv", "003,short"), ("a.csv", "004,a,b,c"), ("b.csv", "007,x,3,"), ("b.csv", "008")]
    counts = {r.file: (r.reject_count, r.warning) for r in files.reject_counts(rejects).collect()}
    assert counts == {f: (2, "2 lines with a wrong number of fields were left out.") for f in ("a.csv", "b.csv")}
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "e.csv").write_text("\n")
    with pytest.raises(ValueError, match="No header"):
        files.read_csv_checked(spark, str(tmp_path / "empty"))


def test_rows_are_numbered_across_ranges(spark):
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, 'a', 'hot') k", "id")
    out = sorted(map(tuple, numbered(rows.repartition(5), ["k"], ["id"], "test").collect()))
    for key, ids in (("a", range(0, 3000, 3)), ("hot", [i for i in range(3000) if i % 3])):
        assert [r for r in out if r[0] == key] == [(key, i, n, len(ids)) for n, i in enumerate(ids, 1)]


def test_a_rerun_replaces_its_own_run_alone(spark, tmp_path):
    for value, run in ((1.0, "a"), (2.0, "b"), (3.0, "a")):
        metrics = spark.createDataFrame([(value,)], "mae double")
        files.append_run(files.run_record("run", {"x": 1}, metrics), f"{tmp_path}/runs", run)
    rows = spark.read.parquet(f"{tmp_path}/runs").collect()
    assert sorted((r.run_id, r.metrics["mae"]) for r in rows) == [("a", 3.0), ("b", 2.0)]


def test_months_outside_the_range_are_not_read(spark, tmp_path):
    path, source = f"{tmp_path}/months", ledger(spark, SF_SMALL)
    undated = source.limit(1).withColumn("date", F.lit(None).cast("date"))
    files.write_by_month(source.unionByName(undated), path)
    assert (tmp_path / "months" / "ledger_month=none").is_dir()
    first, last = date(1995, 2, 10), date(1995, 5, 9)
    got = files.read_days(spark, path, first, last)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, source.where(F.col("date").between(first, last)).collect()))
    assert got.columns == source.columns
    plan = plan_text(got)
    assert "PartitionFilters: [isnotnull(ledger_month" in plan and "(ledger_month#" in plan
    assert len({r.f.split("ledger_month=")[1][:7] for r in got.select(F.input_file_name().alias("f")).collect()}) == 4
    files.write_by_month(source.where(F.col("date") < "1995-03-01"), path)  # replaces its months, leaves the others
    assert spark.read.parquet(path).count() == source.count() + 1


def plan_text(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()
