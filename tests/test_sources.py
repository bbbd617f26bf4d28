"""Ingest, cleaning and export."""

import datetime
import glob
from decimal import Decimal

from pyspark.sql import functions as F

from platematch.functions import diff_tables
from platematch.plans import worklist
from platematch.schemas import TABLES
from platematch.sources import (catalog_source, clean_erp_columns, count_rejects, load_domain, order_result, shown_hours,
                                worklist_csv_lines, write_analysis, write_domain, write_worklist_csv)
from tests.shop import build_domain


def test_missing_columns_tables_and_padding(spark, tmp_path):
    raw = spark.createDataFrame([(1, "T1  ")], "IDNES int, OLCOD string")
    plans = load_domain(spark, {"a_nes": raw}, ["a_nes", "workplanjobssheets"])
    assert plans["a_nes"].columns == list(TABLES["a_nes"])
    row = plans["a_nes"].first()
    assert row.olcod == "T1" and row.x_op_ass is None and plans["workplanjobssheets"].isEmpty()
    write_domain(plans, str(tmp_path / "d"))
    assert load_domain(spark, str(tmp_path / "d"), ["a_nes"], cleaned=True)["a_nes"].first() == row
    folded = load_domain(spark, {"a_nes": raw}, ["a_nes"], case_insensitive_codes=True)["a_nes"]
    assert folded.where(F.col("olcod") == "t1").count() == 1


def test_hours(spark):
    cases = {"1.5": "1.5", " 2 ": "2", "1,5": "15", "1.234,5": "1234.5", "2:30": "2.5", "1:30:36": "1.51", "-3": "-3",
             "(4)": "-4", "5-": "-5", "1e2": "100", "1.02:15": "26.25", "1:02:15:00": "26.25", "0:20": "0.333333",
             "abc": None, "": None, "25:61:99": "26.044167"}
    df = spark.createDataFrame([(k,) for k in cases], "t string").withColumn("h", F.col("t"))
    got = {r.t: r.h for r in clean_erp_columns(df, {"h": "hours"}).collect()}
    assert got == {k: None if v is None else Decimal(v).quantize(Decimal("0.000001")) for k, v in cases.items()}
    comma = clean_erp_columns(df, {"h": "hours"}, comma_is_decimal=True).where("t = '1,5'").first()
    assert comma.h == Decimal("1.5")


def test_dates_numbers_and_rejects(spark):
    df = spark.createDataFrame([("20240131", 20240230, "4.2", Decimal("-4.9")), ("2024-01-31 10:20:30", 20240131, " 7", None)],
                               "d string, n int, i string, x decimal(9,2)")
    spec = {"d": "date", "n": "date", "i": "int", "x": "int"}
    a, b = clean_erp_columns(df, spec).collect()
    assert a.d == datetime.datetime(2024, 1, 31) and a.n is None and a.i is None and a.x == -4
    assert b.d == datetime.datetime(2024, 1, 31, 10, 20, 30) and b.n == datetime.datetime(2024, 1, 31) and b.i == 7
    assert {r.column: r.rejected for r in count_rejects(df, spec).collect()} == {"d": 0, "n": 1, "i": 1, "x": 0}


def test_csv_is_exact(spark, tmp_path):
    t = build_domain(spark, a_nes=[
        {"idnes": 1, "olcod": "T1", "nsdsc": 'a "b"; c', "macod": "M1", "nsnot": "", "tempo": "1.50",
         "dtexp": datetime.datetime(2024, 2, 1, 3, 4, 5)},
        {"idnes": 2, "nsdsc": "x", "tempo": "10"}],
        a_mac=[{"macod": "M1", "madsc": "saw"}], l_nelm=[{"idnes": 1, "nmrip": 2}, {"idnes": 1, "nmrip": 5}])
    rows = worklist.plan_worklist(t)
    lines = {r.IdNes: r.line for r in worklist_csv_lines(rows).collect()}
    assert lines == {1: '"T1";1;"a ""b""; c";"saw";01/02/2024 03:04:05;;1.5;7', 2: ';2;"x";;;;10;'}
    write_worklist_csv(rows, str(tmp_path / "out"))
    text = b"".join(open(f, "rb").read() for f in sorted(glob.glob(str(tmp_path / "out" / "part-*")))).decode()
    assert text == "\r\n".join(["Bolla;IDNES;NSDSC;MADSC;DTEXP;NSNOT;TEMPO;RIPET", lines[2], lines[1], ""])


def test_results_in_order(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2), (1, 9), (0, 5)], "request_id int, TrackingId int").withColumns(
        {"Compatible": F.lit(1), "WarehouseResidualQuantity": F.lit(0)})
    assert [r.TrackingId for r in order_result(rows, "sheets").collect()] == [5, 2, 9]
    assert [r.Id for r in order_result(spark.createDataFrame([(1,), (3,)], "Id int"), "headers").collect()] == [3, 1]
    assert [r.IdNes for r in order_result(spark.createDataFrame([(1,), (3,)], "IdNes int"), "worklist").collect()] == [3, 1]
    write_analysis({"sheets": rows.coalesce(1)}, str(tmp_path / "a"), ordered=True)
    assert [r.TrackingId for r in spark.read.parquet(str(tmp_path / "a" / "sheets")).collect()] == [5, 2, 9]


def test_hours_as_shown(spark):
    df = spark.createDataFrame([(Decimal("1.505"),), (Decimal("-0.005"),), (Decimal("2"),), (None,)], "h decimal(18,6)")
    assert [r.s for r in df.select(shown_hours(F.col("h")).alias("s")).collect()] == ["1.51", "-0.01", "2.00", None]


def test_tables_of_the_catalog(spark):
    spark.createDataFrame([("M1 ", "saw")], "macod string, madsc string").createOrReplaceTempView("a_mac")
    got = load_domain(spark, catalog_source(), ["a_mac", "x_ghost"])
    assert got["a_mac"].first().macod == "M1" and got["x_ghost"].isEmpty()
    spark.catalog.dropTempView("a_mac")


def test_bucketed_tables_join_without_moving_the_large_side(spark, shop, tmp_path):
    from platematch.operators import picklists, requirements
    from platematch.sources import catalog_source, write_bucketed

    spark.sql("CREATE DATABASE IF NOT EXISTS plates_by_key")
    write_bucketed(shop, str(tmp_path / "tables"), buckets=4, schema="plates_by_key", mode="overwrite")
    stored = load_domain(spark, catalog_source("plates_by_key"), cleaned=True)
    jobs = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "request_id bigint, idlav bigint")
    assert diff_tables(requirements.jobs_to_parts(jobs, stored), requirements.jobs_to_parts(jobs, shop)).isEmpty()
    assert diff_tables(picklists.plan_customers(stored), picklists.plan_customers(shop)).isEmpty()
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        plan = requirements.jobs_to_parts(jobs, stored)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.sql("DROP DATABASE plates_by_key CASCADE")
    lines = plan.splitlines()
    for table in ("a_lot", "l_cmpa"):
        at = next(k for k, line in enumerate(lines) if "FileScan" in line and f"plates_by_key.{table}[" in line)
        depth, above = lines[at].index("FileScan"), []
        for line in reversed(lines[:at]):  # what stands above the scan, up to its join
            start = next(k for k, c in enumerate(line) if c.isalnum() or c == "*")
            if start < depth:
                depth = start
                above.append(line)
                if "Join" in line:
                    break
        assert "Join" in above[-1] and not any("Exchange" in line for line in above), above
        assert "SelectedBucketsCount: 4 out of 4" in lines[at]
