"""Change sets, pick lists and the scan stream."""

import datetime

from pyspark.sql import types as T

from platematch.functions import diff_tables, ranking
from platematch.operators import changes, picklists
from platematch.plans import worklist
from platematch.sources import coerce_for_target, load_domain, uncoerced
from platematch.streaming import scan_stream_to_rows
from tests.shop import build_domain


def lists(spark):
    return build_domain(
        spark,
        a_nes=[{"idnes": i, "olcod": "T1" if i < 3 else f"T{i}", "stnes": 4 if i != 5 else 3, "macod": "M1" if i != 4 else "DLG-ALL_PLASMA"}
               for i in range(1, 7)],
        xt_lista_di_prelievo=[{"id": 1, "operatore": " op1"}, {"id": 2, "operatore": "op2", "stato": " closed "}],
        xt_lista_di_prelievo_righe=[{"idlista": 1, "idnesting": 6}, {"idlista": 2, "idnesting": 1}])


def test_assignable_plans_skip_what_is_on_the_list(spark):
    t = lists(spark)
    asked = spark.createDataFrame([(1,), (2,), (2,)], "list_id bigint")
    got = {(r.list_id, r.idnes) for r in picklists.assignable_plans(t, asked, top=2).collect()}
    assert got == {(1, 3), (1, 2), (2, 6), (2, 3)}
    assert [r.Id for r in picklists.pick_list_headers(t).collect()] == [1]


def test_adding_twice_and_removing_restores(spark):
    rows = lists(spark)["xt_lista_di_prelievo_righe"]
    adds = spark.createDataFrame([(1, 2), (1, 2), (1, 6)], "list_id bigint, idnes bigint")
    once = changes.add_plans_to_lists(rows, adds)
    assert diff_tables(once, changes.add_plans_to_lists(once, adds)).isEmpty() and once.count() == 3
    assert diff_tables(rows, changes.remove_plans_from_lists(once, adds.where("idnes = 2"))).isEmpty()


def test_only_the_creator_deletes(spark):
    t = lists(spark)
    asks = spark.createDataFrame([(1, "OP1 "), (2, "op1"), (0, "op1"), (2, " ")], "list_id bigint, operator string")
    heads, rows, rejected = changes.delete_lists(t["xt_lista_di_prelievo"], t["xt_lista_di_prelievo_righe"], asks)
    assert [r.id for r in heads.collect()] == [2] and [r.idlista for r in rows.collect()] == [2] and rejected.count() == 3


def test_scan_stream(spark, tmp_path):
    t = lists(spark)
    rows_folder, feed = str(tmp_path / "rows"), str(tmp_path / "feed")
    t["xt_lista_di_prelievo_righe"].write.parquet(rows_folder)
    at = datetime.datetime(2024, 1, 1)
    scans = spark.createDataFrame([(1, "T1 ", at), (1, "T1", at), (1, "T4", at), (1, "T6", at)],
                                  "list_id bigint, ticket string, ts timestamp")
    scans.write.parquet(feed)
    stream = spark.readStream.schema(scans.schema).parquet(feed)
    query = scan_stream_to_rows(stream, lambda: t, rows_folder, str(tmp_path / "bad"), str(tmp_path / "cp"), available_now=True)
    assert query.awaitTermination(90)
    got = {(r.idlista, r.idnesting) for r in spark.read.parquet(rows_folder).collect()}
    assert got == {(1, 6), (2, 1), (1, 2)}
    assert [r.ticket for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == ["T4"]


def test_scans_may_come_late_or_blank(spark, tmp_path):
    t = lists(spark)
    rows_folder, feed = str(tmp_path / "rows"), str(tmp_path / "feed")
    t["xt_lista_di_prelievo_righe"].write.parquet(rows_folder)
    schema = "list_id bigint, ticket string, ts timestamp"
    for hour, ticket in ((12, "T3"), (13, " "), (9, "T1"), (9, None)):
        spark.createDataFrame([(2, ticket, datetime.datetime(2024, 1, 1, hour))], schema).coalesce(1).write.mode(
            "append").parquet(feed)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(feed)
    query = scan_stream_to_rows(stream, lambda: t, rows_folder, str(tmp_path / "bad"), str(tmp_path / "cp"), available_now=True)
    assert query.awaitTermination(90)
    got = {(r.idlista, r.idnesting) for r in spark.read.parquet(rows_folder).collect()}
    assert got == {(1, 6), (2, 1), (2, 3), (2, 2)}
    assert [r.ticket for r in spark.read.parquet(str(tmp_path / "bad")).orderBy("ticket").collect()] == [None, " "]


def test_changes_without_a_place_in_the_order_are_rejected(spark):
    t = lists(spark)
    asked = spark.createDataFrame([(None, 1, "2024-01-01", "lost"), (4, 2, "2024-01-02", "a"), (4, 2, "2024-01-03", "b")],
                                  "seq bigint, idnes bigint, dtexp string, nsnot string")
    plans, rejected = changes.apply_plan_updates(t["a_nes"], asked)
    assert [r.nsnot for r in rejected.collect()] == ["lost"]
    got = {r.idnes: r.nsnot for r in plans.collect()}
    assert got[1] is None and got[2] == "b"
    new = spark.createDataFrame([(None, "op1", None, None), (5, "op2", None, None), (1 << 60, "op3", None, None), (2, " ", None, None)],
                                "seq bigint, operator string, state string, created_at timestamp")
    made = changes.create_lists(t["xt_lista_di_prelievo"], new)
    assert [(r.id, r.operatore) for r in made.where("id > 2").orderBy("id").collect()] == [(3, "op2"), (4, "op3")]
    assert sorted(r.operator for r in changes.rejected_lists(new).collect()) == [" ", "op1"]


def test_operators_need_their_column(spark):
    t = load_domain(spark, {"a_nes": spark.createDataFrame([(1, "T1", 20240131)], "idnes int, olcod string, dtexp int")}, ["a_nes"])
    full = {**lists(spark), **t}
    assert worklist.plan_worklist(full, only_mine=True, operator="op1").count() == 1
    assert full["a_nes"].first().dtexp == datetime.datetime(2024, 1, 31)
    asked = spark.createDataFrame([(1, "T1", None, "op9")], "seq int, ticket string, machine string, operator string")
    assert changes.assign_operator(t["a_nes"], asked).first().x_op_ass is None
    assert changes.assign_operator(lists(spark)["a_nes"], asked).where("x_op_ass = 'op9'").count() == 2


def test_headers_are_written_in_their_types(spark):
    heads = spark.createDataFrame([(1, 20240101, "op", "x")], "id bigint, datacreazione int, operatore string, stato string")
    new = spark.createDataFrame([(1, "op1", None, datetime.datetime(2024, 5, 6))],
                                "seq int, operator string, state string, created_at timestamp_ntz")
    assert changes.create_lists(heads, new).where("id = 2").first().datacreazione == 20240506
    narrow = T.StructType.fromDDL("a smallint, d tinyint")
    rows = spark.createDataFrame([("40000", datetime.date(2024, 1, 1)), ("12", None), ("x", None)], "a string, d date")
    assert [r.a for r in coerce_for_target(rows, narrow).collect()] == [None, 12, 0]
    assert [r.rejected_columns for r in uncoerced(rows, narrow).collect()] == [["a", "d"]]


def test_rank_of_ids_that_lie_far_apart(spark):
    ids = [(k * k * k << 20) - (1 << 50) for k in range(300)]
    rows = spark.createDataFrame([(i,) for i in ids], "id bigint")
    limit, ranking.RANGE_ROWS = ranking.RANGE_ROWS, 40
    try:
        got = {r.id: r["rank"] for r in ranking.newest_first_rank(rows, "id").collect()}
    finally:
        ranking.RANGE_ROWS = limit
    assert got == {i: n for n, i in enumerate(sorted(ids, reverse=True), 1)}
