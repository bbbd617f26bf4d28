"""Material analysis on the hand-written shop."""

import pytest
from pyspark.sql import functions as F

from platematch.functions import diff_tables
from platematch.operators import matching, requirements, verify
from platematch.operators.analysis import analyze
from tests.shop import requests


def by_request(df, *columns):
    out = {}
    for r in df.collect():
        out.setdefault(r["request_id"], []).append(tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]])
    return {k: sorted(v, key=str) for k, v in out.items()}


def test_plans_and_jobs(spark, shop):
    resolved = requirements.with_subject(requirements.resolve_plan(
        requirements.normalize_requests(requests(spark)), shop)).collect()
    plan = {r.request_id: r.plan_id for r in resolved}
    assert (plan[14], plan[15], plan[16], plan[19], plan[12]) == (2, 2, None, 1, 11)
    subject = {r.request_id: r.subject for r in resolved}
    assert (subject[12], subject[13], subject[16], subject[28]) == ("J10", "J", "TLAUNCHED", "-")


def test_anomalies(states):
    found = by_request(requirements.anomalies(states), "Code")
    assert found[4] == found[5] == found[10] == ["NO_COMMON_QUALITY"]
    assert found[6] == ["MULTIPLE_THICKNESS"] and found[8] == ["NO_PARTS"]
    assert found[7] == ["NO_SHAPE", "NO_THICKNESS"] and found[9] == ["NO_JOBS"]
    assert found[13] == ["NO_JOBS", "NO_SHAPE"]  # the ticket still resolves to plan 2, which has no shape
    assert found[16] == ["NO_SHAPE"] and found[2] == ["NO_SHAPE"]
    assert 1 not in found and 11 not in found and found[26] == ["NO_THICKNESS"]
    detail = [r.Detail for r in requirements.anomalies(states).collect() if r.Code == "MULTIPLE_THICKNESS"]
    assert set(detail) == {"Spessori richiesti: 10.000, 10.000"}
    errors = {r.request_id: r.HasError for r in requirements.has_error(requirements.anomalies(states)).collect()}
    assert errors[2] is False and errors[7] is True


def test_minimum_material(states):
    rows = {r.request_id: r for r in requirements.minimum_material(states).collect()}
    assert (rows[1].NumLavorazioni, rows[1].NumParti, rows[1].Spessore, rows[1].QualitaAmmesse) == (1, 2, 10.0, "A")
    assert (rows[1].FormaX, rows[1].FormaY) == (1000.0, 500.0)
    assert rows[2].QualitaAmmesse == "A, B" and rows[3].QualitaAmmesse == "A, D"
    assert rows[12].NestingId == 11 and rows[12].NumParti == 2 and rows[12].NumLavorazioni == 1
    assert rows[9].NumLavorazioni == 0 and rows[9].SpessoriRichiesti is None and rows[9].HasError
    assert rows[6].NumSpessoriDistinti == 2 and rows[6].Spessore is None


def test_required_attributes(states):
    rows = by_request(requirements.required_attributes(states), "ColumnName", "RequiredCode", "Obbligatorio")
    assert rows[1] == [("Alpha1", "H", 1), ("Alpha1", "L", 1)]   # one row per code, not per column
    assert rows[3] == [("Alpha2", "Q2", 0)]
    assert rows[11] == [("Alpha1", "H", 1)]                      # disabled, by-value and blank ones are out
    assert rows[17] == [("Alpha7", "M", 1)]


def test_row_level_grades_agree(spark, shop, states):
    resolved = requirements.with_subject(requirements.resolve_plan(
        requirements.normalize_requests(requests(spark)), shop))
    jobs = requirements.jobs_of_subjects(requirements.distinct_subjects(resolved), shop)
    jobs = resolved.select("request_id", "subject").join(jobs, "subject").select("request_id", "idlav")
    parts = requirements.jobs_to_parts(jobs, shop)
    rows = requirements.part_qualities(parts, shop)
    with_mode = parts.join(shop["l_cmpa"].where("comparingmode IS NOT NULL").select(
        F.col("idrow").alias("order_part_id")), "order_part_id")
    total = with_mode.groupBy("request_id").agg(F.count_distinct("order_part_id").alias("total"))
    divided = rows.groupBy("request_id", "Code").agg(
        F.count_distinct("order_part_id").alias("n"), F.max("Description").alias("Description")).join(
        total, "request_id").where("n = total").select("request_id", "Code", "Description")
    assert diff_tables(divided, requirements.admitted_qualities(states)).isEmpty()


def test_listing(states, stock):
    rows = by_request(matching.matched_sheets(states, stock), "TrackingId", "PartCode", "Compatible")
    assert rows[1] == [(100, "P10", 1), (103, "P10", 1), (104, "P10", 1), (106, "P10", 1), (106, "P20", 1),
                       (107, "P10", 1), (107, "P10B", 1), (108, "P10", 1)]
    # Two admitted grades on one tracking: still once per distinct position.  No shape: no size test.
    assert rows[2] == [(100, "P10", 1), (101, "P10", 1), (103, "P10", 1), (104, "P10", 1), (105, "P10", 1),
                       (106, "P10", 1), (106, "P20", 1), (107, "P10", 1), (107, "P10B", 1), (108, "P10", 1)]
    assert (103, "P10", 2) in rows[3]                # optional attribute missed
    assert rows[11] == [(104, "P10", 1)]             # required height unknown: only offcuts
    assert rows[12] == rows[11]
    assert (106, "P10", 1) not in rows[18] and (100, "P10", 1) in rows[18]
    assert 108 not in [r[0] for r in rows[17]] and 100 in [r[0] for r in rows[17]]
    assert not {4, 5, 6, 7, 8, 9, 10, 13, 20, 21} & rows.keys()
    ghosts = {(r.request_id, r.TrackingId) for r in matching.matched_sheets(states, stock).collect() if r.IsGhost == 1}
    assert (1, 100) in ghosts and all(t == 100 for _, t in ghosts)


def test_listing_is_the_same_in_any_grid(states, stock):
    whole, cut = matching.matched_sheets(states, stock), matching.matched_sheets(states, stock, cell_rows=1)
    assert diff_tables(whole, cut).isEmpty()


def test_strict_positions(states, stock):
    rows = by_request(matching.matched_sheets(states, stock, strict_positions=True), "TrackingId", "PartCode")
    assert (106, "P20") not in rows[1] and (107, "P10B") not in rows[1] and (107, "P10") in rows[1]


def test_signature_form_equals_row_form(states, shop):
    candidates = matching.candidate_sheets(states, shop)
    assert candidates.count() == candidates.distinct().count()
    rows = matching.compatibility_rows(matching.attribute_check(candidates, states, shop))
    assert diff_tables(matching.compatibility(candidates, states, shop), rows).isEmpty()
    assert {r.Compatible for r in rows.select("Compatible").distinct().collect()} == {0, 1, 2}


def test_verification(states, shop):
    checks = ("TrackingId", "SpessoreOk", "QualitaOk", "AttributiOk", "DimensioniOk", "EsitoOk")
    rows = by_request(verify.verify_sheets(states, shop), *checks)
    assert rows[20] == [(100, 1, 1, 1, 1, 1)]
    assert rows[21] == [(101, 1, 1, 0, 1, 0)]
    assert rows[22] == [(102, 1, 1, 0, 1, 0)]                      # no known attribute
    assert rows[23] == [(105, 0, 1, 0, 0, 0)]                      # no common thickness, yet a verdict
    assert rows[24] == [(106, 0, 1, 1, 1, 0), (106, 1, 1, 1, 1, 1)]
    assert rows[26] == [(104, 0, 1, 0, 1, 0)]
    assert rows[27] == [(107, 1, 0, 1, 1, 0), (107, 1, 1, 1, 1, 1)]
    assert rows[29] == [(109, 1, 1, 0, 0, 0)]                      # no characteristics at all
    bad = by_request(verify.nonconforming_attributes(states, shop), "ColumnName", "SheetCode", "RequiredCode", "Status")
    assert bad == {21: [("Alpha1", "L", "H", 0)], 25: [("Alpha2", "Q1", "Q2", 2)]}


def test_analysis_in_bulk_equals_one_by_one(spark, shop):
    everything = requests(spark)
    bulk = analyze(everything, shop)
    assert [r.request_id for r in bulk.rejected.collect()] == [28]
    for one in (1,):
        single = analyze(everything.where(F.col("request_id") == one), shop)
        for name in ("minimum_material", "sheets"):
            theirs = bulk.results()[name].where(F.col("request_id") == one)
            assert diff_tables(single.results()[name], theirs).isEmpty(), (one, name)


@pytest.mark.parametrize("weight", [5, 15, 25])
def test_a_heavier_requirement_never_improves(spark, weight):
    row = spark.range(1).select(
        *[F.expr(f"array(named_struct('c','Alpha1','w',CAST({w} AS DECIMAL(18,6)),'t','P','k',{k}))").alias(n)
          for n, w, k in (("low", weight, 2), ("high", weight + 10, 2))],
        F.expr("array(named_struct('c','Alpha1','w',CAST(20 AS DECIMAL(18,6))))").alias("has"))
    got = row.select(matching.compatible(F.col("low"), F.col("has")).alias("low"),
                     matching.compatible(F.col("high"), F.col("has")).alias("high")).first()
    assert got.low <= got.high and got.low in (1, 2)


def test_a_verification_names_its_tracking(spark):
    asked = spark.createDataFrame([(1, 5, "X1", True), (2, 5, " ", True), (3, 5, None, False), (4, 5, None, None)],
                                  "request_id bigint, nesting_id bigint, tracking_code string, verify boolean")
    usable, rejected = requirements.split_requests(requirements.normalize_requests(asked))
    assert [r.request_id for r in rejected.collect()] == [2] and usable.count() == 3


def test_a_part_more_never_admits_more_grades(spark, shop):
    """Grades are those every part accepts, so adding a part can only take some away."""
    states = {r.request_id: {q.Code for q in r.admitted} for r in requirements.request_states(
        spark.createDataFrame([(k, [10] if k == 1 else [10, 20, 30][:k]) for k in (1, 2, 3)],
                              "request_id bigint, jobs array<bigint>"), shop).collect()}
    assert states[1] >= states[2] >= states[3]
