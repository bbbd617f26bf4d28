"""Benchmark: headline queries on prepared domain tables, one JSON line on stdout.

The domain tables are derived from the driver's tables and written once, the way
a warehouse would hold them; that time is reported as ``prepare``.  Each query
then reads those tables and is written out in full (``noop`` sink).  Every query
runs on a small data folder first, so times are those of a warm JVM.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from fixtures.queries import Domain  # noqa: E402
from platematch.operators import changes, incremental, matching, picklists, requirements, verify  # noqa: E402
from platematch.operators.analysis import AnalysisResult, analyze, results_of_states  # noqa: E402
from platematch.plans import worklist  # noqa: E402
from platematch.schemas import TABLES  # noqa: E402
from platematch.session import local_session, stage, stage_dir  # noqa: E402
from platematch.sources import load_domain  # noqa: E402

CHANGE_SETS = ("plan_changes", "operator_changes", "scans", "row_adds", "list_deletes", "lookup_keys", "searches")


class Prepared:
    """Domain tables of a data folder, written as parquet and read back."""

    def __init__(self, spark, sf_dir: str):
        source, folder = Domain(spark, sf_dir), f"{stage_dir(spark)}/bench-{uuid.uuid4().hex}"
        for name in TABLES:
            source.tables[name].write.parquet(f"{folder}/{name}")
        for name in CHANGE_SETS:
            source.raw[name].write.parquet(f"{folder}/{name}")
        source.requests.write.parquet(f"{folder}/requests")
        self.tables = load_domain(spark, folder, cleaned=True)
        self.raw = {n: spark.read.parquet(f"{folder}/{n}") for n in CHANGE_SETS}
        self.requests = spark.read.parquet(f"{folder}/requests")


def write_out(*frames) -> None:
    for df in frames:
        df.write.format("noop").mode("overwrite").save()


def run_analysis(p: Prepared) -> None:
    write_out(*analyze(p.requests, p.tables).results().values())


def run_requirements(p: Prepared) -> None:
    states = stage(requirements.request_states(p.requests, p.tables), "states")
    write_out(requirements.minimum_material(states), requirements.anomalies(states))


def run_matching(p: Prepared) -> None:
    states = stage(requirements.request_states(p.requests, p.tables), "states")
    write_out(matching.matched_sheets(states, stage(matching.warehouse(p.tables), "stock")))


def run_verification(p: Prepared) -> None:
    asked = p.requests.where(F.col("tracking_code").isNotNull())
    states = stage(requirements.request_states(asked, p.tables), "states")
    write_out(verify.verify_sheets(states, p.tables), verify.nonconforming_attributes(states, p.tables))


def run_after_change(p: Prepared) -> float:
    """Seconds of an analysis after a change of one stock position in 5,000 and one order part in 10,000."""
    old = dict(p.tables)
    old["l_mlpr"] = old["l_mlpr"].where(F.col("idmlpr") % 5000 != 0)
    old["l_cmpa"] = old["l_cmpa"].where(F.col("idrow") % 10007 != 0)
    usable, rejected = requirements.split_requests(requirements.normalize_requests(p.requests))
    states = stage(requirements.request_states(usable, old), "states")
    results = {n: stage(df, "previous") for n, df in results_of_states(states, old, rejected).results().items()}
    previous = incremental.Previous(p.requests, states, AnalysisResult(**results))
    started = time.time()
    write_out(*incremental.analyze_changed(previous, old, p.requests, p.tables).results.results().values())
    return round(time.time() - started, 3)


def run_searches(p: Prepared) -> float:
    """Seconds of a worklist for each of some thousand searches."""
    started = time.time()
    write_out(worklist.plan_worklists(p.tables, p.raw["searches"]))
    return round(time.time() - started, 3)


BENCH = {
    "analyze": run_analysis,
    "minimum_material": run_requirements,
    "matched_sheets": run_matching,
    "verify_sheets": run_verification,
    "plan_worklist": lambda p: write_out(worklist.plan_worklist(p.tables)),
    "lookup_plans": lambda p: write_out(worklist.lookup_plans(p.tables, p.raw["lookup_keys"])),
    "assigned_plans": lambda p: write_out(picklists.assigned_plans(p.tables)),
    "assignable_plans": lambda p: write_out(picklists.assignable_plans(
        p.tables, p.tables["xt_lista_di_prelievo"].select(F.col("id").alias("list_id")), top=3000)),
    "apply_plan_updates": lambda p: write_out(*changes.apply_plan_updates(p.tables["a_nes"], p.raw["plan_changes"])),
    "assign_operator": lambda p: write_out(changes.assign_operator(p.tables["a_nes"], p.raw["operator_changes"])),
    "add_by_ticket": lambda p: write_out(*changes.add_by_ticket(
        p.tables["xt_lista_di_prelievo_righe"], p.tables, p.raw["scans"])),
    "delete_lists": lambda p: write_out(*changes.delete_lists(
        p.tables["xt_lista_di_prelievo"], p.tables["xt_lista_di_prelievo_righe"], p.raw["list_deletes"])),
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    # One machine: its own disk is the shared folder.
    spark = local_session(cpus, **{"spark.ui.showConsoleProgress": "false",
                                   "spark.checkpoint.dir": tempfile.mkdtemp(prefix="run-")})
    warm_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(warm_dir):
        warm = Prepared(spark, warm_dir)
        for run in BENCH.values():
            run(warm)
    started = time.time()
    prepared = Prepared(spark, sf_dir)
    prepare = time.time() - started
    seconds = {}
    for name, run in BENCH.items():
        started = time.time()
        run(prepared)
        seconds[name] = round(time.time() - started, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    n_requests = prepared.requests.count()
    # A tenth of the data, and one request of each: cost by size, and latency.
    growth = {}
    small_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.01")
    for label, folder in (("small", small_dir), ("one_request", sf_dir)):
        if os.path.isdir(folder):
            part = prepared if label == "one_request" else Prepared(spark, folder)
            whole = part.requests
            if label == "one_request":
                part.requests = part.requests.limit(1)
            started = time.time()
            run_analysis(part)
            growth[label] = round(time.time() - started, 3)
            growth[f"{label}_requests"] = part.requests.count()
            part.requests = whole
    more = {"analyze_after_change": run_after_change(prepared), "plan_worklists": run_searches(prepared),
            "searches": prepared.raw["searches"].count()}
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "prepare": round(prepare, 3), "requests": n_requests,
        "requests_per_second": round(n_requests / seconds["analyze"], 1),
        "ms_per_request": round(1000 * seconds["analyze"] / n_requests, 4), "analyze_other_sizes": growth, "not_in_total": more,
    }))


if __name__ == "__main__":
    main()
