"""Versions of several tables, changes to pick lists in a store, and the scan stream into it."""

import datetime

import pytest
from pyspark.sql import functions as F

from platematch.operators import changes, published
from platematch.sources.store import Conflict, Store
from platematch.streaming import scan_stream_to_store
from platematch.streaming.scans import apply_scans
from tests.shop import build_domain

HEADS, ROWS, REJECTED = published.HEADERS, published.ROWS, published.REJECTED
SCANS = "list_id bigint, ticket string, ts timestamp"


@pytest.fixture(scope="module")
def domain(spark):
    return build_domain(
        spark,
        a_nes=[{"idnes": i, "olcod": "T1" if i < 3 else f"T{i}", "stnes": 4 if i != 5 else 3, "macod": "M1" if i != 4 else "DLG-ALL_PLASMA"}
               for i in range(1, 7)],
        xt_lista_di_prelievo=[{"id": i, "operatore": f"op{i}"} for i in range(1, 9)],
        xt_lista_di_prelievo_righe=[{"idlista": i, "idnesting": k} for i in range(1, 9) for k in (1, 6)])


@pytest.fixture
def store(spark, domain, tmp_path):
    return published.create_list_store(spark, str(tmp_path / "store"), domain, buckets=8)


def pairs(store, version=None):
    return {(r.idlista, r.idnesting) for r in store.read(ROWS, version).collect()}


def ids(store, version=None):
    return sorted(r.id for r in store.read(HEADS, version).collect())


def new_entries(spark, *seqs):
    return spark.createDataFrame([(s, f"op{s}", None, None) for s in seqs],
                                 "seq bigint, operator string, state string, created_at timestamp")


def test_a_store_reads_back_and_is_made_once(spark, domain, store):
    assert ids(store) == list(range(1, 9)) and len(pairs(store)) == 16 and store.latest().number == 1
    assert store.read(HEADS).schema.fieldNames() == domain[HEADS].columns
    with pytest.raises(Conflict):
        published.create_list_store(spark, store.folder, domain, buckets=8)


def test_named_buckets_reach_the_scan(spark, store):
    version = store.latest()
    named = store.buckets_of(version, ROWS, spark.createDataFrame([(3,), (3,), (None,)], "x int"), "x")
    assert len(named) <= 2
    rows = store.read(ROWS, version, named)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert {(3, 1), (3, 6)} <= {(r.idlista, r.idnesting) for r in rows.collect()} < pairs(store)


def test_headers_and_rows_go_in_one_version(spark, store):
    asks = spark.createDataFrame([(1, "OP1 "), (2, "op1"), (0, "op1"), (3, "op3")], "list_id bigint, operator string")
    version, rejected = published.delete_lists(store, asks)
    assert version.number == 2 and ids(store) == [2, 4, 5, 6, 7, 8] and rejected.count() == 2
    assert {i for i, _ in pairs(store)} == {2, 4, 5, 6, 7, 8}
    old = store.version(1)
    assert ids(store, old) == list(range(1, 9)) and len(pairs(store, old)) == 16
    untouched = set(range(8)) - set(store.buckets_of(old, HEADS, asks, "list_id"))
    assert all(version.tables[ROWS].writes.get(b) == old.tables[ROWS].writes.get(b) for b in untouched)


@pytest.mark.parametrize("write", (1, 2))
def test_a_failure_between_the_writes_leaves_the_old_pair(spark, store, monkeypatch, write):
    done, real = [], Store._write

    def failing(self, rows, files):
        done.append(1)
        if len(done) == write:
            raise OSError("lost")
        return real(self, rows, files)

    monkeypatch.setattr(Store, "_write", failing)
    asks = spark.createDataFrame([(1, "op1")], "list_id bigint, operator string")
    with pytest.raises(OSError):
        published.delete_lists(store, asks)
    assert store.latest().number == 1 and ids(store) == list(range(1, 9)) and len(pairs(store)) == 16
    monkeypatch.undo()
    published.delete_lists(store, asks)
    assert ids(store) == list(range(2, 9)) and len(pairs(store)) == 14


def test_the_second_of_two_writers_is_refused(spark, store):
    base = store.latest()
    first, second = store.change(base), store.change(base)
    first.append(ROWS, spark.createDataFrame([(1, 2)], "idlista bigint, idnesting bigint"))
    second.append(ROWS, spark.createDataFrame([(1, 3)], "idlista bigint, idnesting bigint"))
    first.publish()
    with pytest.raises(Conflict):
        second.publish()
    assert (1, 2) in pairs(store) and (1, 3) not in pairs(store) and store.latest().number == 2


def test_a_refused_delete_starts_again_from_the_version_that_won(spark, store, monkeypatch):
    real, others = Store._put, [True]

    def put(self, version):
        if others and version.number == 2:
            others.pop()
            other = self.change(self.version(1))
            other.append(ROWS, spark.createDataFrame([(2, 3), (1, 3)], "idlista bigint, idnesting bigint"))
            other.publish()
        return real(self, version)

    monkeypatch.setattr(Store, "_put", put)
    version, _ = published.delete_lists(store, spark.createDataFrame([(1, "op1")], "list_id bigint, operator string"))
    assert version.number == 3 and (2, 3) in pairs(store) and not any(i == 1 for i, _ in pairs(store))


def test_two_batches_never_share_an_id(spark, store, monkeypatch):
    """The second batch reserves and publishes while the first one is between its two versions."""
    real, between = changes.numbered_lists, []

    def numbered(new, first_id, target):
        if not between:
            between.append(True)
            published.create_lists(store, new_entries(spark, 7, 5))
        return real(new, first_id, target)

    monkeypatch.setattr(changes, "numbered_lists", numbered)
    published.create_lists(store, new_entries(spark, 30, 10, 20))
    got = {r.operatore: r.id for r in store.read(HEADS).where("id > 8").collect()}
    assert got == {"op10": 9, "op20": 10, "op30": 11, "op5": 12, "op7": 13}


def test_ids_of_a_lost_batch_stay_unused(spark, store):
    assert store.reserve_ids(HEADS, 3) == 9
    _, rejected = published.create_lists(store, new_entries(spark, 1).unionByName(
        spark.createDataFrame([(2, " ", None, None), (None, "op", None, None)], "seq bigint, operator string, state string, created_at timestamp")))
    assert ids(store)[-2:] == [8, 12] and rejected.count() == 2
    assert published.create_lists(store, new_entries(spark))[0].number == store.latest().number


def test_adding_removing_and_compacting(spark, store):
    for k in range(2, 6):
        published.add_plans_to_lists(store, spark.createDataFrame([(1, k), (1, k), (2, 6), (None, 3), (99, k)], "list_id bigint, idnes bigint"))
    now = pairs(store)
    assert now >= {(1, 2), (1, 5), (99, 5)} and len(now) == 24
    most = max(len(w) for w in store.latest().tables[ROWS].writes.values())
    assert most > 2
    before = store.latest()
    version = store.compact(ROWS, 2)
    assert max(len(w) for w in version.tables[ROWS].writes.values()) <= 2 and pairs(store) == now == pairs(store, before)
    assert store.compact(ROWS, 2).number == version.number
    published.remove_plans_from_lists(store, spark.createDataFrame([(1, 2), (1, 77)], "list_id bigint, idnes bigint"))
    assert pairs(store) == now - {(1, 2)}
    assert store.vacuum(keep=1, older_than_hours=0) > 0 and pairs(store) == now - {(1, 2)}


def test_rows_of_other_buckets_are_refused(spark, store):
    version = store.latest()
    named = store.buckets_of(version, ROWS, spark.createDataFrame([(1,)], "x bigint"), "x")
    with pytest.raises(ValueError):
        store.change(version).rewrite(ROWS, store.read(ROWS, version), named)


def feed_of(spark, folder, scans):
    for list_id, ticket, hour in scans:
        spark.createDataFrame([(list_id, ticket, datetime.datetime(2024, 1, 1, hour))], SCANS).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(SCANS).option("maxFilesPerTrigger", 1).parquet(folder)


def rejects(store):
    return sorted((r.list_id, r.ticket or "") for r in store.read(REJECTED).collect())


def test_late_and_repeated_scans(spark, domain, store, tmp_path):
    stream = feed_of(spark, str(tmp_path / "feed"), [(2, "T3", 12), (2, " T3 ", 13), (2, "T4", 23), (2, "T1", 1), (2, "T4", 23), (2, None, 0), (3, "T3", 2)])
    query = scan_stream_to_store(stream, lambda: domain, store, str(tmp_path / "cp"), repeat_within="1 hour", available_now=True)
    assert query.awaitTermination(240)
    before = pairs(store, store.version(1))
    assert pairs(store) - before == {(2, 3), (2, 2), (3, 3)}
    assert rejects(store) == [(2, ""), (2, "T4")]  # T1 came late, T4 twice


def test_a_batch_that_failed_runs_again(spark, domain, store, tmp_path, monkeypatch):
    stream = feed_of(spark, str(tmp_path / "feed"), [(2, "T3", 1), (3, "T4", 2), (4, "T1", 3)])
    real, done = Store._write, []

    def failing(self, rows, files):
        done.append(1)
        if len(done) == 4:  # in the second batch, between rows and rejects
            raise OSError("lost")
        return real(self, rows, files)

    monkeypatch.setattr(Store, "_write", failing)
    start = lambda: scan_stream_to_store(stream, lambda: domain, store, str(tmp_path / "cp"), available_now=True)
    with pytest.raises(Exception, match="lost"):
        start().awaitTermination(240)
    assert rejects(store) == [] and store.latest().applied == {"scans": 0}
    monkeypatch.undo()
    assert start().awaitTermination(240)
    assert pairs(store) - pairs(store, store.version(1)) == {(2, 3), (4, 2)} and rejects(store) == [(3, "T4")]


def test_a_published_batch_is_passed_over(spark, domain, store):
    scans = spark.createDataFrame([(2, "T3"), (2, "nothing")], "list_id bigint, ticket string")
    version = apply_scans(store, store.latest(), domain, scans, "scans", 0)
    assert apply_scans(store, version, domain, scans, "scans", 0) is version
    again = apply_scans(store, version, domain, scans.where(F.lit(False)), "scans", 1)
    assert again.applied == {"scans": 1} and pairs(store, again) == pairs(store, version) and rejects(store) == [(2, "nothing")]


def test_a_batch_writes_a_file_per_bucket(spark, domain, store, tmp_path):
    """every task of a batch wrote a file for every bucket."""
    feed = str(tmp_path / "feed")
    scans = spark.range(400).selectExpr("id % 8 + 1 AS list_id", "'T' || (id % 50) AS ticket", "timestamp_seconds(id) AS ts")
    scans.write.parquet(feed)
    stream = spark.readStream.schema(SCANS).parquet(feed)
    before = {w for t in store.latest().tables.values() for x in t.writes.values() for w in x}
    scan_stream_to_store(stream, lambda: domain, store, str(tmp_path / "cp"), available_now=True).awaitTermination()
    version = store.latest()
    assert store.read(REJECTED, version).count() == scans.join(
        domain["a_nes"].where("stnes = 4 AND macod = 'M1'"), F.col("ticket") == F.col("olcod"), "left_anti").select("list_id", "ticket").distinct().count()
    files = [p for w in {w for t in version.tables.values() for x in t.writes.values() for w in x} - before
             for p in (tmp_path / "store" / "data" / f"write={w}").glob("bucket=*/*.parquet")]
    assert 0 < len(files) == len({p.parent for p in files})
