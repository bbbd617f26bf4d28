"""Barcode scans as a stream: each scan puts the newest assignable plan of its ticket on a pick list."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from platematch.functions.text import clean_parameter
from platematch.operators import published
from platematch.operators.changes import new_list_rows, resolve_scans
from platematch.sources.store import Store, Version

ROWS_SCHEMA = "idlista bigint, idnesting bigint"


def scan_stream_to_rows(stream: DataFrame, load_tables: Callable[[], dict[str, DataFrame]], rows_folder: str,
                        rejects_folder: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Appends list rows to ``rows_folder``; blank and unknown tickets go to ``rejects_folder``.

    Only rows that are not there yet are appended, and rejects go to a folder
    per batch, so a batch that runs again after a failure changes nothing.  That
    also takes care of repeated scans, however late: there is no watermark and
    no scan is dropped.  ``load_tables`` is called per batch and sees the plans
    of that moment.
    """

    def add_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        try:
            adds, rejected = resolve_scans(load_tables(), batch)
            wanted = adds.select("list_id", "idnes").distinct()
            # Only the lists that this batch names are compared with what is there.
            present = spark.read.schema(ROWS_SCHEMA).parquet(rows_folder).join(
                wanted.select(F.col("list_id").alias("idlista")).distinct(), "idlista", "left_semi")
            fresh = new_list_rows(present, wanted).select(
                F.col("idlista").cast("bigint"), F.col("idnesting").cast("bigint"))
            fresh.write.mode("append").parquet(rows_folder)
            rejected.write.mode("overwrite").parquet(f"{rejects_folder}/batch={batch_id}")
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(add_batch).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if available_now else writer.start()


def scan_stream_to_store(stream: DataFrame, load_tables: Callable[[], dict[str, DataFrame]], store: Store,
                         checkpoint: str, name: str = "scans", repeat_within: str = "10 seconds",
                         available_now: bool = False) -> StreamingQuery:
    """Adds list rows to the store; scans that name no plan go to its table of rejected scans.

    A scan of the same ticket for the same list within ``repeat_within`` of its first arrival is taken for the same
    scan: keyed state remembers it that long and no longer.  State and watermark go by arrival, not by the time a
    scanner stamped on it, so no scan is ever too late; a late one is resolved against the plans of the moment.

    Rows, rejects and the number of the batch appear in one version of the store.  A batch that runs again after it
    was published is passed over, one that failed before leaves nothing behind, and one that meets another writer is
    worked out again on the version that won.  A batch reads the buckets of the lists it names.
    """
    seen = stream.withColumns({"_asked": clean_parameter(F.col("ticket")), "_arrived": F.current_timestamp()})
    once = seen.withWatermark("_arrived", repeat_within).dropDuplicatesWithinWatermark(["list_id", "_asked"])

    def add_batch(batch: DataFrame, number: int) -> None:
        scans = batch.select(F.col("list_id").cast("bigint").alias("list_id"), F.col("ticket").cast("string").alias("ticket"))
        scans.persist()
        try:
            store.retried(lambda version: apply_scans(store, version, load_tables(), scans, name, number))
        finally:
            scans.unpersist()

    writer = once.writeStream.queryName(f"{name}-{uuid.uuid4().hex[:8]}").foreachBatch(add_batch).option(
        "checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if available_now else writer.start()


def apply_scans(store: Store, version: Version, tables: dict[str, DataFrame], scans: DataFrame, name: str,
                number: int) -> Version:
    """The version with batch ``number`` of the stream ``name``; ``version`` itself if it holds that batch."""
    if version.applied.get(name, -1) >= number:
        return version
    adds, rejected = resolve_scans(tables, scans)
    change = store.change(version)
    change.append(published.ROWS, published.fresh_rows(store, version, adds))
    change.append(published.REJECTED, rejected.withColumn("batch", F.lit(number).cast("bigint")))
    change.mark_applied(name, number)
    return change.publish()
