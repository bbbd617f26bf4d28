"""Session settings and the shared folder that stage tables are written to."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join side even where that costs one more shuffle further up.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Hash instead of sort where every partition turned out small enough.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
}


# A stage table that took so many seconds to write has left shuffle files worth a collection of the driver's garbage.
RELEASE_SECONDS = 3.0


def local_session(cores: str = "8", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("platematch")
    settings = {
        **SETTINGS,
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.driver.memory": "16g",
        **extra,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def workers_import(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver has it.

    On a cluster the package is installed or sent with ``--py-files``.
    """
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[1]))


def stage_dir(spark: SparkSession) -> str | None:
    """The shared folder in ``spark.checkpoint.dir``; None where the session names none."""
    return spark.conf.get("spark.checkpoint.dir", None) or None


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder; on a single machine without one, in its temporary folder."""
    folder = stage_dir(spark)
    if folder is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = tempfile.gettempdir()
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    _note(("file", (spark, path)))
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back, or keep it in the cache where no shared folder is named.

    The written form cuts lineage with files that outlive any executor, and
    gives the readers column pruning and true sizes, so later joins are planned
    on facts.  The cached form keeps its lineage: a lost part is computed again.
    ``stages`` removes either.

    Shuffle files go when the driver collects what they belong to, which it has little cause to: so after a long write
    it is asked to, and disks hold the shuffles of one stage table at a time instead of those of a whole job.
    """
    spark, folder = df.sparkSession, stage_dir(df.sparkSession)
    if folder is None:
        kept = df.persist()
        _note(("cache", kept))
        return kept
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    began = time.monotonic()
    df.write.option("compression", "zstd").parquet(path)
    if time.monotonic() - began > RELEASE_SECONDS:
        spark._jvm.System.gc()
    _note(("file", (spark, path)))
    return spark.read.schema(df.schema).parquet(path)


_open: list[list] = []


def _note(entry) -> None:
    if _open:
        _open[-1].append(entry)


@contextmanager
def stages():
    """Everything staged inside is removed on the way out, also after an error.

    Results that read stage tables lazily must be written out before that.
    """
    _open.append([])
    try:
        yield
    finally:
        for kind, what in _open.pop():
            if kind == "cache":
                what.unpersist()
            else:
                remove_path(*what)


def distilled(name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Stages what ``build`` returns and removes what was staged on the way there."""
    with stages():
        result = build()
        outer = _open[:-1]
        inner, _open[:] = _open[-1], outer  # the result itself belongs to the caller
        try:
            kept = stage(result, name)
            if stage_dir(kept.sparkSession) is None:
                kept.count()  # fills the cache while what it reads is still there
        finally:
            _open.append(inner)
    return kept


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that its path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
