"""Tables that change together: every version names its files, and readers follow the newest version.

A store is a folder::

    _versions/00000007.json      what version 7 consists of, written once and never changed
    data/write=w-.../bucket=3/   rows of one write, dealt by a hash of the table's key

A change writes its files first and becomes visible when the marker of the next
version is put in place.  The marker is written aside and renamed without
replacing, so of two writers that start from one version the second is refused
(:class:`Conflict`) and starts again from the version that won.  A writer that
dies before the rename leaves files that no version names, nothing else.

A table is dealt into buckets by its key.  Who names keys reads the buckets of
these alone, and a change writes those buckets anew or adds files to them; the
others are carried over by name.  A marker holds some folder names per bucket;
:meth:`Store.compact` joins many small writes to one.

The rename has to refuse an existing target in one step, as HDFS does; the local
disk of a test tells two writers apart unless they rename in the same instant.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRIES = 20


class Conflict(RuntimeError):
    """Another writer has published a version since this change was begun."""


@dataclass(frozen=True)
class TableFiles:
    key: str
    buckets: int
    schema: str  # JSON
    writes: dict[int, tuple[str, ...]] = field(default_factory=dict)  # bucket -> names of writes


@dataclass(frozen=True)
class Version:
    """``next_ids``: the first free id of a table; ``applied``: the last batch of each stream that is in here."""

    number: int
    tables: dict[str, TableFiles]
    next_ids: dict[str, int] = field(default_factory=dict)
    applied: dict[str, int] = field(default_factory=dict)

    def to_json(self) -> str:
        tables = {name: {"key": t.key, "buckets": t.buckets, "schema": t.schema,
                         "writes": {str(b): list(w) for b, w in t.writes.items()}} for name, t in self.tables.items()}
        return json.dumps({"number": self.number, "tables": tables, "next_ids": self.next_ids, "applied": self.applied})

    @staticmethod
    def from_json(text: str) -> Version:
        raw = json.loads(text)
        tables = {name: TableFiles(t["key"], t["buckets"], t["schema"], {int(b): tuple(w) for b, w in t["writes"].items()})
                  for name, t in raw["tables"].items()}
        return Version(raw["number"], tables, raw["next_ids"], raw["applied"])


class Store:
    """Versioned tables in one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    @staticmethod
    def create(spark: SparkSession, folder: str, tables: Mapping[str, tuple[DataFrame, str]], buckets: int = 64,
               ids: Mapping[str, str] | None = None) -> Store:
        """A store of ``tables``: name -> (rows, key column).

        ``ids`` names, for tables whose ids it hands out, the id column; the first free one follows the largest.
        """
        store = Store(spark, folder)
        files, next_ids = {}, {}
        for name, (rows, key) in tables.items():
            empty = TableFiles(key, buckets, rows.schema.json())
            files[name] = replace(empty, writes={b: (w,) for b, w in store._write(rows, empty).items()})
        for name, column in (ids or {}).items():
            next_ids[name] = (tables[name][0].agg(F.max(column)).first()[0] or 0) + 1
        if not store._put(Version(1, files, next_ids)):
            raise Conflict(f"{folder} holds a store already")
        return store

    # reading

    def latest(self) -> Version:
        numbers = [int(n.split(".")[0]) for n in self._names("_versions") if n.endswith(".json")]
        if not numbers:
            raise ValueError(f"{self.folder} holds no store")
        return self.version(max(numbers))

    def version(self, number: int) -> Version:
        text = self.spark.read.text(self._marker(number), wholetext=True).first()[0]
        return Version.from_json(text)

    def buckets_of(self, version: Version, table: str, keys: DataFrame, column: str) -> list[int]:
        """The buckets in which these keys lie: at most as many numbers as the table has buckets."""
        files = version.tables[table]
        key_type = T.StructType.fromJson(json.loads(files.schema))[files.key].dataType
        found = keys.select(_bucket(F.col(column).cast(key_type), files.buckets).alias("bucket")).distinct()
        return sorted(r["bucket"] for r in found.collect())

    def read(self, table: str, version: Version | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """Rows of a version, the newest by default; only of ``buckets`` where these are given."""
        version = version or self.latest()
        files = version.tables[table]
        schema = T.StructType.fromJson(json.loads(files.schema))
        wanted = sorted(files.writes) if buckets is None else [b for b in buckets if b in files.writes]
        paths = [f"{self.folder}/data/write={w}/bucket={b}" for b in wanted for w in files.writes[b]]
        if not paths:
            return self.spark.createDataFrame([], schema)
        stored = T.StructType([*schema.fields, T.StructField("write", T.StringType()), T.StructField("bucket", T.IntegerType())])
        rows = self.spark.read.schema(stored).option("basePath", f"{self.folder}/data").parquet(*paths)
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(wanted))
        return rows.select(*schema.fieldNames())

    # changing

    def change(self, base: Version | None = None) -> Change:
        return Change(self, base or self.latest())

    def retried(self, attempt: Callable[[Version], object]):
        """``attempt(version)`` with the newest version, again whenever another writer was first."""
        for _ in range(TRIES):
            try:
                return attempt(self.latest())
            except Conflict:
                continue
        raise Conflict(f"{TRIES} versions were published by others meanwhile")

    def reserve_ids(self, table: str, n: int) -> int:
        """The first of ``n`` ids that nobody else is given, whether or not they are used."""

        def attempt(version: Version) -> int:
            change = self.change(version)
            first = change.reserve(table, n)
            change.publish()
            return first

        return self.retried(attempt)

    def compact(self, table: str, most_writes: int = 8) -> Version:
        """Writes buckets that consist of more than ``most_writes`` writes anew, with the same rows."""

        def attempt(version: Version) -> Version:
            full = [b for b, w in version.tables[table].writes.items() if len(w) > most_writes]
            if not full:
                return version
            change = self.change(version)
            change.rewrite(table, self.read(table, version, full), full)
            return change.publish()

        return self.retried(attempt)

    def vacuum(self, keep: int = 2, older_than_hours: float = 24) -> int:
        """Removes all but the last ``keep`` versions and files that no version left names; number of writes removed.

        Files younger than ``older_than_hours`` stay, as they may belong to a change that is not published yet.
        """
        numbers = sorted(int(n.split(".")[0]) for n in self._names("_versions") if n.endswith(".json"))
        named = {w for n in numbers[-keep:] for t in self.version(n).tables.values() for x in t.writes.values() for w in x}
        fs, removed = self._fs(), 0
        for number in numbers[:-keep]:
            fs.delete(self._path(self._marker(number)), False)
        limit = (time.time() - 3600 * older_than_hours) * 1000
        for name in self._names("data"):
            path = self._path(f"{self.folder}/data/{name}")
            if name.removeprefix("write=") not in named and fs.getFileStatus(path).getModificationTime() < limit:
                fs.delete(path, True)
                removed += 1
        return removed

    # files

    def _write(self, rows: DataFrame, files: TableFiles) -> dict[int, str]:
        """Writes rows by bucket: bucket -> name of the write.  A bucket with many rows is written by several tasks.

        In a stream's batches, which Spark plans once and for all, nothing is rebalanced: the hint would leave rows of
        every bucket in every task, and a file of each.  There a bucket is written by one task.
        """
        name = f"w-{uuid.uuid4().hex}"
        path = f"{self.folder}/data/write={name}"
        schema = T.StructType.fromJson(json.loads(files.schema))
        dealt = rows.select(*[F.col(c.name).cast(c.dataType).alias(c.name) for c in schema.fields]).withColumn(
            "bucket", _bucket(F.col(files.key), files.buckets))
        adaptive = rows.sparkSession.conf.get("spark.sql.adaptive.enabled") == "true"
        dealt = dealt.hint("rebalance", "bucket") if adaptive else dealt.repartition("bucket")
        dealt.write.partitionBy("bucket").parquet(path)
        return {int(n.split("=")[1]): name for n in self._names(f"data/write={name}") if n.startswith("bucket=")}

    def _put(self, version: Version) -> bool:
        """Puts a marker in place unless there is one of that number."""
        jvm, target = self.spark._jvm, self._path(self._marker(version.number))
        aside = self._path(f"{self.folder}/_versions/.{uuid.uuid4().hex}")
        out = self._fs().create(aside, False)
        out.write(bytearray(version.to_json().encode()))
        out.close()
        how = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(how, 1)
        options[0] = how.NONE  # refuses a target that is there
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(aside, target, options)
        except Exception as e:
            self._fs().delete(aside, False)
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        return True

    def _marker(self, number: int) -> str:
        return f"{self.folder}/_versions/{number:08d}.json"

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path = self._path(f"{self.folder}/{folder}")
        fs = self._fs()
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []


class Change:
    """What the next version differs in.  Files are written at once, seen by others after :meth:`publish`."""

    def __init__(self, store: Store, base: Version):
        self.store, self.base = store, base
        self._tables, self._ids, self._applied = dict(base.tables), dict(base.next_ids), dict(base.applied)

    def append(self, table: str, rows: DataFrame) -> None:
        files = self._tables[table]
        writes = dict(files.writes)
        for bucket, name in self.store._write(rows, files).items():
            writes[bucket] = (*writes.get(bucket, ()), name)
        self._tables[table] = replace(files, writes=writes)

    def rewrite(self, table: str, rows: DataFrame, buckets: Iterable[int]) -> None:
        """``rows`` become the whole content of these buckets; rows of other buckets are an error."""
        files, mine = self._tables[table], set(buckets)
        written = self.store._write(rows, files)
        if set(written) - mine:
            raise ValueError(f"rows of {table} lie in buckets {sorted(set(written) - mine)} that are not rewritten")
        writes = {b: w for b, w in files.writes.items() if b not in mine}
        self._tables[table] = replace(files, writes={**writes, **{b: (w,) for b, w in written.items()}})

    def reserve(self, table: str, n: int) -> int:
        first = self._ids[table]
        self._ids[table] = first + n
        return first

    def mark_applied(self, stream: str, batch: int) -> None:
        self._applied[stream] = batch

    def publish(self) -> Version:
        version = Version(self.base.number + 1, self._tables, self._ids, self._applied)
        if not self.store._put(version):
            raise Conflict(f"version {version.number} is there already")
        return version


def _bucket(key, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
