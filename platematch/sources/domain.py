"""Schema-adaptive reading of the domain tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platematch.schemas import ABSENT, OPTIONAL_TABLES, TABLES
from platematch.sources.erp import cleaned_column

Source = Callable[[SparkSession, str], "DataFrame | None"]

# How a column of another type than declared is read: dates also come as yyyyMMdd numbers or text, counts as text or decimals.
_CLEANED = {"timestamp_ntz": "date", "int": "int"}


def parquet_source(folder: str, suffix: str = "") -> Source:
    """Tables stored as ``<folder>/<table><suffix>``."""

    def read(spark: SparkSession, table: str) -> DataFrame | None:
        try:
            return spark.read.parquet(f"{folder}/{table}{suffix}")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    return read


def catalog_source(schema: str | None = None) -> Source:
    """Tables or temp views known to the session."""

    def read(spark: SparkSession, table: str) -> DataFrame | None:
        name = f"{schema}.{table}" if schema else table
        return spark.table(name) if spark.catalog.tableExists(name) else None

    return read


def jdbc_source(url: str, schema: str = "dbo", partitioning: Mapping[str, tuple[str, int, int, int]] | None = None,
                **options: str) -> Source:
    """Tables of a relational server.

    ``partitioning`` maps a table to (column, lower, upper, partitions), so large
    tables are read by many tasks; bounds only shape the split, no row is lost.
    """

    def read(spark: SparkSession, table: str) -> DataFrame | None:
        reader = spark.read.format("jdbc").option("url", url).option("dbtable", f"{schema}.{table}").options(**options)
        if partitioning and table in partitioning:
            column, lower, upper, parts = partitioning[table]
            reader = (reader.option("partitionColumn", column).option("lowerBound", lower)
                      .option("upperBound", upper).option("numPartitions", parts))
        return reader.load()

    return read


def load_domain(spark: SparkSession, source: str | Source | Mapping[str, DataFrame],
                tables: Iterable[str] | None = None, *, case_insensitive_codes: bool = False,
                cleaned: bool = False) -> dict[str, DataFrame]:
    """Cleaned domain tables by name.

    Known columns only, codes right-trimmed once, dates and counts cleaned where
    the source has them in another type, optional columns the source lacks as
    typed nulls that are marked as absent, optional tables it lacks as empty.  ``cleaned=True``
    reads tables written by :func:`write_domain`, which need no trimming, so
    filters on codes reach the file scan.
    """
    read = _as_source(source)
    result = {}
    for table in tables or TABLES:
        raw = read(spark, table)
        if raw is None:
            if table not in OPTIONAL_TABLES:
                raise ValueError(f"table {table} not found in the source")
            fields = [T.StructField(c, T.DataType.fromDDL(t)) for c, (_, t) in TABLES[table].items()]
            result[table] = spark.createDataFrame([], T.StructType(fields))
            continue
        result[table] = _conform(raw, table, trim=not cleaned, fold_case=case_insensitive_codes)
    return result


def write_domain(tables: Mapping[str, DataFrame], folder: str, mode: str = "errorifexists") -> None:
    """Cleaned tables as parquet, one folder each; read back with ``load_domain(..., cleaned=True)``."""
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{folder}/{name}")


# Keys by which the large tables are joined most; tables of one key list meet bucket by bucket.
LAYOUT: dict[str, tuple[str, ...]] = {
    "a_lot": ("conum", "locod"), "l_cmpa": ("conum", "locod"), "a_lav": ("conum", "locod", "idfas"),
    "l_pcpa": ("conum", "locod", "idfas"), "a_com": ("conum",), "a_nes": ("idnes",), "l_nelm": ("idnes",), "l_pcfo": ("idptc",),
    "xt_lista_di_prelievo_righe": ("idnesting",), "s_crn": ("idcrn",), "l_mlpr": ("idcrn",), "s_dmp": ("iddmp",),
}


def write_bucketed(tables: Mapping[str, DataFrame], folder: str, buckets: int = 200, schema: str | None = None,
                   mode: str = "errorifexists") -> None:
    """Cleaned tables as catalog tables over ``folder``, the large ones bucketed and sorted by ``LAYOUT``.

    Read them with ``load_domain(spark, catalog_source(schema), cleaned=True)``.  Joins of two such tables, or of one
    with a few rows, then shuffle no large side.  A key that holds a large share of a table fills one bucket, and a
    bucketed scan is not split at run time: for such data set ``spark.sql.sources.bucketing.enabled`` to false, and
    the joins are dealt and split as over any other files.  ``buckets`` should keep a bucket within a task's memory.
    """
    for name, df in tables.items():
        keys = LAYOUT.get(name)
        writer = df.write.mode(mode).format("parquet").option("path", f"{folder}/{name}")
        if keys:
            writer = writer.bucketBy(buckets, *keys).sortBy(*keys)
        writer.saveAsTable(f"{schema}.{name}" if schema else name)


def _as_source(source: str | Source | Mapping[str, DataFrame]) -> Source:
    if isinstance(source, str):
        return parquet_source(source)
    if isinstance(source, Mapping):
        return lambda _spark, table: source.get(table)
    return source


def _conform(raw: DataFrame, table: str, trim: bool, fold_case: bool) -> DataFrame:
    present = {c.lower(): c for c in raw.columns}
    types = {f.name.lower(): f.dataType for f in raw.schema.fields}
    columns = []
    for name, (kind, sql_type) in TABLES[table].items():
        if name not in present:
            columns.append(F.lit(None).cast(sql_type).alias(name, metadata=ABSENT))
            continue
        column = F.col(f"`{present[name]}`")
        if kind == "code" and isinstance(types[name], (T.StringType, T.CharType, T.VarcharType)):
            column = F.rtrim(column) if trim else column
            column = F.collate(column, "UTF8_LCASE") if fold_case else column
        elif clean := _CLEANED.get(sql_type):
            kept = (T.TimestampType, T.TimestampNTZType, T.DateType) if clean == "date" else T.IntegralType
            if not isinstance(types[name], kept):
                column = cleaned_column(raw, present[name], clean)
        columns.append(column.alias(name))
    return raw.select(*columns)
