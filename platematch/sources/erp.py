"""Cleaning of dirty ERP columns, and coercion into whatever type a target column has.

``clean_erp_columns`` never fails a job on a bad cell: the cell becomes null and
the loss stays visible through ``count_rejects`` / ``rejected_rows``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOURS_TYPE = "decimal(18,6)"

# Number texts: an optional sign in front or behind, or parentheses; an optional exponent.
_NUMBER = r"^(?:[+-]?(?:{i}{f}?|{f1})(?:[eE][+-]?\d+)?[+-]?|\((?:{i}{f}?|{f1})\))$"
_POINT_NUMBER = _NUMBER.format(i=r"\d[\d,]*", f=r"(?:\.\d*)", f1=r"\.\d+")
_COMMA_NUMBER = _NUMBER.format(i=r"\d[\d.]*", f=r"(?:,\d*)", f1=r",\d+")
# Clock texts read part by part, any integers: H:MM and H:MM:SS.
_CLOCK = r"^\s*([+-]?\d+)\s*:\s*([+-]?\d+)\s*(?::\s*([+-]?\d+)\s*)?$"
# Time spans with days, d.hh:mm[:ss[.f]] or d:hh:mm:ss[.f]; hours, minutes, seconds in range.
_SPAN = (r"^(-?)(?:(\d{1,8})\.)?(0?\d|1\d|2[0-3]):([0-5]?\d)(?::([0-5]?\d(?:\.\d{1,7})?))?$",
         r"^(-?)(\d{1,8}):(0?\d|1\d|2[0-3]):([0-5]?\d):([0-5]?\d(?:\.\d{1,7})?)$")


def clean_erp_columns(df: DataFrame, spec: Mapping[str, str], *, comma_is_decimal: bool = False,
                      text_formats: Sequence[str] = ("yyyyMMdd",)) -> DataFrame:
    """``spec`` maps a column to ``date``, ``hours`` or ``int``; each is replaced by its clean value or null."""
    return df.withColumns({c: _cleaned(df, c, kind, comma_is_decimal, text_formats) for c, kind in spec.items()})


def count_rejects(df: DataFrame, spec: Mapping[str, str], **options) -> DataFrame:
    """One row (column, rejected) per cleaned column; a reject is a value that had to become null."""
    counts = df.agg(*[F.count_if(bad).alias(c) for c, bad in _rejects(df, spec, options).items()])
    return counts.unpivot([], list(spec), "column", "rejected")


def rejected_rows(df: DataFrame, spec: Mapping[str, str], **options) -> DataFrame:
    """Rows with at least one reject, and the names of the columns concerned."""
    bad = _rejects(df, spec, options)
    names = F.filter(F.array(*[F.when(b, F.lit(c)) for c, b in bad.items()]), lambda n: n.isNotNull())
    return df.withColumn("rejected_columns", names).where(F.size("rejected_columns") > 0)


def coerce_for_target(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast each column for the type its target has.

    Text going into an integer column becomes that integer or 0; a timestamp
    becomes ``yyyyMMdd`` as integer or ``yyyy-MM-dd HH:mm:ss`` as text; other
    columns pass unchanged.  What the target type cannot hold becomes null:
    :func:`uncoerced` shows those rows.
    """
    targets = {f.name.lower(): f.dataType for f in schema.fields}
    columns = []
    for field in df.schema.fields:
        column, target = F.col(f"`{field.name}`"), targets.get(field.name.lower())
        is_time = isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))
        if isinstance(target, T.IntegralType) and isinstance(field.dataType, T.StringType):
            digits = column.rlike(r"^\s*[+-]?\d+\s*$")
            whole = F.trim(column).try_cast(target)
            column = F.when(column.isNotNull(), F.when(digits, whole).otherwise(F.lit(0).cast(target)))
        elif isinstance(target, T.IntegralType) and is_time:
            column = F.date_format(column, "yyyyMMdd").try_cast(target)
        elif isinstance(target, T.StringType) and is_time:
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def uncoerced(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows that :func:`coerce_for_target` has to empty a cell of, and the names of those columns."""
    names = [f.name for f in df.schema.fields]
    both = df.withColumn("_row", F.struct(*[F.col(f"`{n}`") for n in names]))
    typed = coerce_for_target(both, schema)
    lost = F.filter(F.array(*[F.when(F.col(f"`{n}`").isNull() & F.col("_row")[n].isNotNull(), F.lit(n))
                              for n in names]), lambda n: n.isNotNull())
    return typed.withColumn("rejected_columns", lost).where(F.size("rejected_columns") > 0).select(
        "_row.*", "rejected_columns")


def parse_hours(text: Column, comma_is_decimal: bool = False) -> Column:
    """Hours from text: a number, else a localized number, else a clock text, else a span with days."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    point = _number(F.replace(t, F.lit(","), F.lit("")))
    comma = _number(F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
    comma_first = t.rlike(r"^[^.]*,\d+$") if comma_is_decimal else F.lit(False)
    # Each attempt is guarded by its own pattern, and the first that applies decides.
    return (
        F.when(comma_first & t.rlike(_COMMA_NUMBER), comma)
        .when(t.rlike(_POINT_NUMBER), point)
        .when(t.rlike(_COMMA_NUMBER), comma)
        .when(t.rlike(_CLOCK), _in_hours(
            F.lit(""), F.lit("0"), *[F.regexp_extract(t, _CLOCK, g) for g in (1, 2, 3)]))
        .when(t.rlike(_SPAN[0]), _in_hours(*[F.regexp_extract(t, _SPAN[0], g) for g in range(1, 6)]))
        .when(t.rlike(_SPAN[1]), _in_hours(*[F.regexp_extract(t, _SPAN[1], g) for g in range(1, 6)]))
    )


def _number(text: Column) -> Column:
    negative = text.rlike(r"^\(|^-|-$")
    size = F.regexp_replace(text, r"^[+(-]|[+)-]$", "").try_cast("double")
    exact = F.regexp_replace(text, r"^[+(-]|[+)-]$", "").try_cast("decimal(38,10)")
    value = F.coalesce(exact.try_cast(HOURS_TYPE), size.try_cast(HOURS_TYPE))
    return F.when(negative, -value).otherwise(value).cast(HOURS_TYPE)


def _in_hours(sign: Column, days: Column, hours: Column, minutes: Column, seconds: Column) -> Column:
    def part(c: Column) -> Column:
        return F.when(c == "", F.lit(0)).otherwise(c.try_cast("decimal(20,7)"))

    total = part(days) * 86400 + part(hours) * 3600 + part(minutes) * 60 + part(seconds)
    value = (total.cast("decimal(26,7)") / F.lit(3600)).try_cast(HOURS_TYPE)
    return F.when(sign == "-", -value).otherwise(value).cast(HOURS_TYPE)


def cleaned_column(df: DataFrame, name: str, kind: str) -> Column:
    """Clean value of one column with the default options."""
    return _cleaned(df, name, kind, False, ("yyyyMMdd",))


def _cleaned(df: DataFrame, name: str, kind: str, comma_is_decimal: bool, text_formats: Sequence[str]) -> Column:
    column, dtype = F.col(f"`{name}`"), df.schema[name].dataType
    if kind == "date":
        if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return column.cast("timestamp_ntz")
        text = F.trim(column.cast("string"))
        formats = text_formats if isinstance(dtype, T.StringType) else ("yyyyMMdd",)
        # Packed dates are spelled out and cast, which never consults the session time zone.
        dashed = F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
        tries = [F.when(text.rlike(r"^\d{8}$"), dashed.try_cast("timestamp_ntz")) if f == "yyyyMMdd"
                 else F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats]
        if isinstance(dtype, T.StringType):
            # Only full dates: a bare year or clock text is no date here.
            tries.append(F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), text.try_cast("timestamp_ntz")))
        return F.coalesce(*tries)
    if kind == "hours":
        if isinstance(dtype, T.StringType):
            return parse_hours(column, comma_is_decimal)
        return column.try_cast(HOURS_TYPE)
    if kind == "int":
        if isinstance(dtype, T.StringType):
            return F.when(column.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(column).try_cast("int"))
        if isinstance(dtype, (T.FloatType, T.DoubleType)):
            return F.bround(column, 0).try_cast("int")
        return column.try_cast("int")  # a decimal is cut towards zero
    raise ValueError(f"unknown kind {kind!r} for column {name}")


def _rejects(df: DataFrame, spec: Mapping[str, str], options: dict) -> dict[str, Column]:
    opts = {"comma_is_decimal": False, "text_formats": ("yyyyMMdd",), **options}
    return {
        c: F.col(f"`{c}`").isNotNull()
        & _cleaned(df, c, kind, opts["comma_is_decimal"], opts["text_formats"]).isNull()
        for c, kind in spec.items()
    }
