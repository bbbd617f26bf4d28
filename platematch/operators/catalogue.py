"""Grade and attribute catalogues, and the attributes of parts and sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platematch.schemas import ALPHA_NAMES, ALPHAS

# Fixed values of the source data model.
MODE_SINGLE, MODE_GROUP, MODE_COMPATIBLE = "S", "R", "C"
CONTROL_BY_WEIGHT, CONTROL_BY_VALUE = "P", "V"
CHECK_MANDATORY, CHECK_OPTIONAL = 1, 2


def unpivot_attributes(df: DataFrame, id_columns: list[str]) -> DataFrame:
    """(ids, ColumnName, Code): one row per attribute that is neither null nor blank."""
    block = df.selectExpr(*id_columns, *[f"{a} AS {n}" for a, n in zip(ALPHAS, ALPHA_NAMES)])
    long = block.unpivot(id_columns, list(ALPHA_NAMES), "ColumnName", "Code")
    return long.where("rtrim(Code) <> ''")


def attribute_catalogue(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per known attribute value: column, code, labels, weight and how it is checked."""
    heads, values = tables["x_jde_attributianagrafica"], tables["x_jde_attributivalori"]
    return heads.join(values, heads["id"] == values["id_x_jde_attributianagrafica"]).select(
        F.col("codicefactory").alias("ColumnName"), F.col("codice").alias("Code"),
        F.col("codicejde").alias("JDECode"), F.col("descrizione").alias("Description"),
        F.col("peso").cast("decimal(18,6)").alias("Weight"),
        F.col("tipocontrollo").alias("FilterType"), F.col("controlloabilitato").cast("int").alias("FilterCheckType"),
    )


def enforced(catalogue: DataFrame) -> DataFrame:
    """Catalogue rows that can make a requirement: checks by value and disabled checks are out."""
    return catalogue.where(
        (F.col("FilterType") != CONTROL_BY_VALUE) & F.col("FilterCheckType").isin(CHECK_MANDATORY, CHECK_OPTIONAL)
    )


def grades_for(demands: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Grades that satisfy each distinct (qualitycode, comparingmode): adds (Code, Description).

    ``S`` the grade itself, ``R`` every grade of the same group, ``C`` the listed
    substitutes that exist as grades and the grade itself.
    """
    grades = tables["jdequality"]
    known = grades.select(F.col("code").alias("Code"), F.col("description").alias("Description"))
    wanted = demands.select("qualitycode", "comparingmode").distinct()

    itself = (
        wanted.where(F.col("comparingmode").isin(MODE_SINGLE, MODE_COMPATIBLE))
        .join(known, F.col("qualitycode") == F.col("Code"))
    )
    group_of = grades.select(F.col("code").alias("_member"), F.col("grouping").alias("_group")).distinct()
    in_group = known.join(group_of, F.col("Code") == F.col("_member")).drop("_member")
    grouped = (
        wanted.where(F.col("comparingmode") == MODE_GROUP)
        .join(group_of, F.col("qualitycode") == F.col("_member")).drop("_member")
        .join(in_group, "_group").drop("_group")
    )
    pairs = tables["jdecompatibility"].select(F.col("code").alias("_from"), F.col("compatible").alias("_to")).distinct()
    substitutes = (
        wanted.where(F.col("comparingmode") == MODE_COMPATIBLE)
        .join(pairs, F.col("qualitycode") == F.col("_from")).drop("_from")
        .join(known, F.col("_to") == F.col("Code")).drop("_to")
    )
    return itself.unionByName(grouped).unionByName(substitutes).distinct()


WORD = 64


def grade_masks(demands: DataFrame, tables: dict[str, DataFrame]) -> tuple[DataFrame, Column]:
    """((qualitycode, comparingmode, mask), known): which grades satisfy a demand, as bits in 64-bit words.

    ``known`` is the whole grade catalogue as one array of (Code, Description) in order of the codes; its places are
    the bits.  Demands that no grade satisfies have no row.
    """
    grades = tables["jdequality"].where(F.col("code").isNotNull()).groupBy(F.col("code").alias("Code")).agg(
        F.max("description").alias("Description"))
    listed = grades.agg(F.array_sort(F.collect_list(F.struct("Code", "Description"))).alias("known"))
    places = listed.select(F.posexplode("known").alias("at", "grade")).select("at", F.col("grade.Code").alias("Code"))
    known = listed.scalar()
    found = grades_for(demands, tables).join(places, "Code").select(
        "qualitycode", "comparingmode", F.floor(F.col("at") / WORD).alias("word"),
        F.expr(f"shiftleft(1L, at % {WORD})").alias("bit"))
    words = found.groupBy("qualitycode", "comparingmode", "word").agg(F.bit_or("bit").alias("bits"))
    by_word = words.groupBy("qualitycode", "comparingmode").agg(
        F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("_bits"))
    mask = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("_last")),
                       lambda w: F.coalesce(F.try_element_at("_bits", w), F.lit(0).cast("bigint")))
    masks = by_word.withColumn("_last", F.floor((F.size(known) - 1) / WORD)).select(
        "qualitycode", "comparingmode", mask.alias("mask"))
    return masks, known


def grades_of_mask(known: Column, words: Column) -> Column:
    """The entries of ``known`` whose bits are set, in their order; ``known`` has to be a column by now."""
    def is_set(at: Column) -> Column:
        return F.getbit(F.get(words, F.floor(at / WORD).cast("int")), at % WORD) == 1

    return F.filter(known, lambda grade, at: is_set(at))
