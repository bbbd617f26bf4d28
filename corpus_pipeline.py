"""Training-data pipeline over ``documents``: what each stage keeps is written and read by the next.

Stages take (spark, docs, sf_dir) and return documents with the same columns;
the last returns placed pieces.  Their results are tested against brute force,
as the language model of the first stage and the packing are not SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platematch.llm import decontaminate, jaccard, langid, lines, packing
from platematch.llm.queries import table
from platematch.session import stage, workers_import

# Measured with four languages in 1024 dimensions: random letters of other scripts reach 0.12, random Latin ones
# seldom more; of cuts of 40 characters from documents 1 % are under 0.16.  Shorter texts cannot be told from noise.
MIN_LANGUAGE_SCORE, JUDGED_LETTERS = 0.13, 40


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the documents do not have."""
    while name in docs.columns:
        name += "_"
    return name


def _same_columns(kept: DataFrame, docs: DataFrame) -> DataFrame:
    return kept.select(*[F.col(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters that are near some language; learned from the documents themselves.

    A document is rejected without a letter, or where its best cosine is no more than noise though its
    different words have letters enough to tell; shorter ones stay.
    """
    workers_import(spark)
    lang, score = _free(docs, "_lang_told"), _free(docs, "_lang_score")
    told = langid.identify(docs, langid.prototypes(docs), lang_out=lang, score_out=score)
    letters = F.length(F.array_join(F.array_distinct(F.split(F.lower("text"), r"\P{L}+")), ""))
    near = (F.col(score) >= MIN_LANGUAGE_SCORE) | (letters < JUDGED_LETTERS)
    return _same_columns(told.where((F.col(lang) != "und") & near), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines seen before; documents that lose their whole text go."""
    workers_import(spark)
    gone = _free(docs, "_gone")
    done = lines.dedup_lines(docs, lines_out=_free(docs, "_lines"), removed_out=gone)
    left = done.where((F.col(gone) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return _same_columns(left.withColumn("n_chars", F.length("text").cast("long")), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies: the one that names it.  Rows of one id stay or go together."""
    workers_import(spark)
    named = jaccard.jaccard_components(docs)
    copies = named.where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    return _same_columns(docs.join(copies, "doc_id", "left_anti"), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item in them."""
    return _same_columns(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 4096 tokens."""
    import public_tokenizers

    workers_import(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
