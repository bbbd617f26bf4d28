"""Queries that apply the operators to the driver's tables, whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from platematch.llm import (bestfit, chat, decontaminate, hardneg, jaccard, langid, lines, packing, quality, repeats,
                            spelling, toxicity, urls)
from platematch.session import stage, workers_import

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
# Host labels whose pages make up the URL list of the query.
LISTED_LABELS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def table(spark, sf_dir, name):
    workers_import(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark, sf_dir):
    """Every document without the 50-byte strings of documents before it."""
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("kept", "spans")


def op2_decontamination(spark, sf_dir):
    """Every place where a test item stands in a document, with at most 5 % of its characters edited."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumn(
        "contaminated", F.lit(True))


def op3_chat_formatting(spark, sf_dir):
    """All conversations and one that consists of control strings."""
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.prefix_target_examples(rows.unionByName(extra)))


def op4_url_filters(spark, sf_dir):
    """Pages against the rules and against the list of pages on listed hosts."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host, path = urls.host_of(F.col("url")), urls.path_of(F.col("url"))
    listed = pages.where(host.rlike(r"(^|\.)(" + "|".join(LISTED_LABELS) + r")\.")).select(
        urls.canonical(host, path).alias("key"))
    return urls.url_verdicts(pages, listed, RULES)


def op5_language_id(spark, sf_dir):
    """Learned from three quarters of the documents, applied to all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learn = docs.where(~F.coalesce(langid.held_out(F.col("doc_id")), F.lit(False)))
    told = langid.identify(docs.select("doc_id", "text"), langid.prototypes(learn))
    return told.select("doc_id", F.coalesce(langid.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
                       "lang_pred", "score")


def op6_ngram_jaccard_join(spark, sf_dir):
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op7_packing(spark, sf_dir):
    """All documents in windows of 4096 tokens."""
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_quality_rules(spark, sf_dir):
    return quality.quality_rules(table(spark, sf_dir, "documents")).drop("cleaned")


def op9_line_dedup(spark, sf_dir):
    """Every document without the lines that an earlier line is like."""
    return lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_toxicity(spark, sf_dir):
    """Expected severity of all documents, learned from a bounded sample of labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.severity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op11_best_fit_packing(spark, sf_dir):
    """All documents in as few windows of 4096 tokens as large-item matching finds."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bestfit.best_fit(docs, public_tokenizers.path("word_bpe_49k.json"))


def op12_spelling_variants(spark, sf_dir):
    """Words of all documents with their more frequent form; every 31st (document, word) loses a letter."""
    found = spelling.letter_runs(table(spark, sf_dir, "documents"), least=7, keep=("doc_id",))
    run, size = F.col("run"), F.length("run")
    named = found.withColumn("h", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), run)))
    cut = spelling.without_letter(run, F.pmod(F.col("h"), size).cast("int"))
    runs = named.select(F.when(F.col("h") % 31 == 0, cut).otherwise(run).alias("run"))
    return spelling.spelling_variants(stage(spelling.word_counts(runs), "spelling_words"))


def op13_hard_negatives(spark, sf_dir):
    """Hard negatives of every 100th vector; every 7th vector is taken under the next label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", label)
    vectors = hardneg.labelled_vectors(rows, "vec_id", "label", "embedding", scale=256)
    return hardneg.mine_hard_negatives(vectors, F.col("id") % 100 == 0)


QUERIES = {f.__name__: f for f in (
    op1_suffix_array_dedup, op2_decontamination, op3_chat_formatting, op4_url_filters, op5_language_id, op6_ngram_jaccard_join, op7_packing, op8_quality_rules, op9_line_dedup,
    op10_toxicity, op11_best_fit_packing, op12_spelling_variants, op13_hard_negatives)}
