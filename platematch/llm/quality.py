"""Quality rules, line first: clean the lines, then judge what is left.

DataFrame functions only; a document is judged within its own row, so there is
no shuffle and no hot key.  Words are runs of anything but ASCII blanks.

Defined cases: a null text is an empty one; an empty document has no words and
fails the base rules; ``n_chars`` of whitespace never counts as lost text.
Other columns of the input are ignored; repeated rows are judged each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = r"[\x20\x09-\x0D]"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
# Phrases that mark a line as boilerplate, in lower case.
BOILERPLATE = (
    "all rights reserved", "privacy policy", "terms of use", "terms of service", "use of cookies", "accept cookies",
    "is licensed under", "licensed under", "released under the", "permission is hereby granted", "copyright",
    "subscribe to our newsletter", "sign up for", "click here", "enable javascript", "lorem ipsum",
)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, BLANK + "+"), lambda w: w != "")


def without_blanks(text: Column) -> Column:
    return F.translate(text, BLANKS, "")


def repeated_window_words(words: str, n: int = 3) -> Column:
    """Words that lie in an ``n``-word window found twice or more in the array column ``words``.

    Windows are compared by a 64-bit hash.  Sorting (hash, place) brings equal
    windows together; the places found are put in order again and their spans
    added up, so the cost is n log n however long the text.
    """
    windows = F.slice(F.col(words), 1, F.greatest(F.size(words) - (n - 1), F.lit(0)))
    hashes = F.transform(windows, lambda w, i: F.xxhash64(*[F.get(words, i + k) for k in range(n)]))
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(_covered(placed, n))


def _covered(placed: Column, n: int) -> Column:
    # One-element arrays stand for "let": a sorted array is evaluated once and then looked into.
    repeated = F.flatten(F.transform(F.array(placed), lambda s: F.filter(
        s, lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]))))
    places = F.array(F.sort_array(F.transform(repeated, lambda x: x["i"])))
    spans = F.flatten(F.transform(places, lambda p: F.transform(
        p, lambda x, j: F.least(F.lit(n), F.coalesce(F.get(p, j + 1) - x, F.lit(n))))))
    return F.aggregate(spans, F.lit(0), lambda total, x: total + x)


def line_fails(line: Column, min_words: int = 4) -> Column:
    """True where a line with words breaks the punctuation, navigation or boilerplate rule.

    Punctuation: a line of at least ``min_words`` words that does not end with a
    sentence mark (quotes and brackets may follow), or with more exclamation and
    question marks than half its words.  Navigation: more menu signs and symbols
    than a third of the words, at least two.  Boilerplate: a listed phrase.
    """
    words = F.size(words_of(line))
    bare = F.length(line)
    marks = bare - F.length(F.translate(line, "!?", ""))
    signs = bare - F.length(F.translate(line, SYMBOLS + "»›•·", ""))
    unfinished = (words >= min_words) & ~line.rlike("[.!?:;…][\"'”»)\\]]*" + BLANK + "*$")
    boilerplate = F.lower(line).rlike("|".join(BOILERPLATE))
    return unfinished | (2 * marks > words) & (marks >= 2) | (3 * signs > words) & (signs >= 2) | boilerplate


def clean_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                max_lost_pct: int = 50) -> DataFrame:
    """(id, text, words, cleaned, chars, kept_chars, verdict) of every document.

    ``cleaned`` is the text without the lines that fail; lines without words stay.
    ``verdict`` is false where more than ``max_lost_pct`` percent of the
    characters in words are gone.
    """
    cleaned = F.array_join(F.filter(F.split("text", "\n"), lambda line: ~line.rlike(r"[^\x20\x09-\x0D]")
                                    | ~line_fails(line)), "\n")
    return (
        documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .select("doc_id", "text", words_of(F.col("text")).alias("words"), cleaned.alias("cleaned"),
                F.length(without_blanks(F.col("text"))).alias("chars"))
        .withColumn("kept_chars", F.length(without_blanks(F.col("cleaned"))))
        .withColumn("verdict", 100 * (F.col("chars") - F.col("kept_chars")) <= max_lost_pct * F.col("chars"))
    )


def quality_rules(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50,
                  max_repeat_pct: int = 50, max_lost_pct: int = 50) -> DataFrame:
    """Base figures, cleaned text and verdict of every document."""
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    judged = clean_lines(documents, id_col, text_col, max_lost_pct).select(
        "doc_id", "text", "cleaned", "verdict", "kept_chars", F.size("words").cast("long").alias("n_words"),
        F.col("chars").cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        repeated_window_words("words").cast("long").alias("n_repeat_words"),
        lines.alias("_lines"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("verdict")).alias("kept"), "cleaned")
