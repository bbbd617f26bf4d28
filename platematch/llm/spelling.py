"""Spelling variants: words one edit apart, found by walking a distributed trie level by level.

The trie of all words is a table of edges (parent, label, child) in which chains
without a branch are one edge; a word ends in a mark of its own, so each word is
a leaf.  A state is (word, position, node, edits).  Without an edit a word stands
on its own path, so its states there need no join.  An edit takes it onto another
edge of a node on that path: the label's first letter replaces one of the word or
comes in addition, and the rest of the label must be what follows in the word.
Then the states are joined with the edges again and again, one level a round; a
state that reaches a leaf with its last letter is a neighbour.

Two words one edit apart share a prefix or a suffix of half their length.  There
are therefore two tries, of the words and of the words reversed, and edits are
made from the middle of a word on only, where few edges leave a node.  A pair is
found from the shorter word, or from the one with the lesser letter; both
directions are returned.  Nodes are named by 64-bit hashes of their prefix: a
clash can only add paths, and each pair found is checked by its edit distance.

Defined cases: null texts have no words; a null id counts as an empty one where
ids are used; documents that repeat count each time; an empty table gives no
words.  Words of any length are compared whole, by code points.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platematch.session import distilled, stage

LETTERS = "[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
END = "\u0000"
NODE_WORDS = 10_000  # of a node that more words pass, edges are copied and states dealt to the copies


def letter_runs(documents: DataFrame, least: int = 1, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(run, *keep): maximal runs of at least ``least`` letters, A-Z in lower case."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))
    run = F.col("_run")
    plain = F.when(F.lower(run) == run, run).otherwise(F.translate(run, UPPER, LOWER))
    return documents.select(*keep, F.explode(found).alias("_run")).select(*keep, plain.alias("run"))


def without_letter(run: Column, at: Column) -> Column:
    """``run`` without its code point ``at``, counted from 0."""
    return F.concat(run.substr(F.lit(1), at), run.substr(at + 2, F.length(run)))


def word_counts(runs: DataFrame, word_col: str = "run", least: int = 7, occurrences: int = 2) -> DataFrame:
    """(word, n): words of enough code points and occurrences."""
    return (runs.where(F.length(word_col) >= least).groupBy(F.col(word_col).alias("word"))
            .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= occurrences))


def _letter(t: Column, at: Column) -> Column:
    return t.substr(at + 1, F.lit(1))


def _paths(words: DataFrame) -> DataFrame:
    """(side, t, word, n, stops): each word in both directions with the branching nodes of its second half.

    A stop is (depth, node, copies).  Words on whose second half nothing branches have no neighbour and go.
    """
    sides = words.select("word", "n", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.concat("word", F.lit(END)).alias("t")),
        F.struct(F.lit(1).alias("side"), F.concat(F.reverse("word"), F.lit(END)).alias("t")))).alias("_s")).select(
        "word", "n", "_s.*")
    size = F.length("t") - 1
    depths = F.sequence(F.greatest(F.lit(0), F.floor((size - 1) / 2).cast("int")), size)
    prefixes = sides.select("side", "t", "n", F.explode(depths).alias("depth"))
    at = F.xxhash64("side", F.col("t").substr(F.lit(1), F.col("depth")))
    prefixes = prefixes.withColumn("node", at)
    letter = _letter(F.col("t"), F.col("depth"))
    branching = (
        prefixes.groupBy("node").agg(F.min(letter).alias("_lo"), F.max(letter).alias("_hi"), F.count(F.lit(1)).alias("_n"))
        .where(F.col("_lo") != F.col("_hi"))
        .select("node", F.ceil(F.col("_n") / NODE_WORDS).cast("int").alias("copies")))
    return prefixes.join(branching, "node").groupBy("side", "t", "n").agg(
        F.sort_array(F.collect_list(F.struct("depth", "node", "copies"))).alias("stops"))


def _word(side: Column, t: Column) -> Column:
    bare = t.substr(F.lit(1), F.length(t) - 1)
    return F.when(side == 0, bare).otherwise(F.reverse(bare))


def _edges(paths: DataFrame) -> DataFrame:
    """(parent, salt, first, label, size, child, child_copies, near, near_n): one row per edge and copy."""
    t, here, size = F.col("t"), F.col("_stop"), F.length("t")
    steps = paths.select("side", "t", "n", "stops", F.posexplode("stops").alias("_k", "_stop")).withColumn(
        "_next", F.get("stops", F.col("_k") + 1))
    to = F.coalesce(F.col("_next.depth"), size)
    leaf = F.col("_next").isNull()
    return steps.select(
        here["node"].alias("parent"), here["copies"].alias("_copies"),
        t.substr(here["depth"] + 1, F.lit(1)).alias("first"),
        t.substr(here["depth"] + 1, to - here["depth"]).alias("label"),
        F.coalesce(F.col("_next.node"), F.xxhash64("side", "t")).alias("child"),
        F.coalesce(F.col("_next.copies"), F.lit(1)).alias("child_copies"),
        F.when(leaf, _word(F.col("side"), t)).alias("near"), F.when(leaf, F.col("n")).alias("near_n"),
    ).distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))).withColumn(
        "size", F.length("label")).drop("_copies")


def _salt(copies: Column) -> Column:
    return F.pmod(F.xxhash64("t"), copies.cast("bigint")).cast("int")


def _edges_ahead(edges: DataFrame) -> DataFrame:
    """Edges an edit may take, once for each letter ``ahead`` that may follow their first one.

    That is the label's second letter, or after a label of one letter the first ones of the child's edges.
    """
    taken = edges.where(F.col("first") != END)
    long = taken.where(F.col("size") > 1).withColumn("ahead", F.expr("substr(label, 2, 1)"))
    after = edges.where(F.col("salt") == 0).select(F.col("parent").alias("_node"), F.col("first").alias("ahead")).distinct()
    short = taken.where(F.col("size") == 1).join(after, F.col("child") == F.col("_node")).drop("_node")
    return long.unionByName(short)


def _first_edits(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """States after the one edit: (side, t, n, position, node, copies, edits, near, near_n).

    What an edit continues with is known, so a state meets only edges that this letter may follow.
    """
    t, i, letters = F.col("t"), F.col("position"), F.length("t") - 1
    own = paths.select("side", "t", "n", F.explode("stops").alias("_stop")).select(
        "side", "t", "n", F.col("_stop.depth").alias("position"), F.col("_stop.node").alias("node"),
        _salt(F.col("_stop.copies")).alias("_salt"))
    # A letter is replaced, and the word goes on behind it; or one is added, and it goes on where it was.
    replaced = F.when((i >= F.floor(letters / 2)) & (i < letters), F.struct(F.lit(1).alias("uses"), _letter(t, i + 1).alias("next")))
    added = F.when(i >= F.floor((letters + 1) / 2), F.struct(F.lit(0).alias("uses"), _letter(t, i).alias("next")))
    edits = own.select("*", _letter(t, i).alias("_own"), F.inline(F.array_compact(F.array(replaced, added))))
    uses, first, size = F.col("uses"), F.col("first"), F.col("size")
    other = F.when(uses == 1, first > F.col("_own")).otherwise(first != F.col("_own"))
    rest = (size <= 2) | (F.expr("substr(label, 3)") == t.substr(i + uses + 2, size - 2))
    met = edits.join(_edges_ahead(edges), (F.col("node") == F.col("parent")) & (F.col("_salt") == F.col("salt"))
                     & (F.col("next") == F.col("ahead")) & other & rest)
    return met.select("side", "t", "n", (i + uses + size - 1).alias("position"), F.col("child").alias("node"),
                      F.col("child_copies").alias("copies"), F.lit(1).alias("edits"), "near", "near_n")


def _next_level(states: DataFrame, edges: DataFrame) -> DataFrame:
    """States one edge further, where the whole label is what follows in the word."""
    t, i = F.col("t"), F.col("position")
    here = states.select("side", "t", "n", "position", "node", "edits", _salt(F.col("copies")).alias("_salt"),
                         _letter(t, i).alias("_letter"))
    met = here.join(edges, (F.col("node") == F.col("parent")) & (F.col("_salt") == F.col("salt"))
                    & (F.col("_letter") == F.col("first")) & (F.col("label") == t.substr(i + 1, F.col("size"))))
    return met.select("side", "t", "n", (i + F.col("size")).alias("position"), F.col("child").alias("node"),
                      F.col("child_copies").alias("copies"), "edits", "near", "near_n")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): all ordered pairs of words that one inserted, deleted or replaced code point parts.

    ``words`` has a row (word, n) for each word; words that hold U+0000 are near nothing.
    """

    def build():
        listed = words.select("word", "n").where(~F.contains("word", F.lit(END)))
        paths = stage(_paths(listed), "spelling_paths")
        edges = stage(_edges(paths), "spelling_edges")
        level = stage(_first_edits(paths, edges), "spelling_states")
        reached = []
        while True:
            reached.append(level.where(F.col("near").isNotNull()))
            open_states = level.where(F.col("near").isNull())
            if open_states.isEmpty():
                break
            level = stage(_next_level(open_states, edges), "spelling_states")
        found = reduce(DataFrame.unionByName, reached).select(
            _word(F.col("side"), F.col("t")).alias("word"), "n", "near", "near_n").distinct()
        found = found.where(F.levenshtein("word", "near", 1) == 1)
        return found.unionByName(found.select(
            F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"),
            F.col("n").alias("near_n"))).distinct()

    return distilled("spelling_neighbours", build)


def _roots(forms: DataFrame, most: int, times: int) -> DataFrame:
    """(word, root): forms followed to the last.  Each is ``times`` as frequent as the one before, so few hops do."""
    hops, reach = forms.select("word", F.col("form").alias("root")), 1
    while times ** (reach + 1) <= most:  # a way of more than ``reach`` forms may exist
        further = hops.select(F.col("word").alias("_at"), F.col("root").alias("_to"))
        hops = hops.join(further, F.col("root") == F.col("_at"), "left").select(
            "word", F.coalesce("_to", "root").alias("root"))
        reach *= 2
    return hops


def spelling_variants(words: DataFrame, times: int = 10) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each row (word, n) of ``words``.

    A word's form is its most frequent neighbour (ties: the first by code points) if that is at least ``times``
    (over 1) as frequent; its root is what following forms ends in.  ``words`` is read several times: stage it.
    """
    near = neighbours(words)
    best = F.min(F.struct((-F.col("near_n")).alias("_less"), "near"))
    summary = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("_best"))
    told = stage(words.select("word", "n").join(summary, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(-F.col("_best._less") >= times * F.col("n"), F.col("_best")).alias("_form")).select(
        "word", "n", "n_near", F.col("_form.near").alias("form"), (-F.col("_form._less")).alias("form_n")),
        "spelling_forms")
    most = told.agg(F.max("n")).first()[0] or 0
    roots = _roots(told.where(F.col("form").isNotNull()), most, times)
    return told.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
