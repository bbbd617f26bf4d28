"""The pipeline on a small corpus, stage by stage, and the queries that SQL cannot express."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from platematch.llm.queries import QUERIES  # noqa: E402
from platematch.session import stage  # noqa: E402
from tests.llm.helpers import jaccard_components, kept_by_language, prose, without_repeats  # noqa: E402

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "line_dedup", "ngram_jaccard_join", "decontamination", "packing"]


def test_pipeline_on_planted_rows(spark):
    bench = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").limit(3).collect()]
    text = {k: "\n".join(" ".join(prose(100 * k + j, 15)) + "." for j in range(4)) for k in range(12)}
    rows = [(k, t) for k, t in text.items()]
    rows += [(20, None), (21, ""), (22, "123 456\n789"), (23, text[3]), (24, text[4] + "\none more line of " + text[5][:30])]
    rows += [(30, " ".join(prose(1, 30)) + " " + bench[0] + " end"), (31, bench[1])]
    near = text[6].split()
    near[10] = "different"
    rows.append((40, " ".join(near)))
    rows.append((41, " ".join(text[6].split())))
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {}
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, SMALL), name)
        if name != "packing":
            assert docs.columns == COLUMNS
            kept[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(kept["language_id"]) == kept_by_language(rows)
    assert 23 not in kept["line_dedup"] and kept["line_dedup"][24].startswith("one more line")
    assert set(text) <= set(kept["line_dedup"])
    # Two run the lines of document 6 together: the second is one line like the first's, that one a copy of 6.
    assert {40, 41} & set(kept["line_dedup"]) == {40}
    assert {6, 40} & set(kept["ngram_jaccard_join"]) == {6} and set(text) <= set(kept["ngram_jaccard_join"])
    assert {30, 31} & set(kept["decontamination"]) == set() and set(text) <= set(kept["decontamination"])
    assert {r.doc_id for r in docs.collect()} == set(kept["decontamination"])


def test_language_stage_rejects_what_is_in_no_learned_language(spark):
    rng = random.Random(5)
    scripts = {"cyrillic": (0x430, 0x450), "greek": (0x3B1, 0x3CA), "cjk": (0x4E00, 0x9FA0), "hebrew": (0x5D0, 0x5EB), "latin": (97, 123)}
    clean = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    short = [(10_000 + i, t[:k], None) for i, t, _ in clean[:60] if t for k in (12, 100) if len(t) > 400]
    foreign = {}
    for name, (low, high) in scripts.items():
        for words in (12, 30, 200):
            for _ in range(20):
                text = " ".join("".join(chr(rng.randrange(low, high)) for _ in range(rng.randint(5, 9))) for _ in range(words))
                foreign[20_000 + len(foreign)] = (name, text)
    rows = clean + short + [(i, t, None) for i, (_, t) in foreign.items()]
    docs = spark.createDataFrame([(i, t, lang, "s", None) for i, t, lang in rows],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs, SMALL).collect()}
    assert kept_by_language([(i, t) for i, t, _ in clean + short]) <= kept
    passed = [foreign[i][0] for i in kept if i in foreign]
    assert set(passed) <= {"latin"} and passed.count("latin") <= 3


def test_pipeline_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, SMALL), name)
    assert docs.isEmpty()


def test_queries_over_whole_tables(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op6_ngram_jaccard_join"](spark, SMALL).collect()}
    assert got == jaccard_components(docs)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
           for r in QUERIES["op1_suffix_array_dedup"](spark, SMALL).collect()}
    assert got == without_repeats(docs)


def test_language_of_documents_held_out(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = QUERIES["op5_language_id"](spark, "/root/testdata/sf0.01").where("held_out").collect()
    right = sum(lang[r.doc_id] == r.lang_pred for r in got)
    assert len(got) > 200 and right >= 0.98 * len(got)


def test_toxicity_of_labelled_documents(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = {r.doc_id: r.toxic for r in QUERIES["op10_toxicity"](spark, "/root/testdata/sf0.01").collect()}
    caught = sum(got[d] for d, t in labels.items() if t) / sum(labels.values())
    blamed = sum(got[d] for d, t in labels.items() if not t) / sum(not t for t in labels.values())
    assert caught >= 0.9 and blamed <= 0.02
