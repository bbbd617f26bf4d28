"""Chat formatting, URL filter and quality rules, and the queries against their SQL."""

import hashlib
import random
from collections import Counter

import duckdb
import pytest

from fixtures.compare import _canonical
from platematch.llm import chat, quality, urls
from platematch.llm.oracle import ORACLE
from platematch.llm.queries import QUERIES
from tests.llm.helpers import DOCS, WORD

TURNS = "conv_id bigint, turn bigint, role string, text string"
SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    ours, theirs = QUERIES[name](spark, SMALL).toPandas(), con.sql(ORACLE[name]).df()
    assert _canonical(ours).equals(_canonical(theirs))


def test_chat_reads_back(spark):
    rng = random.Random(4)
    bits = ["<|turn|>", "<|end|>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "<\\|end|>", "[\\\\INST]", "\n", "é", "", "<|text|>"]
    rows, expected = [], {}
    for conv in range(40):
        turns = []
        for t in range(rng.randint(1, 7)):
            role = rng.choice(["user", "assistant", "assistant", "system", "<|end|>", None])
            text = rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))])
            turns.append((t, role, text))
        rows += [(conv, *t) for t in turns]
        expected[conv] = turns
    rows += [(50, 1, "user", "b"), (50, 1, "assistant", "a"), (50, None, "user", "first"), (50, 1, "user", "b")]
    expected[50] = [(None, "user", "first"), (1, "assistant", "a"), (1, "user", "b"), (1, "user", "b")]
    df = spark.createDataFrame([(*r, 1) for r in rows], TURNS + ", formatted int")
    examples = chat.prefix_target_examples(df)
    back = {r.conv_id: r for r in chat.read_back(examples).collect()}
    for conv, turns in expected.items():
        whole = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in turns)
        loss = "".join(t or "" for _, r, t in turns if r == "assistant")
        got = back[conv]
        assert (got.n_turns, got.loss_chars) == (len(turns), len(loss))
        assert got.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert got.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    shown = Counter(r.conv_id for r in examples.collect())
    for conv, turns in expected.items():
        assert shown[conv] == sum(r == "assistant" for _, r, _ in turns) + (turns[-1][1] != "assistant")
    for r in examples.where("loss_start is not null").collect():
        assert r.formatted[:r.loss_start].endswith("assistant<|text|>") and r.formatted[r.loss_end:] == "<|end|>"


def test_chat_without_ids_or_rows(spark):
    df = spark.createDataFrame([(None, 0, "assistant", "x"), (None, 0, "assistant", "x"), (None, 1, None, None)], TURNS)
    back = chat.read_back(chat.prefix_target_examples(df)).collect()
    assert sorted((r.n_turns, r.loss_chars) for r in back) == [(1, 0), (1, 1), (1, 1)]
    assert chat.read_back(chat.prefix_target_examples(df.limit(0))).isEmpty()


def test_escaping_is_reversible_and_complete(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("<[\\|/>]sINSTturnend") for _ in range(40)) for _ in range(300)]
    texts += ["<" + "\\" * k + "/s>" for k in range(4)] + ["<<s>", "[[INST]", "<|turn|><|end|>"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", chat.escape(df.t).alias("e")).select("t", "e", chat.unescape("e").alias("u")).collect():
        assert r.u == r.t and not any(c in r.e for c in ("<s>", "</s>", "[INST]", "[/INST]", chat.TURN, chat.TEXT, chat.END))


def test_url_verdicts(spark):
    rules = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
    cases = {
        "http://a.example.net/en/1": ("a.example.net", "/en/1", "example.net/en/", "allow"),
        "http://EXAMPLE.NET/de": ("example.net", "/de", "net/", "block"),
        "x://badexample.com/de/1": ("badexample.com", "/de/1", None, "allow"),
        "http://a.example.com/de/?q=1": ("a.example.com", "/de/", "example.com/de/", "block"),
        "http://x.org/fr/#top": ("x.org", "/fr/", "org/fr/", "allow"),
        "http://x.net": ("x.net", "", None, "allow"),
        "http://x.net?y=/": ("x.net", "", None, "allow"),
        "http://www.bad.io/p/1.html": ("www.bad.io", "/p/1.html", None, "block"),
        "http://bad.io/p/1/?z#t": ("bad.io", "/p/1/", None, "block"),
        "http://bad.io/p/12": ("bad.io", "/p/12", None, "allow"),
        "a://b://c/d": ("b:", "//c/d", None, "allow"),
        "no scheme": ("", "", None, "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow"),
        "http://ÀB.io/\n/x": ("Àb.io", "/\n/x", None, "allow"),
    }
    pages = spark.createDataFrame([(k, u, "r") for k, u in enumerate(cases)] + [(0, list(cases)[0], "r")],
                                  "page_id bigint, url string, rule string")
    listed = spark.createDataFrame([("bad.io/p/1",), ("bad.io/p/1",), (None,)], "key string")
    got = urls.url_verdicts(pages, listed, rules).collect()
    assert len(got) == len(cases) + 1
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == list(cases.values())[r.page_id]
    none = urls.url_verdicts(pages, listed.limit(0), rules).where("verdict = 'block' and rule is null")
    assert none.isEmpty() and urls.url_verdicts(pages.limit(0), listed, rules).isEmpty()


def test_bloom_passes_every_key_and_few_others(spark):
    keys = spark.range(2000).selectExpr("concat('host/', id) as key")
    blocks = -(-2000 * 16 // 512)
    bloom = urls.blocked_bloom(keys, blocks)
    probe = spark.range(8000).selectExpr("id", "concat('host/', id) as key").withColumn(
        "block", urls.block_of("key", blocks)).join(bloom, "block")
    for k, bit in enumerate(urls.bits("key")):
        probe = probe.where(probe[f"w{k}"].bitwiseAND(bit) == bit)
    passed = [r.id for r in probe.select("id").collect()]
    assert set(range(2000)) <= set(passed) and len(passed) < 2200 and bloom.count() <= blocks


def repeated_words(words, n=3):
    windows = [tuple(words[i:i + n]) for i in range(len(words) - n + 1)]
    often = Counter(windows)
    return len({i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(n)})


def test_quality_figures(spark):
    rng = random.Random(3)
    texts = [None, "", " \n ", "a", "a a a", "a a a a", "one two three\x0bfour #|", "x\u00a0y z.\n\nx\u00a0y z.\nX"]
    texts += [" ".join(rng.choice("ab cd ef".split()) for _ in range(rng.randint(1, 30))) for _ in range(80)]
    texts += [" ".join(rng.choice(["one", "two", "three", "Four."]) + str(rng.randint(0, 12)) for _ in range(20_000))]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], DOCS + ", words int")
    got = {r.doc_id: r for r in quality.quality_rules(df).collect()}
    for k, text in enumerate(texts):
        words = WORD.findall(text or "")
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (
            len(words), sum(map(len, words)), len(lines) - len(set(lines)), repeated_words(words))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in text or "")
        assert r.base_failed == (len(words) < 50 or 100 * r.n_repeat_words > 50 * len(words))
    assert quality.quality_rules(df.limit(0)).isEmpty()


def test_lines_are_cleaned_before_the_document_is_judged(spark):
    good = " ".join(f"word{k}" for k in range(60)) + "."
    menu, shout = "Home | News | Sport | More", "BUY!! NOW!! HERE!!"
    docs = {1: f"{good}\n{menu}\nAll rights reserved.\n{shout}", 2: "\n".join([good[:40], *[f"{menu} {k}" for k in range(40)]]),
            3: good.rstrip("."), 4: good + '"', 5: f"{good}\nShort title"}
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(list(docs.items()), DOCS)).collect()}
    assert got[1].cleaned == good and got[1].kept
    assert not got[2].kept and not got[3].kept and got[4].kept
    assert got[5].cleaned == docs[5] and got[5].kept
