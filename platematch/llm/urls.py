"""URL filter: host and path rules first, then a list of canonical URLs.

Listed URLs go into a blocked Bloom filter, a table of 512-bit blocks; a key
lives in one block and sets one bit in each of its eight words.  Urls without a
rule look into their block; only those whose eight bits are set go on to the
exact hash join with the list, which removes the false positives.  The filter
is a table joined by block number, so it may grow with the list; Spark sends it
to every task only where it measured it as small.

Defined cases: a null url or one without ``://`` has an empty host and path,
fits no rule and is not listed, so it is allowed; repeated rows are judged each;
an empty list blocks nothing.  Columns other than id and url are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platematch.functions.skew import left_lookup

WORDS = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str]  # "allow" or "block", host followed by path


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Without ``www.`` or ``m.``, port, ``.html`` and closing slashes; null without a host."""
    short = F.regexp_replace(F.regexp_replace(host, r"^(www|m)\.", ""), r":\d*$", "")
    return F.when(host != "", F.concat(short, F.regexp_replace(path, r"(/index)?(\.html?)?/*$", "")))


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """(rule, verdict) of the longest rule that fits, else null; rules are a short stated list."""
    tests = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        tests.append(F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*tests, F.lit(None).cast("struct<rule:string,verdict:string>"))


def bits(url: Column) -> list[Column]:
    """For each word of a block, the one bit that a key sets."""
    spread = F.xxhash64(url, F.lit(1))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(spread, 6 * k).bitwiseAND(63).cast("int"))
            for k in range(WORDS)]


def block_of(url: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(n_blocks))


def blocked_bloom(listed: DataFrame, n_blocks: int) -> DataFrame:
    """(block, w0 .. w7) over the column ``key``."""
    words = [b.alias(f"w{k}") for k, b in enumerate(bits(F.col("key")))]
    return listed.select(block_of(F.col("key"), n_blocks).alias("block"), *words).groupBy("block").agg(
        *[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)])


def url_verdicts(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule], bits_per_key: int = 16,
                 id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages``; ``listed`` has a column ``key``."""
    listed = listed.where(F.col("key").isNotNull()).select("key").distinct()
    n_blocks = max(1, -(-listed.count() * bits_per_key // (64 * WORDS)))
    bloom = blocked_bloom(listed, n_blocks)
    judged = (
        pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
        .select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
        .withColumn("ruled", rule_for(F.col("host"), F.col("path"), rules))
        .withColumn("key", F.when(F.col("ruled").isNull(), canonical(F.col("host"), F.col("path"))))
        .withColumn("block", F.when(F.col("key").isNotNull(), block_of(F.col("key"), n_blocks)))
    )
    probed = left_lookup(judged, bloom, {"block": "block"}, "page_id")
    set_all = reduce(lambda a, b: a & b, [F.col(f"w{k}").bitwiseAND(b) == b for k, b in enumerate(bits(F.col("key")))])
    possible = probed.withColumn("hit", F.when(F.coalesce(set_all, F.lit(False)), F.col("key")))
    exact = left_lookup(possible, listed.select("key", F.lit(True).alias("listed")), {"hit": "key"}, "page_id")
    return exact.select("page_id", "host", "path", F.col("ruled.rule").alias("rule"), F.coalesce(
        F.col("ruled.verdict"), F.when(F.col("listed"), "block"), F.lit("allow")).alias("verdict"))
