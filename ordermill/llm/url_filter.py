"""URL rules, and a blocked Bloom filter before an exact join with a list of URLs.

A few rules (host and path prefix) decide first; the longest fitting rule wins. Other
URLs are blocked if their canonical form is listed. A Bloom filter of the list, small
by construction and broadcast, passes possible hits; only these are shuffled to the exact
join with the list, which removes false positives. SQL functions throughout.

Host and path of a null URL, or one without ``://``, are empty: no rule fits, it is not
listed, and the verdict is allow. Repeated rows give a row each.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ordermill.llm.bloom import bloom_filter, with_possible
from ordermill.llm.stored import stored


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


# Fixed values.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without www. and m., path without .html and slashes at its end; null without a host."""
    bare = F.regexp_replace(host, r"^(www|m)\.", "")
    return F.when(host != "", F.concat(bare, F.regexp_replace(path, r"(\.html)?/*$", "")))


def rule_column(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> Column:
    """A struct of the longest fitting rule as text and its verdict, or null."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        made = F.struct(F.lit(rule.host + rule.path).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        chosen = F.when(fits, made).otherwise(chosen)
    return chosen


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of each row of ``pages`` (page_id, url).

    ``listed`` has the canonical URLs to block in its column ``canonical``.
    """
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = parts.select("*", rule_column(F.col("host"), F.col("path"), rules).alias("r"))
    asked = judged.select(
        "page_id", "host", "path", "r.rule", "r.verdict",
        F.when(F.col("r").isNull(), canonical(F.col("host"), F.col("path"))).alias("canonical"),
    )
    listed = stored(listed.select("canonical").where("canonical IS NOT NULL").distinct(), "listed-urls")
    asked = with_possible(asked, "canonical", bloom_filter(listed, "canonical"), "possible")
    out = "page_id", "host", "path", "rule"
    passed = asked.where("NOT possible").select(*out, F.coalesce("verdict", F.lit("allow")).alias("verdict"))
    hits = asked.where("possible").join(
        listed.withColumnRenamed("canonical", "_listed").hint("shuffle_hash"), F.col("canonical") == F.col("_listed"), "left"
    )
    exact = F.when(F.col("_listed").isNotNull(), "block").otherwise("allow")
    return passed.unionByName(hits.select(*out, exact.alias("verdict")))
