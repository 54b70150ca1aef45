import re

import pytest
from pyspark.sql import functions as F

from ordermill.llm import bloom, url_filter

URLS = [
    None, "", "no scheme", "http://", "http://Example.ORG/es/1", "https://a.b.example.org/es", "https://notexample.org/es/x",
    "http://example.org/en/12#x", "http://example.org/en/2", "http://x.org", "http://x.org?a=/", "http://x.com/fr/1", "http://com/de/",
    "http://x.com/de/5?utm_source=a", "http://www.x.net/a/b.html", "http://m.x.net/a/b/", "http://x.net/a/b?utm_source=feed",
    "ftp://x.net/a/b://c", "http://x.net/a/c", "x://y://z/fr/", "http://ÄB.net/a", "http://a.net/\nnew",
]


def judged(url, listed):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = ("", "") if not m else ("".join(c.lower() if c.isascii() else c for c in m[1]), m[2])
    fitting = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fitting:
        rule = max(fitting, key=lambda r: len(r.host + r.path))
        return host, path, rule.host + rule.path, rule.verdict
    canonical = re.sub(r"^(www|m)\.", "", host) + re.sub(r"(\.html)?/*$", "", path, count=1) if host else None
    return host, path, None, "block" if canonical in listed else "allow"


@pytest.fixture
def pages(spark):
    return lambda urls: spark.createDataFrame(
        [(i, u, "h", "r") for i, u in enumerate(urls)], "page_id bigint, url string, host string, rule string"
    ).repartition(3)


def test_equals_plain_rules(spark, pages):
    listed = ["x.net/a/b", None, "x.net/a/b", "y/never"]
    urls = URLS * 2
    table = spark.createDataFrame([(c,) for c in listed], "canonical string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages(urls), table).collect()}
    assert got == {i: judged(u, {c for c in listed if c}) for i, u in enumerate(urls)}
    assert {v[3] for v in got.values()} == {"allow", "block"}


def test_empty_tables(spark, pages):
    nothing = spark.createDataFrame([], "canonical string")
    assert url_filter.judge(pages([]), nothing).collect() == []
    got = {r.page_id: r.verdict for r in url_filter.judge(pages(URLS), nothing).collect()}
    assert got == {i: judged(u, set())[3] for i, u in enumerate(URLS)}


@pytest.mark.parametrize("broadcast", [1, bloom.BROADCAST_BLOCKS])
@pytest.mark.parametrize("per_block", [16, 4000])
def test_filter_never_loses_a_key(spark, monkeypatch, broadcast, per_block):
    monkeypatch.setattr(bloom, "BROADCAST_BLOCKS", broadcast)
    monkeypatch.setattr(bloom, "KEYS_PER_BLOCK", per_block)
    monkeypatch.setattr(bloom, "LEAST_BLOCKS", 1)
    keys = spark.range(0, 2000).select((F.col("id") * 7).alias("k"), F.lit(1).alias("_block"))
    made = bloom.bloom_filter(keys, "k")
    assert made.blocks == (128 if per_block == 16 else 1) and made.table.count() <= made.blocks
    asked = bloom.with_possible(spark.range(0, 14000).select(F.col("id").alias("k"), F.lit(2).alias("_block")), "k", made, "possible")
    assert asked.where((F.col("k") % 7 == 0) & ~F.col("possible")).count() == 0
    passed = asked.where((F.col("k") % 7 != 0) & F.col("possible")).count()
    assert passed < 600 if per_block == 16 else passed >= 0
    assert asked.columns == ["k", "_block", "possible"]


def test_five_million_keys_pass_few_strangers(spark):
    made = bloom.bloom_filter(spark.range(0, 5_000_000), "id")
    assert made.blocks > bloom.BROADCAST_BLOCKS
    strangers = bloom.with_possible(spark.range(5_000_000, 5_200_000), "id", made, "possible")
    assert strangers.where("possible").count() < 0.05 * 200_000
    held = bloom.with_possible(spark.range(0, 5_000_000, 97), "id", made, "possible")
    assert held.where("NOT possible").count() == 0
