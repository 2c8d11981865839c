"""URL rules by brute force; the trees by held-out rule labels; no Python in the plan."""

import re

from pyspark.sql import functions as F

from tablelens.llm.registry import QUERIES, _url_rules
from tablelens.llm.url_filter import UrlRule, entropy, judge

from .conftest import SF, UP


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    return host.translate(UP), path


def ruled(url, rules):
    host, path = parts(url)
    fit = [r for r in rules for h, p in [r.rule.split("/", 1)] if (host == h or host.endswith(f".{h}")) and path.startswith(f"/{p}")]
    best = max(fit, key=lambda r: len(r.rule), default=None)
    return host, path, best and best.rule, best and best.verdict


ODD = [None, "", "x", "http://", "://ORG/a", "https://Example.ORG/es/1?q=/x#y", "http://a.example.org/en/12", "http://xorg/a", "http://org", "http://a.com/fr/x",
       "http://b.com/de/?a=1&b=2", "http://c.net/en/1", "http://c.net/en/1", "ftp://é.com/fr", "http://a.org?x/es/", "no://b://c.org/d", "http://" + "a" * 100_000 + ".net/x"]


def test_rules_on_odd_urls(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "page_id long, url string").withColumn("verdict", F.lit("z")).withColumn("HOST", F.lit("z"))
    assert judge(df, _url_rules()).columns == ["page_id", "url", "host", "path", "rule", "verdict", "block_score"]
    got = {r.page_id: r for r in judge(df, _url_rules()).collect()}
    for i, url in enumerate(ODD):
        host, path, rule, verdict = ruled(url, _url_rules())
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), url
        assert got[i].verdict == verdict or (verdict is None and got[i].verdict in ("allow", "block"))
        assert (got[i].block_score is None) == (rule is not None)
    assert judge(df.limit(0), _url_rules()).count() == 0
    assert {r.verdict for r in judge(df, []).collect()} == {"allow"}


def test_trees_find_held_out_rules(spark):
    """Hide the rules from half of the hosts' URLs: the trees should agree with them there."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    shown = [UrlRule("block", "example.com/de/"), UrlRule("allow", "example.com/fr/"), UrlRule("block", "example.org/de/"), UrlRule("allow", "example.org/fr/")]
    out = judge(pages.filter("url rlike '/(de|fr)/'"), shown).filter("rule is null")
    agree = out.filter((F.col("verdict") == "block") == F.col("path").startswith("/de/")).count()
    assert out.count() > 50 and agree >= 0.95 * out.count()


def test_entropy(spark):
    got = spark.createDataFrame([("",), ("aaaa",), ("abab",), ("abcd",), ("aab",)], "s string").select(entropy(F.col("s"))).collect()
    assert [round(r[0], 4) for r in got] == [0.0, 0.0, 1.0, 2.0, 0.9183]


def test_native_plans(spark):
    for key in ("op6_url_filter", "op7_quality_rules"):
        plan = QUERIES[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", plan)
