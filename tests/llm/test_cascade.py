import random

import pytest
from oracle import same
from pyspark.sql import functions as F

from sealwright.llm.cascade import build, judge_urls, url_parts
from sealwright.llm.queries import OP12_SQL, op12_url_rules


def brute(url, rules):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([i for i in map(rest.find, "/?#") if i >= 0] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end : min([i for i in map(rest.find, "?#") if i >= 0] or [len(rest)])]
    fit = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None, key=lambda r: (r[0], r[1], r[3] == "allow"))
    return host, path, best and best[2], best[3] if best else "allow"


def test_query(spark):
    d = "/root/testdata/sf0.01"
    same(op12_url_rules(spark, d), OP12_SQL, d)


RULES = [("net", "/", "block"), ("a.net", "/en/", "allow"), ("a.net", "", "block"), ("B.org", "/x", "block"), ("b.org", "/x", "allow"), ("co", "/long/er", "block"), ("w.co", "/long/", "allow"), ("ww.co", "/long", "block"), ("é.de", "/ü", "block")]


def test_odd_urls(spark):
    hosts = ["net", "a.net", "x.a.net", "xa.net", "NET", "a.net.", ".net", "b.ORG", "co", "w.co", "v.ww.co", "é.de", "a:1.net", "", "[::1]", "https"]
    ends = ["", "/", "/en", "/en/", "/en/a?q=/en/", "?/en/", "#/en/", "/x#y", "/long/er/z", "/long/", "/ü" + "y" * 5000, "//en/", "/\nen"]
    urls = [s + h + e for s in ("http://", "x://", "") for h in hosts for e in ends] + [None, "", "://", "a://b://c.net/", "http:/net/"]
    rows = [(i if i % 50 else None, u, "h", 1, "r") for i, u in enumerate(urls * 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, key int, rule string")
    rules = spark.createDataFrame(RULES * 2, "host string, path string, verdict string")
    got = sorted((tuple(r) for r in judge_urls(df, rules).collect()), key=repr)
    want = [(None if i % 50 == 0 else i, *brute(u, [(h.lower(), p, v) for h, p, v in RULES])) for i, u in enumerate(urls * 2)]
    assert got == sorted(want, key=repr)
    assert judge_urls(df.limit(0), rules).count() == 0
    assert {r.verdict for r in judge_urls(df, rules.limit(0)).collect()} == {"allow"}


def test_wrong_rules_are_errors(spark):
    for bad in [(None, "/", "block"), ("", "/", "allow"), ("a/b", "/", "allow"), ("a", "x", "allow"), ("a", "/", "maybe"), ("a", "/", None)]:
        with pytest.raises(ValueError, match="not a rule"):
            judge_urls(spark.createDataFrame([(1, "x")], "page_id long, url string"), spark.createDataFrame([bad], "host string, path string, verdict string"))


def test_long_list_is_exact_over_the_universe(spark):
    keys = spark.range(60_000).select(F.concat(F.lit("h"), "id", F.lit(".net/")).alias("key"))
    listed = keys.where("xxhash64(key) % 7 = 0")
    cascade = build(listed, keys.union(keys.limit(5000)), 65_000)
    assert len(cascade.levels) > 3
    import numpy as np

    rows = keys.select(F.xxhash64("key").alias("h"), F.xxhash64("key", F.lit(1)).alias("g"), (F.expr("xxhash64(key) % 7 = 0")).alias("want")).toPandas()
    got = cascade.holds(rows.h.to_numpy(np.int64).view(np.uint64), rows.g.to_numpy(np.int64).view(np.uint64))
    assert (got == rows.want.to_numpy()).all()
    assert sum(level.bits for level in cascade.levels) < 16 * listed.count()
    with pytest.raises(ValueError, match="max_bytes"):
        build(listed, keys, 60_000, max_bytes=100)


def test_many_rules(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 2)))
    rules = list({(h, p): (h, p, rnd.choice(["allow", "block"])) for h, p in ((".".join(word() for _ in range(rnd.randint(1, 3))), "/" + "/".join(word() for _ in range(rnd.randint(0, 2)))) for _ in range(300))}.values())
    urls = ["s://" + ".".join(word() for _ in range(rnd.randint(1, 4))) + "/" + "/".join(word() for _ in range(3)) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(5)
    got = sorted(tuple(r) for r in judge_urls(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect())
    assert got == [(i, *brute(u, rules)) for i, u in enumerate(urls)]


def test_host_and_path(spark):
    got = spark.createDataFrame([("HTTP://Ab.İ/P?x",)], "url string").select(*url_parts(F.col("url"))).first()
    assert tuple(got) == ("ab.İ", "/P")
