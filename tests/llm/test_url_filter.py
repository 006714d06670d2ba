import random

from pyspark.sql import functions as F

from linemill.llm.bloom import BloomFilter
from linemill.llm import url_filter as U

URLS = [
    None, "", "no scheme", "http://", "http://example.com/en/712?q", "https://A.Example.COM/en/8#x", "http://b.example.net/de/8", "http://example.net/de/9", "x://y://z/p", "http://org/es/", "http://xorg/es/1",
    "http://free-bets.example.com", "http://free-bets.example.com/", "http://m.free-bets.example.com/fr/1", "http://com/en/é/\n", "http://h?/en/", "http://.com/en/", "http://a..com/en/1",
    "http://free-bets.example.com?q", "http://me:pw@free-bets.example.com:80/x", "HTTP://m.FREE-bets.example.com./x", "http://example.com:80/en/7", "http://a@example.com/en/7", "http://" + "a." * 3000 + "com/en/" + "x" * 50_000,
]


def brute(url, rules, listed):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: next((i for i, c in enumerate(path) if c in "?#"), len(path))]
    fits = lambda k, host, path: (host == k.split("/")[0] or host.endswith("." + k.split("/")[0])) and path.startswith(k[k.index("/") :])
    rule = max(((k, v) for k, v in rules if fits(k, host, path)), key=lambda r: (len(r[0]), r[0].index("/")), default=(None, None))
    bare = host.rpartition("@")[2]
    bare = bare[: bare.rindex(":")] if ":" in bare and (bare.rpartition(":")[2] or "0").isdigit() else bare
    seen = any(fits(k, bare.removesuffix("."), path or "/") for k in listed)
    return host, path, rule[0], rule[1] or ("block" if seen else "allow")


def test_matches_brute_force(spark):
    rng = random.Random(8)
    urls = URLS + [f"http://{rng.choice(['m.', ''])}{rng.choice(['example.com', 'example.net', 'com', 'x.org', 'free-bets.example.org'])}/{rng.choice(['en', 'de', 'es'])}/{rng.randrange(10)}{rng.choice(['', '?a', '#b'])}" for _ in range(150)]
    rows = list(enumerate(urls)) + [(1, urls[5]), (None, urls[5])]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 as key", "2 as verdict")
    for blocks in (1, 1 << 10):
        got = U.judge(pages, U.listing(spark), max_blocks=blocks).collect()
        assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got), key=str) == sorted(((i, *brute(u, U.RULES, U.LISTED)) for i, u in rows), key=str)
    assert U.judge(pages.limit(0), U.listing(spark)).collect() == []
    assert {r.verdict for r in U.judge(pages, U.listing(spark).limit(0)).collect()} == {"allow"}


def test_equally_long_rules_and_listings_as_they_are_written(spark):
    rules, listed = [("b.com/x", "block"), ("com/xabcd"[:7], "allow"), ("com/a/", "allow")], ["evil.com/", "com/b/"]
    urls = ["http://b.com/xabc", "http://b.com/x", "http://evil.com/a/1", "http://evil.com:8/q", "http://evil.com:8/a/", "http://z.com/b/", "http://z.com./b/", "http://evil.com" + "?" * 9]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = U.judge(pages, U.listing(spark, rules, listed)).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == [(i, *brute(u, rules, listed)) for i, u in enumerate(urls)]


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    bloom = BloomFilter(keys, "k")
    asked = spark.range(40_000).select("id", bloom.may_contain(F.col("id").cast("string"), bloom.bits()).alias("may"))
    counts = {r.known: r.n for r in asked.filter("may").groupBy((F.col("id") < 20_000).alias("known")).agg(F.count("*").alias("n")).collect()}
    assert counts[True] == 20_000 and counts.get(False, 0) < 400
