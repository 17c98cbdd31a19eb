from platterlake.llm import urlfilter as u

SCHEMA = "page_id long, url string, host string, rule string, uid long, key string"


def judged(spark, urls, listed=None):
    pages = spark.createDataFrame([(i, x, "c", "c", 0, "c") for i, x in enumerate(urls)], SCHEMA)
    listed = None if listed is None else spark.createDataFrame([(x,) for x in listed], "k string")
    found = u.verdicts(pages, u.inline(spark, u.RULES, "host path action"), listed).collect()
    return [(r.host, r.path, r.rule, r.verdict) for r in sorted(found, key=lambda r: r.page_id)]


def test_rules(spark):
    urls = ["http://A.Example.COM/en/71?x", "https://b.com/en/x#f", "http://notexample.com/en/7", "x://m.de.net/de/1", "http://example.net/de/8", "http://a.example.net/de/9", "http://org/es/", "http://a.org/ES/", None, "no host", "http://", "http://a.com", "a://b://c/d"]
    found = judged(spark, urls)
    assert found[0] == ("a.example.com", "/en/71", "example.com/en/7", "allow")
    assert found[1] == ("b.com", "/en/x", "com/en/", "block")
    assert found[2] == ("notexample.com", "/en/7", "com/en/", "block")
    assert found[3] == ("m.de.net", "/de/1", "net/de/", "allow")
    assert found[4][2:] == ("example.net/de/8", "block")
    assert found[5][2:] == ("net/de/", "allow")
    assert found[6][2:] == ("org/es/", "block")
    assert found[7:] == [("a.org", "/ES/", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("a.com", "", None, "allow"), ("b:", "//c/d", None, "allow")]


def test_list_is_exact_and_rules_win(spark):
    urls = [f"http://h{i}.de/p/{i}/?q" for i in range(300)] + ["http://x.com/en/7"]
    found = judged(spark, urls, [f"h{i}.de/p/{i}" for i in range(0, 300, 3)] + [None, "zz"])
    assert [v for *_, v in found] == ["block" if i % 3 == 0 else "allow" for i in range(300)] + ["block"]


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(20_000).selectExpr("concat('k', id) AS key")
    bloom = u.BlockedBloom(keys, 20_000)
    assert bloom.passes(keys, "key").count() == 20_000
    assert bloom.passes(spark.range(20_000).selectExpr("concat('other', id) AS key"), "key").count() < 600


def test_large_lists_take_the_exact_join_alone(spark, monkeypatch):
    urls = [f"http://www.h{i}.de/p/{i}/?q" for i in range(60)] + ["http://x.com/en/7", None]
    listed = [f"h{i}.de/p/{i}" for i in range(0, 60, 3)]
    want = judged(spark, urls, listed)
    assert [v for *_, v in want] == ["block" if i % 3 == 0 else "allow" for i in range(60)] + ["block", "allow"]
    monkeypatch.setattr(u, "MAX_BLOCKS", 0)
    monkeypatch.setattr(u, "MAX_KEYS", 0)
    assert judged(spark, urls, listed) == want


def test_odd_rows(spark):
    long = "http://a.example.org/es/" + "x/" * 200_000
    rows = [(None, long), (None, long), (5, "HTTP://m.EXAMPLE.org/es/?a")]
    pages = spark.createDataFrame([(i, x, "c", "c", 0, "c") for i, x in rows], SCHEMA)
    found = u.verdicts(pages, u.inline(spark, u.RULES, "host path action"), None).collect()
    assert sorted((r.page_id is None, len(r.path), r.rule, r.verdict) for r in found) == [(False, 4, "org/es/", "block")] + [(True, 4 + 400_000, "org/es/", "block")] * 2


def test_empty_tables(spark):
    assert judged(spark, []) == []
    assert judged(spark, ["http://a.b/c"], []) == [("a.b", "/c", None, "allow")]
