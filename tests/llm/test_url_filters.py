from collections import defaultdict

from tessera.llm import url_filters as uf


def test_parts_and_rules(spark):
    urls = {
        "http://A.Example.COM/en/7x?q#f": ("a.example.com", "/en/7x", "example.com/en/7", "allow"),
        "https://x.com/en/1": ("x.com", "/en/1", "com/en/", "block"),
        "https://com/en/": ("com", "/en/", "com/en/", "block"),
        "https://notexample.net/de/8": ("notexample.net", "/de/8", "net/de/", "allow"),
        "https://b.example.net/de/81": ("b.example.net", "/de/81", "example.net/de/8", "block"),
        "https://xcom/en/": ("xcom", "/en/", None, None),
        "//x.org/es/": ("", "", None, None),
        "http://É.org?/es/": ("É.org", "", None, None),
        None: ("", "", None, None),
        "": ("", "", None, None),
    }
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    host, path = uf.url_parts(df["url"])
    parts = df.withColumn("host", host).withColumn("path", path)
    for limit in (200, 0):
        uf.INLINE_RULES, kept = limit, uf.INLINE_RULES
        got = {r["url"]: (r["host"], r["path"], r["rule"], r["rule_verdict"]) for r in uf.with_rules(parts, uf.RULES).collect()}
        uf.INLINE_RULES = kept
        assert got == urls


def test_propagation_against_the_definition(spark):
    pages = [(1, "http://good.com/de/", "<a href='http://mid.com/x'>"), (2, "http://mid.com/", '<a href="//leaf.com">'), (3, "http://leaf.com/", None), (4, "http://spam.com/en/1", ""), (5, "http://fan.com/", '<A HREF="https://SPAM.com/?a">'), (6, "http://sub.mid.com/", ""), (7, None, None)]
    rules = [("allow", "good.com", "/de/"), ("block", "spam.com", "/en/")]
    df = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in uf.judge(df, rules).collect()}
    edges = {("good.com", "mid.com"), ("mid.com", "leaf.com"), ("fan.com", "spam.com"), ("sub.mid.com", "mid.com"), ("mid.com", "sub.mid.com")}
    for name, seed, pairs in (("trust", "good.com", edges), ("distrust", "spam.com", {(b, a) for a, b in edges})):
        out = defaultdict(int)
        for a, _ in pairs:
            out[a] += 1
        score = {seed: 1.0}
        for _ in range(60):
            new = defaultdict(float)
            lost = sum(v for h, v in score.items() if not out[h])
            new[seed] += 1 - uf.DAMPING + uf.DAMPING * lost
            for a, b in pairs:
                new[b] += uf.DAMPING * score.get(a, 0) / out[a]
            score = new
        assert abs(sum(score.values()) - 1) < 1e-9
        for r in got.values():
            assert abs(r[name] - score.get(r["host"], 0.0)) < 1e-5
    assert {k: r["verdict"] for k, r in got.items()} == {1: "allow", 2: "allow", 3: "allow", 4: "block", 5: "block", 6: "allow", 7: "allow"}


def test_the_test_pages_have_a_graph_and_it_decides(spark):
    from pathlib import Path

    import pytest

    sf = "/root/testdata/sf0.01"
    if not Path(sf).exists():
        pytest.skip("no test tables")
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    host, path = uf.url_parts(pages["url"])
    parts = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    assert uf.host_edges(parts).count() > 50
    seeds = uf.with_rules(parts, uf.RULES).groupBy("host").agg({"rule_verdict": "count"})
    bare = {r["host"] for r in seeds.where("`count(rule_verdict)` = 0").collect()}
    verdicts = {r["host"]: r for r in uf.judge(pages, uf.RULES).where("rule is null").collect()}
    # by its own pages alone such a host would have neither trust nor distrust
    assert any(verdicts[h]["trust"] + verdicts[h]["distrust"] > 0 for h in bare)
    assert any(verdicts[h]["verdict"] == "block" for h in bare)


def test_parents_without_pages_join_their_hosts(spark):
    pages = [(1, "http://a.x.site.com/en/1", None), (2, "http://b.x.site.com/", None), (3, "http://c.other.com/", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in uf.judge(df, [("block", "a.x.site.com", "/en/")]).collect()}
    assert got == {1: "block", 2: "block", 3: "allow"}


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert uf.judge(df, uf.RULES).count() == 0
