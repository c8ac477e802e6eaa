import re

from pyspark.sql import functions as F

from threatlens.llm import url_filter as U

URLS = ["http://a.example.org/es/x", "http://example.org/en/12?q", "https://EXAMPLE.org/en/2", "http://x.com/fr/1", "http://com/de/",
        "http://notexample.org/es/", "http://example.org", "http://example.org?x=/es/", None, "", "no url", "ftp://h/p#f", "http://b.org/",
        "http://a.b.example.org:80/es/", "x://://y", "http://example.org/es/", "http://example.org/es/", "://org/es", "http://a.com/DE/",
        "http://" + "s." * 200 + "com/de/" + "p" * 5000]


def brute(url, rules=U.CONTRACT_RULES):
    m = re.match(r"(?s:.*?)://([^/?#]*)([^?#]*)", url or "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]) if m else ""
    path = m[2] if m else ""
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits) if fits else (0, 0, 0, None, "allow")
    return host, path, best[3], best[4]


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "html", "x", "y") for i, u in enumerate(urls)],
                                 "page_id long, url string, html string, verdict string, host string")


def test_matches_brute_force(spark):
    got = {r.page_id: tuple(r)[1:] for r in U.filter_urls(pages(spark, URLS), U.rules_frame(spark)).collect()}
    assert got == {i: brute(u) for i, u in enumerate(URLS)}


def test_precedence_and_repeated_rules(spark):
    rules = [("org", "/a", "allow"), ("org", "/a", "allow"), ("org", "/a", "block"), ("x.org", "/", "allow"), (None, "/", "block")]
    urls = ["http://x.org/a", "http://y.org/a", "http://x.org/b"]
    got = {r.page_id: (r.rule, r.verdict) for r in U.filter_urls(pages(spark, urls), U.rules_frame(spark, rules)).collect()}
    assert got == {0: ("x.org/", "allow"), 1: ("org/a", "block"), 2: ("x.org/", "allow")}


def test_empty_tables(spark):
    assert U.filter_urls(pages(spark, URLS).where("page_id < 0"), U.rules_frame(spark)).collect() == []
    none = U.rules_frame(spark).where("host = ''")
    assert {r.verdict for r in U.filter_urls(pages(spark, URLS), none).collect()} == {"allow"}


def test_null_and_repeated_ids_keep_their_rows(spark):
    df = spark.createDataFrame([(None, "http://a.com/de/"), (1, "http://a.com/de/"), (1, None)], "page_id long, url string")
    got = U.filter_urls(df, U.rules_frame(spark)).collect()
    assert sorted((str(r.page_id), r.verdict) for r in got) == [("1", "allow"), ("1", "block"), ("None", "block")]


def test_very_long_urls_take_linear_time(spark):
    import time

    urls = ["http://" + "a." * 1_000_000 + "com/de/x", "http://" + "." * 3_000_000 + "org/x", "http://example.org/es/" + "p/" * 1_000_000,
            "http://" + "x" * 3_000_000, "x" * 3_000_000, " " * 3_000_000, "http://h" + "\n" * 3_000_000, "http://example.org/en/1" + "://" * 900_000]
    t = time.time()
    got = {r.page_id: (r.rule, r.verdict) for r in U.filter_urls(pages(spark, urls), U.rules_frame(spark)).collect()}
    assert got == {i: brute(u)[2:] for i, u in enumerate(urls)}
    assert time.time() - t < 60


def test_any_number_of_rule_lengths_and_shuffled_rules(spark, monkeypatch):
    rules = [("h.org", "/" + "p" * i, "block" if i % 2 else "allow") for i in range(5000)] + [("a." * i + "org", "/q", "block") for i in range(60)]
    urls = ["http://h.org/" + "p" * n for n in (0, 1, 17, 4098, 4999, 6000)] + ["http://" + "a." * n + "org/q" for n in (0, 1, 30, 59, 80)]
    want = {i: brute(u, rules)[2:] for i, u in enumerate(urls)}
    for limit in (16 << 20, 0):
        monkeypatch.setattr(U, "BROADCAST_BYTES", limit)
        got = {r.page_id: (r.rule, r.verdict) for r in U.filter_urls(pages(spark, urls), U.rules_frame(spark, rules)).collect()}
        assert got == want


def test_columns_with_the_names_of_helpers(spark):
    names = ("host", "path", "rule", "verdict", "r_host", "r_path", "r_key", "digest", "key", "suffix", "prefix", "prefixes", "hit_url", "w")
    df = pages(spark, URLS).select("page_id", "url", *[F.lit("x").alias(c) for c in names])
    got = {r.page_id: tuple(r)[1:] for r in U.filter_urls(df, U.rules_frame(spark)).collect()}
    assert got == {i: brute(u) for i, u in enumerate(URLS)}
