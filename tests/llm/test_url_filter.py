from __future__ import annotations

import re
from collections import Counter

import duckdb

from trolley.llm import url_filter as U

LABELS = "url string, bad int"


def brute(url):
    host = path = ""
    if url and "://" in url:
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]
    fits = [(len(h + p), h + p, a) for a, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else None


def test_query(spark, sf):
    urls = dict(duckdb.sql(f"select page_id, url from read_parquet('{sf}/pages.parquet')").fetchall())
    rows = U.op10_url_filter(spark, sf).collect()
    assert sorted(r["page_id"] for r in rows) == sorted(urls)
    for r in rows:
        host, path, rule, verdict = brute(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict or not verdict and r["verdict"] in ("allow", "block")
    labelled = U.labels_by_content(*(spark.read.parquet(f"{sf}/{t}.parquet") for t in ("pages", "documents", "labels")))
    assert labelled.count() > 10


def test_odd_urls(spark):
    urls = [
        None, "abc", "HTTP://Ex.NET", "x://a.b/c?d", "http://a.org#f/g", "http://net/a/b/c/d/e/f/g/h/i/j/k", "http://NET/?q=/",
        "http://xnet/a", "https://a.example.net/en/1", "https://example.com/de/", "https://ÄB.org/fr/ü", "://", "http:///p", "x://h//a//b",
    ]
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls + urls)], "page_id long, url string, source string")
    out = U.judge(pages, spark.createDataFrame([], LABELS))
    assert out.columns[:3] == pages.columns
    rows = out.collect()
    assert len(rows) == 2 * len(urls)
    for r in rows:
        host, path, rule, verdict = brute(r["url"])
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "allow")
    assert U.judge(pages.limit(0), spark.createDataFrame([], LABELS)).collect() == []


def test_bad_branches_stand_alone_and_go(spark):
    pages, labels = [], []
    for host in ("h1", "h2"):
        for part in ("news", "spam"):
            for k in range(60):
                pages.append((len(pages), f"http://{host}.org/{part}/{k}.html"))
                if k % 2:
                    labels.append((pages[-1][1], int((host, part) == ("h1", "spam"))))
    rows = U.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, LABELS)).collect()
    assert Counter((r["host"], r["template"], r["verdict"]) for r in rows) == {
        ("h2.org", "/*/*", "allow"): 120,
        ("h1.org", "/news/*", "allow"): 60,
        ("h1.org", "/spam/*", "block"): 60,
    }


def test_no_verdict_without_own_labels(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x"), (2, "http://b.org/y")], "page_id long, url string")
    rows = U.judge(pages, spark.createDataFrame([("http://a.org/x", 1)] * 30, LABELS)).collect()
    assert {r["page_id"]: r["verdict"] for r in rows} == {1: "block", 2: "allow"}
