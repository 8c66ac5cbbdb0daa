from __future__ import annotations

from collections import Counter

from trolley.llm import url_filter as U


def _judged(spark, urls):
    """Counts of (host, first segment that is named, bad, verdict); ``urls``: (url, bad), every one labelled."""
    pages = spark.createDataFrame([(u,) for u, _ in urls], "url string")
    rows = U.judge(pages, spark.createDataFrame(urls, "url string, bad int")).collect()
    bad = dict(urls)
    return Counter((bad[r["url"]], r["verdict"]) for r in rows), {r["template"] for r in rows}


def test_a_bad_section_among_many_even_ones(spark):
    urls = [(f"http://hot.org/s{k}/{i}.html", int(k == 7)) for k in range(30) for i in range(20)]
    verdicts, templates = _judged(spark, urls)
    assert verdicts == {(0, "allow"): 580, (1, "block"): 20}
    assert "/s7/*" in templates


def test_a_bad_branch_far_down(spark):
    deep = "http://a.org/" + "/".join("abcdefghijk")
    urls = [(f"{deep}/{part}/{i}", int(part == "spam")) for part in ("news", "spam") for i in range(30)]
    verdicts, templates = _judged(spark, urls)
    assert verdicts == {(0, "allow"): 30, (1, "block"): 30}
    assert templates == {"/*" * 11 + "/news/*", "/*" * 11 + "/spam/*"}
