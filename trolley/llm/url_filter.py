"""URL filters: host and path rules, and a path-template tree judged by labelled purity.

Each host has a tree of path segments, grown a level at a time over all urls
of nodes with labels of both kinds, to any depth. A segment whose labelled share
differs statistically from the rest of its node stands alone, a rare one from
``HANDFUL`` labels on. At a node with many different segments the other rare
ones are variable and become a wildcard (their file ending stays, if these
differ); all others are merged into ``*``. A template
is rejected if its smoothed share of bad labels reaches ``REJECT``: the share
is drawn towards the host's, and the host's towards that of all urls.

Urls are grouped first, so copies and hot hosts are counts before any join;
nothing is collected.

Defined results: a null url or one without ``://`` has an empty host and path,
which are a host and a template like others; a template without labels is allowed; repeated urls count as often as they occur; without labels
nothing is rejected; an empty table gives an empty result; other columns
of the pages stay.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trolley.llm import html_text
from trolley.llm.near import BROADCAST_ROWS
from trolley.llm.shared import settle, table

#: (action, host, start of the path) of the registered query.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: A node with this many different segments is variable below; a segment with at most this share of it is rare.
MIN_VARIABLE, RARE_SHARE = 8, 0.05
#: Standard errors by which a branch must differ from its siblings to stand alone.
APART = 2.58
#: Labels with which a rare segment is compared for itself.
HANDFUL = 5
#: Pseudo-counts of the parent's share, and the smoothed share from which a template is rejected.
WEIGHT, REJECT = 8.0, 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """(rule, action) of the longest fitting rule, or null; a bounded list of rules, written into the plan."""
    found = F.lit(None).cast("struct<rule:string,action:string>")
    for action, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(action).alias("action"))).otherwise(found)
    return found


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _differs() -> Column:
    """Whether a branch's labelled share differs from that of the rest of its node (t_labelled, t_bad)."""
    rest, rest_bad = F.col("t_labelled") - F.col("labelled"), F.col("t_bad") - F.col("bad")
    pooled = F.col("t_bad") / F.col("t_labelled")
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.col("labelled") + 1 / rest))
    differs = F.abs(F.col("bad") / F.col("labelled") - rest_bad / rest) > error * APART
    return F.when((F.col("labelled") > 0) & (rest > 0), differs).otherwise(False)


def templates(urls: DataFrame) -> DataFrame:
    """(host, path, template) of distinct urls; ``urls``: host, path, n, labelled, bad."""
    parts = F.filter(F.split("path", "/", -1), lambda s: s != "")
    grown = urls.select("host", "path", "n", "labelled", "bad", parts.alias("parts"), F.lit("").alias("template"))
    grown = settle(grown, "urls")
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "bad")]
    done, level = [], 0
    while True:
        # Below a node without labels of both kinds no branch differs, so all is variable there.
        mixed = grown.groupBy("host", "template").agg(F.sum("labelled").alias("own"), F.sum("bad").alias("own_bad"))
        mixed = mixed.where((F.col("own_bad") > 0) & (F.col("own_bad") < F.col("own"))).select("host", "template", F.lit(True).alias("open"))
        grown = grown.join(_small(settle(mixed, "mixed")), ["host", "template"], "left")
        open_ = F.coalesce("open", F.lit(False)) & (F.size("parts") > level)
        grown = settle(grown.withColumn("open", open_), "urls")
        left = F.concat("template", F.repeat(F.lit("/*"), F.greatest(F.lit(0), F.size("parts") - level)))
        done.append(grown.where("not open").withColumn("template", left).drop("open"))
        grown = grown.where("open").drop("open")
        if grown.isEmpty():
            break
        segment = F.get("parts", F.lit(level)).alias("segment")
        leaves = grown.select("host", "template", segment, "n", "labelled", "bad")
        leaves = settle(leaves.groupBy("host", "template", "segment").agg(*sums), "segments")
        node = leaves.groupBy("host", "template").agg(
            F.count(F.lit(1)).alias("kinds"),
            F.sum("n").alias("all"),
            F.sum("labelled").alias("t_labelled"),
            F.sum("bad").alias("t_bad"),
        )
        node = _small(settle(node, "nodes"))
        branches = leaves.join(node, ["host", "template"])
        rare = (F.col("kinds") >= MIN_VARIABLE) & (F.col("n") <= F.col("all") * RARE_SHARE)
        alone = _differs() & (~rare | (F.col("labelled") >= HANDFUL))
        wild = F.concat(F.lit("*"), F.regexp_extract("segment", r"(\.[A-Za-z][A-Za-z0-9]{0,4})$", 1))
        branch = F.when(alone, F.col("segment")).when(rare, wild).otherwise("*")
        branches = branches.select("host", "template", "segment", alone.alias("alone"), branch.alias("branch"), "n", "labelled", "bad")
        branches = settle(branches, "branches")
        shares = branches.where("not alone").groupBy("host", "template", "branch").agg(*sums).join(node, ["host", "template"])
        merged = shares.select("host", "template", "branch", F.when(_differs(), F.col("branch")).otherwise("*").alias("to"), F.lit(False).alias("alone"))
        named = branches.join(_small(settle(merged, "merged")), ["host", "template", "branch", "alone"], "left")
        named = settle(named.select("host", "template", "segment", F.coalesce("to", "branch").alias("to")), "named")
        grown = grown.withColumn("segment", segment).join(_small(named), ["host", "template", "segment"])
        grown = grown.withColumn("template", F.concat("template", F.lit("/"), "to")).drop("segment", "to")
        level += 1
    grown = done[0]
    for more in done[1:]:
        grown = grown.unionByName(more)
    return grown


def judge(pages: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """``pages`` (url and others) with host, path, rule, verdict, template, bad_share.

    labelled: (url, bad) with bad 0 or 1, any number of rows for a url.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    marks = labelled.select(*[x.alias(n) for x, n in zip(host_and_path(F.col("url").cast("string")), ("host", "path"))], "bad")
    marks = marks.groupBy("host", "path").agg(F.count("bad").alias("labelled"), F.sum("bad").alias("bad"))
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), host.alias("host"), path.alias("path"))
    counts = rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")).join(marks, ["host", "path"], "left")
    counts = counts.fillna(0, ["labelled", "bad"])
    grown = templates(counts)
    sums = [F.sum(c).alias(c) for c in ("labelled", "bad")]
    by_template = grown.groupBy("host", "template").agg(*sums)
    by_host = by_template.groupBy("host").agg(*[F.sum(c).alias(f"host_{c}") for c in ("labelled", "bad")])
    everywhere = by_template.agg(*sums).first()
    prior = (everywhere["bad"] or 0) / max(1, everywhere["labelled"] or 0)
    host_share = (F.col("host_bad") + WEIGHT * prior) / (F.col("host_labelled") + WEIGHT)
    share = (F.col("bad") + host_share * WEIGHT) / (F.col("labelled") + WEIGHT)
    share = F.when(F.col("labelled") > 0, share)  # no verdict without a label of its own
    by_template = by_template.join(_small(settle(by_host, "hosts")), "host").select("host", "template", share.alias("bad_share"))
    judged = grown.select("host", "path", "template").join(_small(settle(by_template, "templates")), ["host", "template"])
    out = rows.join(_small(settle(judged, "judged")), ["host", "path"], "left").withColumn("ruled", ruled(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("ruled.action"), F.when(F.col("bad_share") >= REJECT, "block").otherwise("allow"))
    return out.select("row.*", "host", "path", F.col("ruled.rule").alias("rule"), verdict.alias("verdict"), "template", "bad_share")


_BLANK = " \t\n\x0b\x0c\r"


def labels_by_content(pages: DataFrame, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad): pages whose article without headings is the text of a labelled document, white space apart.

    bad: 1 if the document's quality is 0 or it is toxic.
    """
    bad = F.greatest(1 - F.coalesce("quality", F.lit(1)), F.coalesce("toxic", F.lit(0))).cast("int").alias("bad")
    hashed = documents.select("doc_id", F.xxhash64(F.translate("text", _BLANK, "")).alias("h"))
    known = hashed.join(labels.select("doc_id", bad), "doc_id").groupBy("h").agg(F.max("bad").alias("bad"))
    texts = html_text.extract(pages, F.col("url"), headings=False).where("text != ''")
    texts = texts.select(F.col("key").alias("url"), F.xxhash64(F.translate("text", _BLANK, "")).alias("h"))
    return texts.join(known, "h").select("url", "bad")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    pages = table(spark, sf_dir, "pages")
    marks = labels_by_content(pages, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    found = judge(pages.select("page_id", "url"), settle(marks, "marks"))
    return found.select("page_id", "host", "path", "rule", "verdict", "template", "bad_share")
