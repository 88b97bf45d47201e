"""URL filters with redirect equivalence.

Rules (host, path, verdict) judge a url by its host and path: a rule fits its host and every
subdomain of it, if the path starts with the rule's, and the longest rule that fits counts.
Rules are found by equi-joins on the last labels of a host and on a prefix of the path, so a
list of millions costs no scan of it for each url.

Urls that redirect to one another, or that name one canonical url, are aliases: connected
components over the edges of redirects (a table, and ``meta refresh`` of a page) and of
canonical links. A block of one alias, crawled or only named by a link, blocks every alias
that no rule judges. An explicit allow stands: the url that an allow rule fits stays allowed
whatever its aliases are. It does not unblock others.

A url is a node under its normal form: scheme and host in lower case, no default port, no
fragment. Only urls with an edge are nodes, and the component step combines a hub's links
before they move.

Defined results: a null url or one without ``://`` has an empty host and path, fits no rule, has
no aliases and is allowed. Rows are judged one by one, so repeated rows, rows of one id and rows
without an id all come back. Of equal rules an allow counts; of equally long ones that of
the longer host. Rules without a host or with another verdict than allow or block judge nothing. A null
or empty html has no links; links that are no web addresses are none; a page's head is parsed to
its end or to the body, however long it is. Columns other than the id, url and html are not read.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, outlive, stage, staging
from .components import components

LINKED = r"(?i)\bcanonical\b|http-equiv"


def host(url: Column) -> Column:
    """What stands between the first ``://`` and the path, query or fragment, A-Z in lower case."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def normal(url: Column) -> Column:
    """The form under which spellings of one web address are one node; null for other texts."""
    scheme = F.lower(F.regexp_extract(url, "^([A-Za-z]+)://", 1))
    default = F.when(scheme == "http", ":80$").otherwise(":443$")
    site = F.regexp_replace(host(url), default, "")
    query = F.regexp_extract(url, r"://[^?#]*(\?[^#]*)", 1)
    return F.when(scheme.isin("http", "https") & (site != ""), F.concat(scheme, F.lit("://"), site, path(url), query))


def rules(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) as a table."""
    return spark.createDataFrame(rows, "host string, path string, verdict string")


def judge(urls: DataFrame, listed: DataFrame) -> DataFrame:
    """(url, rule, verdict) of each distinct url (column url) that a rule of ``listed`` (host, path, verdict) fits."""
    lower = F.translate("host", string.ascii_uppercase, string.ascii_lowercase)
    told = listed.where("host <> '' and verdict in ('allow', 'block')")
    told = told.select(lower.alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "verdict")
    told = told.groupBy("rule_host", "rule_path").agg(F.min("verdict").alias("verdict"))  # allow before block
    depth = told.agg(F.max(F.size(F.split("rule_host", r"\.")))).first()[0] or 0
    lengths = told.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("lengths"))

    labels = F.slice("labels", -F.least(F.size("labels"), F.lit(depth)), F.least(F.size("labels"), F.lit(depth)))
    parts = urls.where("url is not null").select("url").distinct().select("url", path(F.col("url")).alias("path"), F.split(host(F.col("url")), r"\.").alias("labels"))
    parts = parts.where(F.lit(depth) > 0).select("url", "path", labels.alias("labels"))
    ends = F.transform("labels", lambda _, i: F.array_join(F.slice("labels", i + 1, F.size("labels")), "."))
    reached = parts.select("url", "path", F.explode(ends).alias("rule_host")).join(lengths, "rule_host")
    reached = reached.select("url", "path", "rule_host", F.explode("lengths").alias("n")).where("n <= length(path)")
    fits = reached.withColumn("rule_path", F.expr("substring(path, 1, n)")).join(told, ["rule_host", "rule_path"])
    row = F.struct(F.concat("rule_host", "rule_path").alias("rule"), "verdict")
    best = F.max_by(row, F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host")))
    return fits.groupBy("url").agg(best.alias("best")).select("url", "best.rule", "best.verdict")


class _Head(HTMLParser):
    """Canonical links and refreshes of a page's head."""

    def __init__(self):
        super().__init__()
        self.base, self.found, self.open = None, [], True

    def handle_starttag(self, tag, attributes):
        if not self.open:
            return
        said = {k: v or "" for k, v in reversed(attributes)}  # the first of an attribute counts
        if tag == "body":
            self.open = False
        elif tag == "base" and self.base is None and said.get("href"):
            self.base = said["href"].strip()
        elif tag == "link" and "canonical" in said.get("rel", "").lower().split():
            self.found.append(said.get("href", "").strip())
        elif tag == "meta" and said.get("http-equiv", "").strip().lower() == "refresh":
            _, mark, target = said.get("content", "").partition("=")
            if mark and _.replace(" ", "").lower().endswith(("url", "url'", 'url"')):
                self.found.append(target.strip().strip("'\""))


def targets(url: str, html: str, step: int = 1 << 16) -> list[str]:
    """Absolute addresses that a page's head names as its canonical url or sends its reader to."""
    head = _Head()
    for at in range(0, len(html), step):
        head.feed(html[at : at + step])
        if not head.open:
            break
    out = []
    for target in head.found:
        try:
            base = urljoin(url, head.base) if head.base else url
            if target:
                out.append(urljoin(base, target))
        except ValueError:  # no address
            continue
    return out


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(source, target) of each page's canonical links and refreshes, as written but made absolute."""
    rows = pages.select(F.col(url).alias("url"), F.col(html).alias("html")).where(F.col("url").isNotNull() & F.col("html").rlike(LINKED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("url").to_pylist(), batch.column("html").to_pylist())
            pairs = [(u, t) for u, h in rows for t in targets(u, h)]
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*pairs)], names=["source", "target"])

    return arrow(rows).mapInArrow(run, "source string, target string")


def blocked_aliases(edges: DataFrame, listed: DataFrame) -> DataFrame:
    """(node) of every url, in normal form, that is an alias of a blocked one by ``edges`` (source, target).

    The result is lazy over staged tables; call it within ``staging`` and write it there.
    """
    ends = edges.select(normal(F.col("source")).alias("a"), normal(F.col("target")).alias("b")).where("a <> b").distinct()
    ends = stage(ends, "links")
    named = ends.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    nodes = stage(named.withColumn("id", F.monotonically_increasing_id()), "nodes")  # exact: no hash that could collide
    one, two = (nodes.select(F.col("node").alias(c), F.col("id").alias(f"{c}_id")) for c in ("a", "b"))
    pairs = ends.join(one, "a").join(two, "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    joined = components(pairs)
    of_node = nodes.join(joined.withColumnRenamed("node", "id"), "id")
    blocked = judge(nodes.select(F.col("node").alias("url")), listed).where("verdict = 'block'")
    wrong = of_node.join(blocked.select(F.col("url").alias("node")), "node", "left_semi").select("component").distinct()
    return of_node.join(wrong, "component", "left_semi").select("node")


def filter_pages(
    pages: DataFrame, listed: DataFrame, redirects: DataFrame | None = None, id: str = "page_id", url: str = "url", html: str | None = "html"
) -> DataFrame:
    """(id, url, host, path, rule, verdict) of each page: its rule's verdict, or else block if an alias is blocked.

    ``listed`` has host, path and verdict; ``redirects`` (source, target) adds edges to those of the pages' html.
    """
    spark = pages.sparkSession
    edges = links(pages, url, html) if html else None
    if redirects is not None:
        more = redirects.select(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"))
        edges = more if edges is None else edges.union(more)
    rows = pages.select(F.col(id).alias("id"), F.col(url).alias("url"))
    found = rows.join(judge(rows, listed), "url", "left")
    found = found.withColumn("alias", F.lit(None).cast("string"))
    if edges is not None:
        with staging(spark):
            nodes = outlive(stage(blocked_aliases(edges, listed), "blocked"))
        if not nodes.isEmpty():
            named = nodes.select("node", F.col("node").alias("alias"))
            found = found.drop("alias").withColumn("node", normal(F.col("url"))).join(named, "node", "left")
    verdict = F.coalesce("verdict", F.when(F.col("alias").isNotNull(), "block"), F.lit("allow"))
    return found.select(F.col("id").alias(id), F.col("url").alias(url), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "rule", verdict.alias("verdict"))
