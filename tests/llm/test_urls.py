import random
import re
from collections import defaultdict

from tallyloom.llm import urls

RULES = [("net", "/", "block"), ("Example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("same.org", "/x", "block"), ("same.org", "/x", "allow"), ("", "/", "block"), ("fr", "/", "maybe")]
SCHEMA = "page_id long, url string, html string, host string, rule string"


def split(url):
    found = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    lower = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)
    return (lower(found[1]), found[2]) if found else ("", "")


def judged(url):
    host, path = split(url)
    best = None
    for h, p, v in sorted(RULES, key=lambda r: r[2]):
        h = h.lower()
        if h and v in ("allow", "block") and (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return best


def node(url):
    found = re.match(r"([A-Za-z]+)://[^/?#]*[^?#]*(\?[^#]*)?", url or "")
    if not found or found[1].lower() not in ("http", "https") or not split(url)[0]:
        return None
    scheme, (host, path) = found[1].lower(), split(url)
    host = re.sub(":80$" if scheme == "http" else ":443$", "", host)
    return f"{scheme}://{host}{path}{found[2] or ''}"


def plain(pages, edges):
    """Verdicts by flooding the whole graph from every blocked node."""
    near = defaultdict(set)
    for a, b in edges:
        a, b = node(a), node(b)
        if a and b and a != b:
            near[a].add(b)
            near[b].add(a)
    seen = {n for n in near if (judged(n) or ("", ""))[1] == "block"}
    todo = list(seen)
    while todo:
        for n in near[todo.pop()] - seen:
            seen.add(n)
            todo.append(n)
    out = []
    for id, url, *_ in pages:
        found = judged(url)
        out.append((id, *split(url), found and found[0], found[1] if found else "block" if node(url) in seen else "allow"))
    return sorted(out, key=str)


def rows(frame):
    return sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in frame.collect()), key=str)


def page(id, url, html=None):
    return id, url, html, "clash", "clash"


def test_rules_and_aliases_equal_a_flood(spark):
    rng = random.Random(4)
    hosts = ["a.net", "www.example.net", "example.com", "b.example.com", "x.org", "free.io", "other.io:80", "UP.IO"]
    pool = [f"{rng.choice(['http', 'https', 'HTTP'])}://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'fr', 'x'])}/{i}{rng.choice(['', '?a=1', '#top'])}" for i in range(120)]
    pages = [page(i, u, f'<html><head><link href="{rng.choice(pool).replace("&", "&amp;")}" rel="alternate canonical"></head>' if rng.random() < 0.3 else "<p>canonical</p>") for i, u in enumerate(pool)]
    edges = [(p[1], re.search('href="([^"]*)"', p[2])[1]) for p in pages if "href" in p[2]]
    redirects = [(rng.choice(pool), rng.choice(pool)) for _ in range(15)]
    table = spark.createDataFrame(redirects, "source string, target string")
    got = rows(urls.filter_pages(spark.createDataFrame(pages, SCHEMA), urls.rules(spark, RULES), table))
    assert got == plain(pages, edges + redirects)
    assert {v for *_, rule, v in got if rule is None} == {"allow", "block"}


def test_a_long_chain_and_a_hub_share_a_block_and_an_allow_stands(spark):
    chain = [f"http://c.io/{i}" for i in range(60)]
    edges = list(zip(chain, chain[1:])) + [(f"http://hub{i}.io/", chain[-1]) for i in range(300)]
    edges += [(chain[0], "https://never.crawled.net/"), ("http://ok.example.net/en/1", chain[3]), ("http://apart.io/", "http://apart.io/2")]
    pages = [page(i, u) for i, u in enumerate(sorted({a for a, _ in edges}))]
    got = rows(urls.filter_pages(spark.createDataFrame(pages, SCHEMA), urls.rules(spark, RULES), spark.createDataFrame(edges, "source string, target string")))
    assert got == plain(pages, edges)
    verdicts = {(host, path): v for _, host, path, _, v in got}
    assert verdicts["ok.example.net", "/en/1"] == "allow" and verdicts["apart.io", "/"] == "allow" and verdicts["hub299.io", "/"] == "block"


def test_links_of_a_head(spark):
    url = "https://a.io/dir/page?x=1"
    assert urls.targets(url, '<link rel=canonical href="/other?a=1&amp;b=2#t">') == ["https://a.io/other?a=1&b=2#t"]
    assert urls.targets(url, "<META HTTP-EQUIV='Refresh' content='0; URL=next.html'>") == ["https://a.io/dir/next.html"]
    assert urls.targets(url, '<base href="//b.io/q/"><link rel=canonical href=x>') == ["https://b.io/q/x"]
    assert urls.targets(url, '<!-- <link rel=canonical href="/no"> --><script>"<link rel=canonical href=/no>"</script>') == []
    assert urls.targets(url, '<body><link rel=canonical href="/no">') == []
    assert urls.targets(url, '<meta http-equiv="refresh" content="30"><link rel=canonical href="http://[bad">') == []
    assert urls.targets(url, "<p>" * 100_000 + '<link rel=canonical href="/far">') == ["https://a.io/far"]


def test_odd_pages(spark):
    long = "http://" + "a." * 20_000 + "net/" + "p" * 50_000
    pages = [page(None, None, None), page(1, ""), page(1, "no scheme.net/"), page(2, "http://x.net"), page(2, "http://x.net"), page(3, "http://X.NET/A?b"), page(4, "://net/"),
             page(5, long, "canonical"), page(6, "ftp://a.net/", '<link rel=canonical href="http://a.io/">'), page(7, "http://same.org/xy"), page(8, "http://ex.fr/")]
    got = rows(urls.filter_pages(spark.createDataFrame(pages, SCHEMA), urls.rules(spark, RULES)))
    assert got == plain(pages, [])
    assert rows(urls.filter_pages(spark.createDataFrame([], SCHEMA), urls.rules(spark, RULES))) == []
    none = urls.filter_pages(spark.createDataFrame(pages, SCHEMA), urls.rules(spark, []), html=None)
    assert {r.verdict for r in none.collect()} == {"allow"}
