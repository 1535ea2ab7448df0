import pytest
from pyspark.sql import functions as F

from tidemark.llm import op11_url_filter as op
from tidemark.llm import queries

RULES = (op.Rule("allow", "good.org", "/"), op.Rule("block", "bad.net", "/"),
         op.Rule("block", "good.org", "/spam"), op.Rule("allow", "org", "/x"))
SCHEMA = "page_id long, url string, html string, host string, verdict string, trust long, kind string"


def _page(i, url, *links, extra=""):
    html = "".join(f'<A class="x"\n HREF = "{x}">t</a>' for x in links) + extra
    return (i, url, html, "clash", "clash", 7, "clash")


def _pages():
    return [
        _page(1, "https://Good.ORG/a?q#f", "http://near.com/x", "//Near.com/y", "/rel", "http://good.org/z"),
        _page(2, "http://near.com/1", "https://far.com"),
        _page(3, "http://sour.com/1", "http://bad.net/p", extra='<a name="n">x</a><a href=http://bad.net>'),
        _page(4, "http://bad.net/", "http://near.com"),
        _page(5, "http://good.org/spam/1"),
        _page(6, "http://alone.com"),
        _page(7, None), (8, "no scheme", None, None, None, None, None), _page(None, "ftp://far.com:21/#"),
        _page(1, "https://Good.ORG/a?q#f", "http://near.com/x"),
        _page(9, "http://deep.a.good.org/x?y=http://bad.net/"),
        _page(10, "http://10.0.0.1/x", extra="<a " * 50_000 + "http://"),
        _page(11, "http://notgood.org/x/y"), _page(12, "http://notgood.org"),
    ]


def _plain(pages, rules, rounds, percent=100):
    """Dictionaries and loops; links by a simple parser."""
    import re
    found = []
    for page_id, url, html, *_ in pages:
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.split(r"[/?#]", rest)[0]
            path = re.split(r"[?#]", rest[len(host):])[0]
            host = "".join(c.lower() if c.isascii() else c for c in host)
        fit = [(len(r.host + r.path), r) for r in rules
               if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        found.append((page_id, host, path, max(fit)[1] if fit else None, html or ""))
    edges, hosts = set(), {f[1] for f in found if f[1]}
    for _, host, _, _, html in found:
        for to in re.findall(r'(?is)<a\s[^<>]*?href\s*=\s*["\']?(?:[a-z][a-z0-9+.-]*:)?//([^"\'<>/?#\s]+)', html):
            if host and to.lower() != host:
                edges.add((host, to.lower()))
                hosts.add(to.lower())
    for host in hosts:
        labels = host.split(".")
        if not re.search(r"(^|\.)[0-9]*(:[0-9]*)?$", host):
            for i in range(1, len(labels) - 1):
                a, b = ".".join(labels[i - 1:]), ".".join(labels[i:])
                edges |= {(a, b), (b, a)}
    ranks = {}
    for kind, verdict in (("trust", "allow"), ("distrust", "block")):
        flow = [(a, b) if kind == "trust" else (b, a) for a, b in edges]
        out = {a: sum(x == a for x, _ in flow) for a, _ in flow}
        restart = {}
        for host in hosts:
            ruled = [r.verdict for _, h, _, r, _ in found if h == host and r]
            if verdict in ruled:
                restart[host] = op.UNIT * ruled.count(verdict) // len(ruled) * 3 // 20
        rank = dict(restart)
        for _ in range(rounds):
            new = dict(restart)
            for a, b in flow:
                new[b] = new.get(b, 0) + rank.get(a, 0) * 17 // (20 * out[a])
            rank = new
        ranks[kind] = rank
    rows = []
    for page_id, host, path, rule, _ in found:
        t, d = (ranks[k].get(host, 0) for k in ("trust", "distrust"))
        rows.append((page_id, host, path, rule and rule.host + rule.path,
                     rule.verdict if rule else "block" if d * 100 > t * percent else "allow", t, d))
    return sorted(rows, key=str)


@pytest.mark.parametrize("rounds", [0, 1, 7])
def test_against_plain_walk(spark, rounds):
    rows = _pages()
    got = op.judge(spark.createDataFrame(rows, SCHEMA), RULES, rounds)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "trust", "distrust"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == _plain(rows, RULES, rounds)


def test_links_carry_trust_and_distrust(spark):
    got = {r["page_id"]: r for r in op.judge(spark.createDataFrame(_pages(), SCHEMA), RULES).collect()}
    assert got[3]["verdict"] == "block" and got[3]["distrust"] > 0 == got[3]["trust"]  # links to a blocked host
    assert got[2]["verdict"] == "allow" and got[2]["trust"] > 0                        # linked from a trusted one
    assert got[6]["verdict"] == got[7]["verdict"] == "allow"                           # nothing reaches them
    assert got[5]["rule"] == "good.org/spam" and got[12]["rule"] is None
    assert got[11]["rule"] == "org/x" and got[9]["rule"] == "good.org/"


def test_seed_tables_and_percent(spark):
    pages = spark.createDataFrame([_page(1, "http://a.com/", "http://b.com"), _page(2, "http://b.com/"),
                                   _page(3, "http://c.com/", "http://b.com")], SCHEMA)
    hosts = lambda *h: spark.createDataFrame([(x,) for x in h], "host string")
    run = lambda **k: {r["page_id"]: r["verdict"] for r in op.judge(pages, (), **k).collect()}
    assert run(blocked=hosts("B.com")) == {1: "block", 2: "block", 3: "block"}
    assert run(blocked=hosts("b.com"), trusted=hosts("a.com")) == {1: "allow", 2: "block", 3: "block"}
    assert run(blocked=hosts("b.com"), trusted=hosts("a.com"), percent=10 ** 6)[2] == "allow"
    with pytest.raises(ValueError):
        op.judge(pages, [op.Rule("allow", str(i), "/") for i in range(op.MOST_RULES + 1)])


def test_hub_is_split(spark):
    """A hub with all edges, split by their other ends, gives the plain ranks."""
    n = 300
    edges = spark.createDataFrame([("hub", f"h{i}") for i in range(n)] + [("h0", "hub")], "a string, b string")
    seed = spark.createDataFrame([("trust", "hub", op.UNIT)], "kind string, host string, seed long")
    got = {r["host"]: r["trust"] for r in op.propagate(edges, seed, 2).collect()}
    restart = op.UNIT * 3 // 20
    first = restart * 17 // (20 * n)
    hub = restart + first * 17 // 20
    assert got == {"hub": hub} | {f"h{i}": first for i in range(n)}


def test_empty_and_native(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert op.judge(empty, queries.URL_RULES, 2).collect() == []
    plan = op.judge(spark.createDataFrame(_pages(), SCHEMA), RULES, 1)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rules_on_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.op11_host_trust(spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/pages.parquet").count()
    bad = got.filter((F.col("rule") == "org/") & (F.col("verdict") != "allow")
                     | F.col("rule").like("example.org%") & (F.col("verdict") != "block"))
    assert bad.count() == 0
