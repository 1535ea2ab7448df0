"""URL filter: host and path rules, and trust propagated over the host graph.

1. A url's host and path are matched with a short list of rules (``addresses``).
2. Host edges: the hosts that a page's ``<a href>`` links name, and, since a
   domain answers for its subdomains and is judged by them, an edge both ways between a host
   and the domain above it (``a.b.c`` and ``b.c``; top-level labels are no domains).
3. Personalised PageRank from trusted seeds over the edges, and the same from
   blocked seeds over the reversed edges (who links to a blocked host is
   distrusted).  A host is a seed by the share of its ruled urls that are
   allowed or blocked.  A fixed number of rounds in whole numbers (``UNIT`` for a full
   seed, shares rounded down), so the order of sums does not matter and equal
   graphs give equal ranks.
4. A host whose distrust is above ``percent`` hundredths of its trust is blocked.

All of it is DataFrame operations.  Skew: edges are distinct pairs, counted with
partial aggregates.  The edges of a host that has more than 1/2000 of them
(at most 4000 such hosts, both ways) are split into ``PARTS`` by their other end, and the host's
rank is sent to each part; a rank is divided by the degree before the join, so no
edge is joined for it.  Pages get their host's ranks by ``join_spread``: of hosts
with more than 1/2000 of the pages, at most 2000, by broadcast, the others by
shuffle.  Five rounds at a time are written to the shared folder, which cuts the
lineage.  No links, ranks or hosts come to the driver.

Cases: a null url, or one without ``://``, has an empty host and path, fits no
rule and is in no graph; its verdict is that of a host without ranks (allow).  Null
html has no links.  Equal trust and distrust: allow (for percent 100).  Of two
rules of one length the one with the longer host wins, then the earlier.
Repeated rows are judged each by itself; links of repeated pages count once.  A
text of any length is searched whole: a link's pattern stays within its tag.
Empty tables give no rows.  Other columns are not read; the result has the id's
and its own columns only.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import join_spread, written

#: rank of a host all of whose ruled urls are allowed (or blocked), before damping
UNIT = 10 ** 9
#: damping 17/20: of a rank that much goes on over the edges
ON, OF = 17, 20
PARTS = 64
#: an edge list longer than this share of all edges is split
HOT = 2000
#: rounds between two written tables
STRIDE = 5
MOST_RULES = 500
ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: the host of an absolute or scheme-relative link, within one tag
LINK = (r"(?i)<a[ \t\r\n\f][^<>]*?href[ \t\r\n\f]*=[ \t\r\n\f]*[\"']?"
        r"(?:[a-z][a-z0-9+.-]*:)?//([^\"'<>/?# \t\r\n\f]+)")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), ADDRESS, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), ADDRESS, 2)


def fitting(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest fitting rule's text and verdict (null where none fits)."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; an expression takes {MOST_RULES}. "
                         "Give long lists of hosts as tables (trusted, blocked)")
    longest = sorted(rules, key=lambda r: (-len(r.host + r.path), -len(r.host)))
    text = verdict = F.lit(None).cast("string")
    for r in reversed(longest):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        text = F.when(fits, F.lit(r.host + r.path)).otherwise(text)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def addresses(pages: DataFrame, rules: Sequence[Rule], page_id: str = "page_id",
              url: str = "url") -> DataFrame:
    """page_id, host, path, rule, ruled (the rule's verdict)."""
    found = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"),
                         path_of(F.col(url)).alias("path"))
    text, verdict = fitting(rules, F.col("host"), F.col("path"))
    return found.select("page_id", "host", "path", text.alias("rule"), verdict.alias("ruled"))


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Distinct (a, b): a page of host a links to host b."""
    named = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(LINK), 1))
    return (pages.select(host_of(F.col(url)).alias("a"), named.alias("named"))
            .filter("a <> '' and size(named) > 0")
            .select("a", F.explode("named").alias("b"))
            .select("a", F.translate("b", UPPER, LOWER).alias("b"))
            .filter("a <> b").distinct())


def domain_edges(hosts: DataFrame) -> DataFrame:
    """Distinct (a, b) both ways between a host, or domain, and the one above
    it, up to two labels.  Numeric addresses have no domains."""
    label = F.split("host", r"\.")
    n = F.size(label)

    def domain(i: Column) -> Column:  # without its first i labels
        return F.array_join(F.slice(label, i + 1, n - i), ".")

    steps = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.struct(
        domain(i - 1).alias("a"), domain(i).alias("b")))
    up = (hosts.filter((n > 2) & ~F.col("host").rlike(r"(^|\.)[0-9]*(:[0-9]*)?$"))
          .select(F.explode(steps).alias("e")).select("e.*").filter("a <> b").distinct())
    return up.union(up.select("b", "a"))


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Distinct (a, b) of links and domains, written."""
    links = written(link_edges(pages, url, html), "links")
    hosts = (pages.select(host_of(F.col(url)).alias("host")).distinct()
             .union(links.select(F.col("b"))).distinct())
    return written(links.union(domain_edges(hosts)).distinct(), "host-edges")


def seeds(found: DataFrame, trusted: DataFrame | None = None,
          blocked: DataFrame | None = None) -> DataFrame:
    """kind, host, seed: by the share of the host's ruled urls that are allowed
    or blocked.  ``trusted`` and ``blocked``, tables with a column host, count
    as full seeds beside them; the larger one holds."""
    counted = (found.filter("ruled is not null and host <> ''").groupBy("host")
               .agg(F.count_if(F.col("ruled") == "allow").alias("allow"),
                    F.count(F.lit(1)).alias("n")))
    parts = [counted.select(F.lit(kind).alias("kind"), "host",
                            F.expr(f"{UNIT} * {of} div n").alias("seed"))
             for kind, of in (("trust", "allow"), ("distrust", "(n - allow)"))]
    for kind, table in (("trust", trusted), ("distrust", blocked)):
        if table is not None:
            parts.append(table.select(F.lit(kind), F.translate("host", UPPER, LOWER),
                                      F.lit(UNIT).cast("long")))
    return (reduce(DataFrame.union, parts).filter("seed > 0 and host <> ''")
            .groupBy("kind", "host").agg(F.max("seed").alias("seed")))


def propagate(edges: DataFrame, seed: DataFrame, rounds: int = 20) -> DataFrame:
    """host, trust, distrust after ``rounds`` rounds of both walks."""
    flow = edges.select(F.lit("trust").alias("kind"), F.col("a").alias("host"),
                        F.col("b").alias("to")).union(
        edges.select(F.lit("distrust"), F.col("b"), F.col("a")))
    degree = written(flow.groupBy("kind", "host").agg(F.count(F.lit(1)).alias("degree")), "degrees")
    most = edges.count() // HOT
    hot = F.broadcast(degree.filter(F.col("degree") > most).select("kind", "host", F.lit(1).alias("hot")))
    flow = written(flow.join(hot, ["kind", "host"], "left").select(
        "kind", "host", "to",
        F.when(F.col("hot").isNotNull(), F.pmod(F.xxhash64("to"), F.lit(PARTS))).otherwise(0)
        .cast("int").alias("part")), "flow")

    def folded(rows: DataFrame) -> DataFrame:
        return rows.groupBy("kind", "host").agg(F.sum("degree").alias("degree"),
                                                F.sum("rank").alias("rank"))

    none = F.lit(0).cast("long")
    restart = written(folded(
        seed.select("kind", "host", none.alias("degree"),
                    F.expr(f"seed * {OF - ON} div {OF}").alias("rank"))
        .union(degree.select("kind", "host", "degree", none))), "restart")
    ranks = restart
    for k in range(rounds):
        sent = (ranks.filter("rank > 0 and degree > 0").select(
            "kind", "host", F.expr(f"rank * {ON} div ({OF} * degree)").alias("share"),
            F.explode(F.sequence(F.lit(0), F.when(F.col("degree") > most, PARTS - 1).otherwise(0)))
            .alias("part")))
        ranks = folded(flow.join(sent, ["kind", "host", "part"]).select(
            "kind", F.col("to").alias("host"), none.alias("degree"), F.col("share").alias("rank"))
            .union(restart))
        if k % STRIDE == STRIDE - 1 or k == rounds - 1:
            ranks = written(ranks, "ranks")

    def of(kind: str) -> Column:
        return F.sum(F.when(F.col("kind") == kind, F.col("rank")).otherwise(none)).alias(kind)

    return ranks.groupBy("host").agg(of("trust"), of("distrust")).filter("trust + distrust > 0")


def judge(pages: DataFrame, rules: Sequence[Rule], rounds: int = 20, percent: int = 100,
          page_id: str = "page_id", url: str = "url", html: str = "html",
          trusted: DataFrame | None = None, blocked: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust (of the host, 0
    where nothing reaches it), a row for each page."""
    found = written(addresses(pages, rules, page_id, url), "addresses")
    ranks = written(propagate(host_edges(pages, url, html), seeds(found, trusted, blocked), rounds),
                    "host-ranks")
    judged = join_spread(found, ranks, "host")
    trust, distrust = (F.coalesce(F.col(c), F.lit(0).cast("long")) for c in ("trust", "distrust"))
    # decimals: a rank times a hundred can pass a long
    worse = (distrust.cast("decimal(20,0)") * 100) > (trust.cast("decimal(20,0)") * percent)
    return judged.select(
        F.col("page_id").alias(page_id), "host", "path", "rule",
        F.coalesce("ruled", F.when(worse, "block").otherwise("allow")).alias("verdict"),
        trust.alias("trust"), distrust.alias("distrust"))
