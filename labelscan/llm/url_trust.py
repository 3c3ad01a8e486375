"""URL filtering by rules and, where no rule fits, by trust that flows over a graph of hosts.

Hosts are linked by the links of their pages and, both ways, with the domain they are a subdomain of. A
personalised PageRank starts from hosts whose pages the rules allow (trust, along the links) and another one
from hosts whose pages the rules block (distrust, against the links: who links to blocked hosts is suspect).
A host is blocked if its distrust exceeds ``THRESHOLD`` times its trust.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscan.llm.common import pick, staged

#: (verdict, rule): host and path prefix.
RULES = (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
)

#: Share of a host's rank that flows on, rounds, weight of the link to the parent domain, and the threshold.
DAMPING, ROUNDS, PARENT_WEIGHT, THRESHOLD = 0.7, 15, 1.0, 1.0

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Link targets with a host of their own.
LINK = r"""(?i)href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def parse(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    rest = F.when(F.locate("://", url) > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), CAPITALS, SMALL)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as a struct (verdict, rule), else null."""
    out = None
    for verdict, rule in sorted(rules, key=lambda x: (-len(x[1]), x[1])):
        domain, slash, prefix = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + prefix)
        found = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(a, b, w): weights of the links between hosts of ``pages`` (host, html), parents included."""
    links = pages.where("host <> ''").select(F.col("host").alias("a"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), 1)).alias("b"))
    links = links.select("a", F.translate("b", CAPITALS, SMALL).alias("b")).where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("w"))
    hosts = pages.where("host <> ''").select(F.col("host").alias("a")).distinct().union(links.select(F.col("b").alias("a")))
    up = _domains(hosts.distinct())
    both = up.union(up.select(F.col("b").alias("a"), F.col("a").alias("b"))).select("a", "b", F.lit(PARENT_WEIGHT).alias("w"))
    return links.union(both).groupBy("a", "b").agg(F.sum("w").alias("w"))


def _domains(hosts: DataFrame) -> DataFrame:
    """(a, b): every host or domain with more than two labels, and the domain above it."""
    labels = F.split("a", r"\.")
    name = lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    steps = F.when(F.size(labels) > 2, F.transform(F.sequence(F.lit(1), F.size(labels) - 2), lambda i: F.struct(name(i).alias("a"), name(i + 1).alias("b"))))
    return hosts.select(F.explode(steps).alias("x")).select("x.a", "x.b").distinct()


def spread(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust) after ``rounds`` rounds; seeds: (host, good, bad), edges: (a, b, w).

    Hosts without a link that way keep what would flow on.
    """
    total = seeds.agg(F.sum("good"), F.sum("bad")).first()
    good, bad = (x or 1.0 for x in total)
    named = edges.select(F.col("a").alias("host")).union(edges.select(F.col("b").alias("host"))).union(seeds.select("host")).distinct()
    start = named.join(seeds, "host", "left").select("host", (F.coalesce("good", F.lit(0.0)) / good).alias("good"), (F.coalesce("bad", F.lit(0.0)) / bad).alias("bad"))
    start = staged(start)
    out, into = edges.groupBy("a").agg(F.sum("w").alias("out")), edges.groupBy("b").agg(F.sum("w").alias("into"))
    shares = edges.join(out, "a").join(into, "b").select("a", "b", (F.col("w") / F.col("out")).alias("t"), (F.col("w") / F.col("into")).alias("d"))
    zero = F.lit(0.0)
    loops_t = start.select("host").join(out, F.col("host") == F.col("a"), "left_anti").select(F.col("host").alias("a"), F.col("host").alias("b"), F.lit(1.0).alias("t"), zero.alias("d"))
    loops_d = start.select("host").join(into, F.col("host") == F.col("b"), "left_anti").select(F.col("host").alias("a"), F.col("host").alias("b"), zero.alias("t"), F.lit(1.0).alias("d"))
    flows = shares.select("a", "b", "t", zero.alias("d")).union(shares.select(F.col("b").alias("a"), F.col("a").alias("b"), zero.alias("t"), "d")).union(loops_t).union(loops_d)
    flows = staged(flows.groupBy("a", "b").agg(F.sum("t").alias("t"), F.sum("d").alias("d")))
    rank = start.select("host", F.col("good").alias("trust"), F.col("bad").alias("distrust"))
    for _ in range(rounds):
        moved = rank.join(flows, F.col("host") == F.col("a")).groupBy("b").agg(F.sum(F.col("trust") * F.col("t")).alias("mt"), F.sum(F.col("distrust") * F.col("d")).alias("md"))
        rank = staged(
            start.join(moved, F.col("host") == F.col("b"), "left").select(
                "host",
                (F.col("good") * (1 - damping) + F.coalesce("mt", zero) * damping).alias("trust"),
                (F.col("bad") * (1 - damping) + F.coalesce("md", zero) * damping).alias("distrust"),
            )
        )
    return rank


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every row of ``pages`` (page_id, url, html).

    Urls without ``://`` and null urls have an empty host; no rule fits them and they are allowed. Hosts that
    neither trust nor distrust reaches are allowed. Repeated rows are judged row by row and count as often as
    seeds. An empty table gives no rows.
    """
    rows = pick(pages, page_id="long", url="string", html="string")
    host, path = parse(F.col("url"))
    seen = rows.select("page_id", host.alias("host"), path.alias("path"), "html")
    fit = rule_of(F.col("host"), F.col("path"), rules)
    judged = seen.select("page_id", "host", "path", "html", fit.alias("fit"))
    good, bad = (F.sum(F.when(F.col("fit.verdict") == v, 1.0).otherwise(0.0)) for v in ("allow", "block"))
    seeds = staged(judged.where("host <> ''").groupBy("host").agg(good.alias("good"), bad.alias("bad")))
    edges = staged(host_edges(seen))
    rank = spread(edges, seeds)
    method = F.when(F.coalesce("distrust", F.lit(0.0)) > F.coalesce("trust", F.lit(0.0)) * threshold + 1e-12, "block").otherwise("allow")
    joined = judged.drop("html").join(rank, "host", "left")
    return joined.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", method).alias("verdict"), "trust", "distrust")
