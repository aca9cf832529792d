"""URL filters: rules, and link-graph propagation for what no rule reaches.

Rules name a host and the beginning of a path; they hold for the host and its subdomains, the
longest rule wins, block winning over allow at equal length. Each page's (host, path) is looked up
by equi-joins on the host's parents and on path beginnings of the lengths that rules have, so a
large rule set costs no cross join.

Hosts are judged by two walks over the host graph (edges from links in pages, counted once per
page, pre-aggregated, self-links left out). Trust is personalised PageRank from the hosts with
allowed pages, along links: who is linked by the trusted is trusted. Distrust runs against the
links from the hosts with blocked pages: who links to the blocked is distrusted. A host is blocked
if its distrust exceeds ``threshold`` times its trust. Seeds weigh by their share of ruled pages.
The walk of a host without links returns to the seeds. Each round is one join and one aggregation
over hosts, cut by a checkpoint; hosts with very many links (``HUBS`` at most) send their rank by
broadcast, so that no task gets a hub's links. Rounds end when no rank moves by more than ``tol`` of itself, so that
hosts far from the seeds are reached and compared too. Moves shrink by ``damping`` each round and a
reached host keeps a rank above zero, so the rounds do end; ranks below ``LEAST`` count as zero there.

Null urls and those without "://": host and path are empty; rules do not fit; the empty host is
judged like any other. Null html: no links. Repeated rows are judged alike; null ids stay null. No
rules, or none that fit: no seeds, everything is allowed. Columns of the table keep their names;
added ones evade them. Empty input: empty output.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultmill.llm.common import HUBS, LEAF, cut, table, unused

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMPING, TOL, THRESHOLD = 0.85, 1e-8, 1.0
LEAST = 1e-300  # near the smallest number of full precision
HREF = r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]*)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(sites: DataFrame, rules: DataFrame) -> DataFrame:
    """sites(host, path), distinct; rules(action, host, path) -> (host, path, rule, action) where one fits."""
    r = rules.select(F.col("host").alias("rh"), F.col("path").alias("rp"), "action").distinct()
    lengths = r.groupBy("rh").agg(F.collect_set(F.length("rp")).alias("lengths"))  # as many as a host has lengths
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    at = sites.select("host", "path", F.explode(parents).alias("rh")).join(lengths, "rh")
    at = at.select("host", "path", "rh", F.explode("lengths").alias("n")).where(F.length("path") >= F.col("n"))
    fits = at.select("host", "path", "rh", F.expr("substring(path, 1, n)").alias("rp")).join(r, ["rh", "rp"])
    rule = F.concat("rh", "rp")
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length(rule).alias("n"), (F.col("action") == "block").alias("b"), rule.alias("rule"), "action")).alias("m"))
    return best.select("host", "path", F.col("m.rule").alias("rule"), F.col("m.action").alias("action"))


def host_edges(pages: DataFrame) -> DataFrame:
    """pages(host, html) -> (src, dst, n): how many pages of src link to dst, other hosts only."""
    found = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(HREF), 1), lambda u: F.translate(F.regexp_extract(u, r"(?s)^[^/]*//([^/?#]*)", 1), UPPER, LOWER)))
    links = pages.select(F.col("host").alias("src"), F.explode(found).alias("dst"))
    return links.where("dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def walk(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, *, damping: float = DAMPING, tol: float = TOL) -> DataFrame:
    """Personalised PageRank. nodes(host), edges(src, dst, n), seeds(host, mass) -> (host, rank)."""
    total = seeds.agg(F.sum("mass")).first()[0]
    if not total:
        return nodes.select("host", F.lit(0.0).alias("rank"))
    out = cut(edges.groupBy("src").agg(F.sum("n").alias("all"), F.count("*").alias("links")))
    many = F.col("links") > max(LEAF, edges.count() // HUBS)
    hubs = F.broadcast(out.where(many))
    met = edges.join(hubs.select("src", F.col("all").alias("hub")), "src", "left")
    share = (F.col("n") / F.col("all")).alias("w")
    steps = met.where("hub is not null").select("src", "dst", (F.col("n") / F.col("hub")).alias("w"), F.lit(True).alias("hub"))
    steps = cut(steps.unionByName(met.where("hub is null").select("src", "dst", "n").join(out.where(~many), "src").select("src", "dst", share, F.lit(False).alias("hub"))))
    start = nodes.join(seeds, "host", "left").select("host", (F.coalesce("mass", F.lit(0.0)) / F.lit(float(total))).alias("seed"))
    ends = start.join(out.select(F.col("src").alias("host"), many.alias("hub")), "host", "left").select("host", "seed", F.col("hub").isNull().alias("ends"), F.coalesce("hub", F.lit(False)).alias("hub"))
    state = cut(ends.withColumn("rank", F.col("seed")))
    while True:
        back = state.where("ends").agg(F.sum("rank")).first()[0] or 0.0
        ranks = state.select(F.col("host").alias("src"), "rank", "hub")
        sent = steps.where("hub").join(F.broadcast(ranks.where("hub").drop("hub")), "src").unionByName(steps.where("not hub").join(ranks.where("not hub").drop("hub"), "src"))
        moved = sent.groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("rank") * F.col("w")).alias("got"))
        rank = F.col("seed") * (1 - damping + damping * back) + damping * F.coalesce("got", F.lit(0.0))
        new = cut(state.join(moved, "host", "left").select("host", "seed", "ends", "hub", rank.alias("rank"), F.abs(rank - F.col("rank")).alias("moved")))
        state = new.drop("moved")
        if new.where(F.col("moved") > tol * F.col("rank") + LEAST).isEmpty():
            return state.select("host", "rank")


def filter_urls(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD) -> tuple[DataFrame, dict[str, str]]:
    """All rows of pages with host, path, rule, verdict, trust and distrust added."""
    n = unused(("host", "path", "rule", "verdict", "trust", "distrust", "site_host", "site_path"), pages)
    url = pages[f"`{url_col}`"].cast("string")
    sites = cut(pages.select(host_of(url).alias("host"), path_of(url).alias("path")).groupBy("host", "path").agg(F.count("*").alias("pages")))
    fits = cut(ruled(sites.select("host", "path"), rules))
    # links found once per page; only pairs of hosts are kept
    edges = cut(host_edges(pages.select(host_of(url).alias("host"), pages[f"`{html_col}`"].cast("string").alias("html"))))
    nodes = cut(sites.select("host").unionByName(edges.select(F.col("dst").alias("host"))).distinct())
    counted = sites.join(fits, ["host", "path"]).groupBy("host", "action").agg(F.sum("pages").cast("double").alias("mass"))
    trust = walk(nodes, edges, counted.where("action = 'allow'").select("host", "mass"))
    distrust = walk(nodes, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"), counted.where("action = 'block'").select("host", "mass"))
    ranks = cut(trust.withColumnRenamed("rank", "trust").join(distrust.withColumnRenamed("rank", "distrust"), "host"))
    verdict = F.coalesce("action", F.when(F.col("distrust") > F.lit(threshold) * F.col("trust"), "block").otherwise("allow"))
    judged = sites.select("host", "path").join(fits, ["host", "path"], "left").join(ranks, "host").select(F.col("host").alias(n["site_host"]), F.col("path").alias(n["site_path"]), F.col("rule").alias(n["rule"]), verdict.alias(n["verdict"]), F.col("trust").alias(n["trust"]), F.col("distrust").alias(n["distrust"]))
    p = pages.withColumns({n["host"]: host_of(url), n["path"]: path_of(url)})
    out = p.join(judged, (p[n["host"]] == judged[n["site_host"]]) & (p[n["path"]] == judged[n["site_path"]])).drop(n["site_host"], n["site_path"])
    return out, n


RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op3_url_trust(spark: SparkSession, sf_dir: str, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    out, _ = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html"), spark.createDataFrame(rules, "action string, host string, path string"))
    return out.select("page_id", "host", "path", "rule", "verdict")


# ranks by 200 rounds; the walk itself ends when they have settled
OP3_SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, html, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(action, rh, rp) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
sites AS (SELECT host, path, count(*) AS pages FROM p GROUP BY ALL),
fits AS (
  SELECT host, path, rh || rp AS rule, action FROM sites JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY length(rh || rp) DESC, action = 'block' DESC) = 1),
found AS (
  SELECT DISTINCT page_id, html, host AS src, translate(regexp_extract(u, '(?s)^[^/]*//([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst
  FROM (SELECT *, unnest(regexp_extract_all(html, '(?i)<a\s(?:[^>]*?\s)?href\s*=\s*["'']?((?:[a-z][a-z0-9+.-]*:)?//[^"''\s>]*)', 1)) AS u FROM p)),
edges AS (SELECT src, dst, count(*) AS n FROM found WHERE dst <> '' AND src <> dst GROUP BY ALL),
nodes AS (SELECT host FROM sites UNION SELECT dst FROM edges),
mass AS (SELECT host, action, sum(pages)::DOUBLE AS m FROM sites JOIN fits USING (host, path) GROUP BY ALL),
steps AS (
  SELECT 'allow' AS action, src, dst, n / sum(n) OVER (PARTITION BY src) AS w FROM edges
  UNION ALL SELECT 'block', dst, src, n / sum(n) OVER (PARTITION BY dst) FROM edges),
seeds AS (
  SELECT a.action, nodes.host, coalesce(m, 0) / t AS seed, NOT EXISTS (SELECT 1 FROM steps s WHERE s.action = a.action AND s.src = nodes.host) AS ends
  FROM nodes CROSS JOIN (SELECT action, sum(m) AS t FROM mass GROUP BY action) a LEFT JOIN mass ON mass.host = nodes.host AND mass.action = a.action),
walk(i, action, host, r) AS (
  SELECT 0, action, host, seed FROM seeds
  UNION ALL
  SELECT i + 1, action, host, any_value(seed) * 0.15 + 0.85 * sum(x) FROM (
    SELECT walk.i, s.action, s.host, s.seed, walk.r * coalesce(w, CASE WHEN f.ends THEN s.seed ELSE 0 END) AS x
    FROM walk JOIN seeds f ON f.action = walk.action AND f.host = walk.host JOIN seeds s ON s.action = walk.action
    LEFT JOIN steps ON steps.action = walk.action AND steps.src = walk.host AND steps.dst = s.host
    WHERE walk.i < 200) GROUP BY i, action, host),
ranks AS (SELECT host, coalesce(sum(r) FILTER (action = 'allow'), 0) AS trust, coalesce(sum(r) FILTER (action = 'block'), 0) AS distrust FROM walk WHERE i = 200 GROUP BY host)
SELECT page_id, p.host, p.path, rule, coalesce(action, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN fits USING (host, path) LEFT JOIN ranks ON ranks.host = p.host
"""
