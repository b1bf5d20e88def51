"""URL filters: path rules first, then propagation over the host graph, with DataFrame functions only.

Rules (host, path, verdict) fit their host and all its subdomains where the url's path starts with the rule's;
the longest wins. Hosts of pages that an allow rule takes are trusted seeds, those of blocked pages are
distrusted seeds, each with the share of its pages so ruled. Over the distinct host edges of the
pages' absolute links, personalised PageRank carries trust from seeds along links, and the same walk
over reversed links carries distrust from blocked seeds to the hosts that link to them. A page without a rule is blocked
where its host's distrust exceeds `margin` times its trust and either links brought it distrust of a seed that has
`least` times the mean share of a seed, or it has that much itself; else it is allowed. How much links brought
isn't asked, as each of n hosts that link to a seed gets an nth: a seed's linkers are judged alike at any n.

Ranks are fixed-point integers (2**24 to 1), so sums don't depend on their order. Edges and ranks
stay distributed; each round is a join on the source host, where Spark can split a host with many edges, and a
sum with partial aggregation; lineage is cut every few rounds.

Defined results: a null url, or one without ://, has an empty host and path and is judged like any
page of the host ''; repeated rows and urls count as often as they come; links to the page's own host and links
that name no host count for nothing; null html has no links; very long html is read whole; an empty table gives no rows. Other columns
are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zephyrlake.llm.common import Scratch, ascii_lower, read

#: The rules of the query: host, path, verdict.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
ONE = 1 << 24


@dataclass(frozen=True)
class Propagation:
    """damping as a whole percentage; rounds of each walk; lineage is cut every `cut` rounds."""

    damping: int = 85
    rounds: int = 12
    cut: int = 4
    margin: int = 1
    least_percent: int = 1


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without it."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.coalesce(ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ? or # or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule, as its host and path put together, and its verdict; nulls where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def links_of(html: Column) -> Column:
    """Hosts of the absolute links: href values of the form scheme://host or //host."""
    found = F.regexp_extract_all(html, F.lit(r"""(?i)\shref\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^/?#"'\s>]+)"""), F.lit(1))
    return F.transform(found, lambda u: ascii_lower(F.regexp_extract(u, r"//(.*)$", 1)))


def walk(edges: DataFrame, seeds: DataFrame, cfg: Propagation, scratch: Scratch, name: str) -> DataFrame:
    """(host, rank) of hosts with a rank over 0: edges (src, dst), seeds (host, mass), both distinct.

    Each round: rank = (1 - d) mass + d sum of rank / outdegree over the edges in, in whole units.
    """
    degree = edges.groupBy("src").agg(F.count("*").alias("degree"))
    edges = scratch.write(edges.join(degree, "src"), f"{name}-edges")
    start = seeds.select("host", F.expr(f"mass * {100 - cfg.damping} div 100").alias("base"))
    rank = start.select("host", F.col("base").alias("rank"))
    if edges.isEmpty():
        return rank.filter("rank > 0")
    for k in range(cfg.rounds):
        sent = edges.join(rank, F.col("src") == F.col("host")).select(
            F.col("dst").alias("host"), F.expr(f"rank * {cfg.damping} div (100 * degree)").alias("part")
        )
        sent = sent.groupBy("host").agg(F.sum("part").alias("part"))
        rank = sent.join(start, "host", "full").select("host", (F.coalesce("part", F.lit(0)) + F.coalesce("base", F.lit(0))).alias("rank")).filter("rank > 0")
        if (k + 1) % cfg.cut == 0 or k + 1 == cfg.rounds:
            rank = scratch.write(rank, f"{name}-{k}")
    return rank


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES, cfg: Propagation | None = None) -> DataFrame:
    """(id, host, path, rule, verdict, trust, distrust) of each page."""
    cfg = cfg or Propagation()
    scratch = Scratch(pages.sparkSession, "url-graph")
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    seen = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = seen.select(id_col, "host", "path", name.alias("rule"), verdict.alias("ruled"))

    edges = pages.select(
        host.alias("src"), F.explode(F.array_distinct(links_of(F.col(html_col)))).alias("dst")
    ).filter("src <> '' and dst <> '' and src <> dst").distinct()
    edges = scratch.write(edges, "edges")
    share = lambda v: F.floor(F.sum(F.when(F.col("ruled") == v, 1).otherwise(0)) * F.lit(ONE) / F.count("*")).cast("long")
    hosts = scratch.write(ruled.groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("blocked")), "hosts")
    some = F.when(F.col("blocked") > 0, F.col("blocked"))
    mean, least = hosts.agg(F.coalesce(F.floor(F.avg(some)), F.lit(0)).cast("long"), F.coalesce(F.min(some), F.lit(0))).first()
    trust = walk(edges, hosts.filter("allowed > 0").select("host", F.col("allowed").alias("mass")), cfg, scratch, "trust")
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    distrust = walk(turned, hosts.filter("blocked > 0").select("host", F.col("blocked").alias("mass")), cfg, scratch, "distrust")
    strong = (F.col("blocked") > 0) & (F.col("blocked") * 100 >= F.lit(mean) * cfg.least_percent)
    reach = distrust
    if least * 100 < mean * cfg.least_percent:
        reach = walk(turned, hosts.filter(strong).select("host", F.col("blocked").alias("mass")), cfg, scratch, "reach")
    own = F.when(strong, F.expr(f"blocked * {100 - cfg.damping} div 100")).otherwise(0)

    known = hosts.select("host", own.alias("own")).join(
        reach.withColumnRenamed("rank", "reach"), "host", "left"
    ).join(trust.withColumnRenamed("rank", "trust"), "host", "left").join(
        distrust.withColumnRenamed("rank", "distrust"), "host", "left"
    ).fillna(0, ["trust", "distrust", "reach"])
    much = (F.col("distrust") * 10_000 >= F.lit(mean) * cfg.least_percent * (100 - cfg.damping)) | (F.col("reach") > F.col("own"))
    bad = (F.col("distrust") > cfg.margin * F.col("trust")) & much & (F.col("distrust") > 0)
    known = known.select("host", "trust", "distrust", bad.alias("bad"))
    out = ruled.join(known, "host", "left")
    return out.select(
        id_col, "host", "path", "rule", F.coalesce("ruled", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"), "trust",
        "distrust"
    )


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"))


def _sql_walk(name: str, edges: str, mass: str, rounds: int = 12) -> str:
    """The rounds of walk() in SQL, each a common table expression."""
    steps = [f"{name}0 AS (SELECT host, {mass} * 15 // 100 AS rank FROM hosts WHERE {mass} > 0)"]
    for k in range(1, rounds + 1):
        steps.append(
            f"{name}{k} AS (SELECT coalesce(s.host, b.host) AS host, coalesce(part, 0) + coalesce(b.rank, 0) AS rank FROM (SELECT dst AS host, "
            f"CAST(sum(rank * 85 // (100 * degree)) AS BIGINT) AS part FROM {edges} JOIN {name}{k - 1} ON src = host GROUP BY dst) s FULL JOIN {name}0 b ON s.host = b.host)"
        )
    return ",\n".join(steps)


OP3_SQL = rf"""
WITH u AS (
  SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, html, coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM h),
v AS (
  SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS ruled FROM r),
hosts AS (
  SELECT *, CASE WHEN blocked * 100 >= floor(avg(CASE WHEN blocked > 0 THEN blocked END) OVER ()) THEN blocked ELSE 0 END AS strong FROM (
    SELECT host, CAST(floor(sum(CASE WHEN ruled = 'allow' THEN 1 ELSE 0 END) * {ONE} / count(*)) AS BIGINT) AS allowed,
      CAST(floor(sum(CASE WHEN ruled = 'block' THEN 1 ELSE 0 END) * {ONE} / count(*)) AS BIGINT) AS blocked FROM v GROUP BY host)),
mean AS (SELECT CAST(coalesce(floor(avg(blocked) FILTER (blocked > 0)), 0) AS BIGINT) AS mean FROM hosts),
l AS (
  SELECT DISTINCT host AS src, translate(regexp_replace(unnest(regexp_extract_all(html,
    '\shref\s*=\s*["'']?((?:[a-z][a-z0-9+.-]*:)?//[^/?#"''\s>]+)', 1, 'i')), '^.*?//', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM h),
e AS (SELECT src, dst FROM l WHERE src <> '' AND dst <> '' AND src <> dst),
fwd AS (SELECT src, dst, count(*) OVER (PARTITION BY src) AS degree FROM e),
bwd AS (SELECT dst AS src, src AS dst, count(*) OVER (PARTITION BY dst) AS degree FROM e),
{_sql_walk("t", "fwd", "allowed")},
{_sql_walk("d", "bwd", "blocked")},
{_sql_walk("s", "bwd", "strong")}
SELECT v.page_id, v.host, v.path, v.rule, coalesce(v.ruled, CASE WHEN coalesce(d12.rank, 0) > coalesce(t12.rank, 0) AND coalesce(d12.rank, 0) > 0
    AND (coalesce(d12.rank, 0) * 10000 >= mean * 1 * 15 OR coalesce(s12.rank, 0) > hosts.strong * 15 // 100) THEN 'block' ELSE 'allow' END) AS verdict,
  CAST(coalesce(t12.rank, 0) AS BIGINT) AS trust, CAST(coalesce(d12.rank, 0) AS BIGINT) AS distrust
FROM v CROSS JOIN mean JOIN hosts ON v.host = hosts.host LEFT JOIN t12 ON v.host = t12.host LEFT JOIN d12 ON v.host = d12.host LEFT JOIN s12 ON v.host = s12.host
"""
