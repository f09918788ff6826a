"""URL filters, in DataFrame functions only: rules on host and path, and trust and distrust over the links between hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

# Fixed values: (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
DAMPING = 0.85
#: Rounds of the SQL, which has no test of convergence.
ROUNDS = 10
#: Propagation ends when all scores together are nearer to their limits than this, over the number of hosts.
TOLERANCE = 1e-6
#: Rounds from one stored table, and test, to the next.
EVERY = 4
#: A host without a rule is blocked if its distrust is above its trust and above so many times the mean of all hosts.
LIMIT = 1.0
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def small(c: Column) -> Column:
    """A-Z in lower case."""
    return F.translate(c, _CAPITALS, _SMALL)


def located(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, rule_verdict of each page; null url or no `://`: host and path empty."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), small(F.regexp_extract(url, _URL, 1)).alias("host"), F.regexp_extract(url, _URL, 2).alias("path"))
    rule = verdict = F.lit(None).cast("string")
    for kind, host, path in sorted(RULES, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return parts.select("*", rule.alias("rule"), verdict.alias("rule_verdict"))


def links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links from the pages of one host to another host. Relative links stay on their host and carry nothing."""
    src = small(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), _URL, 1))
    found = pages.select(src.alias("src"), F.explode(F.regexp_extract_all(F.coalesce(F.col("html").cast("string"), F.lit("")), F.lit(_LINK), 1)).alias("dst"))
    return found.select("src", small(F.col("dst")).alias("dst")).where("src <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """(kind, host, score): personalised PageRank of kind `trust` along edges (src, dst, n) and of kind `distrust` against them.

    seeds: (kind, host, seed), summing to 1 for each kind. Each round a host passes on its score in proportion to its
    links; a host without links passes on nothing. Rounds go on until what is missing to the limit, added up over all
    hosts and kinds and times the number of hosts, is under tolerance: as a round brings any two sets of scores together by
    damping, it is at most d / (1 - d) of the last change, d = damping ** EVERY. Hosts that nothing reaches have no row.
    """
    jump = stored(seeds.where("seed > 0").select("kind", "host", ((1 - damping) * F.col("seed")).alias("base")), "hostrank-seeds")
    ways = edges.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    out = ways.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    ways = stored(ways.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (damping * F.col("n") / F.col("all")).alias("share")), "hostrank-ways")
    scores = jump.select("kind", "host", F.col("base").alias("score"))
    if ways.isEmpty():
        return scores
    hosts = ways.select("host").union(ways.select("dst")).union(jump.select("host")).distinct().count()
    left = damping**EVERY / (1 - damping**EVERY)
    while True:
        before = scores.select("kind", "host", F.col("score").alias("was"))
        for _ in range(EVERY):
            flow = ways.join(scores, ["kind", "host"]).groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.col("score") * F.col("share")).alias("in"))
            scores = jump.join(flow, ["kind", "host"], "full").select("kind", "host", (F.coalesce("base", F.lit(0.0)) + F.coalesce("in", F.lit(0.0))).alias("score"))
        scores = stored(scores, "hostrank-scores")
        change = F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("was", F.lit(0.0)))
        changed = scores.join(before, ["kind", "host"], "full").agg(F.sum(change).alias("c")).first()["c"] or 0.0
        # Sums in another order differ in their last bits, which no round can mend.
        if changed * left * hosts < tolerance or changed < 1e-14:
            return scores


def url_verdicts(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages (page_id, url, html).

    The longest rule that fits decides. Without a rule, the host does: seeds of trust are hosts by the share of their pages
    that a rule allows, seeds of distrust by the share that a rule blocks; scores are spread over the links between hosts;
    hosts above the limit are blocked, all others allowed, as are pages without a host. Null html has no links. Null ids,
    ties and repeated rows are as any row; other columns are ignored; no rows: no rows.
    """
    rows = located(pages)
    share = lambda kind: F.sum((F.col("rule_verdict") == kind).cast("int")) / F.count("*")
    hosts = rows.where("host <> ''").groupBy("host").agg(F.coalesce(share("allow"), F.lit(0.0)).alias("trust"), F.coalesce(share("block"), F.lit(0.0)).alias("distrust"))
    hosts = stored(hosts, "hostrank-hosts")
    total = hosts.agg(F.count("*").alias("hosts"), F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")).first()
    shares = [hosts.select(F.lit(k).alias("kind"), "host", (F.col(k) / F.lit(total[k] or 1.0)).alias("seed")) for k in ("trust", "distrust")]
    scores = propagate(links(pages), shares[0].unionByName(shares[1]))
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0))
    bad = scores.groupBy("host").agg(of("trust").alias("trust"), of("distrust").alias("distrust")).where((F.col("distrust") > F.col("trust")) & (F.col("distrust") * total["hosts"] > LIMIT))
    bad = stored(bad.select(F.col("host").alias("_bad")), "hostrank-bad")
    judged = rows.join(bad, F.col("host") == F.col("_bad"), "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.when(F.col("_bad").isNotNull(), "block").otherwise("allow")).alias("verdict"))


def oracle() -> str:
    """The same in SQL, with ROUNDS rounds written out: the same where no score needs more."""
    by_length = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    case = lambda pick: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{pick(k, h, p)}'" for k, h, p in by_length) + " END"
    lower = lambda x: f"translate({x}, '{_CAPITALS}', '{_SMALL}')"
    url = "^(?s:.*?)://([^/?#]*)([^?#]*)"
    link = _LINK.replace("'", "''")
    rounds = "".join(
        f""", r{i + 1} AS (SELECT kind, host, sum(x) AS score FROM (SELECT kind, host, {1 - DAMPING} * seed AS x FROM seeds UNION ALL
  SELECT ways.kind, dst, score * share FROM ways JOIN r{i} ON ways.kind = r{i}.kind AND ways.host = r{i}.host) GROUP BY ALL)"""
        for i in range(ROUNDS)
    )
    return f"""
WITH u AS (SELECT page_id, {lower(f"regexp_extract(coalesce(url, ''), '{url}', 1)")} AS host, regexp_extract(coalesce(url, ''), '{url}', 2) AS path, coalesce(html, '') AS html FROM pages),
rows_ AS (SELECT page_id, host, path, {case(lambda k, h, p: h + p)} AS rule, {case(lambda k, h, p: k)} AS rule_verdict FROM u),
hosts AS (SELECT host, count(*) FILTER (rule_verdict = 'allow')::DOUBLE / count(*) AS trust, count(*) FILTER (rule_verdict = 'block')::DOUBLE / count(*) AS distrust FROM rows_ WHERE host <> '' GROUP BY host),
seeds AS (SELECT 'trust' AS kind, host, trust / (SELECT sum(trust) FROM hosts) AS seed FROM hosts WHERE trust > 0
  UNION ALL SELECT 'distrust', host, distrust / (SELECT sum(distrust) FROM hosts) FROM hosts WHERE distrust > 0),
edges AS (SELECT src, dst, count(*) AS n FROM (SELECT host AS src, {lower("unnest(regexp_extract_all(html, '" + link + "', 1))")} AS dst FROM u) WHERE src <> '' AND src <> dst GROUP BY ALL),
both_ AS (SELECT 'trust' AS kind, src AS host, dst, n FROM edges UNION ALL SELECT 'distrust', dst, src, n FROM edges),
ways AS (SELECT kind, host, dst, {DAMPING} * n / sum(n) OVER (PARTITION BY kind, host) AS share FROM both_),
r0 AS (SELECT kind, host, {1 - DAMPING} * seed AS score FROM seeds){rounds},
last_ AS (SELECT host, coalesce(sum(score) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(score) FILTER (kind = 'distrust'), 0) AS distrust FROM r{ROUNDS} GROUP BY host),
bad AS (SELECT host FROM last_ WHERE distrust > trust AND distrust * (SELECT count(*) FROM hosts) > {LIMIT})
SELECT page_id, host, path, rule, coalesce(rule_verdict, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM rows_
"""
