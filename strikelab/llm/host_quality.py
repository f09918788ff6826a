"""Quality rules by host, in DataFrame functions only: each text's own figures, then shrunk failure rates of its host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, stored

#: A host fails if one rule's shrunk failure rate is above this.
LIMIT = 0.6
#: The prior weighs as much as this many documents at most (and as one at least).
STRONGEST = 10_000.0

# Rules on a document's figures; base_failed is the first two.
RULES = {
    "short": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > word_chars",
    "lines": "n_dup_lines > 2 AND 20 * n_dup_lines > n_words",
}


def figures(docs: DataFrame, host: str = "source", window_hash: str = "xxhash64(w[i], w[i + 1], w[i + 2])") -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each whole text (null: no words).

    Words are runs of other than ASCII white space. Repeated windows of three words are found in the text's own sorted
    array of (hash of the window, its place), packed in 64 bits; nothing is shuffled. Neighbours of equal hash are
    compared by their words: where any differ, the text's windows are sorted by their words instead, so the count is exact.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col(host).cast("string").alias("host"),
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{WHITE}+")).alias("w"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    sized = base.select(
        "doc_id", "host", "n_symbols", "w",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("shiftleft(1L, CAST(ceil(log2(size(w) + 1)) AS INT)) - 1").alias("low"),
    )
    head = [c for c in sized.columns if c not in ("w", "low")]
    packed = F.expr("if(n_words < 3, CAST(array() AS ARRAY<BIGINT>), sort_array(transform(sequence(0, CAST(n_words AS INT) - 3), i -> coalesce((" + window_hash + " & ~low) | i, 0L))))")
    ordered = sized.select(*head, "w", "low", packed.alias("s"))
    same = "filter(s, (x, i) -> (i > 0 AND (x | low) = (s[greatest(i - 1, 0)] | low)) OR (i < size(s) - 1 AND (x | low) = (s[least(i + 1, size(s) - 1)] | low)))"
    at = lambda x, k: f"w[CAST({x} & low AS INT) + {k}]"
    differ = " OR ".join(f"{at('s[i]', k)} <> {at('s[i - 1]', k)}" for k in range(3))
    clash = f"size(s) > 1 AND exists(sequence(1, greatest(size(s) - 1, 1)), i -> (s[i] | low) = (s[i - 1] | low) AND ({differ}))"
    by_words = "array_sort(transform(sequence(0, CAST(n_words AS INT) - 3), i -> struct(w[i] AS a, w[i + 1] AS b, w[i + 2] AS c, CAST(i AS BIGINT) AS i)))"
    alike = lambda y: f"(x.a = {y}.a AND x.b = {y}.b AND x.c = {y}.c)"
    exact = f"transform(array({by_words}), q -> sort_array(transform(filter(q, (x, j) -> (j > 0 AND {alike('q[greatest(j - 1, 0)]')}) OR (j < size(q) - 1 AND {alike('q[least(j + 1, size(q) - 1)]')})), x -> x.i)))[0]"
    fast = f"sort_array(transform({same}, x -> coalesce(x & low, 0L)))"
    places = ordered.select(*head, F.expr(f"CASE WHEN {clash} THEN {exact} ELSE {fast} END").alias("p"))
    cover = "aggregate(transform(p, (x, i) -> if(i + 1 < size(p), least(3L, p[least(i + 1, size(p) - 1)] - x), 3L)), 0L, (a, x) -> a + x)"
    return places.select(*head, F.expr(cover).alias("n_repeat_words"))


def shrunk_hosts(rows: DataFrame) -> DataFrame:
    """host and host_failed from the figures: for each rule, failures k of n documents and a beta prior from all hosts.

    The prior is fitted by moments to the rates of the hosts with two documents or more, each host counting once whatever
    its n. Its mean m is the mean of k / n; k (k - 1) / (n (n - 1)) has the mean of the squared rate without the noise of
    drawing n documents, so that less m^2 (and the noise of m) leaves the spread v of the rates; its weight is
    m (1 - m) / v - 1. Without a spread, or such hosts, hosts are alike: the weight is STRONGEST, m that of all documents
    if no host has two. A host's rate is (k + m weight) / (n + weight).
    """
    sums = rows.groupBy("host").agg(F.count("*").alias("n"), *(F.sum(F.expr(r).cast("int")).alias(k) for k, r in RULES.items()))
    more = lambda c: F.when(F.col("n") > 1, c)
    n = F.col("n").cast("double")
    moments = [F.count(more(F.col("n"))).alias("hosts")]
    for k in RULES:
        moments += [
            F.coalesce(F.avg(more(F.col(k) / n)), F.sum(k) / F.sum("n")).alias(f"m_{k}"),
            F.avg(more(F.try_divide(F.col(k) * (F.col(k) - 1.0), n * (n - 1)))).alias(f"q_{k}"),
            F.coalesce(F.var_samp(more(F.col(k) / n)), F.lit(0.0)).alias(f"v_{k}"),
        ]
    rates = sums.crossJoin(F.broadcast(sums.agg(*moments)))  # one row

    def rate(k: str) -> Column:
        mean = F.col(f"m_{k}")
        spread = F.col(f"q_{k}") - mean * mean + F.try_divide(F.col(f"v_{k}"), F.col("hosts"))
        weight = F.when(spread > 0, mean * (1 - mean) / spread - 1).otherwise(STRONGEST)
        weight = F.least(F.greatest(weight, F.lit(1.0)), F.lit(STRONGEST))
        return (F.col(k) + mean * weight) / (F.col("n") + weight)

    return rates.select("host", F.greatest(*(rate(k) for k in RULES)).alias("worst")).select("host", (F.col("worst") > LIMIT).alias("host_failed"))


def host_quality(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host_failed for each row.

    Documents without a host are a host together. Null ids, ties and repeated rows are as any row; other columns are
    ignored; no rows: no rows.
    """
    rows = stored(figures(docs, host), "host-quality")
    hosts = shrunk_hosts(rows).withColumnRenamed("host", "_host")
    base = F.expr(f"({RULES['short']}) OR ({RULES['repeats']})")
    joined = rows.join(hosts, F.col("host").eqNullSafe(F.col("_host")), "left")
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & ~F.col("host_failed")).alias("kept"), "host_failed",
    )


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
l AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM w),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c FROM g),
p AS (SELECT r, count(DISTINCT i + k) AS n FROM h, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY r),
f AS (SELECT r, doc_id, host, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN w USING (r) JOIN l USING (r) LEFT JOIN p USING (r)),
s AS (SELECT host, count(*) AS n, {", ".join(f"sum(({r})::INT) AS {k}" for k, r in RULES.items())} FROM f GROUP BY host),
mo AS (SELECT count(*) FILTER (n > 1) AS hosts, {", ".join(f"coalesce(avg({k}::DOUBLE / n) FILTER (n > 1), sum({k})::DOUBLE / sum(n)) AS m_{k}, avg({k} * ({k} - 1.0)::DOUBLE / (n * (n - 1))) FILTER (n > 1) AS q_{k}, coalesce(var_samp({k}::DOUBLE / n) FILTER (n > 1), 0) AS v_{k}" for k in RULES)} FROM s),
sp AS (SELECT *, {", ".join(f"q_{k} - m_{k} * m_{k} + v_{k} / nullif(hosts, 0) AS s_{k}" for k in RULES)} FROM mo),
we AS (SELECT *, {", ".join(f"least(greatest(CASE WHEN s_{k} > 0 THEN m_{k} * (1 - m_{k}) / s_{k} - 1 ELSE {STRONGEST} END, 1.0), {STRONGEST}) AS w_{k}" for k in RULES)} FROM sp),
q AS (SELECT host, greatest({", ".join(f"({k} + m_{k} * w_{k}) / (n + w_{k})" for k in RULES)}) > {LIMIT} AS host_failed FROM s, we)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  ({RULES["short"]}) OR ({RULES["repeats"]}) AS base_failed,
  NOT (({RULES["short"]}) OR ({RULES["repeats"]})) AND NOT host_failed AS kept, host_failed
FROM f JOIN q ON f.host IS NOT DISTINCT FROM q.host
"""
