"""The queries of this subpackage, one for each operator and the pipeline, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, decontam, host_quality, hostrank, jaccard, langid, licenses, negatives, surrogates, tokens, toxicity, warc_audit

#: Ends each document in op2's files.
END_ID = 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is a file at source / lang / its fifty / id."""
    docs = _table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 50).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licenses.licence_scan(docs.select("doc_id", path.alias("path"), "text"))


def op2_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, ranks = tokens.binary_output(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return tokens.digests(tokens.read_blocks(blocks, ranks))


def op3_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_quality.host_quality(_table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_spans: stretches of the original text that are hit; their offsets are the operator's spans."""
    found = decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.withColumn("n_spans", F.size("spans").cast("long")).drop("spans")


def op5_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages against a replica of them with changed and lost records."""
    pages = _table(spark, sf_dir, "pages")
    return warc_audit.audit(pages, warc_audit.damaged(pages))


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.surrogates(_table(spark, sf_dir, "documents").select("doc_id", "text"), "a secret of the caller")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"), 4, 85)


def op8_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostrank.url_verdicts(_table(spark, sf_dir, "pages"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components in 256ths, whole; a seventh of the labels is off by one."""
    rows = _table(spark, sf_dir, "embeddings").where("label IS NOT NULL AND embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vector = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("double"))
    return negatives.hard_negatives(rows.select(F.col("vec_id").alias("id"), label.alias("label"), vector.alias("vector")), F.col("id") % 50 == 0)


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages_of(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_license_scan, op2_token_binary, op3_host_quality, op4_decontamination, op5_warc_audit, op6_pii_surrogates, op7_jaccard_join, op8_bpe_trie, op9_toxicity, op10_url_trust, op11_collocations, op12_hard_negatives, op13_language]
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP4 = rf"""
WITH a AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS gram FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dg AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS gram FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM a, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k)),
h AS (SELECT doc_id, i, k, item_id FROM dg JOIN iw USING (k, gram)),
pos AS (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM h),
hit AS (SELECT doc_id, count(*) AS n, count(*) FILTER (before IS NULL OR p <> before + 1) AS s FROM (SELECT *, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM pos) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(it.n, 0)::BIGINT AS n_items, sha256(coalesce(it.ids, '')) AS items_sha256, hit.n IS NOT NULL AS contaminated, coalesce(hit.s, 0)::BIGINT AS n_spans
FROM a LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

_OP7 = rf"""
WITH RECURSIVE a AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + k - 1], ' ') AS gram FROM (SELECT doc_id, w, least(4, len(w)) AS k, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i FROM a WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y USING (gram) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT p.a, p.b FROM p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * o >= 85 * (na.n + nb.n - o)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.c AS component_id FROM documents JOIN (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY a) c USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    paths = "SELECT doc_id, concat_ws('/', source, lang, (doc_id // 50)::VARCHAR, doc_id::VARCHAR || '.txt') AS path, text FROM documents"
    return {
        "op1_license_scan": licenses.oracle(paths),
        "op3_host_quality": host_quality.ORACLE,
        "op4_decontamination": _OP4,
        "op5_warc_audit": warc_audit.ORACLE,
        "op7_jaccard_join": _OP7,
        "op10_url_trust": hostrank.oracle(),
        "op11_collocations": collocations.ORACLE,
        "op12_hard_negatives": negatives.ORACLE,
    }
