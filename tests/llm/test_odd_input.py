"""Every operator on nulls, empty and long texts, repeated rows, empty tables and clashing extra columns."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strikelab.llm import bpe, decontam, host_quality, hostrank, licenses, surrogates, tokens, toxicity, warc_audit

LONG = " ".join(f"w{i % 700} mail{i}@x{i % 9}.example.com" for i in range(4000))
TEXTS = [None, "", " \t\n", "It's 10€ <|endoftext|>!", "ab ab ab ab ab", LONG, "Call +1 (017) 555-7713 now\n\nx"]
ROWS = [(i, t, None if i == 1 else "h", 7, "k", 0.5) for i, t in enumerate(TEXTS)] + [(None, "no id", "h", 7, "k", 0.5)] + [(3, TEXTS[3], "h", 7, "k", 0.5)] * 2
SCHEMA = "doc_id long, text string, source string, n_words long, key string, score double"


@pytest.fixture(params=["rows", "none"])
def docs(spark, request):
    return spark.createDataFrame(ROWS if request.param == "rows" else [], SCHEMA).repartition(3)


def test_tokens(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    blocks, ranks = tokens.binary_output(docs, path, 2)
    got = tokens.digests(tokens.read_blocks(blocks, ranks)).collect()
    rows = docs.select("doc_id", "text").collect()
    lib = Tokenizer.from_file(path)
    ids = {r[0]: lib.encode(r[1] or "", add_special_tokens=False).ids + [2] for r in rows}
    assert len(got) == len(rows)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        want = np.array(ids[r["doc_id"]], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(want), zlib.crc32(want.tobytes()))
        at += len(want)
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == sorted(ids and [r[0] for r in rows], key=lambda d: -1 if d is None else d)


def test_pack():
    ranks = np.array([0, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1], np.uint32)
    for n in range(len(ranks) + 1):
        assert (tokens.unpack(*tokens.pack(ranks[:n]), n) == ranks[:n]).all()


def test_bpe(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    for r in bpe.decode(bpe.encode(docs, path), path).collect():
        want = lib.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == want and r["decoded"] == lib.decode(want, skip_special_tokens=False)
    for r in bpe.round_trip(docs.where("text IS NOT NULL"), path).collect():
        assert r["n_tokens"] >= 0 and len(r["ids_sha256"]) == 64


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(1, "ab, AB"), (2, None), (None, "xx yy zz"), (3, "no words of it here at all in any text above"), (4, "10€")], "item_id long, text string")
    for size in (1 << 20, 4):
        got = decontam.contamination(docs, items, nodes=size).collect()
        for r in got:
            hits = {4: (5, "1"), 3: (1, "4")}.get(r["doc_id"], (0, ""))
            assert (r["n_hit"], r["items_sha256"]) == (hits[0], hashlib.sha256(hits[1].encode()).hexdigest())
            for s in r["spans"]:
                assert TEXTS[r["doc_id"]][s["start"] : s["end"]] in ("ab ab ab ab ab", "10€")
        kept = decontam.without_benchmark(docs, items, nodes=size)
        assert kept.columns == docs.columns and kept.count() == len(got) - sum(r["contaminated"] for r in got)


def test_quality_and_licences(spark, docs):
    n = docs.count()
    got = {r["doc_id"]: r for r in host_quality.host_quality(docs).collect()}
    assert len(got) == (0 if n == 0 else 8)
    if n:
        assert (got[4]["n_words"], got[4]["n_repeat_words"], got[4]["word_chars"]) == (5, 5, 10)
        assert (got[0]["n_words"], got[2]["n_words"], got[0]["base_failed"]) == (0, 0, True)
    files = docs.withColumn("path", F.concat(F.lit("a/b/"), F.col("doc_id").cast("string")))
    files = files.unionByName(files.limit(1).withColumn("path", F.lit("a/LICENSE")).withColumn("text", F.lit("Released under the MIT License.")))
    for r in licenses.licence_scan(files).collect():
        assert r["licence"] == ("MIT" if r["path"] else None)
        assert r["licence_from"] in ("a", "a/LICENSE", None)


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)] + [(None, 1), (4, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.without_toxic(docs, labels, 2.0).columns == docs.columns
    assert toxicity.toxicity(docs, labels.limit(0)).where("predicted = 1").count() == 0


def test_surrogates(spark, docs):
    got = surrogates.surrogates(docs, "secret").collect()
    assert len(got) == docs.count()
    for r in got:
        old = [r["text"]] if r["text"] is None else [TEXTS[r["doc_id"]] if r["doc_id"] is not None else "no id"]
        if r["text"] and r["entities"]:
            values = [(k, old[0][i:j]) for k, i, j in surrogates.entities(old[0])]
            new = [(e["kind"], r["text"][e["start"] : e["end"]]) for e in r["entities"]]
            assert len(set(values)) == len(set(new)) == len(set(zip(values, new, strict=True))) and not set(values) & set(new)


def test_pages(spark):
    url = "http://a.net/x"
    html = '<a href="http://b.org/">b</a>'
    rows = [(1, url, html, "x", 1), (2, None, None, None, 1), (2, "nothing", "", None, 1), (None, "https://B.ORG/fr/?q", html, "x", 1), (5, "https://sub.example.com/de/", "", "x", 1)]
    schema = "page_id long, url string, html string, host string, verdict int"
    got = {(r["host"], r["path"], r["rule"], r["verdict"]) for r in hostrank.url_verdicts(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("a.net", "/x", "net/", "block"), ("", "", None, "allow"), ("b.org", "/fr/", "org/fr/", "allow"), ("sub.example.com", "/de/", "example.com/de/", "block")}
    assert hostrank.url_verdicts(spark.createDataFrame([], schema)).count() == 0
    pages = spark.createDataFrame([(i, url, html * (i % 3), None, 1) for i in range(300)] + rows[3:4], schema)
    bad = pages.withColumn("html", F.when(F.col("page_id") == 77, "!").otherwise(F.col("html"))).where("page_id IS NULL OR page_id <> 99")
    bad = bad.unionByName(spark.createDataFrame([(9000, url, "new", None, 1)], schema))
    assert {(r["record"], r["status"]) for r in warc_audit.audit(pages, bad).collect()} == {(77, "changed"), (99, "missing"), (9000, "extra")}
    assert warc_audit.audit(pages, pages).count() == warc_audit.audit(pages.limit(0), pages.limit(0)).count() == 0


def test_distrust_flows_back(spark):
    edges = spark.createDataFrame([("spam", "bad", 3), ("good", "fine", 1), ("spam", "good", 1)], "src string, dst string, n long")
    seeds = spark.createDataFrame([("trust", "good", 1.0), ("distrust", "bad", 1.0)], "kind string, host string, seed double")
    got = {(r["kind"], r["host"]): r["score"] for r in hostrank.propagate(edges, seeds).collect()}
    assert got["distrust", "spam"] == pytest.approx(0.15 * 0.85) and ("distrust", "good") not in got
    assert got["trust", "fine"] == pytest.approx(0.15 * 0.85)
