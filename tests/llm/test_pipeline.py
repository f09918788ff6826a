"""Each stage against brute force, on odd rows and columns of clashing names, and a whole run."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from strikelab.llm import surrogates, toxicity

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
SCHEMA = "doc_id long, text string, n_chars long, _toxic double, _kept int, entities string, _entities string, ids string, hits string"


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, "", " ", BASE, BASE + " more", BASE, "Dr Jane Doe, jane@doe.org", "short", "w " * 30_000, BASE.upper()]
    rows = [(i, t, len(t or ""), 0.5, 1, "e", "f", "g", "h") for i, t in enumerate(texts)] + [(None, "no id", 5, 0.5, 1, "e", "f", "g", "h")] + [(7, "short", 5, 0.5, 1, "e", "f", "g", "h")] * 2
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_columns_stay_and_no_rows_give_none(spark, docs, name):
    assert STAGES[name](spark, docs, SF).dtypes == docs.dtypes
    assert STAGES[name](spark, docs.limit(0), SF).count() == 0


def key(rows):
    return sorted((str(r["doc_id"]), r["text"] or "") for r in rows)


def test_toxicity_keeps_what_scores_low(spark, docs):
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = key(STAGES["toxicity"](spark, docs, SF).collect())
    low = docs.collect() if model is None else [r for r in toxicity.score(docs, model, "s").collect() if r["s"] < 0.3]
    assert kept == key(low)


def test_near_copies(spark, docs):
    kept = [r["doc_id"] for r in STAGES["near_duplicates"](spark, docs, SF).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [None, 0, 1, 2, 3, 6, 7, 7, 7, 8]))


def test_decontamination(spark, docs):
    passage = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    more = docs.union(docs.limit(1).withColumn("text", F.lit(f"before {passage} after")).withColumn("doc_id", F.lit(99).cast("long")))
    assert 99 not in [r["doc_id"] for r in STAGES["decontamination"](spark, more, SF).collect()]


def test_pii_changes_only_entities(spark, docs):
    old = {r["doc_id"]: r for r in docs.collect()}
    for r in STAGES["pii"](spark, docs, SF).collect():
        text = old[r["doc_id"]]["text"]
        found = list(surrogates.entities(text))
        assert (r["text"] == text) == (not found) and r["entities"] == "e"
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))


def test_bpe_ids(spark, docs):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = STAGES["bpe"](spark, docs, SF).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["ids"] == lib.encode(texts[r["doc_id"]], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, SF), "pipeline-test")
    want = {(r["doc_id"], tuple(r["ids"])) for r in docs.collect()}
    assert {(r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, SF).collect()} == want and 0 < len(want) < 200
