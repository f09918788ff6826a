"""A host's verdict does not hang on the size of the corpus."""

import pytest
from pyspark.sql import functions as F

from strikelab.llm import host_quality


@pytest.mark.parametrize("size", [6_000, 600_000])
@pytest.mark.parametrize("hot", [False, True])
def test_wholly_bad_host_fails_at_any_size(spark, size, hot):
    ordinary = F.when((F.col("id") % 10 > 0) & F.lit(hot), "hot").otherwise(F.concat(F.lit("h"), (F.col("id").cast("string").substr(-1, 1) if not hot else F.floor(F.col("id") / 10) % 20).cast("string")))
    rows = spark.range(size).select(ordinary.alias("host"), (F.pmod(F.xxhash64("id"), F.lit(20)) == 0).alias("bad"))
    rows = rows.union(spark.range(50).select(F.lit("worst").alias("host"), F.lit(True).alias("bad")))
    rows = rows.select("host", F.lit(100).alias("n_words"), F.lit(0).alias("n_repeat_words"), F.when(F.col("bad"), 90).otherwise(0).alias("n_symbols"), F.lit(500).alias("word_chars"), F.lit(0).alias("n_dup_lines"))
    got = {r["host"]: r["host_failed"] for r in host_quality.shrunk_hosts(rows).collect()}
    assert {h for h, failed in got.items() if failed} == {"worst"}
