"""Files: what an audit finds, and how a log by parameter set is dealt."""

import glob
import os

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from strikelab.sources import files


def _names(df):
    return sorted(os.path.basename(r["path"]) for r in df.collect())


def test_files_without_rows_are_readable(spark, tmp_path):
    """A file without rows has a footer; files of other columns, odd folder names and no bad file at all too."""
    rows = spark.range(20).select(F.col("id"), F.lit("x").alias("s"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/a b/full")
    rows.where("id < 0").coalesce(1).write.parquet(f"{tmp_path}/a b/none")
    rows.where("id < 0").select(F.col("id").cast("string")).coalesce(1).write.parquet(f"{tmp_path}/k=[1]%2F/none")
    assert _names(files.unreadable(spark, str(tmp_path))) == []
    for at, content in (("a b/bad-1", b"not a parquet file"), ("k=[1]%2F/bad-2", b"x"), ("bad-3", b"PAR1PAR1"), ("k=[1]%2F/bad-4", b"PAR1" + b"x" * 40)):
        (tmp_path / f"{at}.parquet").write_bytes(content)
    assert _names(files.unreadable(spark, str(tmp_path))) == [f"bad-{i}.parquet" for i in (1, 2, 3, 4)]


def test_a_large_bucket_is_several_sorted_files(spark, tmp_path):
    """Sets lie in one bucket each; no task writes a whole large bucket, and small ones are one file."""
    rows = spark.range(0, 120_000, 1, 16).select((F.col("id") % 2).alias("P_a"), F.when(F.col("id") % 1000 == 0, "rare").otherwise("often").alias("P_b"), F.hash("id").cast("double").alias("A_PNL"))
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "128k")
    try:
        files.write_by_param(rows, f"{tmp_path}/log", 64)
    finally:
        spark.conf.unset(size)
    back = spark.read.parquet(f"{tmp_path}/log")
    sets = {(r["P_a"], r["P_b"]): (r["n"], r["b"], r["s"]) for r in back.groupBy("P_a", "P_b").agg(F.count("*").alias("n"), F.countDistinct("bucket").alias("b"), F.sum("A_PNL").alias("s")).collect()}
    want = {(r["P_a"], r["P_b"]): (r["n"], 1, r["s"]) for r in rows.groupBy("P_a", "P_b").agg(F.count("*").alias("n"), F.sum("A_PNL").alias("s")).collect()}
    assert sets == want
    found = [pq.ParquetFile(p).read(columns=["P_a", "P_b"]).to_pylist() for p in glob.glob(f"{tmp_path}/log/bucket=*/*.parquet")]
    assert max(map(len, found)) < 30_000 and len(found) < 40
    for f in found:
        at = [(r["P_a"], r["P_b"]) for r in f]
        assert at == sorted(at)
