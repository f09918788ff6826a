"""Readers and writers of bars, parameters, logs and cubes."""

from __future__ import annotations

import re
from multiprocessing.pool import ThreadPool

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikelab.plans.grid import split_columns


def read_bars(spark: SparkSession, path: str, first: int, last: int, columns: tuple[str, ...] = ("open", "high", "low", "close")) -> DataFrame:
    """Bars between two minutes of the day; only the key and price columns are read."""
    df = spark.read.parquet(path)
    keys = [c for c in ("idx", "trade_date", "t", "scrip") if c in df.columns]
    return df.select(*keys, *(c for c in columns if c in df.columns)).where(F.col("t").between(first, last))


def read_params(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Each column of a parameter file as its own list of values, blanks dropped."""
    df = spark.read.option("header", True).csv(path)
    return {c: df.select(F.trim(c).alias(c)).where(F.col(c) != "") for c in df.columns}


def read_queue(wide: DataFrame, width: int = 4, names: tuple[str, ...] = ("entry", "om", "sl", "ut_sl")) -> DataFrame:
    """idx, group_no, seq_no, entry, om, sl, ut_sl from rows of an index and blocks of four columns; blank blocks go."""
    first, *rest = wide.columns
    blocks = [F.struct(*(F.col(f"`{c}`").cast("string").alias(n) for c, n in zip(rest[i : i + width], names, strict=True))) for i in range(0, len(rest) - width + 1, width)]
    out = wide.select(F.col(first).alias("idx"), F.posexplode(F.array(*blocks)).alias("group_no", "b"))
    return out.select("idx", "group_no", "b.*").where("entry IS NOT NULL AND entry <> ''")


def write_log(log: DataFrame, path: str, key: str = "EntryTime") -> None:
    """Rows with a key, blanks as null, one folder an index and day."""
    texts = {c: F.nullif(F.col(f"`{c}`"), F.lit("")) for c, t in log.dtypes if t == "string"}
    log.withColumns(texts).where(F.col(key).isNotNull()).write.mode("overwrite").partitionBy("idx", "trade_date").parquet(path)


def pending_work(planned: DataFrame, done: DataFrame, sets: int) -> DataFrame:
    """The planned sessions (idx, trade_date) for which done holds fewer than `sets` results."""
    full = done.groupBy("idx", "trade_date").count().where(F.col("count") >= sets)
    return planned.join(full, ["idx", "trade_date"], "left_anti")


def write_cube(cube: DataFrame, path: str, keys: tuple[str, ...] = ("Index", "Year", "Month", "DTE", "PL Basis"), rows: int = 500_000) -> None:
    """One folder for each key, no file above `rows` rows."""
    cube.repartition(*(F.col(f"`{k}`") for k in keys)).write.mode("overwrite").option("maxRecordsPerFile", rows).partitionBy(*keys).parquet(path)


def write_cube_csv(cube: DataFrame, path: str, keys: tuple[str, ...] = ("Index", "Year", "Day")) -> None:
    """The cube by weekday as text: one folder for each key."""
    cube.repartition(*(F.col(f"`{k}`") for k in keys)).write.mode("overwrite").option("header", True).partitionBy(*keys).csv(path)


def write_by_param(log: DataFrame, path: str, buckets: int = 64) -> None:
    """The log by parameter set in hashed buckets: a set is read from one bucket, and there are no tiny files.

    A bucket is as many files as its size asks for, by Spark's advisory size of partitions, each sorted by set.
    """
    keys, _ = split_columns(log)
    hashed = log.withColumn("bucket", F.pmod(F.xxhash64(*(F.col(f"`{k}`") for k in keys)), F.lit(buckets)))
    hashed.hint("rebalance", "bucket").sortWithinPartitions("bucket", *(F.col(f"`{k}`") for k in keys)).write.mode("overwrite").partitionBy("bucket").parquet(path)


def unreadable(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files under path that can't be read: their footers are opened, no column is.

    One pass finds the files that give rows. Of what is left, files without rows and unreadable ones, each footer is opened.
    Files of no bytes are none to Spark.
    """
    file = F.col("_metadata.file_path").alias("_file")
    there = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(path).select("path", file)
    rows = spark.read.schema("_none int").option("ignoreCorruptFiles", True).option("recursiveFileLookup", True).parquet(path).select(file).distinct()
    rest = there.join(rows, "_file", "left_anti").select("path").collect()  # names of few files
    with ThreadPool(8) as pool:  # each waits for a task
        opened = pool.map(lambda r: _opens(spark, r["path"]), rest)
    return spark.createDataFrame([(r["path"],) for r, ok in zip(rest, opened, strict=True) if not ok], "path string")


def _opens(spark: SparkSession, path: str) -> bool:
    """Whether a file's columns can be told from its footer."""
    try:
        spark.read.option("ignoreCorruptFiles", True).parquet(re.sub(r"([\\*?{}\[\]])", r"\\\1", path))  # a name, no pattern
    except AnalysisException as e:
        return e.getCondition() != "UNABLE_TO_INFER_SCHEMA"
    return True
