"""What the operators of this subpackage share: stored tables, Arrow text access, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from strikelab.plans.lineage import scratch

#: ASCII white space, as Java regular expressions and Python's bytes.split() see it.
WHITE = r"[\x20\x09-\x0D]"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df written once to the shared folder and read back, so that later jobs neither recompute it nor depend on an executor's disk."""
    spark = df.sparkSession
    at = f"{scratch(spark)}/strikelab/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def raw(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.large_binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text, so that working arrays stay small whatever the length of the texts."""
    for batch in batches:
        sizes = [len(x) if x else 0 for x in raw(batch.column(batch.schema.get_field_index(text)))]
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)


def with_field(df: DataFrame, name: str, kind: str) -> StructType:
    """df's schema and one more column."""
    return StructType([*df.schema.fields, StructField(name, DataType.fromDDL(kind))])


class Memo(dict):
    """A dict that fills itself by `make` and starts again at `most` entries; keys are words, so it is useful and bounded."""

    def __init__(self, make: Callable, most: int = 400_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(v, c) for every vertex of edges (a, b): c is the smallest vertex that it reaches.

    Each round every vertex takes the smallest label among its neighbours and itself, then the label of that label;
    the number of rounds grows with the logarithm of the longest path. Each round's labels are a stored table.
    Null ends and self-loops carry nothing. No edges: no rows.
    """
    pairs = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = stored(pairs.union(pairs.select("b", "a")).distinct().toDF("v", "w"), f"{name}-edges")
    labels = stored(both.groupBy("v").agg(F.min("w").alias("m")).select("v", F.least("v", "m").alias("c")), name)
    while True:
        near = both.join(labels.select(F.col("v").alias("w"), F.col("c").alias("d")), "w").groupBy("v").agg(F.min("d").alias("d"))
        step = labels.join(near, "v").select("v", F.least("c", "d").alias("c"), F.col("c").alias("was"))
        up = step.select(F.col("v").alias("c"), F.col("c").alias("top"))
        after = stored(step.join(up, "c").select("v", "top", "was"), name)
        labels = after.select("v", F.col("top").alias("c"))
        if after.where("top <> was").isEmpty():
            return labels
