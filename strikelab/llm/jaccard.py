"""N-gram Jaccard join: a grouped prefix join over word shingles.

Plan. (1) Texts become sets of 64-bit shingle hashes; equal sets are one set (copies are never paired). (2) A quarter of
all hashes, chosen by value, is counted over the whole corpus: a set with more hashes of its own than the threshold lets
differ has no partner. (3) What is left is counted in full; a set's hashes in the order (frequency, value) give its prefix.
(4) Sets with the same size and the same shared prefix form one group. (5) For each prefix hash, every member is checked
against one hub, the member with the fewest hashes of its own: that is linear and joins large groups of near copies into
components. (6) Only group pairs that still lie in different components are formed, filtered by size, prefix position and
the overlaps with the hub, expanded to members and verified. Every filter is an upper bound on the overlap, so no link
that could join two components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Memo, components, raw, slices, stored

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
#: Of all hashes, one in so many is counted to find the sets without partners.
SAMPLE_OF_HASHES = 4
#: So many set ids at most are broadcast to pick texts (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def shingles(text: bytes | None, words: dict[bytes, int], width: int) -> np.ndarray:
    """Sorted distinct hashes of the windows of `width` words; one hash of all words if there are fewer; empty without words."""
    found = (text or b"").lower().split()
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    k = min(width, len(h))
    if not k:
        return h
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = (out ^ h[i : len(h) - k + 1 + i]) * _MIX[0]
        out ^= out >> np.uint64(32)
    out = (out ^ (out >> np.uint64(30))) * _MIX[1]
    out = (out ^ (out >> np.uint64(27))) * _MIX[2]
    return np.unique(out ^ (out >> np.uint64(31)))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array((np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)).view(np.int64)))


def _hashed(docs: DataFrame, width: int, keep: int) -> DataFrame:
    """doc_id, n (hashes), key (128-bit digest of the set), hs (the hashes divisible by keep)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Memo(xxhash.xxh64_intdigest)
        for b in slices(batches):
            sets = [shingles(t, words, width) for t in raw(b["text"])]
            key = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            hs = [s if keep == 1 else s[s % np.uint64(keep) == 0] for s in sets]
            yield pa.record_batch([b["doc_id"], pa.array([len(s) for s in sets], pa.int64()), pa.array(key, pa.binary()), _lists(hs)], ["doc_id", "n", "key", "hs"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n long, key binary, hs array<bigint>")


def _up(x: Column, y: int) -> Column:
    """x / y rounded up, for whole numbers."""
    return F.expr("CAST(0 AS BIGINT)") + F.floor((x + (y - 1)) / y).cast("long")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with na, nb and o, the size of the intersection."""
    left, right = (sets.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("hs").alias(f"h{x}")) for x in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", F.size(F.array_intersect("ha", "hb")).cast("long").alias("o"))


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text).

    Two documents link when 100 * intersection >= percent * union of their sets of `width`-word shingles (words: ASCII
    lower case, split at ASCII white space; fewer words than `width`: all of them as one shingle). component_id is the
    smallest doc_id reachable by links. Null or wordless texts have n_shingles 0 and link with nothing (component: own
    id). Rows that share a doc_id count as one document. A null doc_id takes part in no link; its component is null.
    Other columns of docs are ignored. Empty input: no rows.
    """
    need = lambda n: _up(percent * F.col(n), 100)  # noqa: E731  shingles of a set that any partner must share
    alpha = lambda a, b: _up(percent * (F.col(a) + F.col(b)), 100 + percent)
    linked = (100 * F.col("o")) >= percent * (F.col("na") + F.col("nb") - F.col("o"))

    hashed = stored(_hashed(docs, width, SAMPLE_OF_HASHES), "jaccard-sample")
    sets = hashed.where("n > 0 AND doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("hs").alias("hs"))
    lone = sets.select("rep", F.explode("hs").alias("h")).groupBy("h").agg(F.count("*").alias("c"), F.min("rep").alias("rep")).where("c = 1").groupBy("rep").agg(F.count("*").alias("lone"))
    alive = stored(sets.select("key", "rep", "n").join(lone, "rep", "left").where(F.coalesce("lone", F.lit(0)) <= F.col("n") - need("n")).select("key", "rep"), "jaccard-alive")

    ids = alive.select(F.col("rep").alias("doc_id")).distinct()
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")
    full = stored(_hashed(chosen, width, 1).withColumnRenamed("doc_id", "rep").join(alive, ["key", "rep"], "left_semi").dropDuplicates(["key"]).select("rep", "n", "hs"), "jaccard-sets")

    tokens = full.select("rep", "n", F.explode("hs").alias("h"))
    shared = tokens.join(tokens.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "h")
    own = Window.partitionBy("rep", "n")
    prefix = (
        shared.select("rep", "n", "h", (F.row_number().over(own.orderBy("df", "h")) - 1).alias("i"), F.count("*").over(own).alias("m"))
        .select("h", "rep", "n", (F.col("n") - F.col("m")).alias("u"), (F.col("n") - F.col("m") + F.col("i")).alias("pos"))
        .where(F.col("pos") <= F.col("n") - need("n"))
    )
    prefix = stored(prefix, "jaccard-prefix")

    members = stored(
        prefix.groupBy("rep", "n", "u").agg(F.sort_array(F.collect_list("h")).alias("hs")).select("rep", F.md5(F.concat_ws(",", "n", "u", F.col("hs").cast("array<string>"))).alias("gid")),
        "jaccard-members",
    )
    groups = prefix.join(members, "rep").groupBy("h", "gid").agg(F.first("n").alias("n"), F.first("u").alias("u"), F.first("pos").alias("pos"), F.min("rep").alias("leader"))
    groups = stored(groups, "jaccard-groups")
    hubs = groups.groupBy("h").agg(F.min(F.struct("u", "leader")).alias("s")).select("h", F.col("s.leader").alias("hub"))
    posted = stored(groups.drop("leader").join(hubs, "h"), "jaccard-posted")
    reach = posted.select("gid", "hub").distinct().join(members, "gid")
    stars = stored(_verified(reach.select(F.col("hub").alias("a"), F.col("rep").alias("b")).where("a <> b").distinct(), full), "jaccard-stars")
    first = components(stars.where(linked), "jaccard-first")

    to_hub = stars.select(F.col("a").alias("hub"), F.col("b").alias("rep"), "o")
    sizes = prefix.select("rep", "n", "u").distinct()
    seen = reach.join(to_hub, ["hub", "rep"], "left").join(sizes, "rep").join(first.toDF("rep", "comp"), "rep", "left")
    # A member's overlap with the hub, and at most so many of its other hashes can be in another set.
    seen = seen.select("gid", "hub", "rep", "n", F.coalesce("o", "n").alias("o"), F.greatest(F.col("n") - F.col("u") - F.coalesce("o", "n"), F.lit(0)).alias("rest"), F.coalesce("comp", "rep").alias("comp"))
    seen = stored(seen, "jaccard-seen")
    wide = seen.groupBy("gid", "hub").agg(F.max("o").alias("o"), F.max("rest").alias("rest"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    hub_comp = seen.where("rep = hub").select("hub", F.col("comp").alias("hub_comp")).distinct()
    rows = posted.join(wide, ["gid", "hub"]).join(hub_comp, "hub", "left").withColumn("out", ~F.coalesce((F.col("lo") == F.col("hi")) & (F.col("lo") == F.col("hub_comp")), F.lit(False)))
    rows = stored(rows.select("h", "hub", "gid", "n", "pos", "o", "rest", "lo", "hi", "out"), "jaccard-rows")
    x, y = (rows.select("h", *(F.col(c).alias(f"{c}{k}") for c in rows.columns if c != "h")) for k in "xy")

    def bounded(a: str, b: str) -> Column:
        """Sizes and the overlaps with a common hub allow a link."""
        return (100 * F.least(F.col(f"n{a}"), F.col(f"n{b}")) >= percent * F.greatest(F.col(f"n{a}"), F.col(f"n{b}"))) & (
            F.least(F.col(f"o{a}"), F.col(f"o{b}")) + F.least(F.col(f"rest{a}"), F.col(f"rest{b}")) >= alpha(f"n{a}", f"n{b}")
        )

    apart = (F.col("lox") != F.col("hiy")) | (F.col("hix") != F.col("loy"))
    near = F.least(F.col("nx") - F.col("posx"), F.col("ny") - F.col("posy")) >= alpha("nx", "ny")
    once = ~F.col("outy") | (F.col("gidx") <= F.col("gidy"))
    pairs = x.where("outx").join(y, "h").where(apart & near & once & bounded("x", "y")).select(F.col("hubx").alias("hub"), "gidx", "gidy").distinct()
    mx, my = (seen.select("hub", *(F.col(c).alias(f"{c}{k}") for c in ("gid", "rep", "n", "o", "rest", "comp"))) for k in "xy")
    open_pairs = pairs.join(mx, ["hub", "gidx"]).join(my, ["hub", "gidy"]).where((F.col("compx") != F.col("compy")) & bounded("x", "y"))
    open_pairs = open_pairs.select(F.least("repx", "repy").alias("a"), F.greatest("repx", "repy").alias("b")).distinct()
    more = stored(_verified(open_pairs, full).where(linked).select("a", "b"), "jaccard-more")

    of = lambda c: first.select(F.col("v").alias(c), F.col("c").alias(f"c{c}"))
    bridges = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    second = components(bridges, "jaccard-second")
    ends = first.toDF("rep", "mid").unionByName(second.join(first, second.v == first.v, "left_anti").select(F.col("v").alias("rep"), F.col("v").alias("mid")))
    top = ends.join(second.toDF("mid", "top"), "mid", "left").select("rep", F.coalesce("top", "mid").alias("top"))
    keys = hashed.where("n > 0 AND doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("rep")).join(top, "rep", "left").select("key", F.coalesce("top", "rep").alias("top"))
    out = hashed.select("doc_id", "n", "key").join(keys, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("top", "doc_id")).alias("component_id"))
    return out


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns as they are, less those of documents that are not the first of their component.

    Rows that share a doc_id are one document and stay or go together. Rows with a null doc_id and rows without words
    stay.
    """
    parts = jaccard_components(docs, width, percent)
    kept = parts.where("doc_id = component_id AND n_shingles > 0").select("doc_id").distinct()
    bare = parts.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id").distinct()
    name = "_kept"
    while name in docs.columns:
        name += "_"
    return docs.join(kept.union(bare).distinct().withColumnRenamed("doc_id", name), F.col("doc_id").eqNullSafe(F.col(name)), "left_semi")
