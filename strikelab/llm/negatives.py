"""Hard-negative mining: cover trees over norm-augmented candidates, searched best first for the largest inner products.

A vector x becomes x with sqrt(M^2 - |x|^2) at its end, so that all have one norm M and the nearest have the largest inner
products. Vectors are dealt by their nearest of a few pivots (the top level), large cells are split, and each part has its
own tree. A node has a centre and a covering radius R, so with a query q all its products lie within q.centre +- |q| R:
nodes below the k-th best found, or outside all windows, are skipped. A leaf is one distinct vector: its product is exact.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Vectors of one tree and anchors of one batch, on average at most; pivots at most, and vectors a pivot stands for.
BLOCK, BATCH, PIVOTS, CELL = 2048, 256, 128, 8192
#: Each level's radius is the one above times this.
SHRINK = 0.75
#: Products must stay under this, where doubles are exact and a hundredfold fits in 64 bits.
_MOST = float(1 << 52)


@dataclass
class CoverTree:
    """Nodes in order of level: centre (a place in `points`), parent, covering radius, level; a leaf's radius is 0.

    points: distinct vectors, whole numbers. rows: `starts` of each point's rows in ids and labels, which are sorted.
    """

    points: np.ndarray
    centre: np.ndarray
    parent: np.ndarray
    radius: np.ndarray
    level: np.ndarray
    starts: np.ndarray
    ids: np.ndarray
    labels: np.ndarray


def cover_tree(vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> CoverTree:
    """Top down: a node's points are covered by centres, its own first, no two of them closer than the level's radius; each
    point joins its nearest. A point alone is a leaf. Works on the matrix of distances, so a tree's rows are bounded."""
    order = np.lexsort([ids, *vectors.T])
    vectors, ids, labels = vectors[order], ids[order], labels[order]
    new = np.ones(len(vectors), bool)
    new[1:] = (vectors[1:] != vectors[:-1]).any(1)
    points, starts = vectors[new], np.append(np.flatnonzero(new), len(vectors))
    norms = (points * points).sum(1)
    grown = np.column_stack([points, np.sqrt(max(norms.max(initial=0), 0) - norms)])
    square = (grown * grown).sum(1)
    far = np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * grown @ grown.T, 0))
    root = int(np.argmin(((grown - grown.mean(0)) ** 2).sum(1)))
    nodes = [(root, -1, float(far[root].max()), 0)]
    open_ = [(0, np.arange(len(points)))]
    level = 0
    while open_:
        level += 1
        below = []
        for node, held in open_:
            c = nodes[node][0]
            if len(held) == 1:
                if nodes[node][2] > 0:
                    nodes.append((c, node, 0.0, level))
                continue
            d = far[c, held]
            reach = float(d.max()) * SHRINK
            near, of, centres = d.copy(), np.zeros(len(held), np.int64), [c]
            left = np.flatnonzero(d > reach)
            while len(left):
                p = held[left[0]]
                e = far[p, held]
                closer = e < near
                near[closer], of[closer] = e[closer], len(centres)
                centres.append(int(p))
                left = left[far[p, held[left]] > reach]
            for k, p in enumerate(centres):
                own = held[of == k]
                if len(own):
                    radius = float(far[p, own].max()) if len(own) > 1 else 0.0
                    nodes.append((p, node, radius, level))
                    if len(own) > 1:
                        below.append((len(nodes) - 1, own))
        open_ = below
    c, p, r, v = map(np.array, zip(*nodes, strict=True))
    return CoverTree(points, c, p, r, v, starts, ids, labels)


def best_first(tree: CoverTree, queries: np.ndarray, take, low: np.ndarray | None = None, high: np.ndarray | None = None) -> np.ndarray:
    """Products (queries, points), -inf where a point was skipped.

    take(found): the product of each query below which nothing can count any more, from what is found so far. low, high:
    (queries, windows); a node that meets none of its query's windows is skipped. Each round every query opens its best
    open nodes, twice as many as in the round before, so later nodes meet a tighter bound.
    """
    m, n = len(queries), len(tree.centre)
    size = np.sqrt((queries * queries).sum(1))
    slack = 1e-7 * (1 + size * (np.sqrt((tree.points**2).sum(1).max(initial=0)) + tree.radius.max(initial=0)))
    kids: list[list[int]] = [[] for _ in range(n)]
    for i, p in enumerate(tree.parent.tolist()):
        if p >= 0:
            kids[p].append(i)
    leaf = np.array([not k for k in kids])
    upper, found = np.full((m, n), -np.inf), np.full((m, len(tree.points)), -np.inf)
    fresh, wave = np.zeros(1, np.int64), np.ones((m, 1), bool)
    most, step = np.full(m, -np.inf), 8
    while True:
        s = queries @ tree.points[tree.centre[fresh]].T
        reach = size[:, None] * tree.radius[fresh][None, :] + slack[:, None]
        up = s + reach
        ok = wave & (up >= most[:, None])
        if low is not None:
            met = np.zeros_like(ok)
            for w in range(low.shape[1]):
                met |= (up >= low[:, w, None]) & (s - reach <= high[:, w, None])
            ok &= met
        ends = leaf[fresh]
        if ends.any():  # every point has one leaf; other queries may have met it before
            at = tree.centre[fresh[ends]]
            found[:, at] = np.where(ok[:, ends], s[:, ends], found[:, at])
            most = np.maximum(most, take(found) - 2 * slack)
        inner = np.flatnonzero(~ends)
        upper[:, fresh[inner]] = np.where(ok[:, inner], up[:, inner], upper[:, fresh[inner]])
        alive = np.flatnonzero(((upper >= most[:, None]) & np.isfinite(upper)).any(0))
        if not len(alive):
            return found
        part = np.where(upper[:, alive] >= most[:, None], upper[:, alive], -np.inf)
        chosen = np.isfinite(part)
        if step < len(alive):
            chosen &= part >= -np.partition(-part, step - 1, axis=1)[:, step - 1, None]
        opened, chosen = alive[chosen.any(0)], chosen[:, chosen.any(0)]
        upper[:, opened] = np.where(chosen, -np.inf, upper[:, opened])
        fresh = np.array([k for o in opened.tolist() for k in kids[o]])
        wave = np.repeat(chosen, [len(kids[o]) for o in opened.tolist()], axis=1)
        step *= 2


def _holds(tree: CoverTree, labels: np.ndarray, same: bool) -> np.ndarray:
    """(queries, points): whether a point has a row of the query's label, or of another."""
    n = len(tree.points)
    lines = np.repeat(np.arange(n), np.diff(tree.starts))
    of = {int(k): np.bincount(lines[(tree.labels == k) == same], minlength=n) > 0 for k in set(labels.tolist())}
    return np.stack([of[k] for k in labels.tolist()])


def _kth(found: np.ndarray, most: int) -> np.ndarray:
    """The product that most + 1 points reach, of which the query's own may be one; -inf without so many."""
    if found.shape[1] <= most:
        return np.full(len(found), -np.inf)
    return np.partition(found, found.shape[1] - most - 1, axis=1)[:, found.shape[1] - most - 1]


def _rows_of(tree: CoverTree, queries: np.ndarray, good: np.ndarray, own: np.ndarray, labels: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, score, id) of the good points' rows of the query's label, or of others, by query, highest score, smallest id. Scores are
    products of whole numbers."""
    q, p = np.nonzero(good)
    scores = np.einsum("ij,ij->i", queries[q].astype(np.int64), tree.points[p].astype(np.int64))
    size = np.diff(tree.starts)[p]
    at = np.repeat(tree.starts[p] - np.cumsum(size) + size, size) + np.arange(size.sum())
    q, scores = np.repeat(q, size), np.repeat(scores, size)
    kept = ((tree.labels[at] == labels[q]) == same) & (tree.ids[at] != own[q])
    q, scores, ids = q[kept], scores[kept], tree.ids[at[kept]]
    order = np.lexsort([ids, -scores, q])
    return q[order], scores[order], ids[order]


def _firsts(groups: np.ndarray, most: int) -> np.ndarray:
    """Which are among the first `most` of their group; groups are neighbours."""
    new = np.append(True, np.diff(groups) != 0)[: len(groups)]
    start = np.maximum.accumulate(np.where(new, np.arange(len(groups)), 0)) if len(groups) else groups
    return np.arange(len(groups)) - start < most


def _checked(tree: CoverTree, queries: np.ndarray) -> None:
    if float(np.sqrt((queries * queries).sum(1).max(initial=0)) * np.sqrt((tree.points * tree.points).sum(1).max(initial=0))) >= _MOST:
        raise ValueError("products of these vectors can pass 2^52")


def positives_in(tree: CoverTree, queries: np.ndarray, own: np.ndarray, labels: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, score, id) of each query's first `most` rows of its label in this tree."""
    _checked(tree, queries)
    holds = _holds(tree, labels, True)
    kth = lambda f: _kth(np.where(holds, f, -np.inf), most)
    found = best_first(tree, queries, kth)
    edge = kth(found)
    good = holds & np.isfinite(found) & (found >= (edge - 0.5)[:, None])
    q, s, i = _rows_of(tree, queries, good, own, labels, True)
    first = _firsts(q, most)
    return q[first], s[first], i[first]


def negatives_in(tree: CoverTree, queries: np.ndarray, own: np.ndarray, labels: np.ndarray, scores: list[list[int]], low: int, high: int, most: int) -> tuple[np.ndarray, ...]:
    """(query, place of the positive, score, id): for each query and each of its positives' scores p the first `most` rows of other
    labels with low * p <= 100 * s <= high * p."""
    _checked(tree, queries)
    wide = max(map(len, scores), default=0)
    goal = np.zeros((len(queries), wide), np.int64)
    lo, hi = np.full((len(queries), wide), np.inf), np.full((len(queries), wide), -np.inf)
    for i, s in enumerate(scores):
        goal[i, : len(s)] = s
        lo[i, : len(s)], hi[i, : len(s)] = np.array(s, float) * low / 100 - 0.5, np.array(s, float) * high / 100 + 0.5
    holds = _holds(tree, labels, False)
    lines = np.arange(len(queries))

    def edges(found: np.ndarray) -> np.ndarray:
        """(windows, queries): the product that most + 1 points well inside the window reach; -inf without so many."""
        order = np.sort(np.where(holds, found, -np.inf), axis=1)
        out = np.full((wide, len(queries)), -np.inf)
        for w in range(wide):
            at = (order <= (hi[:, w] - 1)[:, None]).sum(1) - most - 1
            value = np.where(at >= 0, order[lines, np.maximum(at, 0)], -np.inf)
            out[w] = np.where(value >= lo[:, w] + 1, value, -np.inf)
        return out

    used = np.isfinite(hi.T)
    found = best_first(tree, queries, lambda f: np.where(used, edges(f), np.inf).min(0, initial=np.inf), lo, hi)
    parts = []
    for w, edge in enumerate(edges(found)):
        good = holds & (found >= np.maximum(lo[:, w], edge - 0.5)[:, None]) & (found <= hi[:, w, None])
        q, s, i = _rows_of(tree, queries, good, own, labels, False)
        p = goal[q, w]
        inside = (low * p <= 100 * s) & (100 * s <= high * p)
        q, s, i = q[inside], s[inside], i[inside]
        first = _firsts(q, most)
        parts.append((q[first], np.full(first.sum(), w), s[first], i[first]))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 4


def _matrix(lists: pa.Array) -> np.ndarray:
    n = len(lists)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _batched(df: DataFrame, key: list[str], body, schema: str) -> DataFrame:
    return df.groupBy(*key).applyInArrow(body, schema)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, block: int = BLOCK, batch: int = BATCH, cell: int = CELL) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: id long, label int, vector array of whole numbers (any numeric type); is_anchor: a condition over them. Rows with
    a null in any of these, or in the vector, take no part. A score is the inner product with the anchor; higher ones come
    first, ties by smaller id. Positives: an anchor's first `positives` rows of its label; for each the first `negatives`
    rows of other labels whose score s has low * p <= 100 * s <= high * p. Rows of the anchor's own id are no partners;
    repeated anchors of one id are one (the least vector and label), other repeated rows count each. Only vectors of equal
    length meet; empty ones score 0. Products of vectors that can pass 2^52 are an error. Other columns are ignored.

    At most PIVOTS vectors of a bounded sample, picked by hash, are pivots. Cells of more than `block` rows are split by
    hash of id and row, so no key's group grows with the data; anchors meet each block in batches.
    """
    base = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("int").alias("label"), F.col("vector").cast("array<double>").alias("vector"), is_anchor.alias("anchor"))
    base = base.where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND NOT exists(vector, x -> x IS NULL)").withColumn("dim", F.size("vector"))
    base = base.withColumn("spread", F.pmod(F.xxhash64("id", "label", F.monotonically_increasing_id()), F.lit(1 << 30)).cast("int"))
    base = stored(base, "negatives-rows")
    sizes = {r["dim"]: r["n"] for r in base.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(PIVOTS).collect()}
    pivots: dict[int, np.ndarray] = {}
    for dim, n in sizes.items():
        want = min(PIVOTS, n // cell)
        if want > 1 and dim:
            some = base.where(F.col("dim") == dim).select("vector").distinct().orderBy(F.xxhash64("vector")).limit(want).collect()
            pivots[dim] = np.array([r[0] for r in some])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, dims = np.zeros(b.num_rows, np.int32), np.array(b["dim"].to_pylist(), np.int64)
            for dim in set(dims.tolist()) & set(pivots):
                of = np.flatnonzero(dims == dim)
                x, p = _matrix(b["vector"].take(pa.array(of))), pivots[dim]
                # The added last components differ little between rows, so the plain distance decides the cell.
                at[of] = np.argmin((p * p).sum(1)[None, :] - 2 * x @ p.T, axis=1)
            yield pa.record_batch([*b.columns, pa.array(at)], [*b.schema.names, "cell"])

    placed = stored(base.mapInArrow(dealt, "id long, label int, vector array<double>, anchor boolean, dim int, spread int, cell int"), "negatives-cells")
    counts = placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("splits"))
    placed = placed.join(counts, ["dim", "cell"]).withColumn("block", F.concat_ws("-", "dim", "cell", F.col("spread") % F.col("splits")))

    def built(key, table):  # no type hints: Spark would have to understand them all
        t = table.combine_chunks()
        ids, labels = t["id"].to_numpy(), t["label"].to_numpy()
        x = _matrix(t["vector"].combine_chunks()) if key[1].as_py() else np.zeros((len(ids), 0))
        tree = cover_tree(x, ids, labels)
        return pa.table({"block": [key[0].as_py()], "dim": pa.array([key[1].as_py()], pa.int32()), "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    trees = stored(_batched(placed.select("block", "dim", "id", "label", "vector"), ["block", "dim"], built, "block string, dim int, tree binary"), "negatives-trees", **{"parquet.block.size": str(8 << 20)})
    # Anchors: one a distinct id, numbered into batches.
    asked = placed.where("anchor").groupBy("id").agg(F.min(F.struct("vector", "label", "dim")).alias("a")).select(F.col("id").alias("anchor_id"), "a.*")
    pages = asked.groupBy("dim").agg(F.ceil(F.count("*") / batch).cast("int").alias("pages"))
    asked = stored(asked.join(pages, "dim").withColumn("page", F.pmod(F.xxhash64("anchor_id"), F.col("pages").cast("long")).cast("int")), "negatives-anchors")
    pairs = trees.select("block", "dim").join(pages, "dim").select("block", "dim", F.explode(F.sequence(F.lit(0), F.col("pages") - 1)).alias("page"))

    def meet(questions: DataFrame, extra: list[str], body, schema: str) -> DataFrame:
        """body(tree, ids, labels, queries, batch) for each block and batch of anchors."""
        fields = [("anchor_id", pa.int64()), ("label", pa.int32()), ("vector", pa.list_(pa.float64()))]
        packed = questions.groupBy("dim", "page").agg(F.sort_array(F.collect_list(F.struct("anchor_id", "label", "vector", *extra))).alias("batch"))
        joined = pairs.join(packed, ["dim", "page"]).join(trees.select("block", "tree"), "block").select("dim", "tree", "batch")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    tree, q = pickle.loads(b["tree"][i].as_py()), b["batch"][i].values
                    x = _matrix(q.field(fields[2][0])) if b["dim"][i].as_py() else np.zeros((len(q), 0))
                    yield body(tree, q.field("anchor_id").to_numpy(), q.field("label").to_numpy(), x, q)

        return joined.mapInArrow(run, schema)

    def find_positives(tree, ids, labels, x, q) -> pa.RecordBatch:
        at, scores, found_ids = positives_in(tree, x, ids, labels, positives)
        return pa.record_batch([pa.array(ids[at]), pa.array(found_ids), pa.array(scores)], ["anchor_id", "positive_id", "score"])

    found = meet(asked, [], find_positives, "anchor_id long, positive_id long, score long")
    # Every block gives an anchor `positives` rows at most; sorting these few is a bounded group an anchor.
    ranked = found.groupBy("anchor_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("positive_id").alias("id")))), 1, positives).alias("p"))
    wanted = stored(asked.join(ranked, "anchor_id").withColumn("p", F.transform("p", lambda v: F.struct((-v["s"]).alias("s"), v["id"].alias("id")))), "negatives-positives")

    def find_negatives(tree, ids, labels, x, q) -> pa.RecordBatch:
        mine = q.field("p").to_pylist()
        at, place, scores, found_ids = negatives_in(tree, x, ids, labels, [[v["s"] for v in p] for p in mine], low, high, negatives)
        of = [mine[a][p] for a, p in zip(at.tolist(), place.tolist(), strict=True)]
        return pa.record_batch([pa.array(ids[at]), pa.array(place), pa.array([v["id"] for v in of], pa.int64()), pa.array([v["s"] for v in of], pa.int64()), pa.array(found_ids), pa.array(scores)], ["anchor_id", "place", "positive_id", "positive_score", "negative_id", "score"])

    hard = meet(wanted, ["p"], find_negatives, "anchor_id long, place long, positive_id long, positive_score long, negative_id long, score long")
    top = hard.groupBy("anchor_id", "place", "positive_id", "positive_score").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("negative_id").alias("id")))), 1, negatives).alias("n"))
    return top.select("anchor_id", "positive_id", "positive_score", F.posexplode("n").alias("at", "v")).select("anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("v.id").alias("negative_id"), "positive_score", (-F.col("v.s")).alias("negative_score"))


ORACLE = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS s FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, s AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, id) <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.s AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.s DESC, s.id)::INT AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.s AND 100 * s.s <= 95 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
