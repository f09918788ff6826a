"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows, run once over each text.

The automaton's nodes are bounded: a benchmark of more windows is scanned in blocks, each with its own automaton, which each
worker process builds once. Only what a block hits is stored and put together, never the texts again.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw, slices, stored

#: ASCII capitals become small; every ASCII byte that is no letter or digit becomes a space; bytes from 0x80 are parts of words.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Nodes of one automaton at most (some 40 bytes each): no more than the bytes of its windows, of which a word starts one each.
NODES = 8_000_000
#: The automaton that this worker process has built last.
_BUILT: dict[str, ahocorasick.Automaton | None] = {}


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_NORMAL).split()


def windows_of(text: bytes | None, width: int) -> list[bytes]:
    """The item's windows of `width` words, each between spaces; an item of fewer words is one window; none without words."""
    w = words_of(text)
    k = min(width, len(w))
    return [b" " + b" ".join(w[i : i + k]) + b" " for i in range(len(w) - k + 1)] if k else []


def automaton(items: list[tuple[str | None, bytes]], width: int) -> ahocorasick.Automaton | None:
    """Each window leads to (its bytes in Latin-1 letters, its words, the items that hold it). None if no item has words."""
    holders: dict[bytes, set[str]] = {}
    for item, text in items:
        for w in windows_of(text, width):
            ids = holders.setdefault(w, set())
            if item is not None:
                ids.add(item)
    if not holders:
        return None
    out = ahocorasick.Automaton()
    for w, ids in holders.items():
        out.add_word(w.decode("latin-1"), (len(w), w.count(b" ") - 1, tuple(sorted(ids))))
    out.make_automaton()
    return out


def scan(text: bytes | None, find: ahocorasick.Automaton | None) -> tuple[int, np.ndarray, list[str]]:
    """Words of the text, which of them lie in a window's occurrence (booleans), and the items with occurring windows, sorted as strings."""
    words = words_of(text)
    flat = b" " + b" ".join(words) + b" "
    found = list(find.iter(flat.decode("latin-1"))) if find and words else []
    change = np.zeros(len(words) + 1, np.int64)
    items: set[str] = set()
    if found:
        gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)  # word i stands between gaps i and i + 1
        ends = np.array([e for e, _ in found])
        last = np.searchsorted(gaps, ends)
        lengths = np.array([n for _, (_, n, _) in found])
        np.add.at(change, last - lengths, 1)
        np.add.at(change, last, -1)
        for _, (_, _, ids) in found:
            items.update(ids)
    return len(words), np.cumsum(change)[:-1] > 0, sorted(items)


def spans(text: str | None, hit: np.ndarray) -> list[tuple[int, int]]:
    """The hit words as (start, end) characters of the original text, neighbours joined."""
    flat = (text or "").encode().translate(_NORMAL)
    b = np.frombuffer(flat, np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[False], b, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    char = np.concatenate([[0], np.cumsum((np.frombuffer((text or "").encode(), np.uint8) & 0xC0) != 0x80)])
    out: list[tuple[int, int]] = []
    before = False
    for s, e, h in zip(starts.tolist(), ends.tolist(), hit.tolist(), strict=True):
        if h:
            at = int(char[s]), int(char[e])
            if before:
                out[-1] = out[-1][0], at[1]
            else:
                out.append(at)
        before = h
    return out


def pieces_of(text: bytes | None, width: int, nodes: int) -> Iterator[tuple[bytes, int]]:
    """The text's words in pieces that share width - 1 words, so that each window lies in one, with the bytes of their windows: `nodes`
    or a little more at most."""
    w = words_of(text)
    size = np.concatenate([[0], np.cumsum([len(x) + 1 for x in w])])
    count = max(len(w) - width + 1, 1) if w else 0
    start = 0
    while start < count:
        # A piece's windows start at start .. end - 1.
        end, held = start, 0
        while end < count and (end == start or held < nodes):
            held += int(size[min(end + width, len(w))] - size[end]) + 1
            end += 1
        yield b" ".join(w[start : end + width - 1]), held
        start = end


Block = list[tuple[str | None, bytes]]


def _blocks(benchmark: DataFrame, width: int, nodes: int) -> Iterator[Block]:
    """The benchmark's items, cut into pieces in Spark, in blocks of `nodes` bytes of windows or a piece more; one block at least."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [(i, p, n) for i, t in zip(b["item"].to_pylist(), raw(b["text"]), strict=True) for p, n in pieces_of(t, width, max(nodes // 8, 1))]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())], ["item", "piece", "nodes"])

    block, held = [], 0
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    for r in items.mapInArrow(cut, "item string, piece binary, nodes long").toLocalIterator():
        if held and held + r["nodes"] > nodes:
            yield block
            block, held = [], 0
        block.append((r["item"], bytes(r["piece"])))
        held += r["nodes"]
    yield block


def _finder(docs: DataFrame, block: Block, width: int) -> Callable[[], ahocorasick.Automaton | None]:
    """Gives the block's automaton in a task; its items are a broadcast of bounded size, and a worker process builds it once."""
    items, key = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

    def find() -> ahocorasick.Automaton | None:
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = automaton(items.value, width)
        return _BUILT[key]

    return find


_OUT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start: long, end: long>>"


def _digested(ids: pa.Array, texts: list[bytes | None], rows: list[tuple[int, np.ndarray, list[str]]]) -> pa.RecordBatch:
    return pa.record_batch(
        {
            "doc_id": ids,
            "n_words": pa.array([n for n, _, _ in rows], pa.int64()),
            "n_hit": pa.array([int(h.sum()) for _, h, _ in rows], pa.int64()),
            "n_items": pa.array([len(i) for _, _, i in rows], pa.int64()),
            "items_sha256": pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for _, _, i in rows], pa.string()),
            "contaminated": pa.array([bool(h.any()) for _, h, _ in rows], pa.bool_()),
            "spans": pa.array([[{"start": s, "end": e} for s, e in spans((t or b"").decode(), h)] if h.any() else [] for t, (_, h, _) in zip(texts, rows, strict=True)], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        }
    )


def _numbered(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """docs, stored once with a number for each row."""
    row = "_row"
    while row in docs.columns:
        row += "_"
    return stored(docs.withColumn(row, F.monotonically_increasing_id()), name), row


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, nodes: int = NODES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans for each row of docs (doc_id, text).

    Words: runs of letters, digits and non-ASCII characters, A-Z lower-cased. A document word is hit inside any
    occurrence of a window: `width` consecutive words of an item, or all words of a shorter item. items_sha256: hex of the
    items' ids, sorted as strings and comma-joined. spans: (start, end) in characters of the original text. Null text: no
    words. Items without text or words match nothing; those without an id hit words but are no items. Rows with a null or
    repeated doc_id are judged one by one. An automaton has `nodes` nodes at most, by a bound on the bytes of its windows (an
    item's windows are dealt to several if need be): a larger benchmark takes one pass over the texts for each, which
    stores the hit words of the documents that it hits.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = _blocks(benchmark, width, nodes)
    block, after = next(blocks), next(blocks, None)
    if after is None:
        find = _finder(docs, block, width)

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                texts = raw(b["text"])
                yield _digested(b["doc_id"], texts, [scan(t, find()) for t in texts])

        return base.mapInArrow(whole, _OUT)
    base, row = _numbered(base, "contamination-texts")

    def passed(block: Block) -> DataFrame:
        find = _finder(docs, block, width)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                found = [(i, np.packbits(h).tobytes(), items) for i, t in zip(b[row].to_pylist(), raw(b["text"]), strict=True) for _, h, items in [scan(t, find())] if h.any()]
                yield pa.record_batch([pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.int64(), pa.binary(), pa.list_(pa.string())))], [row, "hits", "items"])

        return stored(base.select(row, "text").mapInArrow(run, f"{row} long, hits binary, items array<string>"), "contamination-hits")

    hits = []
    while block is not None:
        hits.append(passed(block))
        block, after = after, next(blocks, None) if after is not None else None
    # A row's hits are one for each block at most.
    found = reduce(DataFrame.unionByName, hits).groupBy(row).agg(F.collect_list("hits").alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = raw(b["text"])
            rows = []
            for t, h, i in zip(texts, b["hits"].to_pylist(), b["items"].to_pylist(), strict=True):
                n = len(words_of(t))
                bits = reduce(np.bitwise_or, (np.frombuffer(x, np.uint8) for x in h)) if h else np.zeros((n + 7) // 8, np.uint8)
                rows.append((n, np.unpackbits(bits, count=n).astype(bool), sorted(i or [])))
            yield _digested(b["doc_id"], texts, rows)

    return base.join(found, row, "left").select("doc_id", "text", "hits", "items").mapInArrow(ended, _OUT)


def without_benchmark(docs: DataFrame, benchmark: DataFrame, width: int = 10, nodes: int = NODES) -> DataFrame:
    """The rows of docs, all columns as they are, whose text holds no benchmark window. Null and empty texts stay; ties, null ids
    and repeated rows are as any row. A large benchmark takes a pass for each automaton, which stores the rows to go."""

    def clean(texts: list[bytes | None], find: ahocorasick.Automaton | None) -> list[bool]:
        return [next(find.iter((b" " + b" ".join(words_of(t)) + b" ").decode("latin-1")), None) is None if find and t else True for t in texts]

    blocks = _blocks(benchmark, width, nodes)
    block, after = next(blocks), next(blocks, None)
    if after is None:
        find = _finder(docs, block, width)

        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                yield b.filter(pa.array(clean(raw(b.column(b.schema.get_field_index("text"))), find()), pa.bool_()))

        return docs.mapInArrow(kept, docs.schema)
    base, row = _numbered(docs, "decontamination-texts")

    def passed(block: Block) -> DataFrame:
        find = _finder(docs, block, width)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                yield pa.record_batch([b[row].filter(pa.array([not x for x in clean(raw(b["text"]), find())], pa.bool_()))], [row])

        return stored(base.select(row, "text").mapInArrow(run, f"{row} long"), "decontamination-hits")

    gone = []
    while block is not None:
        gone.append(passed(block))
        block, after = after, next(blocks, None) if after is not None else None
    return base.join(reduce(DataFrame.unionByName, gone).distinct(), row, "left_anti").select(*docs.columns)
