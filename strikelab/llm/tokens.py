"""Token-id output: ids ranked by frequency, in one to four bytes each, lengths apart in control bytes.

A table of blocks is the file format. A block holds whole documents in ascending order: `docs` and `counts` (a document's
ids), `control` (two bits an id, four ids a byte: the length of its code less one), `data` (the codes, least byte first)
and `first` (ids before it in its part). Parts are numbered in ascending order. The most frequent ids get the shortest
codes. Readers find everything in the blocks and the rank table, which is no larger than the vocabulary.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import raw, slices, stored

#: Ids in a block, more only where one document has more.
BLOCK_IDS = 1 << 18
#: Pieces remembered in one worker; at this number the memory starts again.
MEMORY = 600_000

# For each control byte: the lengths of its four codes.
_LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data of the codes."""
    r = np.asarray(ranks, np.uint32)
    size = 1 + (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    bits = np.concatenate([size - 1, np.zeros(-len(r) % 4, np.uint8)]).reshape(-1, 4)
    control = bits[:, 0] | bits[:, 1] << 2 | bits[:, 2] << 4 | bits[:, 3] << 6
    data = r.astype("<u4").view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks, by table lookup of each control byte's four lengths."""
    size = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    ends = np.cumsum(size, dtype=np.int64)
    at = ends - size
    b = np.frombuffer(data + bytes(3), np.uint8)
    out = b[at].astype(np.uint32)
    for k in (1, 2, 3):
        if (more := size > k).any():
            out[more] |= b[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


#: A stop or comma between a letter or digit and white space is a piece of its own to the tokenizer.
_TAIL = re.compile(rb"([a-z0-9])([.,])(?=[\x20\x09-\x0D])")


def cut(text: bytes | None) -> list[bytes]:
    """The text's pieces.

    The tokenizer composes characters and then lower-cases, so A-Z can be lower-cased here where nothing composes with
    them: marks that do are in U+0300-037F, whose first byte is 0xCC or 0xCD. Other texts keep their case, as do texts
    that may hold a special token, which the tokenizer finds before that; these are only split.
    """
    text = text or b""
    if b"<|" in text:
        return text.split()
    return _TAIL.sub(rb"\1 \2", text if b"\xcc" in text or b"\xcd" in text else text.lower()).split()


#: Words of small Latin letters; the tokenizer makes one word of each, and neither composes nor changes its letters.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: A plain word and marks after it, which make one more word of the tokenizer; an apostrophe could be part of a rule, "<" of a special token.
_TAILED = re.compile(_PLAIN.pattern + rb"[!-&(-/:;=-@\[-`{-~]+")
#: So many such words go to the tokenizer as one line.
LINE = 64


class Pieces:
    """Ids of white-space pieces of text, through the tokenizers library, each distinct piece once."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the threads
        self.tokenizer = Tokenizer.from_file(path)
        mark = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # ids that end a word
        self.last[[i for t, i in vocabulary.items() if mark and t.endswith(mark)]] = True
        self.start()

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in a row, and how many each has."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in pieces], add_special_tokens=False)]
        return np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64)

    def encode_lines(self, words: list[bytes], each: int) -> tuple[np.ndarray, np.ndarray]:
        """As encode, in lines, of pieces that are `each` words to the tokenizer: the ids that end words part them. One by one where the two don't agree."""
        lines = [b" ".join(words[i : i + LINE]).decode() for i in range(0, len(words), LINE)]
        ids = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)]
        flat = np.concatenate([np.zeros(0, np.uint32), *ids])
        ends = np.flatnonzero(self.last[flat])
        return (flat, np.diff(ends[each - 1 :: each], prepend=-1)) if len(ends) == each * len(words) else self.encode(words)

    def start(self) -> None:
        self.at: dict[bytes, int] = {}
        self.flat, self.offset, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __call__(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each text has."""
        if len(self.at) > MEMORY:
            self.start()
        parts = list(map(cut, texts))
        new: set[bytes] = set()
        for p in parts:
            new.update(set(p).difference(self.at))
        if new:
            plain = list(filter(_PLAIN.fullmatch, new))
            new.difference_update(plain)
            tailed = list(filter(_TAILED.fullmatch, new))
            rest = list(new.difference(tailed))
            found = self.encode_lines(plain, 1), self.encode_lines(tailed, 2), self.encode(rest)
            new, ids, size = plain + tailed + rest, np.concatenate([x for x, _ in found]), np.concatenate([n for _, n in found])
            self.offset = np.concatenate([self.offset, len(self.flat) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, ids])
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
        which = np.fromiter(map(self.at.__getitem__, chain.from_iterable(parts)), np.int64)
        size = self.size[which]
        total = np.cumsum(size)
        ids = self.flat[np.repeat(self.offset[which] - total + size, size) + np.arange(total[-1] if len(total) else 0)]
        ends = np.cumsum([len(p) for p in parts])
        upto = np.concatenate([[0], total])[np.concatenate([[0], ends])]
        return ids, np.diff(upto)


@cache
def _pieces(path: str) -> Pieces:
    """One for each worker process."""
    return Pieces(path)


def tokenize(docs: DataFrame, path: str, end_id: int, width: int = 4) -> DataFrame:
    """doc_id and ids (unsigned little-endian, of `width` bytes, with end_id last) of each whole text; null: empty.

    The text is cut at ASCII white space first, where the tokenizer's own rules (white space dropped, no rule across it)
    cut as well, so the ids are those of the whole text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path)
        for b in slices(batches, most=2 << 20):
            ids, counts = pieces(raw(b["text"]))
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends, end_id).astype(f"<u{width}")
            ends += np.arange(1, len(ends) + 1)
            offsets = np.concatenate([[0], ends * width]).astype(np.int32)
            column = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(ids.tobytes())])
            yield pa.record_batch([b["doc_id"], column], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids binary")


def rank_ids(tokens: DataFrame, width: int = 4) -> np.ndarray:
    """ids by rank: most frequent first, of equals the smaller id. Counted over all tokens; as long as the vocabulary in use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            data = b["ids"]
            some = np.bincount(np.frombuffer(b"".join(raw(data)), f"<u{width}"))
            if len(some) > len(total):
                some[: len(total)] += total
                total = some
            else:
                total[: len(some)] += some
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    counts = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return np.array([r[0] for r in sorted(counts, key=lambda r: (-r[1], r[0]))], np.uint32)


def write_blocks(tokens: DataFrame, ranks: np.ndarray, width: int = 4, block_ids: int = BLOCK_IDS) -> DataFrame:
    """The blocks of tokens (doc_id, ids), stored, in ascending order of doc_id (nulls first; of equals by the ids)."""
    to_rank = np.zeros(int(ranks.max()) + 1 if len(ranks) else 1, np.uint32)
    to_rank[ranks] = np.arange(len(ranks), dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, first = TaskContext.get().partitionId(), 0, 0
        docs: list[int | None] = []
        held: list[bytes] = []
        n = 0

        def block() -> pa.RecordBatch:
            control, data = pack(to_rank[np.frombuffer(b"".join(held), f"<u{width}")])
            row = {"part": [part], "seq": [seq], "first": [first], "docs": [docs], "counts": [[len(x) // width for x in held]], "control": [control], "data": [data]}
            return pa.record_batch(row, schema=schema)

        schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("first", pa.int64()), ("docs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary())])
        for b in batches:
            for doc, ids in zip(b["doc_id"].to_pylist(), raw(b["ids"]), strict=True):
                if n and n + len(ids) // width > block_ids:
                    yield block()
                    seq, first, docs, held, n = seq + 1, first + n, [], [], 0
                docs.append(doc)
                held.append(ids)
                n += len(ids) // width
        if docs:
            yield block()

    parts = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64("ids")
    ordered = tokens.repartitionByRange(parts, F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie, F.col("ids"))
    return stored(ordered.mapInArrow(run, "part int, seq int, first long, docs array<bigint>, counts array<bigint>, control binary, data binary"), "token-blocks", compression="none")


def read_blocks(blocks: DataFrame, ranks: np.ndarray) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (unsigned 32-bit little-endian) of every document in the blocks."""
    sizes = blocks.groupBy("part").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect()  # a row a part
    base, total = {}, 0
    for part, n in sorted(sizes):
        base[part], total = total, total + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, first, docs, counts, control, data in zip(b["part"].to_pylist(), b["first"].to_pylist(), b["docs"].to_pylist(), b["counts"].to_pylist(), raw(b["control"]), raw(b["data"]), strict=True):
                counts = np.array(counts, np.int64)
                ends = np.cumsum(counts)
                ids = ranks[unpack(control, data, int(ends[-1]))].astype("<u4")
                offsets = np.concatenate([[0], ends * 4]).astype(np.int32)
                column = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(ids.tobytes())])
                yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(base[part] + first + ends - counts), column], ["doc_id", "start", "ids"])

    return blocks.mapInArrow(run, "doc_id long, start long, ids binary")


def binary_output(docs: DataFrame, path: str, end_id: int) -> tuple[DataFrame, np.ndarray]:
    """The blocks of all texts, and the ids by rank. Null texts hold end_id alone; repeated rows are documents of their own."""
    width = 2 if max(end_id, Tokenizer.from_file(path).get_vocab_size() - 1) < 1 << 16 else 4
    tokens = stored(tokenize(docs, path, end_id, width), "token-ids")
    ranks = rank_ids(tokens, width)
    return write_blocks(tokens, ranks, width), ranks


def digests(read: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what read_blocks gives, row by row: null and repeated ids are as any, no rows give none."""
    return read.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


