"""Byte-level BPE: distinct words walked as a prefix trie, each prefix encoded once, and decoding by token bytes.

In byte-pair encoding the tokens of a word's prefix are settled by its last token: the encoding of p[:i] is that of
p[:i - len(t)] followed by t, for the one token t that ends there and can stand after the last token before it. Words in
sorted order are the depth-first walk of their trie, so a stack of last tokens, cut to the prefix shared with the word
before, encodes each shared prefix once.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, with_field

#: Fixed: how this family of tokenizers splits text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words remembered in one worker: so many in the young generation, and the one before it.
MEMORY = 150_000
#: Pairs of tokens remembered.
FOLLOWS = 300_000
#: Bits of a token id in a pair.
SHIFT = 20


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in such vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """A tokenizer file's vocabulary, merges and special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        of = lambda s: bytes(letters[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {of(s): i for s, i in spec["model"]["vocab"].items() if s not in self.special}
        self.bytes = {i: s for s, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.names = {i: str(i) for i in self.bytes}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for k, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            a, b = of(a), of(b)
            pair = self.ids[a], self.ids[b]
            self.rank[pair] = k
            self.parts.setdefault(self.ids[a + b], pair)
        self.made = {t: self.rank[p] for t, p in self.parts.items()}  # the merge that makes a token
        self.reachable = {s: i for s, i in self.ids.items() if len(s) == 1 or i in self.parts}
        self.longest = max(map(len, self.reachable))
        self.follows: dict[int, bool] = {}  # pairs of tokens, whether the second can follow the first
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words = regex.compile(WORDS)

    def _can_follow(self, a: int, b: int) -> bool:
        """Whether a then b stay two tokens: no merge across the seam comes before the merges that built its two sides.

        Undo the later of the two sides' last merges again and again: at each state that the seam passes through, the pair
        there must not have a merge that would have come first.
        """
        at_left, at_right, before = self.made.get(a, -1), self.made.get(b, -1), len(self.rank)
        while True:
            if self.rank.get((a, b), before) < before:
                return False
            if at_left < 0 and at_right < 0:
                return True
            if at_left >= at_right:  # of equal merges the left one is done first, so it is the earlier state's right end that counts
                if at_left == at_right:
                    before, b = at_right + 1, self.parts[b][0]
                    at_right = self.made.get(b, -1)
                    continue
                before, a = at_left, self.parts[a][1]
                at_left = self.made.get(a, -1)
            else:
                before, b = at_right + 1, self.parts[b][0]
                at_right = self.made.get(b, -1)

    def _follows(self, key: int) -> bool:
        """_can_follow of the tokens in key (left, then right in the low bits), remembered."""
        if len(self.follows) > FOLLOWS:
            self.follows.clear()
        ok = self.follows[key] = self._can_follow(key >> SHIFT, key & (1 << SHIFT) - 1)
        return ok

    def encode_sorted(self, words: Iterable[bytes]) -> Iterator[tuple[int, ...]]:
        """Ids of each word; words must be in ascending order."""
        get, known, find, longest = self.reachable.get, self.follows.get, self._follows, self.longest
        last: list[int] = [-1]  # of each prefix of the word at hand, its last token
        size: list[int] = [0]  # and that token's bytes
        before = b""
        for w in words:
            n, most = 0, min(len(before), len(w))
            while n < most and before[n] == w[n]:
                n += 1
            del last[n + 1 :], size[n + 1 :]
            for end in range(n + 1, len(w) + 1):
                held = end - 1 - size[n]  # most often the token before grows by the byte
                n = end
                t = get(w[held:end])
                if t is not None:
                    if held:
                        key = last[held] << SHIFT | t
                        ok = known(key)
                        if ok is None:
                            ok = find(key)
                    else:
                        ok = True
                    if ok:
                        last.append(t)
                        size.append(end - held)
                        continue
                # or a shorter token starts within it, or a longer one before it
                for start in chain(range(end - 1, held, -1), range(held - 1, max(-1, end - longest - 1), -1)):
                    t = get(w[start:end])
                    if t is None:
                        continue
                    if start:
                        key = last[start] << SHIFT | t
                        ok = known(key)
                        if not (find(key) if ok is None else ok):
                            continue
                    last.append(t)
                    size.append(end - start)
                    break
            ids, end = [], len(w)
            while end:
                ids.append(last[end])
                end -= size[end]
            ids.reverse()
            yield tuple(ids)
            before = w

    def pieces(self, text: str) -> list[str]:
        """Special tokens and words, in order."""
        if not self.split or not any(s in text for s in self.special):
            return self.words.findall(text)
        out: list[str] = []
        at = 0
        for m in self.split.finditer(text):
            out += self.words.findall(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self.words.findall(text[at:])

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@cache
def encoder_of(path: str) -> "Encoder":
    """One encoder for each worker process: its tables and the words it has met serve all its tasks."""
    return Encoder(path)


class Encoder:
    """Texts to ids, a batch at a time; remembers the words it has met, in two generations: a word met again is young again."""

    def __init__(self, path: str):
        self.codec = Codec(path)
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def __call__(self, texts: list[str | None]) -> list[list[int]]:
        pieces = [self.codec.pieces(t or "") for t in texts]
        if len(self.young) > MEMORY:
            self.young, self.old = {}, self.young
        young, old, special = self.young, self.old, self.codec.special
        met = set().union(*pieces).difference(young)
        again = met.intersection(old)
        young.update(zip(again, map(old.__getitem__, again), strict=True))
        met -= again
        for w in met & special.keys():
            young[w] = (special[w],)
        new = sorted(w.encode() for w in met if w not in special)
        for w, ids in zip(new, self.codec.encode_sorted(new), strict=True):
            young[w.decode()] = ids
        return [list(chain.from_iterable(map(young.__getitem__, p))) for p in pieces]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs' columns with ids array<int>: the text (null: empty) in the tokens of the tokenizer file at `path`.

    Special tokens' strings in a text become those tokens, as the tokenizers library does by default. A column of docs
    named ids is replaced. Work is row by row, so ties, repeated rows and null ids are as any row.
    """
    base = docs.drop("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for b in slices(batches, most=2 << 20):
            ids = encoder(b.column(b.schema.get_field_index("text")).to_pylist())
            yield pa.record_batch([*b.columns, pa.array(ids, pa.list_(pa.int32()))], [*b.schema.names, "ids"])

    return base.mapInArrow(run, with_field(base, "ids", "array<int>"))


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """tokens' columns (with ids) and decoded: the text of the ids, special tokens included; null ids give null."""
    base = tokens.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder_of(path).codec
        for b in batches:
            ids = b.column(b.schema.get_field_index("ids")).to_pylist()
            yield pa.record_batch([*b.columns, pa.array([None if x is None else codec.decode(x) for x in ids], pa.string())], [*b.schema.names, "decoded"])

    return base.mapInArrow(run, with_field(base, "decoded", "string"))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 for each row of docs: encoded, then decoded from the ids alone.

    encode() and decode() in one task, which returns digests in place of ids and texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        names = encoder.codec.names.__getitem__
        for b in slices(batches):
            ids = encoder(b["text"].to_pylist())
            yield pa.record_batch(
                {
                    "doc_id": b["doc_id"],
                    "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(",".join(map(names, x)).encode()).hexdigest() for x in ids]),
                    "decoded_sha256": pa.array([hashlib.sha256(encoder.codec.decode(x).encode()).hexdigest() for x in ids]),
                }
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
