"""Phrase collocation mining: HAT-tries count phrases in each task, and Spark merges their sorted runs.

Words and pairs are counted first. A longer phrase cannot be frequent unless all its pairs are, so phrases of three and
more words are counted only where a bitmap of the frequent pairs says so; the bitmap has a fixed size, and a wrong yes
costs time but changes no count.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import raw, slices, stored

#: Entries of a task's tries before the largest subtrees are spilled, and words known before everything is.
ENTRIES, WORDS = 1_500_000, 500_000
#: Suffixes of one hash container before it bursts into containers by the next word.
BURST = 8_192
#: Bits of the map of frequent pairs: 8 MB, whatever the size of the corpus.
BITS = 1 << 26
#: Salts of the first of two rankings of a language's phrases.
SALTS = 64
#: A-Z become small, what ends a piece a full stop, a tab a space.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else 46 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
_SHIFT = 32
_LOW = (1 << _SHIFT) - 1


class Words(dict):
    """Numbers of words, from 1 in order of arrival; 0 is the end of a piece. `hashes` has a 32-bit hash of each."""

    def __init__(self):
        super().__init__({b".": 0})
        self.names, self._hashes, self._known = [b"."], np.zeros(1, np.uint64), 1

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.names)
        self.names.append(word)
        return n

    @property
    def hashes(self) -> np.ndarray:
        if self._known < len(self.names):
            new = np.fromiter(map(zlib.crc32, self.names[self._known :]), np.uint64, len(self.names) - self._known)
            self._hashes = np.concatenate([self._hashes, new])
            self._known = len(self.names)
        return self._hashes


def numbered(words: Words, texts: list[bytes]) -> np.ndarray:
    """The words of some texts as numbers, 0 where a piece ends and at both ends."""
    flat = b".".join([b"", *texts, b""]).translate(_NORMAL).replace(b".", b" . ")
    tokens = pc.ascii_split_whitespace(pa.array([flat], pa.large_binary()).cast(pa.large_string())).flatten().dictionary_encode()
    of = np.array([words[w] if w else -1 for w in raw(tokens.dictionary)], np.int64)[tokens.indices.to_numpy()]
    return of[of >= 0]


class HatTrie:
    """Counts of phrases as (prefix, suffix), each one or two word numbers in 64 bits: under a prefix a hash container of suffixes,
    which bursts into a node with a container for each next word once it is large. `size`: entries in all."""

    def __init__(self, burst: int = BURST):
        self.root: dict[int, dict] = {}
        self.nodes: set[int] = set()
        self.burst, self.size = burst, 0

    def add(self, prefix: np.ndarray, suffix: np.ndarray, n: np.ndarray) -> None:
        """Entries in order of prefix."""
        edges = [0, *(np.flatnonzero(np.diff(prefix)) + 1).tolist(), len(prefix)] if len(prefix) else [0]
        suffixes, counts = suffix.tolist(), n.tolist()
        for p, i, j in zip(prefix[edges[:-1]].tolist(), edges[:-1], edges[1:], strict=True):
            box = self.root.get(p)
            if p in self.nodes:
                for s, k in zip(suffixes[i:j], counts[i:j], strict=True):
                    leaf = box.setdefault(s & _LOW, {})
                    self.size += s not in leaf
                    leaf[s] = leaf.get(s, 0) + k
                continue
            if box is None:
                box = self.root[p] = dict(zip(suffixes[i:j], counts[i:j], strict=True)) if j - i > 1 else {suffixes[i]: counts[i]}
                self.size += len(box)
            else:
                self.size -= len(box)
                for s, k in zip(suffixes[i:j], counts[i:j], strict=True):
                    box[s] = box.get(s, 0) + k
                self.size += len(box)
            if len(box) > self.burst:
                node: dict[int, dict] = {}
                for s, k in box.items():
                    node.setdefault(s & _LOW, {})[s] = k
                self.root[p] = node
                self.nodes.add(p)

    def take(self, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Removes whole subtrees, the largest first, until `most` entries are left: prefix, suffix and n of each entry."""
        weight = {p: sum(map(len, box.values())) if p in self.nodes else len(box) for p, box in self.root.items()}
        order = sorted(weight, key=weight.__getitem__, reverse=True) if most else list(weight)
        prefixes, sizes, suffixes, counts = [], [], [], []
        for p in order:
            if self.size <= most:
                break
            box = self.root.pop(p)
            for leaf in box.values() if p in self.nodes else (box,):
                suffixes += leaf
                counts += leaf.values()
            self.nodes.discard(p)
            prefixes.append(p)
            sizes.append(weight[p])
            self.size -= weight[p]
        return np.repeat(np.array(prefixes, np.int64), np.array(sizes, np.int64)), np.array(suffixes, np.int64), np.array(counts, np.int64)


def pair_bits(lang: bytes, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where the pair of two hashed words of a language stands in the bitmap."""
    mixed = (a * np.uint64(0x9E3779B1) + np.uint64(zlib.crc32(lang))) * np.uint64(0x85EBCA77C2B2AE63) ^ b * np.uint64(0xC2B2AE3D27D4EB4F)
    return (mixed >> np.uint64(17)) % np.uint64(BITS)


_RUN = "lang string, w1 string, w2 string, w3 string, w4 string, n long"


def _run(lang: bytes, words: Words, prefix: np.ndarray, suffix: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Entries as a sorted run of rows, in batches: by subtrees, and within these by the words' numbers."""
    two = (prefix >> _SHIFT).any()
    cols = [prefix & _LOW, prefix >> _SHIFT, suffix & _LOW, suffix >> _SHIFT] if two else [prefix, suffix & _LOW, suffix >> _SHIFT, suffix >> _SHIFT]
    names = pa.array(words.names, pa.binary()).cast(pa.string())
    rank = np.empty(len(words.names), np.int64)
    rank[pc.sort_indices(names).to_numpy()] = np.arange(len(rank))
    rows = np.lexsort([rank[c] for c in reversed(cols[: 4 if two else 2])])
    for i in range(0, len(rows), 50_000):
        at = rows[i : i + 50_000]
        taken = [names.take(pa.array(c[at], mask=c[at] == 0)) for c in cols]
        yield pa.record_batch([pa.array([lang.decode()] * len(at), pa.string()), *taken, pa.array(n[at])], ["lang", "w1", "w2", "w3", "w4", "n"])


def _counted(batches: Iterator[pa.RecordBatch], add, entries: int, burst: int) -> Iterator[pa.RecordBatch]:
    """Sorted runs of what add(trie, lang, words, numbers) counts; numbers: the words of one language's texts, 0 between pieces."""
    words, tries = Words(), {}

    def spilled(most: int) -> Iterator[pa.RecordBatch]:
        for lang, trie in tries.items():
            yield from _run(lang, words, *trie.take(most))

    for b in slices(batches):
        texts: dict[bytes, list[bytes]] = {}
        for text, lang in zip(raw(b["text"]), raw(b["lang"]), strict=True):
            texts.setdefault(lang, []).append(text)
        for lang, some in texts.items():
            add(tries.setdefault(lang, HatTrie(burst)), lang, words, numbered(words, some))
        if len(words) > WORDS:
            yield from spilled(0)
            words, tries = Words(), {}
        elif sum(t.size for t in tries.values()) > entries:
            yield from spilled(entries // (2 * len(tries)))
    yield from spilled(0)


def _add_short(trie: HatTrie, lang: bytes, words: Words, x: np.ndarray) -> None:
    """Words and pairs, each distinct one of the batch once; a word alone has the suffix 0. Prefix 0 counts all words."""
    both = (x[:-1] > 0) & (x[1:] > 0)
    found, n = np.unique(np.concatenate([x[x > 0] << _SHIFT, x[:-1][both] << _SHIFT | x[1:][both]]), return_counts=True)
    trie.add(np.append(0, found >> _SHIFT), np.append(0, found & _LOW), np.append((x > 0).sum(), n))


def _add_long(bitmap: np.ndarray):
    """Phrases of three and four words whose pairs all stand in the bitmap: the first two are the prefix."""

    def add(trie: HatTrie, lang: bytes, words: Words, x: np.ndarray) -> None:
        h = words.hashes[x]
        at = pair_bits(lang, h[:-1], h[1:])
        ok = (x[:-1] > 0) & (x[1:] > 0) & (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        three = np.flatnonzero(ok[:-1] & ok[1:])
        four = np.flatnonzero(ok[:-2] & ok[1:-1] & ok[2:])
        i = np.concatenate([three, four])
        if not len(i):
            return
        prefix = x[i] | x[i + 1] << _SHIFT
        suffix = x[i + 2] | np.concatenate([np.zeros(len(three), np.int64), x[four + 3]]) << _SHIFT
        order = np.lexsort([suffix, prefix])
        prefix, suffix = prefix[order], suffix[order]
        new = np.append(True, (np.diff(prefix) != 0) | (np.diff(suffix) != 0))
        start = np.flatnonzero(new)
        trie.add(prefix[start], suffix[start], np.diff(np.append(start, len(prefix))))

    return add


def _merged(docs: DataFrame, add, entries: int, burst: int) -> DataFrame:
    """Runs of all tasks, dealt by language and the first two words (a subtree's prefix), summed."""
    runs = docs.mapInArrow(lambda batches: _counted(batches, add, entries, burst), _RUN)
    keys = ["lang", "w1", "w2", "w3", "w4"]
    return runs.repartition("lang", "w1", "w2").groupBy(*keys).agg(F.sum("n").alias("n"))


def _bitmap(pairs: DataFrame) -> np.ndarray:
    """Bits of the pairs (lang, w1, w2), in bytes; BITS / 64 rows at most come to the driver."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = [np.fromiter((zlib.crc32(w) for w in raw(b[c])), np.uint64, b.num_rows) for c in ("w1", "w2")]
            at = np.zeros(b.num_rows, np.uint64)
            langs = np.array(b["lang"].to_pylist(), object)
            for lang in set(langs.tolist()):
                of = langs == lang
                at[of] = pair_bits(lang.encode(), h[0][of], h[1][of])
            yield pa.record_batch([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(np.uint64(1) << (at & np.uint64(63))).view(pa.int64())], ["place", "bits"])

    out = np.zeros(BITS // 64, np.int64)
    found = pairs.mapInArrow(places, "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    out[found["place"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint8)


def phrase_counts(docs: DataFrame, least: int = 30, entries: int = ENTRIES, burst: int = BURST) -> tuple[DataFrame, DataFrame]:
    """(lang, n): all words of each language; (lang, words array, f): phrases of 1 to 4 words that occur `least` times or more.

    A-Z are lower-cased; [.,;:!?\\x0A-\\x0D] part pieces, spaces and tabs words; a phrase lies within a piece, overlaps
    count. Null text: no words. Null lang: `und`. Repeated rows count each; no rows or words: no phrases.
    """
    base = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    short = stored(_merged(base, _add_short, entries, burst).where((F.col("n") >= least) | F.col("w1").isNull()), "phrases-short")
    total = short.where("w1 IS NULL AND n > 0").select("lang", "n")
    short = short.where((F.col("n") >= least) & F.col("w1").isNotNull())
    long = stored(_merged(base, _add_long(_bitmap(short.where("w2 IS NOT NULL"))), entries, burst).where(F.col("n") >= least), "phrases-long")
    words = F.array_compact(F.array("w1", "w2", "w3", "w4"))
    return total, short.unionByName(long).select("lang", words.alias("words"), F.col("n").alias("f"))


def joined(words: Column) -> Column:
    return F.array_join(words, " ")


def _parts(low: int, all_: bool) -> Column:
    """Contiguous parts of `words`: of `low` words at least, without the whole."""
    size = F.size("words")
    lengths = F.filter(F.array(*(F.lit(k) for k in range(low, 4))), lambda k: k < size)
    return F.flatten(F.transform(lengths, lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: joined(F.slice("words", i, k)))))


def collocations(docs: DataFrame, least: int = 30, most: int = 2000, scale: int = 2_000_000, inside: int = 80, entries: int = ENTRIES, burst: int = BURST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `most` phrases of 2 to 4 words.

    a: the phrase's occurrences, `least` at least. A cut after k words gives l and r, those of both parts, and score
    floor(scale * a / (l + r)); the cut of the least score counts, ties to the smallest k. Phrases inside a longer one with
    `inside` percent of their occurrences go. Order: score and a descending, phrase ascending in bytes. Counting is as in
    phrase_counts; ties in all of it cannot be, as phrases are distinct. No frequent phrase: no rows.
    """
    total, counts = phrase_counts(docs, least, entries, burst)
    counts = counts.withColumn("phrase", joined(F.col("words")))
    of = counts.select("lang", "phrase", "f")
    cand = counts.where(F.size("words") > 1)
    cuts = cand.select("lang", "phrase", "words", "f", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "f", "k", joined(F.slice("words", F.lit(1), F.col("k"))).alias("left"), joined(F.slice("words", F.col("k") + 1, F.size("words"))).alias("right"))
    cuts = cuts.join(of.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(of.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr(f"CAST(CAST(f AS DECIMAL(20, 0)) * {scale}BD DIV (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0))) AS BIGINT)")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "f").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    longer = cand.where(F.size("words") > 2).select("lang", "f", F.explode(_parts(2, False)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("g"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(F.col("g").isNull() | (100 * F.col("g").cast("decimal(20,0)") < inside * F.col("f").cast("decimal(20,0)")))
    order = "ORDER BY score DESC, a DESC, phrase"
    rows = kept.select("lang", "phrase", F.col("f").alias("a"), "b.l", "b.r", "b.score").withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    rows = rows.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang, salt {order})")).where(F.col("rank") <= most)
    rows = rows.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang {order})").cast("long")).where(F.col("rank") <= most)
    return rows.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM d),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest(range(1, 5)) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k AS size, phrase, count(*) AS f FROM g GROUP BY ALL),
tot AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE f >= 30 AND size > 1),
cut AS (SELECT lang, phrase, size, f, w, unnest(range(1, size)) AS k FROM c),
sc AS (SELECT cut.*, fl.f AS l, fr.f AS r, (2000000::HUGEINT * cut.f // (fl.f + fr.f))::BIGINT AS score FROM cut JOIN f fl ON fl.lang = cut.lang AND fl.phrase = array_to_string(cut.w[1:cut.k], ' ') AND fl.size = cut.k JOIN f fr ON fr.lang = cut.lang AND fr.phrase = array_to_string(cut.w[cut.k + 1:], ' ') AND fr.size = cut.size - cut.k),
b AS (SELECT lang, phrase, f, min(struct_pack(score := score, k := k, l := l, r := r)) AS b FROM sc GROUP BY ALL),
lg AS (SELECT lang, phrase, max(f) AS g FROM (SELECT lang, f, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, f, w, k, unnest(range(1, size - k + 2)) AS i FROM c, (SELECT unnest(range(2, 4)) AS k) WHERE size > k)) GROUP BY ALL),
kept AS (SELECT b.lang, b.phrase, b.f AS a, b.b.l AS l, b.b.r AS r, b.b.score AS score FROM b LEFT JOIN lg USING (lang, phrase) WHERE g IS NULL OR 100 * g < 80 * b.f),
rk AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score FROM rk JOIN tot USING (lang) WHERE rank <= 2000
"""
