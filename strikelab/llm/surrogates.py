"""PII surrogates: entities in the text are replaced by keyed values of the same type, script and format.

A surrogate is the image of the entity under a keyed permutation of all strings of the same format (a digit for a digit, a
vowel for a vowel, a capital for a capital, each within its script). A permutation gives different entities different
surrogates and the same entity the same one everywhere, without a shared table, and here it moves every value that has a
letter or a digit. A check over the whole corpus still compares all pairs of entity and surrogate and takes the next key
if two entities meet. A name's words are entities of their own, so that a full name, its surname alone and the same words
without a title elsewhere in the text agree in every document. Titles, which tell the gender, stay, and with them the last
letters of the words of Latin, Greek and Cyrillic names.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import unicodedata
import warnings
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, slices, stored, with_field

# Titles by gender, as they stand before names in English, German, French, Spanish and Russian.
TITLES = {
    "male": ["Mr", "Mister", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "Господин"],
    "female": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Señorita", "Sra", "Doña", "Госпожа"],
    "any": ["Dr", "Prof", "Professor"],
}
_TITLE = "|".join(sorted((t for x in TITLES.values() for t in x), key=len, reverse=True))

def _ranges(codes: list[int]) -> str:
    """Those characters as they stand in a character class."""
    starts = [c for c, before in zip(codes, [-2, *codes], strict=False) if c != before + 1]
    ends = [c for c, after in zip(codes, [*codes[1:], -2], strict=True) if after != c + 1]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends, strict=True))


#: Vowel signs, accents and joiners, which are parts of words but not letters.
_SIGNS = _ranges([c for c in range(0x300, 0x10000) if unicodedata.category(chr(c)) in ("Mn", "Mc") or c in (0x200C, 0x200D)])

# One search for all types; the first alternative that fits a place wins.
_FIND = re.compile(
    r"""(?P<email>(?<![\w.+%'SIGNS-])[\w.+%'SIGNS-]+@[^\W_][\w-]*(?:\.[\w-]+)+)
    |(?P<secret>(?:AKIA|ASIA|ghp_|gho_|sk-|xox[bap]-|AIza)[\w-]{12,}|(?<![\w])[0-9a-fA-F]{32,}(?![\w]))
    |(?i:(?:token|password|passwd|pwd|secret|api[_-]?key|access[_-]?key)["']?\s{0,3}[=:]\s{0,3}["']?)(?P<assigned>[^\s"'<>,;]{6,})
    |(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?:\ ?[A-Z0-9]{4}){2,7}(?:\ ?[A-Z0-9]{1,3})?(?!\w))
    |(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\w))
    |(?P<phone>(?<![\w+])\+\d{1,3}(?:[ .()/-]{0,2}\d){6,13}(?!\d)|(?<![\w.(+-])\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?![\w-]))
    |(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))
    |(?P<card>(?<![\w.])\d(?:[ -]?\d){12,18}(?![\w]))
    |\b(?:TITLE)\b\.?\ (?P<name>[^\W\d_a-z](?:[^\W\d_]|[SIGNS])+(?:[ -][^\W\d_a-z](?:[^\W\d_]|[SIGNS])+){0,2})""".replace("TITLE", _TITLE).replace("SIGNS", _SIGNS),
    re.VERBOSE,
)
#: Each type but names and keys with a known start has one of these; none has 40 characters on end without one.
_MARK = re.compile(r"[@=:\d]+")
#: A text with one of these is searched from end to end, any other only around its marks.
_STARTS = [*(t for x in TITLES.values() for t in x), "AKIA", "ASIA", "ghp_", "gho_", "sk-", "xoxa-", "xoxb-", "xoxp-", "AIza"]

# Letters by script; a letter is replaced by one of its own row, so vowels stay vowels.
ALPHABETS = [
    "0123456789",
    "aeiou",
    "bcdfghjklmnpqrstvwxyz",
    "àáâäãåèéêëìíîïòóôöõùúûü",
    "çñßšžčřł",
    "аеёиоуыэюя",
    "бвгджзйклмнпрстфхцчшщъь",
    "αεηιουω",
    "βγδζθκλμνξπρστφχψ",
    "άέήίόύώ",
]
_ROW = {c: (row, row.index(c)) for row in ALPHABETS for c in row}
# Country codes of one and two digits; all others have three.
_COUNTRY = re.compile(r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}")
# Domains that tell nothing of a person, and second levels that belong to the country.
PROVIDERS = {"aol.com", "example.com", "example.net", "example.org", "gmail.com", "gmx.de", "gmx.net", "hotmail.com", "icloud.com", "mail.ru", "outlook.com", "proton.me", "web.de", "yahoo.com", "yandex.ru"}
SECOND = {"ac", "co", "com", "edu", "gov", "net", "org"}
_HEX = "0123456789abcdef"
_LATIN = "abcdefghijklmnopqrstuvwxyz"


def _script(c: str) -> tuple:
    """Script and category of a letter or digit, and whether its capital leads back to it."""
    return unicodedata.name(c, "").split(" ")[0], unicodedata.category(c), len(c.upper()) == 1 and c.upper().lower() == c


@cache
def _scripts() -> dict[tuple, str]:
    """The letters and digits that have no row of their own, by script; scripts with one of them share a row."""
    rows = defaultdict(list)
    for c in map(chr, range(0x110000)):
        if c.isalnum() and c not in _ROW:
            rows[_script(c)].append(c)
    single = "".join(sorted(r[0] for r in rows.values() if len(r) == 1))
    return {k: "".join(r) if len(r) > 1 else single for k, r in rows.items()}


def _row(c: str) -> tuple[str, int] | None:
    """The row of c and its place there; None if it is neither a letter nor a digit."""
    if c in _ROW or not c.isalnum():
        return _ROW.get(c)
    row = _scripts()[_script(c)]
    return row, bisect_left(row, c)


def _permute(x: int, n: int, key: bytes) -> int:
    """The image of x under a keyed permutation of 0 .. n - 1 that moves every number (n > 1): a Feistel network, walked
    until it falls below n, turned round, a step on, and back."""
    half = max(1, (n.bit_length() + 1) // 2)
    mask = (1 << half) - 1

    def mix(i: int, side: int) -> int:
        raw = hashlib.blake2b(side.to_bytes((half + 7) // 8, "little"), key=key, salt=i.to_bytes(2, "little"), digest_size=64).digest()
        while len(raw) * 8 < half:
            raw += hashlib.blake2b(raw, key=key, digest_size=64).digest()
        return int.from_bytes(raw, "little") & mask

    def walk(v: int, rounds: range) -> int:
        while True:
            left, right = v >> half, v & mask
            if rounds[0] == 0:
                for i in rounds:
                    left, right = right, left ^ mix(i, right)
            else:
                for i in rounds:
                    left, right = right ^ mix(i, left), left
            v = left << half | right
            if v < n:
                return v

    if n < 2:
        return x
    back = walk(x, range(5, -1, -1))
    return walk((back + 1) % n, range(6))


def _format(value: str, rows: list[tuple[str, int] | None], key: bytes, kind: str) -> str:
    """value with each place that has a row (alphabet, index) replaced, all places together by one permutation."""
    shape = "".join(f"{len(r[0])}{r[0][0]}" if r else c for c, r in zip(value, rows, strict=True))
    x, n = 0, 1
    for r in rows:
        if r:
            x, n = x * len(r[0]) + r[1], n * len(r[0])
    y = _permute(x, n, hashlib.blake2b(f"{kind}\0{shape}".encode(), key=key, digest_size=32).digest())
    out = []
    for c, r in zip(reversed(value), reversed(rows), strict=True):
        if r:
            y, i = divmod(y, len(r[0]))
            out.append(r[0][i])
        else:
            out.append(c)
    return "".join(reversed(out))


def _luhn(digits: str) -> int:
    """The check digit of digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def canonical(kind: str, value: str) -> str:
    """One spelling for each entity: e-mail addresses and names without regard to case, numbers without marks (a phone's + stays)."""
    if kind in ("email", "name"):
        return value.lower()
    if kind in ("card", "phone", "ssn", "iban"):
        return "+" * (kind == "phone" and value[0] == "+") + re.sub(r"[^0-9A-Za-z]", "", value)
    if kind == "ip":
        return ".".join(str(int(x)) for x in value.split("."))
    return value


def surrogate_of(kind: str, value: str, key: bytes) -> str:
    """The surrogate in the spelling of value: its marks, its capitals."""
    if kind == "ip":
        n = _permute(int(ipaddress.ip_address(canonical(kind, value))), 1 << 32, key)
        return str(ipaddress.ip_address(n))
    if kind == "email":
        name, _, host = value.lower().rpartition("@")
        labels = host.split(".")
        held = host if host in PROVIDERS else ".".join(labels[-2 if len(labels) > 2 and labels[-2] in SECOND else -1 :])
        free = host[: len(host) - len(held)]
        new = _format(f"{name}@{free}", [_row(c) for c in f"{name}@{free}"], key, kind) + held
        return _recase(new, value)
    if kind == "name":
        low = value.lower()
        rows = [_row(c) for c in low]
        for m in re.finditer(r"[^ -]+", low):  # the last letter often tells the gender
            if unicodedata.name(low[m.end() - 1], "").startswith(("LATIN", "GREEK", "CYRILLIC")):
                rows[m.end() - 1] = None
        return _recase(_format(low, rows, key, kind), value)
    plain = canonical(kind, value)
    if kind == "card":
        valid = _luhn(plain[:-1]) == int(plain[-1])
        body = plain[:-1] if valid else plain
        new = _format(body, [_ROW[c] for c in body], key, kind + "v" * valid)
        if valid:
            new += str(_luhn(new))
        elif _luhn(new[:-1]) == int(new[-1]):  # an invalid number stays invalid: step on until it is
            while _luhn(new[:-1]) == int(new[-1]):
                new = _format(new, [_ROW[c] for c in new], key, kind)
        return _respell(new, value)
    if kind == "phone":
        keep = len(_COUNTRY.match(plain[1:])[0]) if plain[0] == "+" else 0
        plain = plain.strip("+")
        return _respell(plain[:keep] + _format(plain[keep:], [_ROW[c] for c in plain[keep:]], key, kind + plain[:keep]), value)
    if kind == "iban":
        rows = [None] * 2 + [(ALPHABETS[0], int(c)) if c.isdigit() else (_LATIN, _LATIN.index(c.lower())) for c in plain[2:]]
        return _respell(_format(plain, rows, key, kind).upper(), value)
    if kind == "ssn":
        return _respell(_format(plain, [_ROW[c] for c in plain], key, kind), value)
    low = value.lower()
    head = re.match(r"(?:akia|asia|ghp_|gho_|sk-|xox[bap]-|aiza)?", low)[0]
    is_hex = not head and all(c in _HEX for c in low)
    rows = [None] * len(head) + [(_HEX, _HEX.index(c)) if is_hex else (_LATIN, _LATIN.index(c)) if c in _LATIN else _row(c) for c in low[len(head) :]]
    case = "".join("A" if a != b else "a" for a, b in zip(value, low, strict=True)) if len(low) == len(value) else "a" * len(value)
    new = _format(low, rows, key, kind + case) if len(low) == len(value) else _format(value, [_row(c) for c in value], key, kind)
    return value[: len(head)] + _recase(new, value)[len(head) :]


def _recase(new: str, like: str) -> str:
    return "".join(a.upper() if b.isupper() and len(a.upper()) == 1 and a.upper().lower() == a else a for a, b in zip(new, like, strict=True)) if len(new) == len(like) else new


def _respell(new: str, like: str) -> str:
    """new's letters and digits between the marks of like."""
    it = iter(new)
    return "".join(next(it) if c.isascii() and c.isalnum() else c for c in like)


def _windows(text: str) -> Iterator[tuple[int, int]]:
    """The stretches of text, from space to space, that can hold an entity."""
    if any(x in text for x in _STARTS):
        yield 0, len(text)
        return
    start = end = -1
    for m in _MARK.finditer(text):
        i = max(0, m.start() - 40)
        if i > end:
            if end >= 0:
                yield start, end
            start = text.rfind(" ", 0, i) + 1
            start = max(start, end, 0)
        if m.end() + 40 > end:
            end = text.find(" ", m.end() + 40)
            if end < 0:
                yield start, len(text)
                return
    if end >= 0:
        yield start, end


_NAME_WORD = re.compile(r"[^ -]+")


def entities(text: str | None) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of each entity, in order and apart from each other.

    Names are found after titles; each of their words is an entity, and so is every other place in the text where the same
    word stands alone.
    """
    found: list[tuple[int, int, str]] = []
    words: set[str] = set()
    for i, j in _windows(text) if text else ():
        for m in _FIND.finditer(text, i, j):
            kind = m.lastgroup
            if kind == "name":
                for w in _NAME_WORD.finditer(text, m.start(kind), m.end(kind)):
                    found.append((w.start(), w.end(), kind))
                    words.add(w[0])
            else:
                found.append((m.start(kind), m.end(kind), "secret" if kind == "assigned" else kind))
    if words:
        apart = rf"(?<![\w@.+%'{_SIGNS}-])(?:{'|'.join(map(re.escape, sorted(words, key=lambda w: (-len(w), w))))})(?![\w@{_SIGNS}])"
        taken = sorted(found)
        starts = [x[0] for x in taken]
        for m in re.finditer(apart, text):
            k = bisect_left(starts, m.end()) - 1  # the last entity that starts before the word's end
            if k < 0 or taken[k][1] <= m.start():
                found.append((m.start(), m.end(), "name"))
    for i, j, kind in sorted(found):
        yield kind, i, j


def pseudonymised(docs: DataFrame, key: bytes, name: str = "entities") -> DataFrame:
    """docs, all columns, with surrogates in text, and `name`: an array of (kind, start, end) in the new text.

    Null and empty texts stay as they are and hold no entity; nothing else of a row is changed, but that a column of docs
    called `name` gives way. Ties, null ids and repeated rows are as any row.
    """
    base = docs.drop(name)
    kind_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Memo(lambda x: surrogate_of(*x, key), 50_000)
        for b in slices(batches):
            at = b.schema.get_field_index("text")
            texts, found = [], []
            for t in b.column(at).to_pylist():
                spans, out, end, shift = [], [], 0, 0
                for kind, i, j in entities(t):
                    new = known[kind, t[i:j]]
                    out += [t[end:i], new]
                    spans.append({"kind": kind, "start": i + shift, "end": i + shift + len(new)})
                    shift += len(new) - (j - i)
                    end = j
                texts.append("".join([*out, t[end:]]) if out else t)
                found.append(spans)
            columns = list(b.columns)
            columns[at] = pa.array(texts, b.schema.field(at).type)
            yield pa.record_batch([*columns, pa.array(found, kind_type)], [*b.schema.names, name])

    return base.mapInArrow(run, with_field(base, name, "array<struct<kind: string, start: bigint, end: bigint>>"))


def collisions(docs: DataFrame, key: bytes) -> DataFrame:
    """(kind, digest, n_entities, n_surrogates): surrogates that more than one entity of docs would get, and entities that
    would get more than one surrogate, with how many; no rows if all is well.

    Entities and surrogates are compared by 128-bit digests of their canonical spellings.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = lambda s: hashlib.blake2b(s.encode(), digest_size=16).digest()
        for b in slices(batches):
            seen = {(k, canonical(k, t[i:j]), canonical(k, surrogate_of(k, t[i:j], key))) for t in b["text"].to_pylist() for k, i, j in entities(t)}
            yield pa.record_batch([pa.array([k for k, _, _ in seen], pa.string()), pa.array([mark(e) for _, e, _ in seen], pa.binary()), pa.array([mark(s) for _, _, s in seen], pa.binary())], ["kind", "entity", "surrogate"])

    pairs = docs.select(F.col("text").cast("string")).mapInArrow(run, "kind string, entity binary, surrogate binary").distinct()
    pairs = stored(pairs, "surrogate-pairs")
    one = F.lit(1).cast("long")
    met = pairs.groupBy("kind", F.col("surrogate").alias("digest")).agg(F.count("*").alias("n_entities"), one.alias("n_surrogates"))
    parted = pairs.groupBy("kind", F.col("entity").alias("digest")).agg(one.alias("n_entities"), F.count("*").alias("n_surrogates"))
    return met.unionByName(parted).where("n_entities > 1 OR n_surrogates > 1")


def surrogates(docs: DataFrame, secret: str, tries: int = 4, name: str = "entities") -> DataFrame:
    """pseudonymised(docs) under the first of `tries` keys drawn from secret that keeps all entities of docs apart.

    Surrogates are one-to-one by construction, so the first key does; if none did, the first is taken, with a warning that
    counts what meets. Odd rows: see pseudonymised; an empty table gives an empty one.
    """
    keys = [hashlib.blake2b(f"{secret}\0{i}".encode(), digest_size=32).digest() for i in range(tries)]
    for key in keys:
        if stored(collisions(docs, key), "surrogate-collisions").isEmpty():
            return pseudonymised(docs, key, name)
    warnings.warn(f"{collisions(docs, keys[0]).count()} surrogates or entities are not one to one under any of {tries} keys", stacklevel=2)
    return pseudonymised(docs, keys[0], name)
