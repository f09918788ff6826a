"""Ids and decoded texts are the tokenizers library's on random texts, whatever was met before."""

import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

from strikelab.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
SIGNS = ["a", "b", "e", "the", "ing", "tion", " ", "  ", "\n", "\t", "'s", "'ll", "é", "ß", "日本", "🙂", "0", "19", "!", "...", "<|", "|>", "<|endoftext|>", "́", " ", "x" * 40]


def texts(n: int, seed: int = 5) -> list[str]:
    rnd = random.Random(seed)
    return ["".join(rnd.choice(SIGNS) for _ in range(rnd.randrange(60))) for _ in range(n)]


def test_ids_with_a_small_memory(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 50)
    monkeypatch.setattr(bpe, "FOLLOWS", 50)
    encoder, lib, given = bpe.Encoder(PATH), Tokenizer.from_file(PATH), texts(3000)
    for i in range(0, len(given), 37):
        for t, ids in zip(given[i : i + 37], encoder(given[i : i + 37]), strict=True):
            assert ids == lib.encode(t, add_special_tokens=False).ids
            assert encoder.codec.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_digests(spark):
    given = [None, *texts(200, 6)]
    lib = Tokenizer.from_file(PATH)
    docs = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in bpe.round_trip(docs, PATH).collect()}
    assert len(got) == len(given)
    for i, t in enumerate(given):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want = len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == want
