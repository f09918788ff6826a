"""Pieces of text encoded in lines have the ids of the whole text."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from strikelab.llm import tokens

TEXTS = [
    "plain words only",
    "Marks, after. words!! and### more$$$ (903) a.b c.,d",
    "it's 'tis don't it's...",
    "x<| y <|endoftext|> z<|startoftext|>!",
    "É é. a̸. z̸ ﬁne İstanbul. ß. ÿ, ÷. ×",
    "",
    None,
    "x" * 3000 + "!!",
    "T\u0308 H\u0331 W\u030a Y\u030a J\u030c T\u0323\u0308 xT\u0308. T\u1dc4\u0308, I\u0307",
]


def test_ids_of_marked_words():
    path = public_tokenizers.path("word_bpe_49k.json")
    ids, counts = tokens.Pieces(path)([t if t is None else t.encode() for t in TEXTS])
    whole = Tokenizer.from_file(path)
    want = [whole.encode(t or "", add_special_tokens=False).ids for t in TEXTS]
    assert [list(x) for x in np.split(ids, np.cumsum(counts)[:-1])] == want


def test_random_marks():
    rnd = random.Random(11)
    letters = [*"abctTHWYJIsSzZ.,!' \n", *map(chr, range(0x300, 0x370)), "\u1dc4", "\u0323", "ẗ", "É", "ß", "ſ", "K", "日", "ŉ", "ά", "ͅ", "<", "|", "9"]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(24))) for _ in range(20_000)]
    path = public_tokenizers.path("word_bpe_49k.json")
    ids, counts = tokens.Pieces(path)([t.encode() for t in texts])
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
