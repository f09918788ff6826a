"""Every value moves, whatever its script, and each entity has one surrogate."""

import hashlib

import pytest

from strikelab.llm import surrogates

KEY = hashlib.blake2b(b"k", digest_size=32).digest()
TEXTS = ["Dr. 王伟", "Dr. محمد", "Prof. דוד", "Dr. प्रकाश", "Dr. Ωμέγα", "Dr. Łukasz", "Dr. Ąžuolas", "Dr. 김철수", "王伟@example.com", "रामकुमार@example.com", "ÞÓR@example.com", "٣٤@example.com"]


@pytest.mark.parametrize("text", TEXTS)
def test_every_script_moves(text):
    ((kind, i, j),) = surrogates.entities(text)
    old = text[i:j]
    assert old == text.removeprefix("Dr. ").removeprefix("Prof. ")
    new = surrogates.surrogate_of(kind, old, KEY)
    assert new != old and len(new) == len(old)
    assert [c.isupper() for c in new] == [c.isupper() for c in old]
    assert surrogates.canonical(kind, surrogates.surrogate_of(kind, old.upper(), KEY)) == surrogates.canonical(kind, new)


def test_no_letter_stays_in_a_row_alone():
    for row in surrogates._scripts().values():
        assert len(row) > 1 and list(row) == sorted(set(row))


def test_one_surrogate_for_an_entity(spark):
    spellings = ["+49 30 123456789", "+4930123456789", "+49-30-123456789", "+493 0123456789"]
    got = {surrogates.canonical("phone", surrogates.surrogate_of("phone", x, KEY)) for x in spellings}
    assert len(got) == 1 and got.pop()[:3] == "+49"
    docs = spark.createDataFrame([(i, x) for i, x in enumerate([*spellings, "(493) 012-3456", "+49 30123456", "01.2.3.4", "1.2.3.4", *TEXTS])], "doc_id long, text string")
    assert surrogates.collisions(docs, KEY).count() == 0


def replaced(text: str) -> str:
    out, end = [], 0
    for kind, i, j in surrogates.entities(text):
        out += [text[end:i], surrogates.surrogate_of(kind, text[i:j], KEY)]
        end = j
    return "".join([*out, text[end:]])


def test_names_agree_with_and_without_titles():
    full, short, bare, other = (replaced(t).split() for t in ("Dr Jane Doe wrote", "Ms Doe wrote", "Dr Jane Doe wrote. Jane Doe and Doe left", "Mrs Jane Roe wrote"))
    assert full[2] == short[1] == bare[5] == bare[7] and full[1] == bare[1] == bare[4] == other[1]
    assert "Doe" not in bare and "Jane" not in bare and other[2] != full[2]
    assert replaced("Doe and Jane, untitled") == "Doe and Jane, untitled"
    assert [w[-1] for w in full[1:3]] == ["e", "e"]


def test_own_domains_go_and_providers_stay():
    new = replaced("jane@janedoe.com jane@gmail.com a@b.firm.co.uk").split()
    assert "janedoe" not in new[0] and new[0].endswith(".com") and new[1].endswith("@gmail.com") and new[2].endswith(".co.uk") and "firm" not in new[2]


def test_one_to_one_over_many(spark):
    texts = [f"Mr {a}{b} +49 30 {n:07d} u{n}@mail{n % 50}.org 10.0.{n % 256}.{n // 256} {n:03d}-12-{n:04d}" for n, (a, b) in enumerate((x, y) for x in ("Jan", "Ola", "Per", "Uwe", "Kim") for y in "abcdefghijklmnopqrstuvwxyz")]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    old = {(k, surrogates.canonical(k, t[i:j])) for t in texts for k, i, j in surrogates.entities(t)}
    got = surrogates.surrogates(docs, "secret").collect()
    new = {(e["kind"], surrogates.canonical(e["kind"], r["text"][e["start"] : e["end"]])) for r in got for e in r["entities"]}
    assert len(new) == len(old) and not old & new
    again = surrogates.surrogates(docs, "another").collect()
    assert {r["text"] for r in again}.isdisjoint(r["text"] for r in got)
