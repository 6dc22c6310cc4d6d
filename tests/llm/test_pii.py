from __future__ import annotations

import random
import re

import pytest

from rankloom.llm import pii
from tests.llm.odd import ROWS, docs, empty

KEY = b"k"
TEXT = (
    "Dear Mr John Smith and Mrs Smith, call +1 (243) 555-5526 or 243-555-5526; Frau Müller; Госпожа Анна Иванова; "
    "mail A.B@X.COM a.b@x.com 4111 1111 1111 1111 and 4785380592391139$$$, 10.0.0.1. 152.143.123.131### 123-45-6789 GB82 WEST 1234 5698 7654 32"
)


def rewritten(spark, texts, key=KEY):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in pii.pseudonymise(df, key).collect()}


def test_kinds_and_formats(spark):
    r = rewritten(spark, [TEXT])[0]
    kinds = [p.kind for p in r.pii]
    assert kinds == ["given:m:latin", "surname::latin", "surname::latin", "phone", "phone", "surname::latin", "given:f:cyrillic", "surname:f:cyrillic", "email", "email", "card", "card", "ip", "ip", "ssn", "iban"]
    made = [p.made for p in r.pii]
    assert made[1] == made[2]  # one family
    assert made[8] == made[9].upper()  # one address, each in its letter case
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", made[3]) and re.fullmatch(r"\d{3}-\d{3}-\d{4}", made[4])
    assert re.fullmatch(r"\d{4} \d{4} \d{4} \d{4}", made[10]) and pii.luhn(made[10].replace(" ", "")) and made[10][0] == "4"
    assert re.fullmatch(r"\d{16}", made[11]) and re.fullmatch(r"\d+(\.\d+){3}", made[12]) and re.fullmatch(r"9\d\d-\d\d-\d{4}", made[14])
    assert made[6].capitalize() in pii.GIVEN["f", "cyrillic"] and made[7].endswith("ова") and made[0] in pii.GIVEN["m", "latin"]
    for p in r.pii:
        assert TEXT[p.start : p.end] not in r.text
    # nothing else changes
    at, rest = 0, r.text
    for p in r.pii:
        assert rest.startswith(TEXT[at : p.start])
        rest, at = rest[p.start - at + len(p.made) :], p.end
    assert rest == TEXT[at:]


def test_names_recur_without_titles(spark):
    texts = ["Mr John Smith came. Smith agreed; John Smith's dog, Smithson and a blacksmith left. smith stays.", "Herr Prof. Dr. Jürgen Groß sprach mit Groß.", "Dr Maria Lopez met Mrs Maria Lopez and Sir Bors", "Доктор Анна Иванова и Анна", "Mr A saw A bee, Mr. and"]
    got = rewritten(spark, texts)
    made = [p.made for p in got[0].pii]
    assert [texts[0][p.start : p.end] for p in got[0].pii] == ["John", "Smith", "Smith", "John", "Smith"]
    assert made[0] == made[3] and made[1] == made[2] == made[4]
    assert got[0].text == f"Mr {made[0]} {made[1]} came. {made[1]} agreed; {made[0]} {made[1]}'s dog, Smithson and a blacksmith left. smith stays."
    assert [p.kind for p in got[1].pii] == ["given:m:latin", "surname::latin", "surname::latin"] and "Prof. Dr." in got[1].text and "Groß" not in got[1].text
    assert [p.kind for p in got[2].pii] == ["given:f:latin", "surname::latin"] * 2 + ["surname::latin"] and got[2].pii[0].made == got[2].pii[2].made
    assert [p.kind for p in got[3].pii] == ["given::cyrillic", "surname::cyrillic", "given::cyrillic"] and "Анна" not in got[3].text
    assert got[4].n_pii == 1 and got[4].text.endswith(" saw A bee, Mr. and")


def test_first_names_show_names(spark):
    texts = ["John Smith, born 1970, met Smith.", "With Claire Dubois-Martin and claire dubois", "Elizabeth. The xJohn Smith and John smith"]
    got = rewritten(spark, texts)
    assert [p.kind for p in got[0].pii] == ["given:m:latin", "surname::latin", "surname::latin"] and got[0].pii[1].made == got[0].pii[2].made
    assert got[1].n_pii == 2 and got[1].text.endswith("and claire dubois")
    assert got[2].text == texts[2]


def test_addresses_of_a_domain_keep_one(spark):
    texts = ["jo@acme.de al@acme.de jo@other.com JO@ACME.DE"] + [f"a{i}@h{i}.com b{i}@h{i}.com" for i in range(40)]
    got = rewritten(spark, texts)
    made = [p.made for p in got[0].pii]
    domain = [x.lower().split("@")[1] for x in made]
    assert domain[0] == domain[1] == domain[3] != domain[2] and len(set(made)) == 4 and made[3] == made[0].upper()
    domains = [{p.made.split("@")[1] for p in got[i].pii} for i in range(1, 41)]
    assert all(len(d) == 1 for d in domains) and len(set().union(*domains)) == 40


def parts(text, good):
    """(start, end) of the maximal runs of characters that ``good`` takes."""
    out, a = [], None
    for i, c in enumerate(text + "\n"):
        if i < len(text) and good(c):
            a = i if a is None else a
        elif a is not None:
            out.append((a, i))
            a = None
    return out


def detect(text):
    """Addresses, numbers and titled names by hand, without patterns: for texts whose entities stand between spaces."""
    out = []
    for a, e in parts(text, lambda c: not c.isspace()):
        w = text[a:e]
        octets, groups = w.split("."), w.split("-")
        if w.count("@") == 1 and all(w.split("@")) and "." in w.split("@")[1]:
            out.append((a, e, "email"))
        elif len(octets) == 4 and all(o.isascii() and o.isdigit() and str(int(o)) == o and int(o) < 256 for o in octets):
            out.append((a, e, "ip"))
        elif [len(g) for g in groups] == [3, 2, 4] and all(g.isascii() and g.isdigit() for g in groups):
            out.append((a, e, "ssn"))
        elif w.isascii() and w.isdigit() and 13 <= len(w) <= 19:
            out.append((a, e, "card"))
    words = parts(text, lambda c: not c.isspace())
    names = {text[a:e] for (x, y), (a, e) in zip(words, words[1:]) if text[x:y] in ("Mr", "Frau")}
    return sorted(out + [(a, e, "surname::latin") for a, e in words if text[a:e] in names])


def test_against_a_detector_of_its_own():
    rng = random.Random(31)
    entities = ["jo.x@acme.de", "a@b.org", "10.0.0.1", "255.1.20.9", "123-45-6789", "4111111111111111", "Mr Smith said", "Frau Keller sagte", "Smith", "Keller", "Berg"]
    near = ["256.1.1.1", "1.2.3", "01.2.3.4", "12-345-6789", "1234-56-789", "411111111111", "41111111111111111111", "a@b", "@x.org", "smith", "Smiths", "word", "x2024", "3.5", "1,000"]
    for _ in range(3000):
        text = rng.choice([" ", "\n"]).join(rng.choice(entities if rng.random() < 0.4 else near) for _ in range(rng.randrange(14)))
        assert pii.find(text) == detect(text), text


def test_clean_texts_stay(spark):
    clean = ["The year 2024, page 12, 3.5 % and 1,000 words; chapter 4.2.1", "Mr. and mrs", "a @ b", "deadbeef0123456789abcdef01234567", None, "", "7.88.162", "1234567890123456789012345"]
    got = rewritten(spark, clean)
    assert [got[i].text for i in range(len(clean))] == clean and all(not got[i].n_pii for i in got)


def test_equal_entities_agree_and_distinct_differ(spark):
    texts = [f"mail u{i % 40}@h.com ip 10.1.{i % 40}.7 card {4000000000000000 + i % 40}" for i in range(120)]
    got = rewritten(spark, texts)
    for n in range(3):
        by = {}
        for i in range(120):
            by.setdefault(i % 40, set()).add(got[i].pii[n].made)
        assert all(len(s) == 1 for s in by.values()) and len({x for s in by.values() for x in s}) == 40
    assert rewritten(spark, texts, b"other")[0].text != got[0].text and rewritten(spark, texts)[0].text == got[0].text


@pytest.mark.parametrize("limit", [0, 10**6])
def test_collisions_draw_again(spark, monkeypatch, limit):
    plain = pii.surrogate

    def weak(key, kind, canonical, attempt=0):
        if kind == "ip" and attempt < 2:  # few forms at first, among them an original
            return ["1.1.1.1", "2.2.2.2", "10.0.0.5"][hash_of(canonical) % 3]
        return plain(key, kind, canonical, attempt)

    def hash_of(x):
        return sum(map(ord, x))

    monkeypatch.setattr(pii, "surrogate", weak)
    monkeypatch.setattr(pii, "BROADCAST_ENTITIES", limit)
    got = rewritten(spark, [f"at 10.0.0.{i} and 10.0.0.{(i + 1) % 30}" for i in range(30)] * 2)
    made = {}
    for r in got.values():
        for p, original in zip(r.pii, re.findall(r"10\.0\.0\.\d+", f"10.0.0.{r.doc_id % 30} 10.0.0.{(r.doc_id % 30 + 1) % 30}")):
            assert made.setdefault(original, p.made) == p.made
    assert len(set(made.values())) == 30 and not set(made) & set(made.values())


def test_too_few_forms_raise(spark, monkeypatch):
    monkeypatch.setattr(pii, "ATTEMPTS", 2)
    monkeypatch.setattr(pii, "surrogate", lambda *a: "1.1.1.1")
    with pytest.raises(Exception, match="clash"):
        rewritten(spark, ["10.0.0.1 10.0.0.2 10.0.0.3 10.0.0.4"])


def test_odd_rows(spark):
    rows = [*ROWS, (20, "mail x@y.org", None), (None, "mail x@y.org", None)]
    out = pii.pseudonymise(docs(spark, rows), KEY)
    assert out.columns.count("pii") == 1 and "a b" in out.columns and out.count() == len(rows)
    found = out.where("n_pii > 0").collect()
    assert len(found) == 2 and found[0].text == found[1].text != "mail x@y.org"
    assert pii.pseudonymise(empty(spark), KEY).count() == 0


def test_planted_entities_are_gone(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    planted = re.compile(r"(?i)[a-z]+\.\d\d@mail\d\.example\.com|\+1 \(\d{3}\) 555-\d{4}|(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w)|(?<!\w)\d{16}(?!\w)")
    hits = 0
    for r in pii.op9_pii_surrogates(spark, sf).collect():
        found = planted.findall(texts[r.doc_id])
        hits += len(found)
        assert not [x for x in found if x in (r.text or "")]
        if not found:
            assert (r.text or "") == texts[r.doc_id] or r.n_pii
    assert hits > 50
