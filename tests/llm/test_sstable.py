from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from rankloom.llm import sstable
from rankloom.llm.tokens import Encoder
from tests.llm.odd import ROWS, docs, empty

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encode():
    return Encoder(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet=st.sampled_from(list("abÉéñßİŉǅ'.,!0 \n\t　̈한😀<|endoftx>")), max_size=60))
def test_ids_by_word_equal_ids_of_the_text(text):
    encode, tokenizer = _both()
    assert np.frombuffer(encode(text), f"<u{encode.width}").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


_held = []


def _both():
    if not _held:
        _held.extend([Encoder(PATH), Tokenizer.from_file(PATH)])
    return _held


def test_other_tokenizers_are_encoded_whole():
    path = public_tokenizers.path("byte_bpe_50k.json")
    e, t = Encoder(path), Tokenizer.from_file(path)
    assert e._words is None
    assert np.frombuffer(e("Hello  world,\n it's"), f"<u{e.width}").tolist() == t.encode("Hello  world,\n it's", add_special_tokens=False).ids


def test_shards_hold_every_row_in_order(spark, tmp_path, tokenizer):
    manifest = sstable.write_tokens(docs(spark), str(tmp_path / "s"), PATH, end_id=2, shards=3)
    got = sorted(map(tuple, sstable.read_tokens(manifest).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r[0] for r in ROWS), key=lambda x: (x is not None, x))
    at = 0
    for doc, start, n, _ in got:
        assert start == at
        at += n
    want = sorted((str(d), len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, t, _ in ROWS for i in [tokenizer.encode(t or "", add_special_tokens=False).ids + [2]])
    assert sorted((str(d), n, c) for d, _, n, c in got) == want
    assert manifest.agg({"entries": "sum"}).first()[0] == len(ROWS)


def test_lookup(spark, tmp_path, tokenizer, monkeypatch):
    monkeypatch.setattr(sstable, "BLOCK", 64)
    rows = [(i * 3 - 40, f"text number {i} " * (i % 9), "en") for i in range(60)] + [(5, "again", "en")]
    manifest = sstable.write_tokens(docs(spark, rows), str(tmp_path / "s"), PATH, end_id=2, shards=4)
    for doc in (-40, -37, 5, 137):
        want = sorted(tokenizer.encode(t, add_special_tokens=False).ids + [2] for d, t, _ in rows if d == doc)
        assert sorted(sstable.lookup(manifest, doc)) == want
    assert sstable.lookup(manifest, -39) == [] and sstable.lookup(manifest, 10**12) == [] and sstable.lookup(manifest, None) == []


def test_damage_is_found(spark, tmp_path):
    manifest = sstable.write_tokens(docs(spark), str(tmp_path / "s"), PATH, end_id=2, shards=1)
    path = manifest.first().path
    data = bytearray(open(path, "rb").read())
    data[20] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(Exception):
        sstable.read_tokens(manifest).collect()


@pytest.mark.parametrize("n", [None, -(1 << 63), -1, 0, 1, (1 << 63) - 1])
def test_keys(n):
    assert sstable.id_of(sstable.key_of(n)) == n


def test_keys_keep_order():
    ids = [-(1 << 63), -5, -1, 0, 1, 255, 256, (1 << 63) - 1]
    assert [sstable.key_of(i) for i in ids] == sorted(sstable.key_of(i) for i in ids)


def test_empty(spark, tmp_path):
    manifest = sstable.write_tokens(empty(spark), str(tmp_path / "s"), PATH, end_id=2)
    assert manifest.count() == 0 and sstable.read_tokens(manifest).count() == 0 and sstable.lookup(manifest, 1) == []
