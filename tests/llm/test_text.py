from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from rankloom.llm import text as tx
from tests.llm.odd import lower

CHARS = st.text(alphabet=st.sampled_from(list("abZ09 \n\t.,-\x1cé日😀\x85 ")), max_size=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.none() | CHARS, max_size=6), st.integers(1, 4))
def test_shingles_are_sets_of_words(texts, k):
    for table, pattern in ((tx.SPACED, r"[^\x20\x09-\x0D]+"), (tx.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        seen = {}
        got = list(tx.shingle_sets(pa.array(texts, pa.string()), table, k))
        assert len(got) == len(texts)
        for t, g in zip(texts, got):
            w = re.findall(pattern, lower(t))
            want = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
            assert len(want) == len(g) and list(g) == sorted(set(g.tolist()))
            key = frozenset(want)
            assert seen.setdefault(key, g.tolist()) == g.tolist()
        assert len({tuple(v) for v in seen.values()}) == len(seen)


def test_long_words_and_slices():
    a = "x" * 5000
    b = "x" * 1024 + "y" + "x" * 3975
    column = pa.array(["skip", a, None, b, a]).slice(1)
    sets = [s.tolist() for s in tx.shingle_sets(column, tx.SPACED, 4)]
    assert sets[0] == sets[3] != sets[2] and sets[1] == []


@pytest.mark.parametrize("limit", [1, 7, 64])
def test_chunks_change_nothing(monkeypatch, limit):
    texts = pa.array(["a b c d e", "", "f g", None, "h i j k l m"])
    whole = [s.tolist() for s in tx.shingle_sets(texts, tx.SPACED, 2)]
    monkeypatch.setattr(tx, "CHUNK", limit)
    assert [s.tolist() for s in tx.shingle_sets(texts, tx.SPACED, 2)] == whole
    assert np.array_equal(tx.rolling(np.zeros(2, np.uint64), 3), np.zeros(0, np.uint64))
