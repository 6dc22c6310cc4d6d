from __future__ import annotations

import itertools
import random

import public_tokenizers
import pytest

from rankloom.llm import packing
from tests.llm.odd import ROWS, docs, empty


def padding(lengths, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts))


@pytest.mark.parametrize("seed", range(12))
def test_boundaries_are_optimal(seed):
    rng = random.Random(seed)
    lengths = sorted(rng.sample(range(60), rng.randrange(1, 9)))
    counts = [rng.randrange(1, 30) for _ in lengths]
    for k in (1, 2, 3, 5):
        got = packing.boundaries(lengths, counts, k)
        assert len(got) <= k and got == sorted(set(got)) and got[-1] == lengths[-1]
        best = min(padding(lengths, counts, [*c, lengths[-1]]) for m in range(min(k, len(lengths))) for c in itertools.combinations(lengths[:-1], m))
        assert padding(lengths, counts, got) == best


def test_boundaries_of_nothing():
    assert packing.boundaries([], [], 3) == []


def check(rows, n, budget):
    assert len(rows) == n
    batches = {}
    for r in rows:
        assert r.padding == r.boundary - r.n_tokens >= 0
        batches.setdefault((r.bucket, r.batch), []).append(r)
    last = {}
    for (bucket, batch), members in batches.items():
        assert sorted(m.position for m in members) == list(range(len(members)))
        assert len(members) == 1 or len(members) * members[0].boundary <= budget
        last.setdefault(bucket, {})[batch] = len(members)
    for sizes in last.values():  # all batches of a bucket are full but the last
        assert sorted(sizes) == list(range(len(sizes))) and len({v for k, v in sizes.items() if k < len(sizes) - 1}) <= 1


@pytest.mark.parametrize("budget,step", [(64, 1), (500, 8)])
def test_batches(spark, budget, step):
    rng = random.Random(budget)
    data = [(i if i % 50 else 7, rng.choice([None, 0, 1, 5, 5, 5, 5, rng.randrange(90)])) for i in range(700)]
    df = spark.createDataFrame(data, "doc_id long, n_tokens int")
    rows = packing.pack(df, buckets=4, budget=budget, step=step).collect()
    check(rows, 700, budget)
    assert sorted((r.doc_id, r.n_tokens) for r in rows) == sorted((d, n or 0) for d, n in data)
    again = packing.pack(df.repartition(3), buckets=4, budget=budget, step=step)
    key = lambda rs: sorted((r.doc_id, r.n_tokens, r.bucket, r.boundary) for r in rs)
    assert key(again.collect()) == key(rows)
    for bucket in {r.bucket for r in rows}:  # in the order of ids
        ids = [r.doc_id for r in sorted((r for r in rows if r.bucket == bucket), key=lambda r: (r.batch, r.position))]
        assert ids == sorted(ids)


def test_odd_rows(spark):
    counted = packing.token_lengths(docs(spark), public_tokenizers.path("word_bpe_49k.json"))
    assert counted.columns == ["doc_id", "n_tokens"]
    rows = packing.pack(counted, budget=1000).collect()
    check(rows, len(ROWS), 1000)
    assert [r.n_tokens for r in rows if r.doc_id == 7] == [40_001] and [r.n_tokens for r in rows if r.doc_id == 2] == [1]
    out = packing.pack(empty(spark))
    assert out.count() == 0 and out.columns == packing.pack(counted).columns
