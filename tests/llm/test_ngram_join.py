from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from rankloom.llm import ngram_join as nj
from tests.llm.odd import ROWS, docs, empty, lower
from tests.oracle import rows_of, rows_of_sql


def brute(rows, k, percent):
    sets = []
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append((d, frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])))
    parent = {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (x, a) in enumerate(sets):
        for y, b in sets[:i]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                u, v = root(x), root(y)
                parent[max(u, v)] = min(u, v)
    return sorted((d, len(s), root(d)) for d, s in sets)


def corpus(seed, vocabulary, n=220):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    base = [[rng.choice(words) for _ in range(rng.choice([3, 8, 30, 60, 150]))] for _ in range(20)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            j = rng.randrange(len(w))
            r = rng.random()
            if r < 0.5:
                w[j] = rng.choice(words)
            elif r < 0.75 and len(w) > 1:
                del w[j]
            else:
                w.insert(j, rng.choice(words))
        if rng.random() < 0.3:
            w += base[0][: rng.randrange(len(base[0]))]
        rows.append((i * 3 + 1, rng.choice([" ", "  ", "\n"]).join(w)))
    return rows + [(9001, None), (9002, ""), (9003, "  "), (9004, "One"), (9005, "one"), (9006, "one two")]


#: Everything frequent, nearly everything rare, blocks of a few members, and a plain case.
@pytest.mark.parametrize("rare,vocabulary,block,k,percent", [(16, 3000, 512, 4, 85), (2, 3000, 8, 5, 80), (1, 50, 3, 4, 85), (0, 20, 4, 2, 60), (16, 3000, 512, 3, 100)])
def test_against_brute_force(spark, monkeypatch, rare, vocabulary, block, k, percent):
    monkeypatch.setattr(nj, "RARE", rare)
    monkeypatch.setattr(nj, "BLOCK", block)
    rows = corpus(rare + k, vocabulary)
    got = nj.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()
    assert sorted(map(tuple, got)) == brute(rows, k, percent)


@pytest.mark.parametrize("limit", [0, 5])
def test_the_class_decides_the_work_alone(spark, monkeypatch, limit):
    monkeypatch.setattr(nj, "MAX_FREQUENT", limit)
    monkeypatch.setattr(nj, "BROADCAST_IDS", limit)
    monkeypatch.setattr(nj, "FILTER_BITS", 1 << 12)
    monkeypatch.setattr(nj, "GATHER", 500)
    rows = corpus(9, 200, 150)
    assert sorted(map(tuple, nj.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect())) == brute(rows, 4, 85)


def test_a_group_of_near_copies_of_which_many_pairs_are_links(spark):
    rng = random.Random(11)
    base = [f"b{i}" for i in range(148)]
    rows = []
    for i in range(250):
        w = list(base)
        for j in rng.sample(range(148), rng.choice([1, 2, 3, 3])):
            w[j] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    assert sorted(map(tuple, nj.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect())) == brute(rows, 4, 85)


@pytest.mark.parametrize("clash", [False, True])
def test_repeated_and_missing_ids(spark, monkeypatch, clash):
    """Rows are linked by their own texts alone, whatever ids they share, and sets that clash in half a signature stay apart."""
    if clash:
        half = nj._half
        monkeypatch.setattr(nj, "_half", lambda g, seed: half(g, seed) & 7 if seed == 0xA24BAED4963EE407 else half(g, seed))
    monkeypatch.setattr(nj, "SPREAD", 2)
    monkeypatch.setattr(nj, "BLOCK", 3)
    rng = random.Random(21)
    rows = [(d % 60 if rng.random() < 0.9 else None, t) for d, t in corpus(4, 300, 150)]
    rows += rows[:20]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    places = brute(list(enumerate(t for _, t in rows)), 4, 85)
    groups = {}
    for i, n, c in places:
        groups.setdefault(c, []).append(i)
    want = [(rows[i][0], n, min((rows[j][0] for j in groups[c] if rows[j][0] is not None), default=None) if n else rows[i][0]) for i, n, c in places]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, nj.ngram_jaccard_join(df, 4, 85).collect()), key=key) == sorted(want, key=key)
    kept = []
    for c, members in groups.items():
        if places[members[0]][1] == 0:
            kept += [rows[i] for i in members]
        else:
            kept.append(min((rows[i] for i in members), key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest())))
    text = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(map(tuple, nj.drop_near_duplicates(df, 4, 85).collect()), key=text) == sorted(kept, key=text)


def test_rows_that_share_an_id_go_one_by_one(spark):
    x, y = "one two three four five six seven eight", "other words of a text that is unlike the first"
    df = spark.createDataFrame([(1, x, "a"), (9, x, "b"), (9, y, "c"), (None, x, "d"), (7, y + " but", None)], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.text, r.source) for r in nj.drop_near_duplicates(df.where("source is not null")).collect()) == [(1, x, "a"), (9, y, "c")]
    assert sorted((r.doc_id, r.component_id) for r in nj.ngram_jaccard_join(df.where("doc_id is not null")).collect()) == [(1, 1), (7, 7), (9, 1), (9, 7)]
    assert nj.drop_near_duplicates(docs(spark)).columns == docs(spark).columns and nj.drop_near_duplicates(empty(spark)).count() == 0


def test_parities_are_a_lower_bound():
    rng = np.random.default_rng(5)
    for _ in range(200):
        common = rng.integers(0, 1 << 63, rng.integers(1, 300), dtype=np.uint64)
        x, y = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, rng.integers(0, 90), dtype=np.uint64)])) for _ in range(2))
        assert nj._apart(nj._parity(x), nj._parity(y)) <= len(np.setxor1d(x, y))


def test_odd_rows(spark):
    rows = {(r.doc_id, r.n_shingles): r.component_id for r in nj.ngram_jaccard_join(docs(spark), 4, 85).collect()}
    assert rows[5, 11] == 1 and rows[None, 11] == 1 and rows[1, 11] == 1
    assert all(rows[i, 0] == i for i in (2, 3, 4)) and rows[9, 1] == 9 and rows[7, 1] == 7
    assert nj.ngram_jaccard_join(docs(spark), 4, 85).count() == len(ROWS)
    assert nj.ngram_jaccard_join(empty(spark)).count() == 0
    assert nj.ngram_jaccard_join(docs(spark, [(1, None, "en")])).collect()[0].component_id == 1
    with pytest.raises(ValueError):
        nj.ngram_jaccard_join(docs(spark), percent=20)


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert rows_of(nj.op7_ngram_jaccard_join(spark, sf)) == rows_of_sql(nj.SQL["op7_ngram_jaccard_join"], sf)


def test_dealt_join_equals_a_plain_one_and_parts_hot_values(spark):
    from pyspark.sql import functions as F

    from rankloom.llm.ngram_join import GROUP, _dealt_join

    many = spark.range(9000).select(F.when(F.col("id") < 6000, F.lit(1)).otherwise(F.col("id")).alias("k"), "id")
    one = spark.range(8000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x"))
    counts = many.groupBy("k").agg(F.count("*").alias("m"))
    got = _dealt_join(many, one, "k", counts, 9000, F.xxhash64("id"))
    assert sorted(got.select("k", "id", "x").collect()) == sorted(many.join(one, "k").select("k", "id", "x").collect())
    groups = many.where("k = 1").select(F.pmod(F.xxhash64("id"), F.lit(-(-6000 // GROUP))).alias("g")).groupBy("g").count().collect()
    assert len(groups) == -(-6000 // GROUP) and max(r["count"] for r in groups) < 2 * GROUP
    empty = many.limit(0)
    assert _dealt_join(empty, one, "k", empty.groupBy("k").agg(F.count("*").alias("m")), 0, F.xxhash64("id")).count() == 0
