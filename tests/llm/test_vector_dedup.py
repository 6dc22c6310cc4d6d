from __future__ import annotations

import numpy as np
import pytest

from rankloom.llm import vector_dedup as vd
from rankloom.llm.hnsw import Graph
from rankloom.llm.text import mix
from tests.oracle import rows_of, rows_of_sql


def brute(rows, least):
    ok = {i: np.array(v, float) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = {i: [j for j in ok if j != i and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] / np.sqrt((ok[i] @ ok[i]) * (ok[j] @ ok[j])) >= least] if i in ok else [] for i, _ in rows}
    out = []
    for i, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((i, len(links[i]), min(seen), min(seen) == i))
    return sorted(out)


def groups(seed, n=300, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, dim))
    rows = [(int(i), (centres[rng.integers(40)] + rng.normal(size=dim) * rng.choice([0.02, 0.15])).astype(np.float32).tolist() if rng.random() < 0.7 else rng.normal(size=dim).astype(np.float32).tolist()) for i in range(n)]
    same = rows[3][1]
    return rows + [(1000 + i, same) for i in range(5)] + [(2000, [2 * x for x in same]), (2001, [-x for x in same])]


ODD = [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [1.0] * 15 + [None]), (3004, [1.0] * 15 + [float("nan")]), (3005, [float("inf")] + [1.0] * 15), (3006, [1.0, 2.0]), (3007, [2.0, 4.0]), (3008, [-0.0] * 16), (3009, [1e30] * 16), (3010, [1e-30] * 16)]


@pytest.mark.parametrize("shards", [1, 3, None])
def test_against_brute_force(spark, shards):
    rows = groups(1) + ODD
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, id string")
    got = sorted(map(tuple, vd.near_duplicates(df, 0.9, shards=shards).collect()))
    assert got == brute(rows, 0.9)


def test_a_large_group_is_counted_in_full(spark, monkeypatch):
    monkeypatch.setattr(vd, "BEAM", 8)
    monkeypatch.setattr(vd, "MAX_BEAM", 32)
    rng = np.random.default_rng(2)
    centre = rng.normal(size=16)
    rows = [(i, (centre + rng.normal(size=16) * 0.1).astype(np.float32).tolist()) for i in range(400)] + [(500 + i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, vd.near_duplicates(df, 0.9, shards=2).collect())) == brute(rows, 0.9)


def test_recall_of_the_graph():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 32)).astype(np.float32)
    x[3000:] = x[:3000] + rng.normal(size=(3000, 32)).astype(np.float32) * 0.05
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    order, levels = Graph.order(mix(np.arange(6000, dtype=np.uint64)))
    g = Graph.build(x[order], levels)
    assert levels == sorted(levels) and levels[-1] == 6000
    q = x[::20]
    ids, _ = g.search(q, 32)
    true = q @ x[order].T
    found = sum(np.isin(np.flatnonzero(t >= 0.9), i).sum() for t, i in zip(true, ids))
    assert found >= 0.97 * (true >= 0.9).sum()
    for links in g.levels:
        assert links.max() < len(links) and not (links == np.arange(len(links))[:, None]).any()


def damaged(n=2000, partners=2):
    """A shard of random vectors whose graph loses nodes n - partners and on: each is found only from entries of its own."""
    rng = np.random.default_rng(7)
    unit = rng.normal(size=(n, 32))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    order, levels = Graph.order(mix(np.arange(n, dtype=np.uint64)))
    g = Graph.build(unit.astype(np.float32), levels)
    for links in g.levels:
        links[links >= n - partners] = -1
    return vd._Shard(np.arange(n), np.ones(n, np.int64), unit, g)


def test_audit_leaves_self_links_out():
    s = damaged()
    some = slice(None, 1022, 4)
    queries = s.unit[-2:] + 1e-3  # nodes of another shard, next to the lost ones
    queries /= np.linalg.norm(queries, axis=1, keepdims=True)
    samples = [(s.ids[some], s.unit[some]), (np.array([5000, 5001]), queries)]
    # counted with self links, 256 of 258 links would be found
    assert len(vd._links(s, s.unit[some], 0.9, vd.BEAM)[0]) == 256 >= vd.RECALL * 258 and not len(vd._links(s, queries, 0.9, vd.BEAM)[0])
    rows = vd._audit(s, samples, 0.9)
    assert rows[0] == (vd.BEAM, 0, 2, 0) and rows[-1][0] > vd.MAX_BEAM and rows[-1][2:] == (2, 2)
    assert vd._audit(s, samples[:1], 0.9) == []
    assert vd._audit(damaged(partners=0), samples, 0.9) == [(vd.BEAM, 0, 2, 2)]


def test_beams_hold_in_each_class_and_over_all_shards():
    good, small = [(32, 0, 100, 100), (32, 9, 10**6, 10**6)], [(32, 0, 100, 50), (32, 9, 10**6, 10**6), (64, 0, 100, 100), (64, 9, 10**6, 10**6)]
    assert vd._beams({"a": good, "b": []}) == {"a": 32, "b": 32}
    assert vd._beams({"a": good, "b": small, "c": []}) == {"a": 64, "b": 64, "c": 64}
    assert vd._beams({str(i): good for i in range(99)} | {"b": small, "c": []}) == {str(i): 32 for i in range(99)} | {"b": 64, "c": 32}


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vd.near_duplicates(df).count() == 0
    df = spark.createDataFrame([(1, None), (None, [1.0])], "vec_id long, embedding array<float>")
    assert list(map(tuple, vd.near_duplicates(df).collect())) == [(1, 0, 1, True)]


def test_repeated_ids(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, vd.near_duplicates(df).collect())) == [(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True)]


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert rows_of(vd.op10_vector_dedup(spark, sf)) == rows_of_sql(vd.SQL["op10_vector_dedup"], sf)
