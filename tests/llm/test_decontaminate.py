from __future__ import annotations

import random
import re
import time

import pytest

from rankloom.llm import decontaminate as dc
from tests.llm.odd import ROWS, docs, empty, lower


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def greedy(p, t, least):
    """Greedy string tiling by its definition: mark a longest match of unmarked words again and again."""
    fp, ft, covered = [True] * len(p), [True] * len(t), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n] and fp[i + n] and ft[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least or n == 0:
            return covered
        fp[i : i + n] = [False] * n
        ft[j : j + n] = [False] * n
        covered += n


def bench_table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


@pytest.mark.parametrize("block_chars", [1 << 20, 60])
def test_against_brute_force(spark, block_chars):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([2, 4, 8, 15, 25]))) for _ in range(6)]
    texts = []
    for _ in range(50):
        parts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(12)))]
        for _ in range(rng.randrange(3)):
            w = rng.choice(items).split()
            a = rng.randrange(len(w))
            parts.insert(rng.randrange(2), " ".join(w[a:] + [rng.choice(vocabulary)] + w[:a]))
        texts.append(", ".join(parts).title())
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in dc.decontaminate(df, bench_table(spark, items), least=0.5, block_chars=block_chars).collect()}
    for i, t in enumerate(texts):
        parts = {k: greedy(words(x), words(t), min(5, len(words(x)))) / len(words(x)) for k, x in enumerate(items)}
        parts = {k: v for k, v in parts.items() if v >= 0.5}
        r = got[i]
        assert r["items"] == sorted(parts) and r.n_items == len(parts) and r.coverage == max(parts.values(), default=0.0)


def test_tiles_against_brute_force():
    rng = random.Random(13)
    for _ in range(400):
        item = [rng.randrange(3) for _ in range(rng.randrange(1, 30))]
        runs = [[rng.randrange(3) for _ in range(rng.randrange(1, 20))] for _ in range(rng.randrange(4))]
        least = rng.randrange(1, 5)
        apart = [x for n, r in enumerate(runs) for x in [*r, f"end {n}"]]
        tiles = dc.tile(item, runs, least)
        assert sum(n for *_, n in tiles) == greedy(item, apart, least)
        seen, seen_runs = set(), set()
        for i, r, j, n in tiles:
            assert item[i : i + n] == runs[r][j : j + n] and n >= least
            assert not seen & (own := set(range(i, i + n))) and not seen_runs & (other := {(r, x) for x in range(j, j + n)})
            seen |= own
            seen_runs |= other


def test_repeated_words_and_lines_take_linear_time(spark):
    line = "one line of words that a text repeats again and again\n"
    items = ["word " * 200, "word " * 99 + "other " + "word " * 100, line * 12, "a b " * 100]
    texts = ["word " * 100_000, line * 20_000, "a b " * 50_000, "word other " * 50_000]
    t = time.perf_counter()
    rows = dc.decontaminate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bench_table(spark, items)).orderBy("doc_id").collect()
    assert time.perf_counter() - t < 60
    assert [r["items"] for r in rows] == [[0, 1], [2], [3], []] and [r.coverage for r in rows] == [1.0, 1.0, 1.0, 0.0]


def test_reordered_passage(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    w = item.split()
    texts = [item, " ".join(w[10:] + ["x"] + w[:10]), " ".join(w[:6]), "nothing of it", item.upper().replace(" ", " - ")]
    rows = dc.decontaminate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bench_table(spark, [item, None, "", "..."])).orderBy("doc_id").collect()
    assert [r["items"] for r in rows] == [[0], [0], [], [], [0]]
    assert [r.coverage for r in rows] == [1.0, 1.0, 0.0, 0.0, 1.0]


def test_repeated_runs():
    assert sum(n for *_, n in dc.tile([1, 2, 3, 1, 2, 3], [[1, 2, 3], [1, 2, 3], [9]], 3)) == 6
    assert sum(n for *_, n in dc.tile([1, 2, 3, 1, 2, 3], [[1, 2, 3]], 3)) == 3


def test_odd_rows(spark):
    bench = bench_table(spark, ["the quick brown fox jumps over the lazy dog"])
    out = dc.decontaminate(docs(spark), bench)
    assert out.count() == len(ROWS) and out.columns.count("items") == 1 and "a b" in out.columns
    assert sorted(str(r.doc_id) for r in out.where("n_items > 0").collect()) == ["1", "5", "None"]
    assert dc.decontaminate(empty(spark), bench).count() == 0
    assert dc.decontaminate(docs(spark), bench_table(spark, [None])).where("n_items > 0 or coverage > 0").count() == 0
    assert dc.decontaminate(docs(spark), spark.createDataFrame([], "item_id long, text string")).where("n_items > 0").count() == 0


def test_planted_passages(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {r.doc_id for r in dc.op3_decontaminate(spark, sf).where("contaminated").collect()}
    assert got == {d for d, t in texts.items() if any(i in t for i in items)}
