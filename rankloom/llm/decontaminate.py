"""Benchmark decontamination by greedy string tiling.

Seeds are the hashes of MIN_MATCH consecutive words; documents and benchmark items are joined on shared seeds.  For
each pair whose seeds could cover enough of the item, the longest matches of unmarked words are marked again and again
by running Karp-Rabin, and the covered part of the item decides; the order of the tiles doesn't matter.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..storage import cut
from .rows import append
from .text import ALNUM, mix, rolling, words

MIN_MATCH = 5
COVERED = 0.5
_BASE = 0xD1342543DE82EF95
#: Characters of the benchmark that tasks hold at once; a larger one is taken in blocks, one pass over the documents each.
BLOCK_CHARS = 32 << 20


class _Windows:
    """Karp-Rabin hashes of the windows of a sequence, of any length, and which of them hold no marked word."""

    def __init__(self, words: np.ndarray, free: np.ndarray, power: np.ndarray):
        self.words, self.free, self.power = words, free, power
        # sums of word * base**place; times base**(a common length - place), a window's sum is its hash
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words) * power[: len(words)], dtype=np.uint64)])
        self.room = np.zeros(0, np.int64)
        self.measure()

    def measure(self) -> None:
        """Unmarked words from each place on."""
        n = len(self.words)
        self.room = np.minimum.accumulate(np.where(self.free, n, np.arange(n))[::-1])[::-1] - np.arange(n)

    def hashes(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of the unmarked windows."""
        at = np.flatnonzero(self.room[: len(self.words) - length + 1] >= length) if length <= len(self.words) else np.zeros(0, np.int64)
        return at, (self.sums[at + length] - self.sums[at]) * self.power[len(self.power) - 1 - at]

    def mark(self, at: int, length: int) -> None:
        self.free[at : at + length] = False


def tile(item: Sequence[int], runs: Sequence[Sequence[int]], least: int) -> list[tuple[int, int, int, int]]:
    """Greedy string tiling of ``item`` with the runs of a document: (place in item, run, place in run, length).

    A longest match of unmarked words is marked again and again (ties: first in the item, then in the document), down
    to ``least`` words.  The longest length is found by halving, each probe holding the Karp-Rabin hashes of all unmarked
    windows of one length against those of the item; it only falls, and all matches of one length are marked in one
    walk.  A level costs time in proportion to the words, so repeated words cost no more than others.
    """
    if not len(item) or not runs or least < 1:
        return []
    first = np.cumsum([0, *(len(r) + 1 for r in runs)])
    words, free = np.zeros(int(first[-1]), np.uint64), np.zeros(int(first[-1]), bool)
    for a, r in zip(first.tolist(), runs):  # a marked place after each run parts it from the next
        words[a : a + len(r)], free[a : a + len(r)] = np.asarray(r, np.uint64), True
    power = np.multiply.accumulate(np.full(len(words) + len(item) + 1, _BASE, np.uint64))
    own, other = _Windows(np.asarray(item, np.uint64), np.ones(len(item), bool), power), _Windows(words, free, power)

    def shared(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        i, x = own.hashes(length)
        j, y = other.hashes(length)
        known = np.unique(x)
        k = np.minimum(np.searchsorted(known, y), max(len(known) - 1, 0))
        hit = known[k] == y if len(known) else np.zeros(len(y), bool)
        return i, x, j[hit], y[hit]

    tiles, most = [], len(item)
    while True:
        low, high, found = least - 1, min(most, int(own.room.max(initial=0)), int(other.room.max(initial=0))), None
        probe = high  # a whole copy is found at once
        while low < high:
            if len((got := shared(probe))[2]):
                low, found = probe, got
            else:
                high = probe - 1
            probe = (low + high + 1) // 2
        if found is None:
            return tiles
        most, (i, x, j, y) = low, found
        order = np.argsort(y, kind="stable")
        y, j = y[order], j[order]
        start = {}
        for p, h in zip(i.tolist(), x.tolist()):
            if not own.free[p : p + most].all():
                continue
            a = start.get(h)
            if a is None:
                a = int(np.searchsorted(y, np.uint64(h)))
            end = int(np.searchsorted(y, np.uint64(h), "right"))
            while a < end:
                q = int(j[a])
                taken = np.flatnonzero(~other.free[q : q + most])
                if len(taken):  # on to the first window past the last marked word of this one
                    a += int(np.searchsorted(j[a:end], q + int(taken[-1]) + 1))
                    continue
                if (own.words[p : p + most] == other.words[q : q + most]).all():
                    own.mark(p, most)
                    other.mark(q, most)
                    r = int(np.searchsorted(first, q, "right")) - 1
                    tiles.append((p, r, q - int(first[r]), most))
                    break
                a += 1
            start[h] = a
        most -= 1
        own.measure()
        other.measure()


class _Items:
    """Word hashes of benchmark items, and their seeds as one sorted array."""

    def __init__(self, ids: list, texts: list, least: int):
        self.ids, self.words = ids, []
        for _, h, at in words(pa.array(texts, pa.string()), ALNUM):
            self.words += [h[a:b] for a, b in zip(at[:-1], at[1:])]
        self.least = [min(least, len(w)) for w in self.words]
        seeds, owners, places = [], [], []
        for i, (w, k) in enumerate(zip(self.words, self.least)):
            if k:
                g = rolling(w, k)  # the hash takes in k
                seeds.append(g)
                owners.append(np.full(len(g), i))
                places.append(np.arange(len(g)))
        none = np.zeros(0, np.int64)
        seed = np.concatenate([*seeds, none.astype(np.uint64)])
        by = np.argsort(seed, kind="stable")
        self.seed, self.owner, self.place = seed[by], np.concatenate([*owners, none])[by], np.concatenate([*places, none])[by]
        self.sizes = sorted({k for k in self.least if k})
        self.rough = np.zeros(1 << 20, bool)
        self.rough[(self.seed & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def hits(self, h: np.ndarray, k: int) -> np.ndarray:
        """Places in h at which a seed of k words begins."""
        g = rolling(h, k)
        at = np.flatnonzero(self.rough[(g & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if not len(at):
            return at
        i = np.searchsorted(self.seed, g[at])
        return at[self.seed[np.minimum(i, len(self.seed) - 1)] == g[at]]

    def covered(self, h: np.ndarray, at: dict[int, np.ndarray], least: float) -> dict[int, float]:
        """Covered part of each item with at least ``least``, from a document's words and the places of its seeds by size.

        Equal seeds of the document are looked up once, so only the items' places count, not their pairs with the document's.
        """
        out = {}
        for k, places in at.items():
            seeds, which = np.unique(rolling(h, k)[places], return_inverse=True)
            a, n = np.searchsorted(self.seed, seeds), np.searchsorted(self.seed, seeds, "right") - np.searchsorted(self.seed, seeds)
            flat = np.repeat(a - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            owner, place, of = self.owner[flat], self.place[flat], np.repeat(np.arange(len(seeds)), n)
            by = np.lexsort((place, owner))
            owner, place, of = owner[by], place[by], of[by]
            ends = np.append(np.flatnonzero(np.diff(owner)) + 1, len(owner))
            for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
                item, q = int(owner[a]), place[a:b]
                w = self.words[item]
                if np.minimum(np.diff(q), k).sum() + k < least * len(w):
                    continue
                mine = np.zeros(len(seeds), bool)
                mine[of[a:b]] = True
                p = places[mine[which]]
                breaks = np.flatnonzero(np.diff(p) > k)  # only within these runs can a tile lie
                runs = [h[x : y + k] for x, y in zip(p[np.append(0, breaks + 1)].tolist(), p[np.append(breaks, len(p) - 1)].tolist())]
                part = sum(n for *_, n in tile(w, runs, k)) / len(w)
                if part >= least:
                    out[item] = part
        return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: float = COVERED, min_match: int = MIN_MATCH, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs with coverage, n_items and items: the ids of the items with at least ``least`` covered, sorted, and the largest such part.

    coverage is 0 where no item reaches ``least``: parts below it aren't measured.  Words are runs of ASCII letters and
    digits and of anything beyond ASCII, A-Z lower-cased.  Items of fewer than min_match words must occur whole; items
    without words, null items and null texts match nothing: coverage 0, no items.  Columns of docs pass through, but for
    those with the three new names.  Repeated items count by distinct id.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text).alias("text")).where("id is not null and length(text) > 0")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    out = docs
    for n in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == n).orderBy("id", "text").collect()
        shared = docs.sparkSession.sparkContext.broadcast(_Items([r.id for r in rows], [r.text for r in rows], min_match))
        before = n > 0
        at = {c: out.columns.index(c) for c in [text_col] + ["coverage", "items"] * before}

        def scan(b: pa.RecordBatch, held: _Items, at=at, before=before) -> list:
            n = b.num_rows
            coverage = b.column(at["coverage"]).to_pylist() if before else [0.0] * n
            found = [set(x) for x in b.column(at["items"]).to_pylist()] if before else [set() for _ in range(n)]
            for first, h, ends in words(b.column(at[text_col]), ALNUM):
                hits = {k: held.hits(h, k) for k in held.sizes}
                hits = {k: p[ends[np.searchsorted(ends, p, "right")] - p >= k] for k, p in hits.items() if len(p)}
                rows = {k: np.searchsorted(ends, p, "right") - 1 for k, p in hits.items()}
                for row in sorted({int(r) for x in rows.values() for r in np.unique(x)}):
                    a = int(ends[row])
                    own = {k: hits[k][rows[k] == row] - a for k in hits}
                    for item, part in held.covered(h[a : int(ends[row + 1])], {k: p for k, p in own.items() if len(p)}, least).items():
                        found[first + row].add(held.ids[item])
                        coverage[first + row] = max(coverage[first + row], part)
            return [coverage, list(map(len, found)), [sorted(x) for x in found]]

        out = append(out, "coverage double, n_items long, items array<long>", scan, lambda s=shared: s.value)
        if n + 1 < blocks:
            out = cut(out)
    return out


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", (F.col("n_items") > 0).alias("contaminated"), F.round("coverage", 6).alias("coverage"), "n_items", "items")


QUERIES = {"op3_decontaminate": op3_decontaminate}
