"""Similarity self-join of documents on sets of word shingles, by prefixes of token combinations.

Order every set by (frequent class last, hash).  With similarity >= t and n shingles, at most (1-t)n of them are
missing from a partner, so two linked sets share a token within their prefixes of floor((1-t)n)+1.  If that token is
rare, its index entry brings the two together.  If not, both prefixes reach into the frequent class; then prefixes
are extended to floor(2(1-t)n)+2, where two tokens that are neighbours in both orders must exist: each missing token
parts at most two pairs of neighbours and each foreign one at most one.  Such documents index every rare token and
the 2-token combinations of neighbouring frequent tokens.  The class decides the work, never the result: any set of
tokens would do, and it is chosen from counts over all documents as the most frequent ones, MAX_FREQUENT at most.

Candidates are verified on the whole sets.  Copies with equal sets are one node; in each index entry the members are
first held against one of them, that with the fewest rare tokens; where an entry then still spans components, its
members in different components are held against each other in blocks.

A node is named by 64 bits of its set's signature; of sets that clash there, which the other 64 bits tell, each but
those of one signature takes its other half as name.  Shingles are compared by 64-bit hashes.  What remains: two sets with
all 128 bits in common would be one node, and a clash of two shingles within one pair of documents counts as one shared
shingle (about the product of the sizes in 2**64 pairs).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from math import ceil, log2
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..storage import cut, scope, ship
from .components import components
from .text import SPACED, mix, shingle_sets

#: A token in more documents than this is of the frequent class, if it is among the MAX_FREQUENT most frequent.
RARE = 16
MAX_FREQUENT = 1 << 21
#: Most bits of the filter that spares index entries of tokens that only one document has: two for each token up to
#: this, and right at any load; beyond, more entries are written that the next aggregate drops.
FILTER_BITS = 1 << 29
#: Sets that clash in 64 bits at most (a handful among 10**10 are expected).
MAX_CLASHES = 1 << 20
#: Partners of a node, homes that meet in an entry, or blocks that are held against one block, that stay in one group of rows.
SPREAD = 64
#: A value that more than a HOT-th of a table's rows share is hot, so fewer than HOT are; its rows stay together in groups of
#: so many.
HOT, GROUP = 1 << 12, 1 << 10
#: Tokens that a task gathers before it passes on their counts.
GATHER = 1 << 21
#: Members of a home that are held against those of another at once; a quarter of a thousand shingles each on average.
BLOCK = 512
#: Texts that a task takes at once.
TEXTS = 250
#: Ids that are broadcast at most (16 bytes each); beyond, the rows are shuffled.
BROADCAST_IDS = 1 << 20


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _half(g: np.ndarray, seed: int) -> int:
    return int(mix(np.array([mix(g ^ np.uint64(seed)).sum() + np.uint64(len(g))], np.uint64))[0].view(np.int64))


def _signature(g: np.ndarray) -> int:
    return _half(g, 0xA24BAED4963EE407)


def _other(g: np.ndarray) -> int:
    return _half(g, 0x9FB21C651E98DF25)


def _name(g: np.ndarray, clashes: frozenset[int]) -> int:
    """The name of a set's node."""
    return _other(g) if (sig := _signature(g)) in clashes else sig


class _Corpus(NamedTuple):
    """Documents as (key, doc_id, text): the key tells texts apart, the id itself if no row lacks or repeats it."""

    docs: DataFrame
    k: int
    table: np.ndarray
    percent: int
    kind: str  # of the key
    clashes: frozenset[int] = frozenset()

    @property
    def plain(self) -> bool:
        return self.kind == "long"


def _corpus(docs: DataFrame, k: int, table: np.ndarray, percent: int) -> _Corpus:
    n = docs.agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
    plain = n.rows == n.ids
    key = F.col("doc_id") if plain else F.md5(F.coalesce("text", F.lit("")))
    return _Corpus(docs.select(key.alias("key"), "doc_id", "text"), k, table, percent, "long" if plain else "string")


def _parity(g: np.ndarray) -> bytes:
    """A bit for each slot of a power of two >= n: whether an odd number of the set's hashes fall there."""
    size = 1 << max(6, (len(g) - 1).bit_length())
    return np.packbits((np.bincount((g & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8)).tobytes()


def _apart(x: bytes, y: bytes) -> int:
    """A lower bound of the number of tokens that only one of two sets has: the slots whose parities differ."""
    u, v = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(u) > len(v):
        u = u[: len(u) // 2] ^ u[len(u) // 2 :]
    while len(v) > len(u):
        v = v[: len(v) // 2] ^ v[len(v) // 2 :]
    return int(np.bitwise_count(u ^ v).sum())


def _sets(c: _Corpus, docs: DataFrame, tokens: bool) -> DataFrame:
    """(key, doc_id, sig, other, n, and the parities or the set), stored: each document's set, both halves of its signature and its size."""
    k, table, clashes = c.k, c.table, c.clashes

    def run(batches):
        for b in batches:
            sets = list(shingle_sets(b.column(2), table, k))
            cols = [b.column(0), b.column(1), pa.array([_name(g, clashes) for g in sets], pa.int64()), pa.array([_other(g) for g in sets], pa.int64()), pa.array([len(g) for g in sets], pa.int64())]
            if tokens:
                ends = np.cumsum([0, *map(len, sets)])
                cols.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _signed(np.concatenate([*sets, np.zeros(0, np.uint64)]))))
            else:
                cols.append(pa.array([_parity(g) for g in sets], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, ["key", "doc_id", "sig", "other", "n", "toks" if tokens else "bits"])

    return cut(docs, batch=TEXTS, by=run, schema=f"key {c.kind}, doc_id long, sig long, other long, n long, " + ("toks array<long>" if tokens else "bits binary"))


def _nodes(c: _Corpus, ids: DataFrame, rows: int) -> tuple[_Corpus, DataFrame, DataFrame]:
    """(corpus with its clashes, ids, nodes): the nodes are (sig, rep, low, n, bits, copies), rep a key of a text with that set, low the smallest id."""
    own = [F.min("key").alias("rep"), F.min("doc_id").alias("low"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.count("*").alias("copies")]
    nodes = ids.where("n > 0").groupBy("sig").agg(*own, F.min("other").alias("o0"), F.max("other").alias("o1"))
    nodes = cut(nodes, rows)
    clashes = frozenset(r.sig for r in nodes.where("o0 != o1").select("sig").limit(MAX_CLASHES).collect())
    if not clashes:
        return c, ids, nodes.drop("o0", "o1")
    if len(clashes) == MAX_CLASHES:
        raise ValueError("too many signatures clash")
    c = c._replace(clashes=clashes)
    shared = ids.sparkSession.createDataFrame([(x,) for x in clashes], "sig long").withColumn("clash", F.lit(True))
    ids = cut(ids.join(F.broadcast(shared), "sig", "left").withColumn("sig", F.when(F.col("clash"), F.col("other")).otherwise(F.col("sig"))).drop("clash"), rows)
    return c, ids, cut(ids.where("n > 0").groupBy("sig").agg(*own), rows)


def _widths(spark: SparkSession, total: int) -> tuple[int, int]:
    """(bits of a token's bucket, bits of the filter) for so many tokens."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bucket_bits = min(20, max(8, ceil(log2(parts * 4)), ceil(log2(max(total, 1) / GATHER + 1))))
    return bucket_bits, max(8 << bucket_bits, min(FILTER_BITS, 1 << ceil(log2(max(total, 1) * 2))))


def _alone[R](step: Callable[..., R]) -> Callable[..., R]:
    """The step's own tables go when its result is there, which reads none of them but a lasting one."""

    @wraps(step)
    def run(c: _Corpus, *args: object) -> R:
        with scope(c.docs.sparkSession):
            return step(c, *args)

    return run


@_alone
def _token_counts(c: _Corpus, total: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(keys of the frequent class sorted, filter of tokens in two documents or more, bits of a key).

    Tokens are counted by the upper bits of their hashes, about 12 more than tell all of them apart; a clash can
    only add a token to the class or the filter, which is harmless.  Tasks pass on blocks of sorted keys, one row
    for each of many ranges of the hash.
    """
    docs, k, table = c.docs, c.k, c.table
    bucket_bits, filter_bits = _widths(docs.sparkSession, total)
    bits = min(64, max(bucket_bits + 32, ceil(log2(max(total, 2))) + 12))
    wide = np.uint32 if bits == bucket_bits + 32 else np.uint64
    segment = filter_bits >> bucket_bits
    low = np.uint64((1 << (bits - bucket_bits)) - 1)

    def run(batches):
        held, size = [], 0

        def flush():
            keys, n = np.unique(np.concatenate(held) >> np.uint64(64 - bits), return_counts=True)
            cuts = np.searchsorted(keys, np.arange((1 << bucket_bits) + 1, dtype=np.uint64) << np.uint64(bits - bucket_bits))
            rest = (keys & low).astype(wide)
            rows = []
            for i in np.flatnonzero(np.diff(cuts)).tolist():
                a, b = cuts[i], cuts[i + 1]
                more = np.flatnonzero(n[a:b] > 1)
                rows.append((i, rest[a:b].tobytes(), more.astype(np.uint32).tobytes(), n[a:b][more].astype(np.uint32).tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 3))], ["bucket", "keys", "at", "n"])

        for b in batches:
            for g in shingle_sets(b.column(0), table, k):
                if len(g):
                    held.append(g)
                    size += len(g)
                if size >= GATHER:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def count(batches):
        bucket, keys, n = None, [], []
        for b in batches:  # sorted by bucket
            for r in range(b.num_rows):
                if (own := b.column(0)[r].as_py()) != bucket:
                    if keys:
                        yield counts_of(bucket, keys, n)
                    bucket, keys, n = own, [], []
                keys.append(x := np.frombuffer(b.column(1)[r].as_py(), wide))
                n.append(c := np.ones(len(x), np.uint32))
                c[np.frombuffer(b.column(2)[r].as_py(), np.uint32)] = np.frombuffer(b.column(3)[r].as_py(), np.uint32)
        if keys:
            yield counts_of(bucket, keys, n)

    def counts_of(bucket, keys, n):
        key = np.concatenate(keys)
        by = np.argsort(key, kind="stable")
        key, n = key[by], np.concatenate(n)[by].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        df, key = np.add.reduceat(n, first), key[first].astype(np.uint64)
        seen = np.zeros(segment, bool)
        seen[(key[df > 1] & np.uint64(segment - 1)).astype(np.int64)] = True
        often = df > RARE
        full = (np.uint64(bucket) << np.uint64(bits - bucket_bits)) | key[often]
        packed = [None] * int(often.sum()) + [np.packbits(seen).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array(np.append(full.view(np.int64), bucket)), pa.array(np.append(df[often], -1)), pa.array(packed, pa.binary())], ["key", "df", "bits"])

    blocks = docs.select("text").mapInArrow(run, "bucket int, keys binary, at binary, n binary")
    counted = cut(blocks.repartition("bucket").sortWithinPartitions("bucket"), batch=TEXTS, by=count, schema="key long, df long, bits binary")
    seen = np.zeros(filter_bits // 8, np.uint8)
    for r in counted.where("df < 0").select("key", "bits").toLocalIterator():  # filter_bits in all
        seen[r.key * (segment // 8) : (r.key + 1) * (segment // 8)] = np.frombuffer(r.bits, np.uint8)
    levels = counted.where("df > 0").groupBy(F.ceil(F.log2("df") * 8).alias("level")).count().collect()  # 512 at most
    least, left = 1 << 30, MAX_FREQUENT
    for r in sorted(levels, reverse=True):
        if (left := left - r["count"]) < 0:
            break
        least = r.level
    often = counted.where("df > 0").where(F.ceil(F.log2("df") * 8) >= least).select("key").toArrow()  # MAX_FREQUENT rows at most
    return np.sort(often.column(0).to_numpy().view(np.uint64)), seen, bits


def _index(c: _Corpus, total: int) -> DataFrame:
    """(key, sig, n, own), stored: the index entries of each document; own: how many of its tokens are rare."""
    docs, k, table, percent, clashes = c.docs, c.k, c.table, c.percent, c.clashes
    spark = docs.sparkSession
    often, seen, bits = _token_counts(c, total)
    bucket_bits, filter_bits = _widths(spark, total)
    rough = np.zeros(1 << 20, bool)
    rough[(often & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
    shared = spark.sparkContext.broadcast((often, rough, seen))
    segment = filter_bits >> bucket_bits
    # Sets too small for the extended prefix (there are none from 75 % on), and what may be linked to them.
    small = max((n for n in range(2, 10_000) if 2 * (100 - percent) * n // 100 + 2 > n), default=0) * 100 // percent if percent > 50 else 1 << 62

    def run(batches):
        often, rough, seen = shared.value
        done = set()  # names that this task has indexed: of a group of copies one is enough

        def frequent(g):
            key = g >> np.uint64(64 - bits)
            out = rough[(key & np.uint64((1 << 20) - 1)).astype(np.int64)]
            at = np.flatnonzero(out)
            if len(at):
                i = np.searchsorted(often, key[at])
                out[at] = often[np.minimum(i, len(often) - 1)] == key[at]
            return out

        def again(g):
            """Those that another document may have."""
            key = g >> np.uint64(64 - bits)
            at = ((key >> np.uint64(bits - bucket_bits)) * np.uint64(segment) + (key & np.uint64(segment - 1))).astype(np.int64)
            return g[(seen[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1]

        for b in batches:
            keys, sigs, ns, own = [], [], [], []
            for g in shingle_sets(b.column(0), table, k):
                n = len(g)
                if not n or (name := _name(g, clashes)) in done:
                    continue
                done.add(name)
                p = (100 - percent) * n // 100 + 1
                f = frequent(g)
                rare = g[~f]
                entries = [again(rare[:p])]
                if len(rare) < p:
                    last = (2 * (100 - percent) * n // 100 + 2) - len(rare)
                    common = g[f][:last]
                    if n <= small:
                        entries.append(common[: p - len(rare)])
                    if len(common) > 1:
                        entries.append(mix(common[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + common[1:]))
                e = np.concatenate(entries)
                if len(e):
                    keys.append(e)
                    sigs.append(np.full(len(e), name, np.int64))
                    ns.append(np.full(len(e), n, np.int64))
                    own.append(np.full(len(e), len(rare), np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(keys)), pa.array(np.concatenate(sigs)), pa.array(np.concatenate(ns)), pa.array(np.concatenate(own))], ["key", "sig", "n", "own"])

    return cut(docs.select("text"), batch=TEXTS, by=run, schema="key long, sig long, n long, own long")


def _sets_of(c: _Corpus, wanted: DataFrame) -> DataFrame:
    """(key, doc_id, sig, other, n, toks) of one document for each of these keys (a stored table), from its text."""
    wanted = F.broadcast(wanted.distinct()) if wanted.count() <= BROADCAST_IDS else wanted.distinct()
    found = c.docs.join(wanted, "key", "left_semi")
    return _sets(c, found if c.plain else found.dropDuplicates(["key"]), True)


def _spread(df: DataFrame, n: str, by: list[str], copies: bool) -> DataFrame:
    """df with a column ``salt`` below ceil(n / SPREAD): one by the hash of ``by``, or a copy of the row for each."""
    most = F.ceil(F.col(n) / SPREAD).cast("int")
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), most - 1)) if copies else F.pmod(F.xxhash64(*by), most).cast("int"))


def _dealt_join(many: DataFrame, one: DataFrame, by: str, counts: DataFrame, rows: int, deal: Column) -> DataFrame:
    """many joined with ``one`` by a column; counts (by, m): how many of the ``rows`` of ``many`` have each of its values.

    The rows of a hot value are dealt by ``deal`` over groups of GROUP rows, with a copy of its row of ``one`` for each.
    """
    hot = F.broadcast(counts.where(F.col("m") * HOT > rows).select(by, F.ceil(F.col("m") / GROUP).cast("int").alias("groups")))  # fewer than HOT rows
    groups = F.coalesce("groups", F.lit(1))
    left = many.join(hot, by, "left").withColumn("group_of", F.pmod(deal, groups).cast("int")).drop("groups")
    right = one.join(hot, by, "left").withColumn("group_of", F.explode(F.sequence(F.lit(0), groups - 1))).drop("groups")
    return left.join(right, [by, "group_of"]).drop("group_of")


@_alone
def _resolved(c: _Corpus, reps: DataFrame, left: DataFrame) -> DataFrame:
    """(a, b), stored: links that join whatever components have linked members in a common entry of ``left`` (key, size, sig, n, c).

    A pair may share many entries, so each node has one home, its largest entry; homes that meet in an entry are held
    against each other once, in blocks of BLOCK members.  Parities leave few pairs of a block; for these the sets are
    fetched and compared, but for pairs that earlier links of the block have joined.
    """
    percent, key_type = c.percent, pa.int64() if c.plain else pa.string()
    home = left.groupBy("sig").agg(F.max(F.struct("size", "key")).key.alias("home"), F.first("n").alias("n"), F.first("c").alias("c"))
    n = left.count()
    home = cut(home.join(reps.select("sig", "rep", "bits"), "sig"), n)
    span = [f(x).alias(f.__name__ + x) for x in ("n", "c") for f in (F.min, F.max)]
    spans = home.groupBy("home").agg(*span, F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / (BLOCK * 256))).alias("parts"))
    # Homes of one component, or whose sizes are too far apart, don't meet; an entry of many homes is dealt over tasks.
    meet = left.join(home.select("sig", "home"), "sig").select("key", "home").distinct()
    meet = meet.join(meet.groupBy("key").agg(F.count("*").alias("homes")), "key").join(spans.drop("parts"), "home")
    x, y = (meet.toDF(h, "key", "homes", f"n0{h}", f"n1{h}", f"c0{h}", f"c1{h}") for h in "xy")
    x, y = _spread(x, "homes", ["x"], False).drop("homes"), _spread(y, "homes", [], True).drop("homes")
    apart = ~((F.col("c0x") == F.col("c1x")) & (F.col("c0y") == F.col("c1y")) & (F.col("c0x") == F.col("c0y")))
    near_sizes = (100 * F.col("n1x") >= percent * F.col("n0y")) & (100 * F.col("n1y") >= percent * F.col("n0x"))
    meet = x.join(y, ["key", "salt"]).where("x <= y").where(apart & near_sizes).select("x", "y").distinct()
    lists = home.join(spans.select("home", "parts"), "home").withColumn("part", F.pmod(F.xxhash64("sig"), F.col("parts")))
    lists = cut(lists.repartition("home", "part").groupBy("home", "part").agg(*span, F.collect_list(F.struct("sig", "n", "c", "rep", "bits")).alias("items")), n, batch=16)
    # The same for blocks, before their lists are joined; a block that meets many others is copied for them.
    x, y = (lists.drop("items").toDF(h, f"p{h}", f"n0{h}", f"n1{h}", f"c0{h}", f"c1{h}") for h in "xy")
    meet = cut(meet.join(y, "y").join(x, "x").where("x < y or px <= py").where(apart & near_sizes).select("x", "px", "y", "py"))
    blocks, copies = meet, {}
    for h in "yx":
        deals = meet.groupBy(h, f"p{h}").agg(F.count("*").alias("blocks"))
        blocks = _spread(blocks.join(deals, [h, f"p{h}"]), "blocks", ["x", "px", "y", "py"], False).drop("blocks").withColumnRenamed("salt", f"s{h}")
        own = lists.select(F.col("home").alias(h), F.col("part").alias(f"p{h}"), F.col("items").alias(f"i{h}")).join(deals, [h, f"p{h}"])
        copies[h] = _spread(own, "blocks", [], True).drop("blocks").withColumnRenamed("salt", f"s{h}")
    for h in "yx":
        blocks = blocks.join(copies[h], [h, f"p{h}", f"s{h}"])
    blocks = blocks.select((F.col("x") == F.col("y")).alias("same"), (F.col("px") == F.col("py")).alias("one"), "ix", "iy", F.xxhash64("x", "px", "y", "py").alias("block"))

    def columns(items: pa.StructArray):
        number = [items.field(i).to_numpy(zero_copy_only=False) for i in range(4)]
        by_size: dict[int, list] = {}
        for i, bits in enumerate(items.field(4).to_pylist()):
            by_size.setdefault(len(bits), []).append((i, bits))
        return number, {s: (np.array([i for i, _ in v]), np.frombuffer(b"".join(b for _, b in v), np.uint64).reshape(len(v), -1)) for s, v in by_size.items()}

    def near(batches):
        for b in batches:
            out = []
            for r in range(b.num_rows):
                (sx, nx, cx, dx), bx = columns(b.column(2)[r].values)
                (sy, ny, cy, dy), by = columns(b.column(3)[r].values)
                once = b.column(0)[r].as_py() and b.column(1)[r].as_py()
                found = []
                for u, (iu, pu) in bx.items():
                    for v, (iv, pv) in by.items():
                        if max(u, v) > 2 * min(u, v):
                            continue  # sizes too far apart for any similarity from 50 %
                        fu, fv = pu, pv
                        while fu.shape[1] > fv.shape[1]:
                            fu = fu[:, : fu.shape[1] // 2] ^ fu[:, fu.shape[1] // 2 :]
                        while fv.shape[1] > fu.shape[1]:
                            fv = fv[:, : fv.shape[1] // 2] ^ fv[:, fv.shape[1] // 2 :]
                        for a in range(0, len(iu), 64):
                            i = iu[a : a + 64]
                            ok = cx[i][:, None] != cy[iv][None, :]
                            total = nx[i][:, None] + ny[iv][None, :]
                            ok &= (100 + percent) * np.minimum(nx[i][:, None], ny[iv][None, :]) >= percent * total
                            if once:
                                ok &= sx[i][:, None] < sy[iv][None, :]
                            p, q = np.nonzero(ok)
                            for w in range(0, len(p), 1 << 14):
                                pw, qw = p[w : w + (1 << 14)], q[w : w + (1 << 14)]
                                far = np.bitwise_count(fu[a + pw] ^ fv[qw]).sum(1, dtype=np.int64)
                                good = (100 + percent) * ((total[pw, qw] - far) // 2) >= percent * total[pw, qw]
                                found.append(np.stack([far[good], i[pw[good]], iv[qw[good]]]))
                f = np.concatenate(found, 1) if found else np.zeros((3, 0), np.int64)
                if f.shape[1]:
                    _, i, j = f[:, np.argsort(f[0], kind="stable")]
                    out.append((b.column(4)[r].as_py(), sx[i], sy[j], cx[i], cy[j], np.unique(np.concatenate([sx[i], sy[j]])), np.unique(np.concatenate([dx[i], dy[j]]))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), *[pa.array([o[i] for o in out], pa.list_(pa.int64())) for i in range(1, 6)], pa.array([o[6].tolist() for o in out], pa.list_(key_type))], ["block", "a", "b", "ca", "cb", "sigs", "keys"])

    rough = cut(blocks.select("same", "one", "ix", "iy", "block"), n, batch=16, by=near, schema=f"block long, a array<long>, b array<long>, ca array<long>, cb array<long>, sigs array<long>, keys array<{c.kind}>")
    sets = _sets_of(c, rough.select(F.explode("keys").alias("key")))
    nodes = rough.select("block", F.explode("sigs").alias("sig")).join(sets.select("sig", "toks"), "sig")
    nodes = nodes.groupBy("block").agg(F.collect_list(F.struct("sig", "toks")).alias("sets"))

    def check(batches):
        for b in batches:
            links = []
            for r in range(b.num_rows):
                items = b.column(4)[r].values
                toks = items.field(1)
                have = {s: toks[i].values.to_numpy().view(np.uint64) for i, s in enumerate(items.field(0).to_pylist())}
                parent: dict[int, int] = {}

                def root(x, parent=parent):
                    while (p := parent.setdefault(x, x)) != x:
                        parent[x] = x = parent[p]
                    return x

                for u, v, cu, cv in zip(*(b.column(i)[r].as_py() for i in range(4))):
                    cu, cv = root(cu), root(cv)
                    if cu != cv:
                        both = len(have[u]) + len(have[v])
                        shared = both - len(np.union1d(have[u], have[v]))
                        if 100 * shared >= percent * (both - shared):
                            parent[max(cu, cv)] = min(cu, cv)
                            links.append((cu, cv))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], ["a", "b"])

    return cut(rough.join(nodes, "block").select("a", "b", "ca", "cb", "sets"), n, lasting=True, batch=4, by=check, schema="a long, b long")


@_alone
def _verified(c: _Corpus, reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b), stored: of the pairs of nodes (a stored table) those that are linked.

    The parities, a sixty-fourth of the sets' size, rule out pairs that must differ in too many tokens; the sets of
    the rest are made anew from their texts and compared in full.
    """
    percent, most = c.percent, pairs.count()
    x = reps.select(F.col("sig").alias("a"), F.col("rep").alias("da"), F.col("n").alias("na"), F.col("bits").alias("ba"))
    y = reps.select(F.col("sig").alias("b"), F.col("rep").alias("db"), F.col("n").alias("nb"), F.col("bits").alias("bb"))

    def near(batches):
        for b in batches:
            na, nb = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            apart = np.array([_apart(u, v) for u, v in zip(b.column(4).to_pylist(), b.column(5).to_pylist())], np.int64)
            # n shared of u in all means (na + nb - 2n) apart; shared * 100 >= percent * (na + nb - shared)
            ok = pa.array((100 + percent) * ((na + nb - apart) // 2) >= percent * (na + nb))
            yield pa.RecordBatch.from_arrays([b.column(i).filter(ok) for i in (0, 1, 6, 7)], ["a", "b", "da", "db"])

    # A central member of many entries has many partners.
    partners = pairs.groupBy("a").agg(F.count("*").alias("m"))
    rough = _dealt_join(pairs.join(y, "b"), x, "a", partners, most, F.xxhash64("b")).select("a", "b", "na", "nb", "ba", "bb", "da", "db")
    rough = cut(rough, most, by=near, schema=f"a long, b long, da {c.kind}, db {c.kind}")
    sets = _sets_of(c, rough.select(F.col("da").alias("key")).union(rough.select(F.col("db").alias("key"))))
    left = sets.select(F.col("sig").alias("a"), F.col("n").alias("na"), F.col("toks").alias("ta"))
    right = sets.select(F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("toks").alias("tb"))
    deals = rough.groupBy("a").agg(F.count("*").alias("pairs"))
    dealt = _dealt_join(rough.select("a", "b"), deals, "a", deals.withColumnRenamed("pairs", "m"), rough.count(), F.xxhash64("b"))
    dealt = _spread(dealt, "pairs", ["b"], False).drop("pairs")
    copies = _spread(left.join(deals, "a"), "pairs", [], True).drop("pairs")
    both = dealt.join(right, "b").join(copies, ["a", "salt"]).withColumn("o", F.size(F.array_intersect("ta", "tb")))
    both = both.where(100 * F.col("o") >= percent * (F.col("na") + F.col("nb") - F.col("o"))).select("a", "b")
    return cut(both, 4 * rough.count(), lasting=True)  # sets are long: fewer rows a file


def ngram_jaccard_join(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", table: np.ndarray = SPACED) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``docs``; other columns are ignored.

    Documents are linked when 100 * shared >= percent * all distinct k-word shingles of the two (50 <= percent <= 100).
    A null or empty text has no shingles, is linked with nothing and its own component; fewer than k words make one
    shingle.  component_id is the smallest id reached by links; rows with equal ids are separate rows, each with the
    component of its own text; a row with a null id keeps its place and gets the component of its text, null if no row with an id has it.
    """
    with scope(docs.sparkSession):
        return cut(_joined(docs, k, percent, id_col, text_col, table).select("doc_id", "n_shingles", "component_id"), lasting=True)


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", table: np.ndarray = SPACED) -> DataFrame:
    """docs with one row of each group of linked rows: that with the smallest id, one without an id only if no other is there.

    Groups are as in ngram_jaccard_join, row by row: of rows that repeat an id, each stays or goes by its own text.  Ties
    in the id go by the text's MD5 hash; of rows alike in both the smallest by all columns stays (so these must be of
    types that can be ordered).  Rows without words all stay; all columns pass through.
    """
    spark = docs.sparkSession
    with scope(spark):
        found = cut(_joined(docs, k, percent, id_col, text_col, table).where("group is not null").select("key", "doc_id", "group"))
        order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
        best = found.groupBy("group").agg(F.min(order).alias("best"), F.count("*").alias("rows")).where("rows > 1")
        own = found.join(best, "group")
        gone = cut(own.where(order != F.col("best")).select(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).distinct(), lasting=True)
        again = own.where(order == F.col("best")).groupBy(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).agg(F.count("*").alias("__rows")).where("__rows > 1").drop("__rows")
        again = cut(again, lasting=True) if found.schema["key"].dataType.simpleString() == "string" else None  # ids are distinct otherwise
    own_id = F.col(id_col).cast("long")
    if again is None:
        return docs.join(gone, own_id == F.col("__id"), "left_anti")
    same = own_id.eqNullSafe(F.col("__id")) & (F.md5(F.coalesce(F.col(text_col), F.lit(""))) == F.col("__key"))
    kept = docs.join(gone, same, "left_anti")
    one = kept.join(again, same).groupBy("__id", "__key").agg(F.min(F.struct(*[F.col(f"`{x}`") for x in docs.columns])).alias("row"))
    return kept.join(again, same, "left_anti").unionByName(one.select("row.*"))


def _joined(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str, table: np.ndarray) -> DataFrame:
    """(key, doc_id, n_shingles, component_id, group), from tables that go with the caller's scope; no group for a row without words."""
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    ship(docs.sparkSession)
    c = _corpus(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), k, table, percent)
    ids = _sets(c, c.docs, False)
    size = ids.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("rows")).first()
    c, ids, reps = _nodes(c, ids, size.rows)
    entries = _index(c, size.tokens)
    keys = entries.groupBy("key").agg(F.min(F.struct("own", "sig", "n")).alias("low"), F.min("sig").alias("least"), F.max("sig").alias("most")).where("least != most")
    multi = cut(entries.join(keys.select("key", F.col("low.sig").alias("rep"), F.col("low.n").alias("rep_n")), "key").distinct(), entries.count())
    n_multi = multi.count()

    def alike(a, b):
        return (100 * F.col(a) >= percent * F.col(b)) & (100 * F.col(b) >= percent * F.col(a))

    pairs = multi.where("sig != rep").where(alike("n", "rep_n")).select(F.col("rep").alias("a"), F.col("sig").alias("b")).distinct()
    links = _verified(c, reps, cut(pairs, n_multi))
    linked = components(links)
    # Entries whose members the first round left in more than one component: whatever of theirs is still apart.  The
    # entry's first member has been held against all others, so no link of its own is missing.
    found = reps.join(linked, F.col("sig") == F.col("node"), "left").select("sig", F.coalesce("component", "sig").alias("c"))
    left = multi.where("sig != rep").join(found, "sig")
    apart = left.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size")).where("lo != hi").select("key", "size")
    left = cut(left.join(apart, "key").select("key", "size", "sig", "n", "c"), n_multi)
    if not left.isEmpty():
        linked = components(links.unionByName(_resolved(c, reps, left)))
    linked = linked.join(reps.select(F.col("sig").alias("node"), "low"), "node")
    lows = linked.groupBy("component").agg(F.min("low").alias("component_id"))
    linked = linked.join(lows, "component").select(F.col("node").alias("sig"), F.col("component").alias("group"), "component_id")
    labels = reps.select("sig", "low").join(linked, "sig", "left").select("sig", F.coalesce("group", "sig").alias("group"), F.coalesce("component_id", "low").alias("component_id"))
    # A group of copies may be a large part of all rows; ids are a stored table, so its rows are numbered alike in each attempt.
    copies = reps.select("sig", F.col("copies").alias("m"))
    full = _dealt_join(ids.where("n > 0"), labels, "sig", copies, size.rows, F.monotonically_increasing_id()).select("key", "doc_id", F.col("n").alias("n_shingles"), "component_id", "group")
    return full.unionByName(ids.where("n = 0").select("key", "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("group")))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, percent=85)


QUERIES = {"op7_ngram_jaccard_join": op7_ngram_jaccard_join}

SQL = {
    "op7_ngram_jaccard_join": r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x != '') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id != b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM w UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id AND r.c < l.b)
SELECT w.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.c) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN r ON r.doc_id = w.doc_id GROUP BY w.doc_id"""
}
