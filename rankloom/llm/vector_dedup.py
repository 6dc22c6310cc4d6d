"""Near-duplicate vectors by HNSW graphs, one for each hash shard, every shard queried with every vector.

Equal vectors are one node.  Each shard gives a sample of its nodes, and every shard is audited with the samples of all:
their links to other nodes, found by brute force, must be found by beams, which are widened until they are, for
each class of group sizes on its own; a shard with few audited links takes the beam that all shards together need.  Queries whose beam is full of links
get a wider one, and beyond MAX_BEAM a scan of the whole shard, so groups of any size are counted in full.  Links are
verified by cosine in double precision.  A task reports counts and a spanning forest of its links, never the pairs.
"""

from __future__ import annotations

import io
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..storage import cut, filesystem, new_dir, scope, ship
from .components import components
from .hnsw import Graph
from .text import mix

#: Shards at least, and the bytes of double-precision vectors in one at most.
SHARDS, SHARD_BYTES = 8, 128 << 20
BEAM, MAX_BEAM = 32, 256
#: Nodes that each shard gives to the audits of all, and the part of their links that beams must find in each class.
AUDIT, RECALL = 256, 0.99


def classes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v, c): the distinct usable vectors in double precision, the smallest id and the number of their rows."""
    v = F.col(vector_col).cast("array<double>")
    d = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("v is not null and size(v) > 0")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    d = d.where(~bad & F.exists("v", lambda x: x != 0))
    d = d.select("id", F.transform("v", lambda x: x + 0.0).alias("v"))  # no negative zeros
    return d.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("c"))


class _Shard(NamedTuple):
    ids: np.ndarray
    counts: np.ndarray
    unit: np.ndarray  # double precision
    graph: Graph


def _load(path: str) -> _Shard:
    fs, name = filesystem(path)
    with fs.open_input_file(name) as f:
        z = np.load(io.BytesIO(f.read()))
    unit = z["unit"]
    return _Shard(z["ids"], z["counts"], unit, Graph(unit.astype(np.float32), [z[f"level{i}"] for i in range(int(z["n_levels"]))]))


def _links(s: _Shard, q: np.ndarray, least: float, beam: int):
    """(rows, nodes): of the queries q (unit, double) the nodes of the shard with cosine >= least, as found."""
    n, rows, nodes = len(s.ids), [], []
    todo, low = np.arange(len(q)), np.float32(least - 1e-3)
    q32 = q.astype(np.float32)
    while len(todo):
        wide = beam > MAX_BEAM or beam >= n
        again = []
        for a in range(0, len(todo), 2048):
            part = todo[a : a + 2048]
            if wide:
                for b in range(0, len(part), max(1, (1 << 23) // n)):
                    own = part[b : b + max(1, (1 << 23) // n)]
                    r, c = np.nonzero(q32[own] @ s.graph.x.T >= low)
                    rows.append(own[r])
                    nodes.append(c)
            else:
                ids, sims = s.graph.search(q32[part], beam)
                full = sims.min(1) >= low
                again.append(part[full])
                r, c = np.nonzero((sims >= low) & ~full[:, None])
                rows.append(part[r])
                nodes.append(ids[r, c].astype(np.int64))
        todo, beam = np.concatenate([*again, np.zeros(0, np.int64)]), beam * 2
    r, c = np.concatenate([*rows, np.zeros(0, np.int64)]), np.concatenate([*nodes, np.zeros(0, np.int64)])
    keep = np.zeros(len(r), bool)
    for a in range(0, len(r), 1 << 16):
        keep[a : a + (1 << 16)] = np.einsum("kd,kd->k", q[r[a : a + (1 << 16)]], s.unit[c[a : a + (1 << 16)]]) >= least
    return r[keep], c[keep]


def _audit(s: _Shard, samples, least: float) -> list[tuple[int, int, int, int]]:
    """(beam, class, links, found) for each beam tried, the last one holding; samples: (ids, unit vectors), one after the other.

    A query's class is the binary logarithm of the number of its links to nodes other than itself; those without are
    left out.  After MAX_BEAM the shard is scanned, which finds all.
    """
    queries, own, true = [], [], []
    for ids, unit in samples:
        for a in range(0, len(ids), step := max(1, min(len(ids), (1 << 23) // max(1, len(s.ids))))):
            n = ((unit[a : a + step] @ s.unit.T >= least) & (ids[a : a + step, None] != s.ids)).sum(1)
            some = np.flatnonzero(n)
            queries.append(unit[a : a + step][some])
            own.append(ids[a : a + step][some])
            true.append(n[some])
    if not sum(map(len, own)):
        return []
    queries, own, true = np.concatenate(queries), np.concatenate(own), np.concatenate(true)
    kind = np.log2(true).astype(np.int64)
    links = np.bincount(kind, weights=true).astype(np.int64)
    out, beam, holds = [], BEAM, False
    while not holds:
        found = np.zeros(len(own), np.int64)
        if beam > MAX_BEAM:
            found = true
        else:
            for a in range(0, len(own), AUDIT):
                r, c = _links(s, queries[a : a + AUDIT], least, beam)
                other = own[a : a + AUDIT][r] != s.ids[c]
                found[a : a + AUDIT] = np.bincount(r[other], minlength=len(own[a : a + AUDIT]))
        of = np.bincount(kind, weights=found).astype(np.int64)
        out += [(beam, int(k), int(links[k]), int(of[k])) for k in np.flatnonzero(links)]
        holds, beam = bool((of >= RECALL * links).all()), beam * 2
    return out


def _beams(audits: dict[str, list[tuple[int, int, int, int]]]) -> dict[str, int]:
    """The beam of each shard, from the audits of all shards of one length.

    It is the shard's own, or a wider one that is the least at which every class holds over all shards; at beams
    wider than its own, a shard counts with what its own has found.
    """
    own = {k: max([beam for beam, *_ in rows], default=BEAM) for k, rows in audits.items()}
    floor = BEAM
    while True:
        links, found = {}, {}
        for k, rows in audits.items():
            for beam, kind, n, m in rows:
                if beam == min(floor, own[k]):
                    links[kind], found[kind] = links.get(kind, 0) + n, found.get(kind, 0) + m
        if all(found[k] >= RECALL * links[k] for k in links):
            return {k: max(b, floor) for k, b in own.items()}
        floor *= 2


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[list, list]:
    """Links (child, root) that join what the links (a, b) join."""
    parent: dict[int, int] = {}

    def root(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    found = [(x, root(x)) for x in list(parent)]
    return [x for x, r in found if x != r], [r for x, r in found if x != r]


def near_duplicates(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", shards: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row with an id.

    Rows are linked if the cosine of their vectors is at least ``least``, of those found; vectors that are null, empty,
    zero or hold null or non-finite components are linked with nothing, as are vectors of different lengths.
    component_id is the smallest id reached by links.  Ids are expected to be distinct; rows that repeat an id are
    rows of their own and count as links of each other if their vectors are.  Rows with a null id are left out.
    """
    spark = vectors.sparkSession
    ship(spark)
    with scope(spark):
        return cut(_linked(spark, vectors.where(F.col(id_col).isNotNull()), least, id_col, vector_col, shards), lasting=True)


def _linked(spark: SparkSession, vectors: DataFrame, least: float, id_col: str, vector_col: str, shards: int | None) -> DataFrame:
    """The result, from tables and files that go with the caller's scope."""
    nodes = cut(classes(vectors, id_col, vector_col), batch=250)
    sizes = {r.dim: r.n for r in nodes.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()}  # a row for each length
    plan = {dim: shards or max(SHARDS, -(-n * dim * 8 // SHARD_BYTES)) for dim, n in sizes.items()}
    if plan:
        per = F.element_at(F.create_map(*[F.lit(x) for kv in plan.items() for x in kv]), F.size("v"))
    else:
        per = F.lit(SHARDS)
    sharded = nodes.select("id", "c", "v", F.concat_ws("-", F.size("v"), F.pmod(F.xxhash64("id", F.lit("shard")), per)).alias("shard"))
    top = new_dir(spark, "graphs")

    def build(key, group):
        name = key[0].as_py()
        ids = group.column("id").to_numpy()
        v = group.column("v").combine_chunks()
        v = np.asarray(v.flatten()).reshape(len(ids), -1)
        order, levels = Graph.order(mix(ids.view(np.uint64)))
        ids, counts, v = ids[order], group.column("c").to_numpy()[order], v[order]
        unit = v / np.abs(v).max(1, keepdims=True)
        unit /= np.sqrt(np.einsum("kd,kd->k", unit, unit))[:, None]
        graph = Graph.build(unit.astype(np.float32), levels)
        fs, at = filesystem(top)
        fs.create_dir(at, recursive=True)
        with fs.open_output_stream(f"{at}/{name}.npz.tmp") as f:
            f.write(graph.dump(ids=ids, counts=counts, unit=unit))
        fs.move(f"{at}/{name}.npz.tmp", f"{at}/{name}.npz")
        some = slice(None, None, max(1, len(ids) // AUDIT))
        sample = io.BytesIO()
        np.savez(sample, ids=ids[some], unit=unit[some])
        with fs.open_output_stream(f"{at}/{name}.sample.tmp") as f:
            f.write(sample.getvalue())
        fs.move(f"{at}/{name}.sample.tmp", f"{at}/{name}.sample")
        return pa.table({"dim": pa.array([v.shape[1]], pa.int32()), "path": [f"{top}/{name}.npz"], "n": pa.array([len(ids)], pa.int64())})

    built = cut(sharded.groupBy("shard").applyInArrow(build, "dim int, path string, n long"))
    shards_of: dict[int, list[str]] = {}
    for r in built.select("dim", "path").collect():  # a row for each shard
        shards_of.setdefault(r.dim, []).append(r.path)

    def sampled(paths):
        for path in paths:
            fs, name = filesystem(path)
            with fs.open_input_file(name.removesuffix("npz") + "sample") as f:
                z = np.load(io.BytesIO(f.read()))
            yield z["ids"], z["unit"]

    def audit(batches):
        for b in batches:
            for dim, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = [(path, *r) for r in _audit(_load(path), sampled(shards_of[dim]), least)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if i else pa.string()) for i in range(5)], ["path", "beam", "kind", "links", "found"])

    audits: dict[str, list] = {path: [] for paths in shards_of.values() for path in paths}
    audited = cut(built.select("dim", "path").repartition(max(1, min(len(audits), 1 << 15))), by=audit, schema="path string, beam long, kind long, links long, found long")
    for r in audited.collect():  # a row for each shard, beam and class
        audits[r.path].append((r.beam, r.kind, r.links, r.found))
    beams = {k: b for paths in shards_of.values() for k, b in _beams({p: audits[p] for p in paths}).items()}
    tasks = built.alias("x").join(built.alias("y"), "dim").select(F.col("x.path").alias("of"), F.col("y.path").alias("in"))
    n_tasks = sum(x * x for x in plan.values())

    def search(batches):
        for b in batches:
            for of, within in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                q, s = _load(of), _load(within)
                for a in range(0, len(q.ids), 1 << 14):
                    r, c = _links(s, q.unit[a : a + (1 << 14)], least, beams[within])
                    x, y = q.ids[a : a + (1 << 14)][r], s.ids[c]
                    node, at = np.unique(r, return_inverse=True)
                    n = np.bincount(at, weights=s.counts[c], minlength=len(node)).astype(np.int64)
                    child, root = _forest(x[x != y], y[x != y])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([q.ids[a : a + (1 << 14)][node], np.array(child, np.int64)])), pa.array([None] * len(node) + root, pa.int64()), pa.array(n.tolist() + [None] * len(child), pa.int64())], ["a", "b", "n"])

    found = cut(tasks.repartition(max(1, min(n_tasks, 1 << 15))), by=search, schema="a long, b long, n long")
    counts = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    linked = components(found.where("b is not null"))
    done = nodes.join(counts, "id", "left").join(linked, F.col("id") == F.col("node"), "left")
    done = done.select("v", F.greatest(F.coalesce("n", "c"), "c").alias("n"), F.coalesce("component", "id").alias("component_id"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vector_col).cast("array<double>"), lambda x: x + 0.0).alias("v"))
    rows = rows.join(done, "v", "left")
    component = F.coalesce("component_id", "vec_id")
    return rows.select("vec_id", F.coalesce(F.col("n") - 1, F.lit(0)).alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op10_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op10_vector_dedup": op10_vector_dedup}

SQL = {
    "op10_vector_dedup": """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS MATERIALIZED (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS s FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
l AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id != b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.s * b.s) >= 0.9),
r(vec_id, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id AND r.c < l.b)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, m.c AS component_id, v.vec_id = m.c AS kept
FROM v JOIN (SELECT vec_id, min(c) AS c FROM r GROUP BY vec_id) m USING (vec_id)"""
}
