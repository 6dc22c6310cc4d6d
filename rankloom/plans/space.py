"""Vector spaces over the nodes of a transition matrix: what the solvers compute with.

A solver is written once against ``Space``.  ``TableSpace`` keeps all its vectors as columns of one table, so linear
combinations are projections, any number of sums is one aggregate, and a product is a join and an aggregate.
``ArraySpace`` does the same with arrays for a graph whose checked size fits one process, where Spark's cost for each
job would be nearly all of the time.  ``BlockSpace`` stands between them: arrays for the vectors of few nodes, blocks in
the shared folder for any number of edges.  All give the same results up to rounding.
"""

from __future__ import annotations

import uuid
import weakref
from abc import ABC, abstractmethod
from collections.abc import Iterator, Sequence
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..functions.scalars import EPSILON
from ..operators.graph import BROADCAST_ROWS, Graph, normalise, with_self_loops
from ..storage import NARROW_ROWS, cut, drop_dir, filesystem, gather, new_dir, store

#: Edges and nodes up to which a graph is solved as arrays (24 and 8 bytes each).
ARRAY_EDGES, ARRAY_NODES = 1 << 22, 1 << 21

#: Edges of a source that stay in one bucket, and edges of a bucket.
HUB, BUCKET = 1 << 20, 1 << 23

#: Edges of a block on average and at most (12 bytes each stored, some 60 in memory while it is made).
BLOCK, BLOCK_MOST = 1 << 20, 1 << 21

Terms = Sequence[tuple[float, object]]


class Space(ABC):
    """Vectors are opaque; ``n`` is their length, ``matvecs`` the number of products so far."""

    n: int
    matvecs: int = 0

    @abstractmethod
    def teleport(self) -> object:
        """The personalisation vector; 1/n everywhere without one."""

    @abstractmethod
    def load(self, x: DataFrame) -> object: ...

    @abstractmethod
    def mult(self, x: object) -> object:
        """The transposed matrix times x, stored."""

    @abstractmethod
    def lin(self, *terms: tuple[float, object]) -> object: ...

    @abstractmethod
    def reduce(self, *wanted: tuple) -> list[float]:
        """("sum", x), ("l1", x) or ("dot", x, y) each, all in one pass."""

    @abstractmethod
    def keep(self, *vectors: object) -> None:
        """Only these are needed from here on."""

    @abstractmethod
    def table(self, x: object) -> DataFrame:
        """(id, x)"""


class ArraySpace(Space):
    def __init__(self, p: Graph, v: DataFrame | None):
        self._spark = p.nodes.sparkSession
        self._ids = np.sort(p.nodes.select("id").toArrow().column(0).to_numpy())
        e = p.edges.select("src", "dst", "w").toArrow()
        self._src = np.searchsorted(self._ids, e.column(0).to_numpy())
        self._dst = np.searchsorted(self._ids, e.column(1).to_numpy())
        self._w = e.column(2).to_numpy()
        order = np.lexsort((self._src, self._dst))  # sums in a fixed order
        self._src, self._dst, self._w = self._src[order], self._dst[order], self._w[order]
        self.n, self.matvecs = len(self._ids), 0
        self._v = self.load(v) if v is not None else np.full(self.n, 1.0 / max(self.n, 1))

    def teleport(self):
        return self._v

    def load(self, x):
        t = x.toArrow()
        out = np.zeros(self.n)
        out[np.searchsorted(self._ids, t.column(0).to_numpy())] = t.column(1).to_numpy()
        return out

    def mult(self, x):
        self.matvecs += 1
        return np.bincount(self._dst, weights=self._w * x[self._src], minlength=self.n).astype(float)

    def lin(self, *terms):
        out = np.zeros(self.n)
        for a, x in terms:
            out += a * x
        return out

    def reduce(self, *wanted):
        ops = {"sum": lambda x: x.sum(), "l1": lambda x: np.abs(x).sum(), "dot": lambda x, y: x @ y}
        return [float(ops[k](*v)) for k, *v in wanted]

    def keep(self, *vectors):
        pass

    def table(self, x):
        return self._spark.createDataFrame(pa.table({"id": pa.array(self._ids, pa.int64()), "x": pa.array(x, pa.float64())}))


def _write(path: str, *arrays: np.ndarray) -> None:
    fs, at = filesystem(path)
    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(at, compression=None) as out:
        for a in arrays:
            out.write(np.ascontiguousarray(a).data.cast("B") if a.size else b"")


def _read(path: str) -> memoryview:
    fs, at = filesystem(path)
    with fs.open_input_file(at) as f:
        return memoryview(f.read())


def _block(path: str, src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Store edges ordered by target and source, as [edges, targets], weights, each target's first edge and sources.

    Repeated edges become one.  Returns the targets.
    """
    order = np.lexsort((src, dst))
    src, dst, w = src[order], dst[order], w[order]
    new = np.flatnonzero(np.r_[True, (dst[1:] != dst[:-1]) | (src[1:] != src[:-1])])
    src, dst, w = src[new], dst[new], np.add.reduceat(w, new)
    first = np.flatnonzero(np.r_[True, dst[1:] != dst[:-1]])
    _write(path, np.array([len(w), len(first)], np.int64), w, first.astype(np.int64), src)
    return dst[first]


def _block_sums(path: str, x: np.ndarray) -> np.ndarray:
    """The weighted sum of x over the sources of each of a block's targets."""
    b = _read(path)
    m, targets = np.frombuffer(b, np.int64, 2)
    w = np.frombuffer(b, np.float64, m, 16)
    first = np.frombuffer(b, np.int64, targets, 16 + 8 * m)
    return np.add.reduceat(w * x[np.frombuffer(b, np.int32, m, 16 + 8 * m + 8 * targets)], first)


def _multiple(x: np.ndarray, of: np.ndarray) -> float | None:
    """c if x is c times ``of`` but for the rounding of its elements, else None."""
    if not len(of) or not of[k := np.argmax(np.abs(of))]:
        return None
    c = float(x[k] / of[k])
    scaled = c * of
    return c if np.all(np.abs(x - scaled) <= 4 * np.finfo(float).eps * np.abs(scaled)) else None


class BlockSpace(ArraySpace):
    """Vectors are arrays, for the nodes are counted to be few; edges, however many, are stored once in blocks by target.

    g isn't normalised yet: a product divides x by the row sums first, which is the same without a join.  A product is
    a job whose tasks read x and some blocks and give back the sums of the blocks' targets.  A target's edges beyond
    BLOCK_MOST make further blocks, so neither a task's memory nor a product depends on hubs.

    A product reads x at nodes with a row alone.  Where x is there a multiple of the vector multiplied last, so is its
    product, without a job: where edges lead from one kind of nodes to another, whose rows are empty, each after the first.
    """

    def __init__(self, g: Graph, v: DataFrame | None, dangling: str = "teleport"):
        if dangling not in ("teleport", "loop"):
            raise ValueError(f"unknown treatment of dangling nodes: {dangling}")
        self._spark = g.nodes.sparkSession
        self._ids = np.sort(g.nodes.select("id").toArrow().column(0).to_numpy())
        self.n, self.matvecs = len(self._ids), 0
        self._v = self.load(v) if v is not None else np.full(self.n, 1.0 / max(self.n, 1))
        self._dir = top = new_dir(self._spark, "blocks")
        self._drop = weakref.finalize(self, _dropped, self._spark, top)
        self._drop.atexit = False  # the session may be gone by then, and the folder goes anyway
        edges = (with_self_loops(g) if dangling == "loop" else g).edges.where("src is not null and dst is not null and w is not null")
        sums = self.load(edges.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("x")).join(F.broadcast(g.nodes), "id", "left_semi"))
        kept = np.abs(sums) > EPSILON
        self._inverse = np.divide(1.0, sums, out=np.zeros(self.n), where=kept)
        self._rows, self._done = np.flatnonzero(kept), None
        _write(f"{top}/ids", self._ids.astype(np.int64))

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, task, k, parts, rows = np.frombuffer(_read(f"{top}/ids"), np.int64), TaskContext.get(), 0, [], 0

            def flush() -> pa.RecordBatch:
                # an attempt's own name: blocks of different attempts never mix
                name = f"{task.partitionId():06d}-{task.taskAttemptId()}-{k}"
                targets = _block(f"{top}/{name}", *(np.concatenate([p[i] for p in parts]) for i in range(3)))
                return pa.RecordBatch.from_pydict({"name": [name], "targets": pa.array([targets.tobytes()], pa.binary())})

            for b in batches:
                ends = [b.column(i).to_numpy() for i in range(2)]
                at = [np.searchsorted(ids, e) for e in ends]
                known = np.logical_and(*(ids[np.minimum(a, len(ids) - 1)] == e for a, e in zip(at, ends))) if len(ids) else np.zeros(b.num_rows, bool)
                one = [a[known].astype(np.int32) for a in at] + [b.column(2).to_numpy()[known]]
                if rows and rows + len(one[2]) > BLOCK_MOST:
                    yield flush()
                    k, parts, rows = k + 1, [], 0
                if len(one[2]):
                    parts.append(one)
                    rows += len(one[2])
            if rows:
                yield flush()

        count = max(self._spark.sparkContext.defaultParallelism, -(-g.edges.count() // BLOCK))  # of a stored graph from its files' footers
        found = gather(edges.select("src", "dst", "w").repartition(count, "dst"), build, "name string, targets binary", NARROW_ROWS)
        self._blocks = [(f"{top}/{name}", np.frombuffer(targets, np.int32)) for name, targets in sorted((r.name, bytes(r.targets)) for r in found)]

    def mult(self, x):
        self.matvecs += 1
        y = np.zeros(self.n)
        if not self._blocks:
            return y
        own = x[self._rows]
        if self._done and (c := _multiple(own, self._done[0])) is not None:
            return c * self._done[1]
        at, paths = f"{self._dir}/x-{uuid.uuid4().hex}", [path for path, _ in self._blocks]
        _write(at, x * self._inverse)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x = None
            for b in batches:
                for i in b.column(0).to_pylist():
                    x = np.frombuffer(_read(at), np.float64) if x is None else x
                    yield pa.RecordBatch.from_pydict({"block": pa.array([i], pa.int64()), "y": pa.array([_block_sums(paths[i], x).tobytes()], pa.binary())})

        tasks = min(len(paths), self._spark.sparkContext.defaultParallelism)  # blocks are alike, and each task reads x once
        found = gather(self._spark.range(0, len(paths), 1, tasks), sums, "block long, y binary")
        for block, part in sorted((r.block, bytes(r.y)) for r in found):  # sums in a fixed order
            y[self._blocks[block][1]] += np.frombuffer(part, np.float64)  # a block's targets are distinct
        fs, path = filesystem(at)
        fs.delete_file(path)
        self._done = own, y.copy()
        return y


def _dropped(spark: SparkSession, path: str) -> None:
    with suppress(Exception):  # a session that has ended
        drop_dir(spark, path)


def bucketed(edges: DataFrame, parts: int) -> DataFrame:
    """Edges (src, salt, dst, w) stored in buckets of (src, salt), so that products move only the vector.

    A source of more than HUB edges is dealt over several salts.
    """
    spark, name, path = edges.sparkSession, f"edges_{uuid.uuid4().hex}", new_dir(edges.sparkSession, "edges")
    hubs = edges.groupBy("src").agg(F.ceil(F.count("*") / HUB).cast("int").alias("salts")).where("salts > 1")
    salt = F.pmod(F.xxhash64("dst"), F.coalesce("salts", F.lit(1))).cast("int")
    dealt = edges.join(hubs, "src", "left").select("src", salt.alias("salt"), "dst", "w")
    dealt.repartition(parts, "src", "salt").write.option("path", path).bucketBy(parts, "src", "salt").saveAsTable(name)
    stored = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files and their description stay
    return stored


class TableSpace(Space):
    """Edges are stored once, in buckets by source; the vectors' table is stored anew by each product.

    A product's own sums and those of the vector that it multiplies are observed while it is stored.
    """

    def __init__(self, p: Graph, v: DataFrame | None, broadcast: bool = True):
        self._spark, self._last, self._broadcast = p.nodes.sparkSession, None, broadcast
        edges = cut(p.edges.select("src", "dst", "w"), batch=NARROW_ROWS)
        parts = max(int(self._spark.conf.get("spark.sql.shuffle.partitions")), -(-edges.count() // BUCKET))
        self._edges = bucketed(edges, parts)
        salts = self._edges.where("salt > 0").groupBy(F.col("src").alias("id")).agg((F.max("salt") + 1).alias("salts"))
        state = p.nodes.select("id").join(salts, "id", "left").select("id", F.coalesce("salts", F.lit(1)).alias("salts"))
        self._personal = v is not None
        if v is not None:
            state = state.join(v.select("id", F.col("v").alias("v")), "id", "left").select("id", "salts", F.coalesce("v", F.lit(0.0)).alias("v"))
        self._state, self._count, self.matvecs, self._known = cut(state), 0, 0, {}
        self.n = self._state.count()

    def _add(self, column) -> str:
        name = f"x{self._count}"
        self._count += 1
        self._state = self._state.withColumn(name, column)
        return name

    def teleport(self):
        return self._add(F.col("v") if self._personal else F.lit(1.0 / max(self.n, 1)))

    def load(self, x):
        name = f"x{self._count}"
        self._count += 1
        self._state = self._state.join(x.select("id", F.col(x.columns[1]).cast("double").alias(name)), "id", "left").fillna(0.0, [name])
        return name

    def step(self, x: str, name: str) -> DataFrame:
        """The state with the product of x as column ``name``."""
        side = self._state.select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col(x).alias("__x"))
        side = F.broadcast(side) if self._broadcast and self.n <= BROADCAST_ROWS else side.hint("merge")
        y = self._edges.join(side, ["src", "salt"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("w") * F.col("__x")).alias(name))
        return self._state.join(y, "id", "left").withColumn(name, F.coalesce(name, F.lit(0.0)))

    def mult(self, x):
        self.matvecs += 1
        name = f"x{self._count}"
        self._count += 1
        seen, path = Observation(), new_dir(self._spark, "state")
        sums = [F.coalesce(F.sum(f(c)), F.lit(0.0)).alias(f"{k}_{c}") for c in dict.fromkeys((x, name)) for k, f in (("sum", F.col), ("l1", F.abs))]
        self._state = store(self.step(x, name).observe(seen, *sums), path)
        if self.n:
            self._known = {tuple(k.split("_", 1)): v for k, v in seen.get.items()}
        if self._last:  # nothing reads the table before this one any more
            drop_dir(self._spark, self._last)
        self._last = path
        return name

    def lin(self, *terms):
        out = F.lit(0.0)
        for a, x in terms:
            out = out + F.lit(float(a)) * F.col(x)
        return self._add(out)

    def reduce(self, *wanted):
        if all(w in self._known for w in wanted):
            return [self._known[w] for w in wanted]
        ops = {"sum": F.col, "l1": F.abs, "dot": lambda x, y: F.col(x) * F.col(y)}
        row = self._state.agg(*[F.coalesce(F.sum(ops[k](*v)), F.lit(0.0)).alias(f"r{i}") for i, (k, *v) in enumerate(wanted)]).first()
        return list(row)

    def keep(self, *vectors):
        self._state = self._state.select("id", "salts", *(["v"] if self._personal else []), *dict.fromkeys(vectors))

    def table(self, x):
        self._last = None  # the result reads it
        return self._state.select("id", F.col(x).alias("x"))


def strategy_of(g: Graph) -> str:
    """By the counted size: ``array`` if one process holds the graph, ``block`` if it holds vectors, else ``table``."""
    if g.nodes.count() > ARRAY_NODES:
        return "table"
    return "array" if g.edges.count() <= ARRAY_EDGES else "block"


def space_of(g: Graph, v: DataFrame | None = None, strategy: str = "auto", dangling: str = "teleport") -> Space:
    """The space of g's transition matrix.  strategy: ``array``, ``block``, ``table``, or ``auto``, see strategy_of."""
    if strategy == "auto":
        strategy = strategy_of(g)
    if strategy not in ("array", "block", "table"):
        raise ValueError(f"unknown strategy: {strategy}")
    if strategy == "block":
        return BlockSpace(g, v, dangling)
    return (ArraySpace if strategy == "array" else TableSpace)(normalise(g, dangling=dangling), v)


def trace_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "iter int, delta double, inner_active boolean, inner_iters int, matvecs long")
