"""Graphs as relations, and the matrix operators over them.

A graph is nodes(id) and edges(src, dst, w): row src, column dst of a square sparse matrix.  Nodes are explicit, for
isolated ones count; repeated edges are separate stored entries that add up.  Everything here is a declarative plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import inverse_or_zero, nonzero

#: Vectors of at most so many rows (16 bytes each) are broadcast to the edges; larger ones are joined by shuffle.
BROADCAST_ROWS = 1 << 21


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame  # id long, distinct
    edges: DataFrame  # src long, dst long, w double

    @classmethod
    def of(cls, edges: DataFrame, nodes: DataFrame | None = None) -> Graph:
        """From any table with src, dst and perhaps w (1 without it); without nodes those that edges touch."""
        w = F.col("w").cast("double") if "w" in edges.columns else F.lit(1.0)
        edges = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), w.alias("w"))
        if nodes is None:
            nodes = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
        return cls(nodes.select(F.col("id").cast("long").alias("id")), edges)

    @property
    def transposed(self) -> Graph:
        return Graph(self.nodes, self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))

    def checked(self, allow_negative: bool = False) -> Graph:
        """The same graph if it is sound: no nulls, both ends of each edge among the nodes, no negative weights; else raises."""
        bad = F.isnull("src") | F.isnull("dst") | F.isnull("w") | F.isnan("w")
        worst = self.edges.agg(F.max(bad.cast("int")).alias("null"), F.min("w").alias("least")).first()
        if worst["null"]:
            raise ValueError("edges hold nulls")
        if not allow_negative and worst["least"] is not None and worst["least"] < 0:
            raise ValueError("edges hold negative weights")
        ends = self.edges.select(F.col("src").alias("id")).union(self.edges.select(F.col("dst").alias("id")))
        few = self.nodes.count() <= BROADCAST_ROWS  # the edges stay where they are
        lost = ends.join(F.broadcast(self.nodes), "id", "left_anti") if few else ends.distinct().join(self.nodes, "id", "left_anti")
        if not lost.isEmpty():
            raise ValueError("an edge's end is not a node")
        return self


def is_square(rows: DataFrame, columns: DataFrame) -> bool:
    """Whether row and column ids are the same set, so that the matrix can be ranked."""
    return compatible(rows, columns)


def compatible(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same ids, so that vectors over them can be combined."""
    return a.select("id").join(b.select("id"), "id", "left_anti").isEmpty() and b.select("id").join(a.select("id"), "id", "left_anti").isEmpty()


def out_of_range(edges: DataFrame, rows: int, columns: int) -> DataFrame:
    """The entries outside of a rows x columns matrix."""
    return edges.where((F.col("src") < 0) | (F.col("src") >= rows) | (F.col("dst") < 0) | (F.col("dst") >= columns))


def _over_nodes(g: Graph, values: DataFrame, name: str) -> DataFrame:
    """values(id, name) with 0 for every node that has none."""
    return g.nodes.join(values, "id", "left").select("id", F.coalesce(name, F.lit(0.0)).alias(name))


def row_sums(g: Graph) -> DataFrame:
    return _over_nodes(g, g.edges.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("x")), "x")


def column_sums(g: Graph) -> DataFrame:
    return _over_nodes(g, g.edges.groupBy(F.col("dst").alias("id")).agg(F.sum("w").alias("x")), "x")


def row_indicator(g: Graph) -> DataFrame:
    """(id, x): 1 for nodes whose row holds a value that isn't zero."""
    return _over_nodes(g, g.edges.where(nonzero(F.col("w"))).select(F.col("src").alias("id")).distinct().withColumn("x", F.lit(1.0)), "x")


def column_indicator(g: Graph) -> DataFrame:
    """(id, x): 1 for nodes whose column holds a value that isn't zero."""
    return _over_nodes(g, g.edges.where(nonzero(F.col("w"))).select(F.col("dst").alias("id")).distinct().withColumn("x", F.lit(1.0)), "x")


def dangling_nodes(g: Graph) -> DataFrame:
    """(id): nodes without a value in their row."""
    return g.nodes.join(g.edges.where(nonzero(F.col("w"))).select(F.col("src").alias("id")), "id", "left_anti")


def normalise(g: Graph, by: str = "row", dangling: str = "teleport") -> Graph:
    """Each row (or column) divided by its sum, those with a sum of zero dropped: the transition matrix.

    dangling: ``teleport`` leaves nodes without a row to the solver, ``loop`` gives them an edge to themselves first.
    The sums are one aggregate joined back, not a window, so the rows of a hub needn't meet in one task.
    """
    if dangling not in ("teleport", "loop"):
        raise ValueError(f"unknown treatment of dangling nodes: {dangling}")
    if by not in ("row", "column"):
        raise ValueError(f"unknown direction: {by}")
    edges, end = g.edges, "src" if by == "row" else "dst"
    if dangling == "loop":
        edges = edges.unionByName(dangling_nodes(g).select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("w")))
    sums = edges.groupBy(end).agg(F.sum("w").alias("total")).where(nonzero(F.col("total")))
    scaled = edges.join(sums, end).select("src", "dst", (F.col("w") * inverse_or_zero(F.col("total"))).alias("w"))
    return Graph(g.nodes, scaled)


def with_self_loops(g: Graph) -> Graph:
    return Graph(g.nodes, g.edges.unionByName(dangling_nodes(g).select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("w"))))


def _product(g: Graph, x: DataFrame, through: str, to: str, broadcast: bool | None) -> DataFrame:
    x = x.select(F.col("id").alias(through), F.col("x"))
    if broadcast or (broadcast is None and x.count() <= BROADCAST_ROWS):
        x = F.broadcast(x)
    y = g.edges.join(x, through).groupBy(F.col(to).alias("id")).agg(F.sum(F.col("w") * F.col("x")).alias("x"))
    return _over_nodes(g, y, "x")


def matvec_transposed(p: Graph, x: DataFrame, broadcast: bool | None = None) -> DataFrame:
    """(id, x): the matrix's transpose times x; the transpose is never built.  x is broadcast only if its size allows."""
    return _product(p, x, "src", "dst", broadcast)


def matvec(p: Graph, x: DataFrame, broadcast: bool | None = None) -> DataFrame:
    """(id, x): the matrix times x."""
    return _product(p, x, "dst", "src", broadcast)


def dangling_mult(p: Graph, x: DataFrame, v: DataFrame | None = None) -> DataFrame:
    """Transposed product plus the mass that dangling nodes lose, spread by v (uniform without it).

    The mass is sum(x) - sum(y), exact when the rows of the others sum to 1; no list of dangling nodes is needed.
    """
    return _teleported(p, x, v, 1.0)


def pagerank_mult(p: Graph, x: DataFrame, alpha: float, v: DataFrame | None = None) -> DataFrame:
    """The whole ranking operator: alpha (P'x + lost v) + (1 - alpha) sum(x) v."""
    return _teleported(p, x, v, alpha)


def _teleported(p: Graph, x: DataFrame, v: DataFrame | None, alpha: float) -> DataFrame:
    y = matvec_transposed(p, x).join(x.select("id", F.col("x").alias("x0")), "id")
    y = y.join(v.select("id", "v"), "id", "left").withColumn("v", F.coalesce("v", F.lit(0.0))) if v is not None else y
    total = y.agg(F.sum("x0").alias("before"), F.sum("x").alias("after"), F.count("*").alias("n"))
    share = F.col("v") if v is not None else 1.0 / F.col("n")
    extra = alpha * (F.col("before") - F.col("after")) + (1.0 - alpha) * F.col("before")
    return y.crossJoin(F.broadcast(total)).select("id", (alpha * F.col("x") + extra * share).alias("x"))  # one row


def matrix_norms(g: Graph) -> DataFrame:
    """(norm1, norminf): the largest column and row sum of absolute values; 0 without entries."""
    column = g.edges.groupBy("dst").agg(F.sum(F.abs("w")).alias("s")).agg(F.coalesce(F.max("s"), F.lit(0.0)).alias("norm1"))
    row = g.edges.groupBy("src").agg(F.sum(F.abs("w")).alias("s")).agg(F.coalesce(F.max("s"), F.lit(0.0)).alias("norminf"))
    return column.crossJoin(row)  # one row each


def graph_stats(g: Graph) -> DataFrame:
    """One row: rows, cols, nnz (stored entries, zeros and repeated ones included), norm1, norminf."""
    size = g.nodes.agg(F.count("*").alias("rows"), F.count("*").alias("cols"))
    nnz = g.edges.agg(F.count("*").alias("nnz"))
    return size.crossJoin(nnz).crossJoin(matrix_norms(g))  # one row each


def entries_sorted(g: Graph) -> DataFrame:
    """Edges bucketed by row, columns ascending within each: the order in which compressed rows are written."""
    return g.edges.repartition("src").sortWithinPartitions("src", "dst", "w")
