"""The front end: validate, normalise, solve once or for many settings, and return tables."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.graph import Graph, graph_stats, matrix_norms, normalise
from ..storage import NARROW_ROWS, cut
from .config import PageRankConfig, Reason, parse_options
from .solvers import algorithm, derivative
from .space import Space, space_of, trace_table


@dataclass
class Result:
    ranks: DataFrame | None  # id, x
    trace: DataFrame | None  # iter, delta, inner_active, inner_iters, matvecs
    iterations: int
    delta: float | None
    reason: Reason


def personalisation(g: Graph, v: DataFrame, normalise_sum: bool = False) -> DataFrame:
    """(id, v) checked to be a distribution over the nodes: no negatives, nulls, unknown or repeated ids, sum 1.

    Nodes that it lacks have 0.  With normalise_sum it is divided by its sum instead of rejected.
    """
    v = v.select(F.col("id").cast("long").alias("id"), F.col("v").cast("double").alias("v"))
    bad = (F.isnull("id") | F.isnull("v") | F.isnan("v") | (F.col("v") < 0)).cast("int")
    row = v.agg(F.max(bad).alias("bad"), F.sum("v").alias("total"), F.count("*").alias("n"), F.count_distinct("id").alias("ids")).first()
    if row.bad or row.n != row.ids or not row.n:
        raise ValueError("the personalisation vector holds negatives, nulls or repeated ids, or nothing")
    if not v.join(g.nodes, "id", "left_anti").isEmpty():
        raise ValueError("the personalisation vector names unknown nodes")
    if normalise_sum and row.total > 0:
        return v.select("id", (F.col("v") / row.total).alias("v"))
    if abs(row.total - 1) > 1e-9:
        raise ValueError("the personalisation vector doesn't sum to 1")
    return v


def _solve(space: Space, config: PageRankConfig, start: DataFrame | None = None) -> Result:
    solution = algorithm(config.algorithm)(space, config, space.load(start) if start is not None else space.teleport())
    spark = SparkSession.getActiveSession()
    last = solution.trace[-1] if solution.trace else None
    return Result(space.table(solution.x), trace_table(spark, solution.trace), last[0] if last else 0, last[1] if last else None, solution.reason)


def pagerank(g: Graph, config: PageRankConfig = PageRankConfig(), v: DataFrame | None = None, start: DataFrame | None = None, strategy: str = "auto", check: bool = True) -> Result:
    """Ranks of a weighted graph.  An empty graph has none."""
    return PageRankSolver(g, strategy, check).set_v(v).set_initial(start).solve(config)


def pagerank_derivative(g: Graph, config: PageRankConfig = PageRankConfig(), v: DataFrame | None = None, strategy: str = "auto") -> Result:
    """The derivative of the ranks in alpha."""
    solver = PageRankSolver(g, strategy).set_v(v)
    ranks = solver.solve(config)
    space = solver.space(config)
    solution = derivative(space, config, space.load(ranks.ranks))
    return Result(space.table(solution.x), trace_table(g.nodes.sparkSession, solution.trace), len(solution.trace), solution.trace[-1][1], solution.reason)


class PageRankSolver:
    """A graph checked and normalised once, solved any number of times; set_* return the solver."""

    def __init__(self, g: Graph, strategy: str = "auto", check: bool = True):
        self._graph = Graph(cut(g.nodes, batch=NARROW_ROWS), cut(g.edges, batch=NARROW_ROWS))  # read several times from here on
        if check:
            self._graph.checked()
        self._strategy, self._v, self._start, self._spaces = strategy, None, None, {}

    def set_v(self, v: DataFrame | None, normalise_sum: bool = False) -> PageRankSolver:
        self._v = personalisation(self._graph, v, normalise_sum) if v is not None else None
        self._spaces = {}
        return self

    def set_initial(self, start: DataFrame | None) -> PageRankSolver:
        self._start = start
        return self

    def _directed(self, config: PageRankConfig) -> Graph:
        return self._graph.transposed if config.transposed else self._graph

    def transition(self, config: PageRankConfig) -> Graph:
        return normalise(self._directed(config), dangling=config.dangling)

    def space(self, config: PageRankConfig) -> Space:
        key = (config.transposed, config.dangling)
        if key not in self._spaces:
            self._spaces[key] = space_of(self._directed(config), self._v, self._strategy, config.dangling)
        return self._spaces[key]

    def solve(self, config: PageRankConfig = PageRankConfig()) -> Result:
        algorithm(config.algorithm)
        space = self.space(config)
        if not space.n:
            return Result(self._graph.nodes.select("id", F.lit(0.0).alias("x")), trace_table(self._graph.nodes.sparkSession, []), 0, None, Reason.TOLERANCE)
        space.matvecs = 0
        return _solve(space, config, self._start)

    def stats(self) -> DataFrame:
        return graph_stats(self._graph)

    def run_info(self, config: PageRankConfig) -> DataFrame:
        """One row: settings and the norms of the transition matrix."""
        return matrix_norms(self.transition(config)).select(F.lit(config.algorithm).alias("alg"), F.lit(config.alpha).alias("alpha"), F.lit(config.maxiter).alias("maxiter"), F.lit(config.tol).alias("tol"), "norm1", "norminf")


def sweep(g: Graph, lines: Iterable[str] | Iterable[PageRankConfig], base: PageRankConfig | None = None, v: DataFrame | None = None, strategy: str = "auto") -> tuple[DataFrame, DataFrame]:
    """(runs, ranks) of one graph for many settings: option strings (blank ones are skipped) or configurations.

    The matrix is checked and normalised once.  A run that fails has its error in runs and doesn't stop the others.
    """
    spark, solver, runs, ranks = g.nodes.sparkSession, PageRankSolver(g, strategy).set_v(v), [], None
    lines = [x for x in (line.strip("\t\r\n") if isinstance(line, str) else line for line in lines) if x]
    for i, line in enumerate(lines):
        run_id, config, result, error = f"run{i}", None, None, None
        try:
            config, unused = parse_options(line, base) if isinstance(line, str) else (line, [])
            result = solver.solve(config)
        except ValueError as e:
            error = str(e)
        c = config or PageRankConfig()
        runs.append((run_id, str(line), c.algorithm, c.alpha, c.tol, c.maxiter, result and result.iterations, result and result.delta, result and result.reason.value, error))
        if result:
            one = result.ranks.select(F.lit(run_id).alias("run_id"), "id", "x")
            ranks = one if ranks is None else ranks.unionByName(one)
    if ranks is None:
        ranks = spark.createDataFrame([], "run_id string, id long, x double")
    return spark.createDataFrame(runs, "run_id string, options string, alg string, alpha double, tol double, maxiter int, iters int, delta double, reason string, error string"), ranks


def write_ranks(ranks: DataFrame, path: str) -> None:
    ranks.select("id", "x").write.parquet(path)
