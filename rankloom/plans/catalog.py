"""The queries over the driver's tables and their equivalents in DuckDB SQL.

Doubles are rounded alike on both sides; ranks are multiplied by the number of nodes before that.
"""

from __future__ import annotations

import gzip
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scalars
from ..operators import graph as gr, placement, vectors as vec
from ..operators.graph import Graph
from ..sources.bsmat import read_bsmat, write_bsmat
from ..sources.bvgraph import graph_properties, read_bvgraph, write_bvgraph
from ..sources.dispatch import pick_format, read_graph
from ..sources.vector import read_vector, write_vector
from ..storage import filesystem, new_dir
from . import graphs, solvers, space
from .config import PageRankConfig
from .pagerank import PageRankSolver, Result, pagerank, pagerank_derivative, sweep

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

TRADE = """SELECT c_nationkey::BIGINT AS src, s_nationkey::BIGINT AS dst, sum(l_quantity) AS w FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2"""
NATIONS = "SELECT n_nationkey::BIGINT AS id FROM nation UNION ALL SELECT 25 + r_regionkey FROM region"
SUPPLY = """SELECT o_custkey AS src, l_suppkey + 1000000 AS dst, count(*)::DOUBLE AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2"""
PARTIES = "SELECT c_custkey AS id FROM customer UNION ALL SELECT s_suppkey + 1000000 FROM supplier"
EVENTS = """SELECT a.id AS src, b.id AS dst, count(*)::DOUBLE AS w FROM (
    SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events) s
  JOIN (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS id FROM (SELECT DISTINCT event_type FROM events)) a ON a.event_type = s.event_type
  JOIN (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS id FROM (SELECT DISTINCT event_type FROM events)) b ON b.event_type = s.next
  GROUP BY 1, 2"""

#: Graphs of the queries: how they are made, and the SQL of their edges and nodes.
_GRAPHS = {"trade": (graphs.trade, TRADE, NATIONS), "supply": (graphs.supply, SUPPLY, PARTIES)}
#: The same matrices for ranking, with repeated edges.
_LINES = {"supply": partial(graphs.supply, merged=False)}


def query(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return put


def _with(graph: str, rest: str, extra: str = "") -> str:
    """SQL with e(src, dst, w), n(id), p (rows normalised) and the personalisation vv (uniform)."""
    _, edges, nodes = _GRAPHS[graph]
    return f"""WITH RECURSIVE e AS MATERIALIZED ({edges}), n AS MATERIALIZED ({nodes}), c AS MATERIALIZED (SELECT count(*)::DOUBLE AS n FROM n),
p AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS pw FROM e),
vv AS MATERIALIZED (SELECT id, 1.0 / (SELECT n FROM c) AS v FROM n){extra}
{rest}"""


def _edges(g: Graph, digits: int = 10) -> DataFrame:
    return g.edges.select("src", "dst", F.round("w", digits).alias("w"))


def _x(df: DataFrame, digits: int = 10) -> DataFrame:
    return df.select("id", (F.round("x", digits) + 0.0).alias("x"))


# ------------------------------------------------------------------ graphs


@query("edges_trade", TRADE)
def _(spark, sf):
    return graphs.trade(spark, sf).edges


@query("edges_supply", SUPPLY)
def _(spark, sf):
    return graphs.supply(spark, sf).edges


@query("edges_copurchase", "SELECT a.l_partkey AS src, b.l_partkey AS dst, count(*)::DOUBLE AS w FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey != b.l_partkey GROUP BY 1, 2")
def _(spark, sf):
    return graphs.copurchase(spark, sf).edges


@query("edges_event_transition", EVENTS)
def _(spark, sf):
    return graphs.event_transitions(spark, sf)[0].edges


@query("edges_page_links", """WITH l AS (SELECT page_id AS src, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS path FROM pages),
d AS (SELECT path, 1000000 + row_number() OVER (ORDER BY path) - 1 AS dst FROM (SELECT DISTINCT path FROM l))
SELECT src, dst, count(*)::DOUBLE AS w FROM l JOIN d USING (path) GROUP BY 1, 2""")
def _(spark, sf):
    return graphs.page_links(spark, sf)[0].edges


# ------------------------------------------------------------------ statistics, predicates and sums

for _name in _GRAPHS:
    query(f"graph_stats_{_name}", _with(_name, """SELECT (SELECT count(*) FROM n) AS rows, (SELECT count(*) FROM n) AS cols, (SELECT count(*) FROM e) AS nnz,
  (SELECT max(s) FROM (SELECT sum(abs(w)) AS s FROM e GROUP BY dst)) AS norm1, (SELECT max(s) FROM (SELECT sum(abs(w)) AS s FROM e GROUP BY src)) AS norminf"""))(
        lambda spark, sf, make=_GRAPHS[_name][0]: gr.graph_stats(make(spark, sf))
    )


def _per_node(name: str, sql: str, f: Callable[[Graph], DataFrame], graph: str = "trade") -> None:
    query(name, _with(graph, sql))(lambda spark, sf: f(_GRAPHS[graph][0](spark, sf)))


_per_node("out_strength", "SELECT id, coalesce(sum(w), 0)::DOUBLE AS x FROM n LEFT JOIN e ON src = id GROUP BY id", gr.row_sums)
_per_node("in_strength", "SELECT id, coalesce(sum(w), 0)::DOUBLE AS x FROM n LEFT JOIN e ON dst = id GROUP BY id", gr.column_sums)
_per_node("row_indicator", "SELECT id, CASE WHEN count(w) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS x FROM n LEFT JOIN e ON src = id AND abs(w) > 1e-16 GROUP BY id", gr.row_indicator)
_per_node("col_indicator", "SELECT id, CASE WHEN count(w) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS x FROM n LEFT JOIN e ON dst = id AND abs(w) > 1e-16 GROUP BY id", gr.column_indicator)
_per_node("dangling_nodes", "SELECT id FROM n WHERE id NOT IN (SELECT src FROM e WHERE abs(w) > 1e-16)", gr.dangling_nodes, "supply")
_per_node("normalize_row", "SELECT src, dst, round(pw, 10) AS w FROM p", lambda g: _edges(gr.normalise(g)))
_per_node("normalize_col", "SELECT src, dst, round(w / sum(w) OVER (PARTITION BY dst), 10) AS w FROM e", lambda g: _edges(gr.normalise(g, by="column")))
_per_node("normalize_loop", "SELECT src, dst, round(pw, 10) AS w FROM p UNION ALL SELECT id, id, 1.0 FROM n WHERE id NOT IN (SELECT src FROM e)", lambda g: _edges(gr.normalise(g, dangling="loop")))
_per_node("out_of_range", "SELECT src, dst, w FROM e WHERE src NOT BETWEEN 0 AND 9 OR dst NOT BETWEEN 0 AND 19", lambda g: gr.out_of_range(g.edges, 10, 20))
_per_node("csr_offsets", """SELECT id, degree, coalesce(sum(degree) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
FROM (SELECT id, count(src) AS degree FROM n LEFT JOIN e ON src = id GROUP BY id)""", placement.csr_offsets, "supply")
_per_node("csr_rows", "SELECT src, array_to_string(list(dst ORDER BY dst), ',') AS dsts, array_to_string(list(w::BIGINT ORDER BY dst), ',') AS ws FROM e GROUP BY src",
          lambda g: placement.csr(g).select("src", F.concat_ws(",", F.col("dst").cast("array<string>")).alias("dsts"), F.concat_ws(",", F.col("w").cast("array<bigint>").cast("array<string>")).alias("ws")), "supply")
_BALANCE = """, d AS MATERIALIZED (SELECT id, 1.0 + count(src) AS weight FROM n LEFT JOIN e ON src = id GROUP BY id),
s AS MATERIALIZED (SELECT id, sum(weight) OVER (ORDER BY id) AS after FROM d), a AS MATERIALIZED (SELECT ceil(sum(weight) / 4) AS avg FROM d),
b(part, last, reached) AS (SELECT 0, -1::BIGINT, 0.0::DOUBLE UNION ALL
  SELECT * FROM (SELECT part + 1, min(s.id), min(s.after)::DOUBLE FROM b JOIN s ON s.after >= b.reached + (SELECT avg FROM a) WHERE part < 3 GROUP BY part) z)"""
query("balance_rows", _with("supply", "SELECT id, (SELECT count(*) FROM b WHERE part > 0 AND last < id)::INTEGER AS part FROM n", _BALANCE))(
    lambda spark, sf: placement.assign_partitions(graphs.supply(spark, sf), 4)
)


@query("balance_report", _with("supply", """SELECT count(*) AS parts, min(rows) AS min_rows, max(rows) AS max_rows, min(nnz)::BIGINT AS min_nnz, max(nnz)::BIGINT AS max_nnz FROM (
  SELECT part, count(*) AS rows, sum(degree) AS nnz FROM (SELECT id, (SELECT count(*) FROM b WHERE part > 0 AND last < id) AS part FROM n)
  JOIN (SELECT id, weight - 1 AS degree FROM d) USING (id) GROUP BY part)""", _BALANCE))
def _(spark, sf):
    g = graphs.supply(spark, sf)
    return placement.balance_report(g.edges, placement.assign_partitions(g, 4))


@query("row_owners", _with("supply", "SELECT part, min(id) AS first, max(id) AS last, count(*) AS rows FROM (SELECT id, (SELECT count(*) FROM b WHERE part > 0 AND last < id)::INTEGER AS part FROM n) GROUP BY part", _BALANCE))
def _(spark, sf):
    return placement.owners(placement.assign_partitions(graphs.supply(spark, sf), 4))


# ------------------------------------------------------------------ products and vectors

_START = "q AS MATERIALIZED (SELECT id, (1 + id % 7) / 8.0 AS x FROM n)"
_PT = "y AS MATERIALIZED (SELECT id, coalesce(s, 0) AS y FROM n LEFT JOIN (SELECT dst, sum(pw * x) AS s FROM p JOIN q ON q.id = p.src GROUP BY dst) ON dst = id)"


def _start(g: Graph) -> DataFrame:
    return g.nodes.select("id", ((1 + F.col("id") % 7) / 8.0).alias("x"))


for _name in _GRAPHS:
    _make = _GRAPHS[_name][0]
    query(f"matvec_t_{_name}", _with(_name, "SELECT id, round(y, 8) AS x FROM y", f", {_START}, {_PT}"))(lambda spark, sf, make=_make: (lambda g: _x(gr.matvec_transposed(gr.normalise(g), _start(g)), 8))(make(spark, sf)))
    query(f"matvec_{_name}", _with(_name, "SELECT id, round(coalesce(s, 0), 8) AS x FROM n LEFT JOIN (SELECT src, sum(pw * x) AS s FROM p JOIN q ON q.id = p.dst GROUP BY src) ON src = id", f", {_START}"))(
        lambda spark, sf, make=_make: (lambda g: _x(gr.matvec(gr.normalise(g), _start(g)), 8))(make(spark, sf))
    )
    query(f"matvec_shuffled_{_name}", _with(_name, "SELECT id, round(y, 8) AS x FROM y", f", {_START}, {_PT}"))(
        lambda spark, sf, make=_make: (lambda g: _x(gr.matvec_transposed(gr.normalise(g), _start(g), broadcast=False), 8))(make(spark, sf))
    )
    query(f"dangling_mult_{_name}", _with(_name, "SELECT y.id, round(y + ((SELECT sum(x) FROM q) - (SELECT sum(y) FROM y)) * v, 9) AS x FROM y JOIN vv USING (id)", f", {_START}, {_PT}"))(
        lambda spark, sf, make=_make: (lambda g: _x(gr.dangling_mult(gr.normalise(g), _start(g)), 9))(make(spark, sf))
    )
    query(f"pagerank_mult_{_name}", _with(_name, "SELECT y.id, round(0.85 * y + (0.85 * ((SELECT sum(x) FROM q) - (SELECT sum(y) FROM y)) + 0.15 * (SELECT sum(x) FROM q)) * v, 8) AS x FROM y JOIN vv USING (id)", f", {_START}, {_PT}"))(
        lambda spark, sf, make=_make: (lambda g: _x(gr.pagerank_mult(gr.normalise(g), _start(g), 0.85), 8))(make(spark, sf))
    )

_Q2 = f", {_START}, q2 AS MATERIALIZED (SELECT id, (id % 5 - 2) / 4.0 AS z FROM n)"


def _second(g: Graph) -> DataFrame:
    return g.nodes.select("id", ((F.col("id") % 5 - 2) / 4.0).alias("x"))


_per_vec = lambda name, sql, f: query(name, _with("supply", sql, _Q2))(lambda spark, sf: f(graphs.supply(spark, sf)))
_per_vec("vec_axpy", "SELECT id, round(0.3 * x + z, 10) AS x FROM q JOIN q2 USING (id)", lambda g: _x(vec.axpy(0.3, _start(g), _second(g))))
_per_vec("vec_aypx", "SELECT id, round(x + 0.3 * z, 10) AS x FROM q JOIN q2 USING (id)", lambda g: _x(vec.aypx(0.3, _start(g), _second(g))))
_per_vec("vec_axpby", "SELECT id, round(0.3 * x + 0.6 * z, 10) AS x FROM q JOIN q2 USING (id)", lambda g: _x(vec.axpby(0.3, _start(g), 0.6, _second(g))))
_per_vec("vec_maxpy", "SELECT id, round(2 * x - 3 * z + 0.5, 10) AS x FROM q JOIN q2 USING (id)", lambda g: _x(vec.together(a=_start(g), b=_second(g)).select("id", vec.combination({"a": 2, "b": -3}, 0.5).alias("x"))))
_per_vec("vec_scale_shift", "SELECT id, round(x * 3 + 0.25, 10) AS x FROM q", lambda g: _x(vec.shift(vec.scale(_start(g), 3), 0.25)))
_per_vec("vec_fill", "SELECT id, 0.5::DOUBLE AS x FROM n", lambda g: vec.filled(g.nodes, 0.5))
_per_vec("vec_norms", "SELECT sum(abs(z)) AS norm1, round(sqrt(sum(z * z)), 8) AS norm2, max(abs(z)) AS norminf FROM q2", lambda g: vec.norms(_second(g)).select("norm1", F.round("norm2", 8).alias("norm2"), "norminf"))
_per_vec("vec_sum", "SELECT sum(z)::DOUBLE AS total FROM q2", lambda g: vec.total(_second(g)))
_per_vec("vec_dots", "SELECT sum(x * z) AS xz, sum(x * x) AS xx, sum(z * z) AS zz FROM q JOIN q2 USING (id)", lambda g: vec.dots(vec.together(x=_start(g), z=_second(g)), {"xz": ("x", "z"), "xx": ("x", "x"), "zz": ("z", "z")}))
_per_vec("vec_normalized", "SELECT id, round(z / sqrt(sum(z * z) OVER ()), 10) + 0.0 AS x FROM q2", lambda g: _x(vec.normalised(_second(g))))
_per_vec("vec_nonzero_inv", "SELECT id, CASE WHEN abs(z) > 1e-16 THEN 1 / z ELSE z END AS x FROM q2", lambda g: vec.nonzero_inverse(_second(g)))
_per_vec("vec_nonzero_indicator", "SELECT id, CASE WHEN abs(z) > 1e-16 THEN 1.0 ELSE 0.0 END::DOUBLE AS x FROM q2", lambda g: vec.nonzero_indicator(_second(g)))


# ------------------------------------------------------------------ solvers


def _states(alpha: float, steps: int, v: str = "vv", start: str = "vv") -> str:
    """SQL table r(it, id, x) of a power iteration over p, n."""
    return f"""r(it, id, x) AS (SELECT 0, id, v::DOUBLE FROM {start} UNION ALL
  SELECT it + 1, id, ay + (1 - sum(ay) OVER ()) * v FROM (
    SELECT r.it, r.id, {alpha} * coalesce(s, 0) AS ay, v FROM r JOIN {v} ON {v}.id = r.id
    LEFT JOIN (SELECT p.dst, sum(p.pw * r.x) AS s FROM p JOIN r ON r.id = p.src GROUP BY p.dst) ON dst = r.id) WHERE it < {steps})"""


def _ranked(steps: int) -> str:
    return f"SELECT id, round(x * (SELECT n FROM c), 8) AS x FROM r WHERE it = {steps}"


def _power_sql(graph: str, alpha: float, steps: int) -> str:
    return _with(graph, _ranked(steps), f", {_states(alpha, steps)}")


_PERSONAL = "pv AS MATERIALIZED (SELECT id, (1 + id % 3) / sum(1 + id % 3) OVER () AS v FROM n)"


def _personal(g: Graph) -> DataFrame:
    raw = g.nodes.select("id", (1 + F.col("id") % 3).cast("double").alias("v"))
    return raw.crossJoin(raw.agg(F.sum("v").alias("t"))).select("id", (F.col("v") / F.col("t")).alias("v"))  # one row


def _ranks(g: Graph, result: Result) -> DataFrame:
    n = g.nodes.count()
    return result.ranks.select("id", F.round(F.col("x") * n, 8).alias("x"))


#: Steps alone decide: no change is below this.
_FIXED = dict(tol=1e-300)
_TIGHT = dict(tol=1e-13)


@query("power_k15", _power_sql("trade", 0.85, 15))
def _(spark, sf):
    g = graphs.trade(spark, sf)
    return _ranks(g, pagerank(g, PageRankConfig(maxiter=15, **_FIXED)))


@query("power_supply_k15", _power_sql("supply", 0.85, 15))
def _(spark, sf):
    g = graphs.supply(spark, sf)
    return _ranks(g, pagerank(g, PageRankConfig(maxiter=15, **_FIXED)))


@query("power_table_k4", _power_sql("supply", 0.85, 4))
def _(spark, sf):
    g = graphs.supply(spark, sf)
    return _ranks(g, pagerank(g, PageRankConfig(maxiter=4, **_FIXED), strategy="table"))


@query("power_personalised_k15", _with("trade", _ranked(15), f", {_PERSONAL}, {_states(0.85, 15, 'pv', 'pv')}"))
def _(spark, sf):
    g = graphs.trade(spark, sf)
    return _ranks(g, pagerank(g, PageRankConfig(maxiter=15, **_FIXED), v=_personal(g)))


@query("power_loop_dangling_k15", _with("trade", _ranked(15), f", {_states(0.85, 15)}").replace("p AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS pw FROM e)", "p AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS pw FROM e UNION ALL SELECT id, id, 1.0 FROM n WHERE id NOT IN (SELECT src FROM e))"))
def _(spark, sf):
    g = graphs.trade(spark, sf)
    return _ranks(g, pagerank(g, PageRankConfig(maxiter=15, dangling="loop", **_FIXED)))


@query("power_transposed_k15", _power_sql("trade", 0.85, 15).replace("SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS pw FROM e", "SELECT dst AS src, src AS dst, w / sum(w) OVER (PARTITION BY dst) AS pw FROM e"))
def _(spark, sf):
    g = graphs.trade(spark, sf)
    return _ranks(g, pagerank(g, PageRankConfig(maxiter=15, transposed=True, **_FIXED)))


@query("power_warm_start", _with("trade", _ranked(20), f", {_states(0.85, 20)}"))
def _(spark, sf):
    g = graphs.trade(spark, sf)
    first = pagerank(g, PageRankConfig(maxiter=10, **_FIXED))
    return _ranks(g, pagerank(g, PageRankConfig(maxiter=10, **_FIXED), start=first.ranks))


@query("power_trace_k15", _with("trade", "SELECT b.it AS iter, round(sum(abs(b.x - a.x)), 10) AS delta FROM r a JOIN r b ON b.id = a.id AND b.it = a.it + 1 GROUP BY b.it", f", {_states(0.85, 15)}"))
def _(spark, sf):
    result = pagerank(graphs.trade(spark, sf), PageRankConfig(maxiter=15, **_FIXED))
    return result.trace.select("iter", F.round("delta", 10).alias("delta"))


for _alg in ("power", "inout", "arnoldi", "linsys"):
    for _name, _alpha, _steps in (("trade", 0.85, 220), ("supply", 0.85, 200)):
        query(f"{_alg}_converged" + "_supply" * (_name == "supply"), _power_sql(_name, _alpha, _steps))(
            lambda spark, sf, make=_LINES.get(_name, _GRAPHS[_name][0]), c=PageRankConfig(algorithm=_alg, alpha=_alpha, **_TIGHT): (lambda g: _ranks(g, pagerank(g, c)))(make(spark, sf))
        )


@query("events_arnoldi", None)
def _(spark, sf):
    g, names = graphs.event_transitions(spark, sf)
    return _ranks(g, pagerank(g, PageRankConfig(algorithm="arnoldi", **_TIGHT))).join(names, "id")


_SQL["events_arnoldi"] = f"""WITH RECURSIVE e AS MATERIALIZED ({EVENTS}),
m AS MATERIALIZED (SELECT event_type AS name, row_number() OVER (ORDER BY event_type) - 1 AS id FROM (SELECT DISTINCT event_type FROM events)),
n AS MATERIALIZED (SELECT id FROM m), c AS MATERIALIZED (SELECT count(*)::DOUBLE AS n FROM n),
p AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS pw FROM e), vv AS MATERIALIZED (SELECT id, 1.0 / (SELECT n FROM c) AS v FROM n),
{_states(0.85, 200)}
SELECT r.id, round(x * (SELECT n FROM c), 8) AS x, name FROM r JOIN m ON m.id = r.id WHERE it = 200"""


@query("richardson_k30", _with("trade", "SELECT id, round(x / (SELECT sum(x) FROM r WHERE it = 30) * (SELECT n FROM c), 8) AS x FROM r WHERE it = 30", """, r(it, id, x) AS (SELECT 0, id, v::DOUBLE FROM vv UNION ALL
  SELECT r.it + 1, r.id, 0.85 * coalesce(s, 0) + v FROM r JOIN vv ON vv.id = r.id
  LEFT JOIN (SELECT p.dst, sum(p.pw * r.x) AS s FROM p JOIN r ON r.id = p.src GROUP BY p.dst) ON dst = r.id WHERE r.it < 30)"""))
def _(spark, sf):
    g = graphs.trade(spark, sf)
    return _ranks(g, pagerank(g, PageRankConfig(algorithm="linsys", maxiter=30, **_FIXED)))


@query("derivative", _with("trade", "SELECT a.id, round((a.x - b.x) / 2e-4 * (SELECT n FROM c), 3) AS x FROM r a JOIN r2 b ON a.id = b.id WHERE a.it = 250 AND b.it = 250", f", {_states(0.8501, 250)}, {_states(0.8499, 250).replace('r(it', 'r2(it', 1).replace('FROM r ', 'FROM r2 r ').replace('JOIN r ON', 'JOIN r2 r ON')}"))
def _(spark, sf):
    g = graphs.trade(spark, sf)
    n = g.nodes.count()
    return pagerank_derivative(g, PageRankConfig(**_TIGHT)).ranks.select("id", (F.round(F.col("x") * n, 3) + 0.0).alias("x"))


@query("topk_ranks", _with("trade", "SELECT id, round(x * (SELECT n FROM c), 8) AS x FROM r WHERE it = 220 ORDER BY r.x DESC, id LIMIT 5", f", {_states(0.85, 220)}"))
def _(spark, sf):
    g = graphs.trade(spark, sf)
    return _ranks(g, Result(vec.top_k(pagerank(g, PageRankConfig(**_TIGHT)).ranks, 5), None, 0, None, None))


_SWEEP = ("-alpha 0.5 -maxiter 15", "-alpha 0.85 -maxiter 15", '-alpha "0.95" -alg power -maxiter 15')


@query("sweep_alpha", " UNION ALL ".join(f"SELECT 'run{i}' AS run_id, id, x FROM ({_power_sql('trade', a, 15)})" for i, a in enumerate((0.5, 0.85, 0.95))))
def _(spark, sf):
    g = graphs.trade(spark, sf)
    ranks = sweep(g, _SWEEP, PageRankConfig(**_FIXED))[1]
    return ranks.select("run_id", "id", F.round(F.col("x") * g.nodes.count(), 8).alias("x"))


@query("sweep_runs", "SELECT * FROM (VALUES ('run0', 'power', 3, 'diverged_its', false), ('run1', 'nosuch', 0, 'failed', true), ('run2', 'power', 3, 'diverged_its', false)) t(run_id, alg, iters, reason, failed)")
def _(spark, sf):
    lines = ["-maxiter 3\r", "", "-alg nosuch", "-alpha 0.5 -maxiter 3"]
    runs = sweep(graphs.trade(spark, sf), lines, PageRankConfig(**_FIXED))[0]
    return runs.select("run_id", "alg", F.coalesce("iters", F.lit(0)).alias("iters"), F.coalesce("reason", F.lit("failed")).alias("reason"), F.col("error").isNotNull().alias("failed"))


# the same by tables, as for graphs of any size; little damping, so that few steps are enough
for _alg in ("power", "inout", "arnoldi", "linsys"):
    query(f"{_alg}_table", _power_sql("trade", 0.2, 40))(
        lambda spark, sf, c=PageRankConfig(algorithm=_alg, alpha=0.2, tol=1e-11): (lambda g: _ranks(g, pagerank(g, c, strategy="table")))(graphs.trade(spark, sf))
    )


@query("power_shuffled_table_k3", _power_sql("supply", 0.85, 3))
def _(spark, sf):
    """Beyond the bound of a broadcast: the vector moves to the edges' buckets."""
    g = graphs.supply(spark, sf)
    s = space.TableSpace(PageRankSolver(g).transition(PageRankConfig()), None, broadcast=False)
    return _ranks(g, Result(s.table(solvers.power(s, PageRankConfig(maxiter=3, **_FIXED), s.teleport()).x), None, 3, None, None))


@query("derivative_table", _with("trade", "SELECT a.id, round((a.x - b.x) / 2e-4 * (SELECT n FROM c), 3) + 0.0 AS x FROM r a JOIN r2 b ON a.id = b.id WHERE a.it = 40 AND b.it = 40", f", {_states(0.2001, 40)}, {_states(0.1999, 40).replace('r(it', 'r2(it', 1).replace('FROM r ', 'FROM r2 ').replace('JOIN r ', 'JOIN r2 ').replace('r.', 'r2.')}"))
def _(spark, sf):
    g = graphs.trade(spark, sf)
    n = g.nodes.count()
    return pagerank_derivative(g, PageRankConfig(alpha=0.2, tol=1e-11), strategy="table").ranks.select("id", (F.round(F.col("x") * n, 3) + 0.0).alias("x"))


@query("sweep_table", " UNION ALL ".join(f"SELECT 'run{i}' AS run_id, id, x FROM ({_power_sql('trade', a, 3)})" for i, a in enumerate((0.5, 0.85))))
def _(spark, sf):
    g = graphs.trade(spark, sf)
    ranks = sweep(g, ["-alpha 0.5 -maxiter 3", "-maxiter 3"], PageRankConfig(**_FIXED), strategy="table")[1]
    return ranks.select("run_id", "id", F.round(F.col("x") * g.nodes.count(), 8).alias("x"))


@query("run_header", _with("trade", "SELECT 'power' AS alg, 0.85::DOUBLE AS alpha, 10000 AS maxiter, 1e-7::DOUBLE AS tol, (SELECT round(max(s), 10) FROM (SELECT sum(pw) AS s FROM p GROUP BY dst)) AS norm1, (SELECT round(max(s), 10) FROM (SELECT sum(pw) AS s FROM p GROUP BY src)) AS norminf"))
def _(spark, sf):
    return PageRankSolver(graphs.trade(spark, sf)).run_info(PageRankConfig()).withColumn("norm1", F.round("norm1", 10)).withColumn("norminf", F.round("norminf", 10))


# ------------------------------------------------------------------ sources and sinks


@query("bsmat_gzip", TRADE)
def _(spark, sf):
    path = f"{new_dir(spark, 'files')}.bsmat"
    write_bsmat(graphs.trade(spark, sf), path)
    for name in (path, f"{path}.degs"):
        fs, at = filesystem(name)
        with fs.open_input_file(at) as f, fs.open_output_stream(f"{at.removesuffix('.degs')}{'.degs' * name.endswith('.degs')}.gz", compression=None) as out:
            out.write(gzip.compress(f.read()))
        fs.delete_file(at)
    return read_graph(spark, f"{path}.gz").edges


@query("smat_edges", TRADE)
def _(spark, sf):
    g, path = graphs.trade(spark, sf), f"{new_dir(spark, 'files')}.smat"
    n, lines = g.nodes.count(), [" ".join(map(repr, e)) for e in g.edges.collect()]  # 25 nodes
    fs, at = filesystem(path)
    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(at) as out:
        out.write("\n".join([f"{n} {n} {len(lines)}", *lines]).encode())
    return read_graph(spark, path).edges


@query("formats", "SELECT * FROM (VALUES ('a.bsmat', '', 'bsmat'), ('a.bsmat.gz', '', 'bsmat'), ('a.x', 'bvgraph', 'bvgraph'), ('a.bsmat', 'smat', 'smat'), ('a.smat', 'nosuch', 'smat'), ('a.parquet', '', 'parquet'), ('a.cluto', '', 'failed'), ('a', '', 'failed'), ('A.BSMAT', '', 'failed')) t(path, hint, format)")
def _(spark, sf):
    rows = []
    for path, hint in (("a.bsmat", ""), ("a.bsmat.gz", ""), ("a.x", "bvgraph"), ("a.bsmat", "smat"), ("a.smat", "nosuch"), ("a.parquet", ""), ("a.cluto", ""), ("a", ""), ("A.BSMAT", "")):
        try:
            rows.append((path, hint, pick_format(path, hint or None)))
        except ValueError:
            rows.append((path, hint, "failed"))
    return spark.createDataFrame(rows, "path string, hint string, format string")


@query("square_and_compatible", _with("trade", "SELECT NOT EXISTS (FROM n WHERE id NOT IN (SELECT src FROM e)) AND NOT EXISTS (FROM e WHERE src NOT IN (FROM n)) AS sources, NOT EXISTS (FROM n WHERE id NOT IN (FROM n)) AS square"))
def _(spark, sf):
    g = graphs.trade(spark, sf)
    return spark.createDataFrame([(gr.compatible(g.nodes, g.edges.select(F.col("src").alias("id"))), gr.is_square(g.nodes, g.nodes))], "sources boolean, square boolean")


@query("entries_sorted", _with("trade", "SELECT src, dst, w, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS place FROM e"))
def _(spark, sf):
    # the order within partitions, as it stands: a row's entries stand together, so places count from its first one
    ordered = gr.entries_sorted(graphs.trade(spark, sf)).withColumn("at", F.monotonically_increasing_id())
    ordered = ordered.groupBy("src").agg(F.min("at").alias("first"), F.collect_list(F.struct("dst", "w", "at")).alias("own"))
    return ordered.select("src", F.inline("own"), "first").select("src", "dst", "w", (F.col("at") - F.col("first")).alias("place"))


@query("bsmat_roundtrip", TRADE)
def _(spark, sf):
    path = f"{new_dir(spark, 'files')}.bsmat"
    write_bsmat(graphs.trade(spark, sf), path)
    return read_bsmat(spark, path, split=100).edges


@query("bvgraph_roundtrip", f"SELECT src, dst, 1.0::DOUBLE AS w FROM ({TRADE})")
def _(spark, sf):
    path = f"{new_dir(spark, 'files')}.graph"
    write_bvgraph(graphs.trade(spark, sf), path)
    return read_bvgraph(spark, path, split=7).edges


@query("bvgraph_properties", f"SELECT (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS nodes, (SELECT count(*) FROM ({TRADE})) AS arcs, 7 AS windowsize, 3 AS minintervallength, 3 AS maxrefcount, 3 AS zetak")
def _(spark, sf):
    path = f"{new_dir(spark, 'files')}.graph"
    write_bvgraph(graphs.trade(spark, sf), path)
    return graph_properties(spark, path).drop("path")


@query("vector_roundtrip", _with("trade", "SELECT id, round(v, 10) AS v FROM pv", f", {_PERSONAL}"))
def _(spark, sf):
    path = f"{new_dir(spark, 'files')}.vec"
    write_vector(_personal(graphs.trade(spark, sf)), path)
    return read_vector(spark, path).select("id", F.round("v", 10).alias("v"))


@query("command_lines", "SELECT * FROM (VALUES (0, '-alpha|0.95'), (1, '-pvec|a b.bin|x\"y'), (2, '')) t(line, args)")
def _(spark, sf):
    lines = [' -alpha\t0.95 ', '-pvec "a b.bin" "x\\"y"', ' "" ']
    return spark.createDataFrame([(i, "|".join(scalars.split_command_line(x))) for i, x in enumerate(lines)], "line int, args string")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
