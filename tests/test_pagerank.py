from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rankloom.operators import graph as gr, placement
from rankloom.operators.graph import Graph
from rankloom.plans import graphs, space
from rankloom.plans.config import PageRankConfig, Reason, UnknownAlgorithm, parse_options
from rankloom.plans.pagerank import PageRankSolver, pagerank, pagerank_derivative, personalisation, sweep
from rankloom.plans.solvers import ALGORITHMS

G4_EDGES = [(0, 1, 1.0), (0, 2, 3.0), (1, 2, 2.0), (2, 0, 1.0)]
G4 = {0.85: [0.40217503, 0.13308124, 0.41712468, 0.04761905], 0.95: [0.42987459, 0.11848866, 0.43524331, 0.01639344]}


def make(spark, edges, n):
    return Graph.of(spark.createDataFrame(edges, "src long, dst long, w double"), spark.range(n))


def ranks(result):
    return [r.x for r in result.ranks.orderBy("id").collect()]


def direct(edges, n, alpha, v=None):
    a = np.zeros((n, n))
    for s, d, w in edges:
        a[s, d] += w
    sums = a.sum(1)
    v = np.full(n, 1 / n) if v is None else np.asarray(v)
    p = np.array([a[i] / sums[i] if abs(sums[i]) > 1e-16 else v for i in range(n)])
    return np.linalg.solve(np.eye(n) - alpha * p.T, (1 - alpha) * v)


def random_graph(seed, n=40, m=160):
    rng = np.random.default_rng(seed)
    return [(int(s), int(d), float(w)) for s, d, w in zip(rng.integers(0, n - 5, m), rng.integers(0, n, m), rng.integers(1, 9, m))]


@pytest.mark.parametrize("algorithm", sorted(ALGORITHMS))
@pytest.mark.parametrize("strategy", ["array", "table"])
def test_golden(spark, algorithm, strategy):
    alpha = 0.85
    result = pagerank(make(spark, G4_EDGES, 4), PageRankConfig(algorithm=algorithm, alpha=alpha, tol=1e-9 if strategy == "array" else 1e-4), strategy=strategy)
    assert result.reason is Reason.TOLERANCE
    assert np.allclose(ranks(result), G4[alpha], atol=1e-7 if strategy == "array" else 1e-3)


@pytest.mark.parametrize("alpha,steps", [(0.85, 23), (0.95, 26)])
def test_golden_steps(spark, alpha, steps):
    result = pagerank(make(spark, G4_EDGES, 4), PageRankConfig(alpha=alpha))
    assert result.iterations == steps
    assert np.allclose(ranks(result), G4[alpha], atol=1e-6)


def test_golden_personalised_and_trace(spark):
    g = make(spark, G4_EDGES, 4)
    v = spark.createDataFrame([(0, 0.7), (1, 0.1), (2, 0.1), (3, 0.1)], "id long, v double")
    result = pagerank(g, PageRankConfig(), v=v)
    assert result.iterations == 24
    assert np.allclose(ranks(result), [0.46137778, 0.11443622, 0.40779256, 0.01639344], atol=1e-6)
    first = [r.delta for r in pagerank(g).trace.orderBy("iter").limit(3).collect()]
    assert np.allclose(first, [0.53125, 0.29351563, 0.18231836])


def test_golden_statistics(spark):
    g = make(spark, G4_EDGES, 4)
    assert tuple(gr.graph_stats(g).first()) == (4, 4, 4, 5.0, 4.0)
    assert tuple(gr.matrix_norms(gr.normalise(g)).first()) == (1.75, 1.0)


@pytest.mark.parametrize("algorithm", sorted(ALGORITHMS))
@pytest.mark.parametrize("seed", [1, 2])
def test_against_direct_solve(spark, algorithm, seed):
    edges = random_graph(seed)
    result = pagerank(make(spark, edges, 40), PageRankConfig(algorithm=algorithm, alpha=0.9, tol=1e-12))
    assert np.allclose(ranks(result), direct(edges, 40, 0.9), atol=1e-10)
    assert abs(sum(ranks(result)) - 1) < 1e-12


def test_strategies_agree(spark):
    g = make(spark, random_graph(3), 40)
    c = PageRankConfig(algorithm="arnoldi", krylov=3, maxiter=2, tol=1e-300)
    assert np.allclose(ranks(pagerank(g, c, strategy="array")), ranks(pagerank(g, c, strategy="table")), atol=1e-12)


def test_shuffled_product_equals_broadcast(spark):
    p = gr.normalise(make(spark, random_graph(4), 40))
    x = spark.range(40).select("id", ((F.col("id") + 1) / 40).alias("x"))
    a, b = (gr.matvec_transposed(p, x, broadcast=f).orderBy("id").collect() for f in (True, False))
    assert np.allclose([r.x for r in a], [r.x for r in b])


@pytest.mark.parametrize("edges,n", [([], 3), ([], 1), ([(0, 0, 1.0)], 1), ([(0, 1, 0.0), (1, 0, 1.0)], 2), ([(0, 1, 1.0), (0, 1, 2.0), (1, 1, 1.0)], 3)])
@pytest.mark.parametrize("algorithm", sorted(ALGORITHMS))
def test_small_and_odd_graphs(spark, edges, n, algorithm):
    result = pagerank(make(spark, edges, n), PageRankConfig(algorithm=algorithm, tol=1e-12))
    assert np.allclose(ranks(result), direct(edges, n, 0.85), atol=1e-9)


def test_empty_graph(spark):
    assert pagerank(make(spark, [], 0)).ranks.count() == 0


def test_properties(spark):
    edges = random_graph(5)
    base = ranks(pagerank(make(spark, edges, 40), PageRankConfig(tol=1e-12)))
    scaled = ranks(pagerank(make(spark, [(s, d, 7 * w) for s, d, w in edges], 40), PageRankConfig(tol=1e-12)))
    moved = ranks(pagerank(make(spark, [(39 - s, 39 - d, w) for s, d, w in edges], 40), PageRankConfig(tol=1e-12)))
    assert np.allclose(base, scaled) and np.allclose(base, moved[::-1])
    assert min(base) >= 0.15 / 40 - 1e-15
    deltas = [r.delta for r in pagerank(make(spark, edges, 40)).trace.orderBy("iter").collect()]
    assert all(b <= 0.85 * a + 1e-15 for a, b in zip(deltas, deltas[1:]))


def test_zero_sum_row_dangles(spark):
    g = make(spark, [(0, 1, 1.0), (0, 2, -1.0), (1, 0, 1.0)], 3)
    assert gr.normalise(g).edges.collect() == gr.normalise(make(spark, [(1, 0, 1.0)], 3)).edges.collect()


def test_derivative(spark):
    edges, h = random_graph(6), 1e-5
    d = ranks(pagerank_derivative(make(spark, edges, 40), PageRankConfig(tol=1e-13)))
    assert np.allclose(d, (direct(edges, 40, 0.85 + h) - direct(edges, 40, 0.85 - h)) / (2 * h), atol=1e-6)
    assert abs(sum(d)) < 1e-10


@pytest.mark.parametrize("rows", [[(0, -0.5), (1, 1.5)], [(0, 0.5)], [(9, 1.0)], [(0, 0.5), (0, 0.5)], [(0, None)], []])
def test_bad_personalisation(spark, rows):
    with pytest.raises(ValueError):
        personalisation(make(spark, G4_EDGES, 4), spark.createDataFrame(rows, "id long, v double"))


@pytest.mark.parametrize("edges", [[(0, 1, -1.0)], [(0, 9, 1.0)], [(None, 1, 1.0)], [(0, 1, None)]])
def test_unsound_graphs_are_rejected(spark, edges):
    with pytest.raises(ValueError):
        pagerank(make(spark, edges, 4))


@pytest.mark.parametrize("options", ["-alpha 1", "-alpha -0.1", "-tol x", "-alpha"])
def test_bad_options(options):
    with pytest.raises(ValueError):
        parse_options(options)


def test_options():
    c, unused = parse_options('-alpha 0.9 -alg inout -inout_beta "0.3" -trans -noout -m a.bsmat -what 3')
    assert (c.alpha, c.algorithm, c.beta, c.transposed, unused) == (0.9, "inout", 0.3, True, ["-what", "3"])


def test_sweep_goes_on_after_errors(spark):
    runs, ranks_ = sweep(make(spark, G4_EDGES, 4), ["-alpha 0.95 ", "\r", "-alpha 2", "-alg none", "-alpha 0.95 -alg arnoldi"])
    rows = {r.run_id: r for r in runs.collect()}
    assert [rows[f"run{i}"].error is None for i in range(4)] == [True, False, False, True]
    assert rows["run0"].reason == "converged_tol" and rows["run0"].iters == 26
    found = [r.x for r in ranks_.where("run_id = 'run3'").orderBy("id").collect()]
    assert np.allclose(found, G4[0.95], atol=1e-6)


def test_unknown_algorithm(spark):
    with pytest.raises(UnknownAlgorithm):
        PageRankSolver(make(spark, G4_EDGES, 4)).solve(PageRankConfig(algorithm="none"))


def test_assign_partitions(spark):
    edges = random_graph(7)
    g, parts = make(spark, edges, 40), 5
    found = {r.id: r.part for r in placement.assign_partitions(g, parts).collect()}
    weight = [1 + sum(s == i for s, *_ in edges) for i in range(40)]
    average, part, total, expected = -(-sum(weight) // parts), 0, 0, {}
    for i, w in enumerate(weight):
        expected[i] = part
        total += w
        if total >= average and part < parts - 1:
            part, total = part + 1, 0
    assert found == expected
    assert placement.even_split(7, 3) == [3, 2, 2]


def test_hub_and_clashing_columns(spark):
    rows = [(0, i % 50 + 1, 1.0, "x", 3) for i in range(3000)]
    df = spark.createDataFrame(rows, "src long, dst long, w double, id string, x int")
    assert abs(sum(ranks(pagerank(Graph.of(df)))) - 1) < 1e-12


def test_a_shuffled_product_moves_only_the_vector(spark, monkeypatch):
    """Edges in buckets of (source, salt) are read where they are, a hub's over several salts."""
    monkeypatch.setattr(space, "HUB", 3)
    edges = [(0, i, 1.0 + i % 3) for i in range(1, 11)] + [(i, (i * 3) % 11, 2.0) for i in range(1, 11)]
    g = Graph.of(spark.createDataFrame(edges, "src long, dst long, w double"), spark.range(12))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        s = space.TableSpace(g, None, broadcast=False)
        x = s.load(spark.range(12).selectExpr("id", "cast(id + 1 as double) x"))
        s.mult(x)
        want = [0.0] * 12
        for a, b, w in edges:
            want[b] += w * (a + 1)
        got = {r.id: r.x for r in s.table("x1").collect()}
        assert [got[i] for i in range(12)] == want
        assert s._edges.where("src = 0").select("salt").distinct().count() > 1
        plan = s.step(x, "y")._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and len(re.findall(r"Exchange hashpartitioning\(src#\d+L?, salt", plan)) == 1
        # sums of a product are known without another pass
        assert s.reduce(("sum", "x1"), ("l1", x)) == [sum(want), 78.0] and ("sum", "x1") in s._known
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("algorithm,options", [("power", {"transposed": True}), ("inout", {"dangling": "loop"}), ("arnoldi", {}), ("linsys", {})])
def test_blocks_equal_arrays(spark, monkeypatch, algorithm, options):
    """Also with a target's edges in several blocks, repeated edges, rows that sum to zero and a personalisation."""
    monkeypatch.setattr(space, "BLOCK", 50)
    monkeypatch.setattr(space, "BLOCK_MOST", 60)
    edges = random_graph(8) + [(i % 35, 7, 1.0 + i % 2) for i in range(300)] + [(38, 3, 0.0)]
    g = make(spark, edges, 40)
    v = spark.createDataFrame([(i, (1 + i % 3) / 79.0) for i in range(40)], "id long, v double")
    c = PageRankConfig(algorithm=algorithm, alpha=0.2, tol=1e-10, **options)
    a, b = (pagerank(g, c, v=v, strategy=s) for s in ("array", "block"))
    assert np.allclose(ranks(a), ranks(b), atol=1e-13, rtol=0) and a.reason is b.reason is Reason.TOLERANCE
    assert [(r.iter, r.matvecs) for r in a.trace.collect()] == [(r.iter, r.matvecs) for r in b.trace.collect()]


def test_blocks_of_odd_graphs(spark):
    for edges, n in ([], 3), ([(0, 0, 1.0)], 1), ([(0, 1, 0.0), (1, 0, 1.0)], 2), ([(0, 1, 1.0), (0, 1, 2.0), (1, 1, 1.0)], 3):
        result = pagerank(make(spark, edges, n), PageRankConfig(alpha=0.2, tol=1e-12), strategy="block")
        assert np.allclose(ranks(result), direct(edges, n, 0.2), atol=1e-9)
    assert pagerank(make(spark, [], 0), strategy="block").ranks.count() == 0


def test_edges_beyond_arrays_go_to_blocks(spark, monkeypatch):
    """A graph too large for one process whose vectors are small isn't solved by tables, whose products cost jobs and shuffles."""
    monkeypatch.setattr(space, "ARRAY_EDGES", 100)
    g, c = make(spark, random_graph(9), 40), PageRankConfig(alpha=0.2, tol=1e-10)
    solver = PageRankSolver(g)
    assert type(solver.space(c)) is space.BlockSpace
    assert np.allclose(ranks(solver.solve(c)), direct(random_graph(9), 40, 0.2), atol=1e-9)
    monkeypatch.setattr(space, "ARRAY_NODES", 39)
    assert type(PageRankSolver(g).space(c)) is space.TableSpace


def test_stored_graphs_have_large_row_groups(spark):
    """A batch becomes a row group, so the batches of narrow tables must not be small."""
    g = PageRankSolver(Graph.of(spark.range(0, 40_000, 1, 1).selectExpr("id src", "(id * 7) % 40000 dst"), spark.range(0, 40_000, 1, 1)))._graph
    for df in (g.nodes, g.edges):
        files = [f.removeprefix("file://") for f in df.inputFiles()]
        assert [pq.ParquetFile(f).num_row_groups for f in files] == [1]


def test_a_product_of_blocks_is_one_job_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(space, "BLOCK", 5)
    s, context = space.space_of(make(spark, random_graph(10), 40), strategy="block"), spark.sparkContext
    context.setJobGroup("product", "")
    try:
        y = s.mult(s.teleport())
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    (job,) = tracker.getJobIdsForGroup("product")
    (stage,) = tracker.getJobInfo(job).stageIds
    assert tracker.getStageInfo(stage).numTasks == context.defaultParallelism < len(s._blocks)
    assert np.allclose(y, space.space_of(make(spark, random_graph(10), 40), strategy="array").mult(s.teleport()), atol=1e-15, rtol=0)


def test_a_multiple_of_the_vector_multiplied_last_needs_no_job(spark, monkeypatch):
    """From one kind of nodes to another, whose rows are empty, a solver's products are multiples of the first; any other vector gets its own."""
    edges = [(i, 20 + i * j % 9, 1.0 + i % 2) for i in range(20) for j in range(1, 4)]  # with repeated ones
    g, jobs, gather = make(spark, edges, 30), [], space.gather
    monkeypatch.setattr(space, "gather", lambda *a, **k: jobs.append(a) or gather(*a, **k))
    result = pagerank(g, PageRankConfig(algorithm="inout", tol=1e-13), strategy="block")
    assert np.allclose(ranks(result), direct(edges, 30, 0.85), atol=1e-12) and result.trace.count() > 40
    assert len(jobs) == 2  # the blocks and one product
    s, a = (space.space_of(g, strategy=x) for x in ("block", "array"))
    one, more = np.arange(1.0, 31.0), np.arange(1.0, 31.0)
    more[3] *= 1 + 1e-12
    elsewhere = np.r_[-3 * one[:20], np.ones(10)]
    for x, new in (one, 1), (elsewhere, 0), (0 * one, 0), (more, 1), (more * 0.3, 0), (one, 1), (np.full(30, np.nan), 1), (np.zeros(30), 1), (one, 1):
        jobs.clear()
        y = s.mult(x)
        assert len(jobs) == new
        assert np.allclose(y[20:], a.mult(x)[20:], atol=1e-15, rtol=1e-14, equal_nan=True)


def test_supply_is_ranked_from_lines(spark):
    """Merging lines of the same customer and supplier would shuffle nearly all of them."""
    merged, lines = (graphs.supply(spark, "/root/testdata/sf0.001", merged=m) for m in (True, False))
    assert lines.edges.count() == graphs.table(spark, "/root/testdata/sf0.001", "lineitem").count()
    plan = lambda g: g.edges._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan(merged) and "HashAggregate" not in plan(lines)
    assert Counter((r.src, r.dst) for r in lines.edges.collect()) == {(r.src, r.dst): r.w for r in merged.edges.collect()}
