"""The command line: load a graph, report it, rank it once or for each line of a script on standard input.

  python -m rankloom -m FILE [-mhint FORMAT] [-script] [-trans] [-alg NAME] [-alpha A] [-tol T] [-maxiter N]
                     [-pvec FILE] [-inout_beta B] [-inout_eta E] [-inout_max_inner_iter N] [-noout] [-out PATH]

Ranks go to PATH as Parquet (run_id, id, x), unless -noout says not to.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable
from contextlib import contextmanager

from pyspark.sql import SparkSession

from ..operators.placement import balance_report
from ..sources.dispatch import read_graph
from ..sources.vector import read_vector
from .config import PageRankConfig, parse_options
from .pagerank import PageRankSolver, sweep


@contextmanager
def stage(spark: SparkSession, name: str):
    """Jobs inside are shown under this name."""
    spark.sparkContext.setJobDescription(name)
    try:
        yield
    finally:
        spark.sparkContext.setJobDescription(None)


def read_script(lines: Iterable[str]) -> list[str]:
    """Option strings, one a line: tabs and line ends trimmed, empty lines left out."""
    return [x for x in (line.strip("\t\r\n") for line in lines) if x]


def _take(args: list[str], name: str) -> str | None:
    if name not in args:
        return None
    i = args.index(name)
    if i + 1 >= len(args):
        raise ValueError(f"{name} needs a value")
    value = args[i + 1]
    del args[i : i + 2]
    return value


def main(argv: list[str], script: Iterable[str] = (), spark: SparkSession | None = None, say=print) -> int:
    args = list(argv)
    if not args or "-m" not in args:
        say(__doc__)
        return 1
    path, hint, out = _take(args, "-m"), _take(args, "-mhint"), _take(args, "-out")
    config, unused = parse_options(" ".join('"' + a.replace("\\", "\\\\").replace('"', '\\"') + '"' for a in args))
    for a in unused:
        say(f"unused argument: {a}")
    spark = spark or SparkSession.builder.appName("rankloom").getOrCreate()
    say(f"rankloom, application {spark.sparkContext.applicationId}, {spark.sparkContext.defaultParallelism} cores")
    with stage(spark, "load"):
        g = read_graph(spark, path, hint)
        solver = PageRankSolver(g)
        say(f"graph: {solver.stats().first().asDict()}")
        say(f"partitions: {balance_report(g.edges).first().asDict()}")
        v = read_vector(spark, config.pvec) if config.pvec else None
    lines = read_script(script) if "-script" in args else [config]
    for i, line in enumerate(lines):
        say(f"run{i}: {line}")
    with stage(spark, "compute"):
        if len(lines) == 1 and isinstance(lines[0], PageRankConfig):
            say(f"transition: {solver.run_info(config).first().asDict()}")
            result = solver.set_v(v).solve(config)
            for r in result.trace.orderBy("iter").toLocalIterator():
                say(f"{r.iter:6d} {r.delta:.6e}" + (f" inner {r.inner_iters}" if r.inner_active else ""))
            say(f"{result.reason.value} after {result.iterations}")
            ranks = result.ranks.selectExpr("'run0' AS run_id", "id", "x")
        else:
            runs, ranks = sweep(g, lines, config, v)
            for r in runs.collect():
                say(f"{r.run_id}: {r.error or f'{r.reason} after {r.iters}, {r.delta:.6e}'}")
    if out and "-noout" not in args:
        with stage(spark, "output"):
            ranks.write.parquet(out)
    return 0


def run() -> None:
    sys.exit(main(sys.argv[1:], sys.stdin if "-script" in sys.argv else ()))


__all__ = ["main", "read_script", "run", "stage"]
