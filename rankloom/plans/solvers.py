"""The iterative solvers, each a function (space, config, start) -> Solution, and their registry."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np

from .config import PageRankConfig, Reason, UnknownAlgorithm
from .space import Space


class Solution(NamedTuple):
    x: object
    reason: Reason
    trace: list[tuple]  # iter, delta, inner_active, inner_iters, matvecs


ALGORITHMS: dict[str, Callable[[Space, PageRankConfig, object], Solution]] = {}


def register(name: str):
    """Add a solver under a name; a later one replaces it."""

    def put(f):
        ALGORITHMS[name] = f
        return f

    return put


def algorithm(name: str):
    if name not in ALGORITHMS:
        raise UnknownAlgorithm(f"unknown algorithm: {name}")
    return ALGORITHMS[name]


def dangling_mult(s: Space, x, v):
    """P'x plus the mass lost at dangling nodes, spread by v."""
    y = s.mult(x)
    before, after = s.reduce(("sum", x), ("sum", y))
    return s.lin((1.0, y), (before - after, v))


def pagerank_mult(s: Space, x, v, alpha: float):
    y = s.mult(x)
    before, after = s.reduce(("sum", x), ("sum", y))
    return s.lin((alpha, y), (alpha * (before - after) + (1 - alpha) * before, v))


def _power_step(s: Space, x, v, alpha: float):
    """(next iterate, 1-norm of the change): what alpha P'x lacks of norm 1 goes back by v."""
    z = s.mult(x)
    y = s.lin((alpha, z), (1 - alpha * s.reduce(("l1", z))[0], v))
    return y, s.reduce(("l1", s.lin((1.0, y), (-1.0, x))))[0]


@register("power")
def power(s: Space, c: PageRankConfig, x) -> Solution:
    """Power iteration; teleport and dangling mass come back together as the part that the product lost."""
    trace, reason = [], Reason.ITERATIONS
    for k in range(1, c.maxiter + 1):
        v = s.teleport()
        x, delta = _power_step(s, x, v, c.alpha)
        s.keep(x)
        trace.append((k, delta, False, 0, s.matvecs))
        if delta < c.tol:
            reason = Reason.TOLERANCE
            break
    return Solution(x, reason, trace)


@register("inout")
def inout(s: Space, c: PageRankConfig, x) -> Solution:
    """Inner-outer iteration: outer steps solve with a smaller damping beta by inner Richardson steps to eta.

    Once an inner solve needs a single step, the rest are power steps.
    """
    beta = c.alpha / 2 if c.beta is None else c.beta
    trace, reason, inner_on = [], Reason.ITERATIONS, True
    v = s.teleport()
    y = dangling_mult(s, x, v)
    for k in range(1, c.maxiter + 1):
        inner = 0
        if inner_on:
            s.keep(x, y)
            v = s.teleport()
            f = s.lin((c.alpha - beta, y), (1 - c.alpha, v))
            while inner < c.max_inner:
                inner += 1
                x = s.lin((1.0, f), (beta, y))
                y = dangling_mult(s, x, v)
                gap = s.reduce(("l1", s.lin((1.0, f), (beta, y), (-1.0, x))))[0]
                s.keep(x, y, f, v)
                if gap < c.eta:
                    break
            delta = s.reduce(("l1", s.lin((1.0, x), (-c.alpha, y), (c.alpha - 1, v))))[0]
            if inner == 1 and gap < c.eta:
                inner_on = False
                x = s.lin((c.alpha, y), (1 - c.alpha, v))
        else:
            s.keep(x)
            x, delta = _power_step(s, x, s.teleport(), c.alpha)
        trace.append((k, delta, inner > 0, inner, s.matvecs))
        if delta < c.tol:
            reason = Reason.TOLERANCE
            break
    return Solution(x, reason, trace)


@register("arnoldi")
def arnoldi(s: Space, c: PageRankConfig, x) -> Solution:
    """Restarted refined Arnoldi for the eigenvalue 1: each restart takes from a Krylov basis the vector with the least
    residual, by an SVD of the small Hessenberg matrix.  A basis that closes early ends there.  Results sum to 1."""
    trace, reason = [], Reason.ITERATIONS
    for k in range(1, c.maxiter + 1):
        v = s.teleport()
        norm = np.sqrt(s.reduce(("dot", x, x))[0])
        basis, h = [s.lin((1.0 / norm, x))], np.zeros((c.krylov + 1, c.krylov))
        size = c.krylov
        for j in range(c.krylov):
            g = pagerank_mult(s, basis[j], v, c.alpha)
            *dots, whole = s.reduce(*[("dot", q, g) for q in basis], ("dot", g, g))
            h[: j + 1, j] = dots
            g = s.lin((1.0, g), *[(-d, q) for d, q in zip(dots, basis)])
            rest = np.sqrt(max(s.reduce(("dot", g, g))[0], 0.0))
            h[j + 1, j] = rest
            if rest <= 1e-14 * np.sqrt(max(whole, 0.0)):
                size = j + 1
                h[j + 1, j] = 0.0
                break
            if j + 1 < c.krylov:
                basis.append(s.lin((1.0 / rest, g)))
                s.keep(*basis, v)
        small = h[: size + 1, :size].copy()
        small[:size, :size] -= np.eye(size)
        weights = np.linalg.svd(small)[2][-1]
        x = s.lin(*[(float(w), q) for w, q in zip(weights, basis)])
        y = pagerank_mult(s, x, v, c.alpha)
        gap, size_x, total = s.reduce(("l1", s.lin((1.0, y), (-1.0, x))), ("l1", x), ("sum", x))
        if not size_x or abs(total) < 1e-300:
            return Solution(x, Reason.BREAKDOWN, trace)
        delta = gap / size_x
        x = s.lin((1.0 / total, x))
        s.keep(x)
        trace.append((k, delta, False, 0, s.matvecs))
        if delta < c.tol:
            reason = Reason.TOLERANCE
            break
    return Solution(x, reason, trace)


@register("linsys")
def linsys(s: Space, c: PageRankConfig, x) -> Solution:
    """Richardson iteration x = alpha P'x + v on the linear system; the solution over its sum is the ranking."""
    trace, reason = [], Reason.ITERATIONS
    for k in range(1, c.maxiter + 1):
        v = s.teleport()
        z = s.mult(x)
        y = s.lin((c.alpha, z), (1.0, v))
        gap, size = s.reduce(("l1", s.lin((1.0, y), (-1.0, x))), ("l1", y))
        x, delta = y, gap / size if size else 0.0
        s.keep(x)
        trace.append((k, delta, False, 0, s.matvecs))
        if delta < c.tol:
            reason = Reason.TOLERANCE
            break
    total = s.reduce(("sum", x))[0]
    return Solution(s.lin((1.0 / total if total else 1.0, x)), reason, trace)


def derivative(s: Space, c: PageRankConfig, rank) -> Solution:
    """The ranking's derivative in alpha: (I - alpha M) d = M rank - v with M the dangling-corrected product, by
    Richardson iteration.  Its entries sum to 0."""
    v = s.teleport()
    f = s.lin((1.0, dangling_mult(s, rank, v)), (-1.0, v))
    d, trace, reason = f, [], Reason.ITERATIONS
    for k in range(1, c.maxiter + 1):
        y = s.lin((c.alpha, dangling_mult(s, d, v)), (1.0, f))
        delta = s.reduce(("l1", s.lin((1.0, y), (-1.0, d))))[0]
        d = y
        s.keep(d, f, v)
        trace.append((k, delta, False, 0, s.matvecs))
        if delta < c.tol:
            reason = Reason.TOLERANCE
            break
    return Solution(d, reason, trace)
