"""Settings of a ranking run, as a dataclass and from option strings."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from enum import Enum

from ..functions.scalars import split_command_line


class Reason(str, Enum):
    """How a run ended."""

    TOLERANCE = "converged_tol"
    ITERATIONS = "diverged_its"
    BREAKDOWN = "diverged_breakdown"
    ITERATING = "iterating"


class UnknownAlgorithm(ValueError):
    pass


@dataclass(frozen=True)
class PageRankConfig:
    algorithm: str = "power"
    alpha: float = 0.85
    tol: float = 1e-7
    maxiter: int = 10_000
    transposed: bool = False
    dangling: str = "teleport"
    beta: float | None = None  # inner-outer: alpha / 2 if not given
    eta: float = 1e-2
    max_inner: int = 1000
    krylov: int = 8
    pvec: str | None = None  # path of a personalisation vector

    def __post_init__(self):
        if not 0 <= self.alpha < 1:
            raise ValueError("alpha must be at least 0 and below 1")
        if self.tol <= 0 or self.maxiter < 0 or self.max_inner < 1 or self.krylov < 1:
            raise ValueError("tol, maxiter, max_inner and krylov must be positive")

    def but(self, **changes) -> PageRankConfig:
        return replace(self, **changes)


#: Option names, the setting of each and its type.  Fixed values: the names are those that option strings use.
OPTIONS = {
    "-alg": ("algorithm", str), "-alpha": ("alpha", float), "-tol": ("tol", float), "-maxiter": ("maxiter", int), "-pvec": ("pvec", str),
    "-inout_beta": ("beta", float), "-inout_eta": ("eta", float), "-inout_max_inner_iter": ("max_inner", int),
}
FLAGS = {"-trans": "transposed"}
#: Accepted without effect on the result: output and loading switches of option strings.
IGNORED_FLAGS = {"-noout", "-script", "-matload_redistribute", "-matload_no_col_sort"}
IGNORED = {"-m", "-mhint", "-matload_root_nz_bufsize", "-matload_redistribute_wnnz", "-matload_redistribute_wrows"}


def parse_options(line: str, base: PageRankConfig | None = None) -> tuple[PageRankConfig, list[str]]:
    """(settings, unused arguments) of an option string, over ``base``; raises ValueError for a bad or missing value."""
    args, changes, unused = iter(split_command_line(line)), {}, []
    for a in args:
        if a in OPTIONS:
            name, kind = OPTIONS[a]
            value = next(args, None)
            if value is None:
                raise ValueError(f"{a} needs a value")
            changes[name] = kind(value)
        elif a in FLAGS:
            changes[FLAGS[a]] = True
        elif a in IGNORED:
            next(args, None)
        elif a not in IGNORED_FLAGS:
            unused.append(a)
    return (base or PageRankConfig()).but(**changes), unused


def describe(config: PageRankConfig) -> str:
    return " ".join(f"{f.name}={getattr(config, f.name)}" for f in fields(config) if getattr(config, f.name) is not None)
