"""Scalar functions: column predicates of the numerical operators, and text helpers of the command line."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: A value at most this far from zero counts as zero.
EPSILON = 1e-16


def nonzero(x: Column) -> Column:
    return F.abs(x) > F.lit(EPSILON)


def indicator(x: Column) -> Column:
    """1 where x is not zero, else 0."""
    return F.when(nonzero(x), F.lit(1.0)).otherwise(F.lit(0.0))


def inverse_or_zero(x: Column) -> Column:
    """1/x, 0 where x counts as zero: for row and column scaling."""
    return F.when(nonzero(x), 1.0 / x).otherwise(F.lit(0.0))


def inverse_or_same(x: Column) -> Column:
    """1/x, x itself where it counts as zero: the in-place inverse of a vector."""
    return F.when(nonzero(x), 1.0 / x).otherwise(x)


def split_filename(name: str) -> tuple[str, str]:
    """(stem, extension) at the last dot; without one the extension is empty."""
    stem, dot, extension = name.rpartition(".")
    return (stem, extension) if dot else (name, "")


def lower_ascii(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def split_command_line(line: str) -> list[str]:
    """Arguments of a line: white space separates; double quotes group, and inside them a backslash takes the next
    character as it is; outside them it is an ordinary character.  Empty arguments vanish; an open quote ends with the line."""
    out, current, quoted, it = [], "", False, iter(line)
    for c in it:
        if c == '"':
            quoted = not quoted
        elif quoted and c == "\\":
            current += next(it, "")
        elif not quoted and c.isspace():
            if current:
                out.append(current)
            current = ""
        else:
            current += c
    return [*out, current] if current else out
