"""Vectors as tables (id, x), one row for each node, and tables of several co-located vectors as columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import indicator, inverse_or_same


def filled(nodes: DataFrame, value: float) -> DataFrame:
    return nodes.select("id", F.lit(float(value)).alias("x"))


def scale(x: DataFrame, a: float) -> DataFrame:
    return x.select("id", (F.col("x") * a).alias("x"))


def shift(x: DataFrame, c: float) -> DataFrame:
    return x.select("id", (F.col("x") + c).alias("x"))


def together(**vectors: DataFrame) -> DataFrame:
    """One table with a column for each vector; all must have the same ids."""
    (first, df), *rest = vectors.items()
    out = df.select("id", F.col("x").alias(first))
    for name, v in rest:
        out = out.join(v.select("id", F.col("x").alias(name)), "id")
    return out


def combination(terms: Mapping[str, float], constant: float = 0.0) -> Column:
    """The linear combination of columns: one projection does for any of the vector updates."""
    out = F.lit(float(constant))
    for name, a in terms.items():
        out = out + F.col(name) * float(a)
    return out


def axpy(a: float, x: DataFrame, y: DataFrame) -> DataFrame:
    """a x + y"""
    return together(a=x, b=y).select("id", combination({"a": a, "b": 1.0}).alias("x"))


def aypx(a: float, x: DataFrame, y: DataFrame) -> DataFrame:
    """x + a y"""
    return together(a=x, b=y).select("id", combination({"a": 1.0, "b": a}).alias("x"))


def axpby(a: float, x: DataFrame, b: float, y: DataFrame) -> DataFrame:
    """a x + b y"""
    return together(a=x, b=y).select("id", combination({"a": a, "b": b}).alias("x"))


def total(x: DataFrame) -> DataFrame:
    return x.agg(F.sum("x").alias("total"))


def norms(x: DataFrame) -> DataFrame:
    """One row: norm1, norm2, norminf."""
    return x.agg(F.sum(F.abs("x")).alias("norm1"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm2"), F.max(F.abs("x")).alias("norminf"))


def dots(df: DataFrame, pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """One row with the products of the named column pairs: one aggregate for any number."""
    return df.agg(*[F.sum(F.col(a) * F.col(b)).alias(name) for name, (a, b) in pairs.items()])


def normalised(x: DataFrame) -> DataFrame:
    """x over its 2-norm; a zero vector stays."""
    norm = x.agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return x.crossJoin(F.broadcast(norm)).select("id", F.when(F.col("norm") > 0, F.col("x") / F.col("norm")).otherwise(F.col("x")).alias("x"))  # one row


def nonzero_inverse(x: DataFrame) -> DataFrame:
    return x.select("id", inverse_or_same(F.col("x")).alias("x"))


def nonzero_indicator(x: DataFrame) -> DataFrame:
    return x.select("id", indicator(F.col("x")).alias("x"))


def top_k(ranks: DataFrame, k: int) -> DataFrame:
    """The k largest, ties by id."""
    return ranks.orderBy(F.desc("x"), "id").limit(k)
