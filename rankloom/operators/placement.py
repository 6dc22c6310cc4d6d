"""Placement: where rows lie, and prefix sums over them without bringing all rows to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..storage import cut
from .graph import Graph


def degrees(g: Graph) -> DataFrame:
    """(id, degree): stored entries in each node's row."""
    d = g.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return g.nodes.join(d, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def running_sum(df: DataFrame, order: str, value: str, name: str = "before") -> DataFrame:
    """df with the sum of ``value`` over all rows before in ``order`` (a column of distinct values).

    Range partitions are summed one by one, and only their totals (a row each) are added up in one task.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = cut(df.repartitionByRange(parts, order).withColumn("__part", F.spark_partition_id()))
    totals = d.groupBy("__part").agg(F.sum(value).alias("__total"))
    offset = F.coalesce(F.sum("__total").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.join(F.broadcast(totals.select("__part", offset.alias("__offset"))), "__part").withColumn(name, F.col("__offset") + inside).drop("__part", "__offset")


def csr_offsets(g: Graph) -> DataFrame:
    """(id, degree, start): where each node's row begins when rows are stored one after another by id."""
    return running_sum(degrees(g), "id", "degree", "start").select("id", "degree", F.col("start").cast("long").alias("start"))


def csr(g: Graph) -> DataFrame:
    """(src, dst array, w array): compressed rows, columns ascending.  A row must fit a task, as it does its owner."""
    rows = g.edges.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dst", "w"))).alias("row"))
    return rows.select("src", F.col("row.dst").alias("dst"), F.col("row.w").alias("w"))


def even_split(rows: int, parts: int) -> list[int]:
    """Rows of each part, the first ones one more where it doesn't divide."""
    return [rows // parts + (rows % parts > i) for i in range(parts)]


def assign_partitions(g: Graph, parts: int, row_weight: float = 1.0, entry_weight: float = 1.0) -> DataFrame:
    """(id, part): rows in order of id, a part closed as soon as its weight reaches the average, the last takes the rest.

    A row weighs row_weight + entry_weight * degree; the average is rounded up.  With running sums a part's end is the
    first row whose sum since the part's start reaches the average, so ``parts`` small lookups do.
    """
    w = degrees(g).withColumn("weight", F.lit(float(row_weight)) + F.lit(float(entry_weight)) * F.col("degree"))
    sums = cut(running_sum(w, "id", "weight").withColumn("after", F.col("before") + F.col("weight")))
    average = sums.agg(F.ceil(F.sum("weight") / parts)).first()[0] or 0
    ends, start = [], 0.0
    while len(ends) < parts - 1:
        end = sums.where(F.col("after") >= start + average).where(F.col("after") > start).agg(F.min(F.struct("id", "after")).alias("e")).first().e
        if end is None:
            break
        ends.append(end.id)
        start = end.after
    part = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]).cast("array<bigint>"), lambda e: e < F.col("id")))
    return sums.select("id", part.alias("part"))


def balance_report(edges: DataFrame, assignment: DataFrame | None = None) -> DataFrame:
    """One row: least and most rows and entries of a partition, Spark's own or those of an assignment (id, part)."""
    if assignment is None:
        parts = edges.groupBy(F.spark_partition_id().alias("part")).agg(F.countDistinct("src").alias("rows"), F.count("*").alias("nnz"))
    else:
        d = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
        parts = assignment.join(d, "id", "left").groupBy("part").agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("nnz"))
    return parts.agg(F.count("*").alias("parts"), F.min("rows").alias("min_rows"), F.max("rows").alias("max_rows"), F.min("nnz").alias("min_nnz"), F.max("nnz").alias("max_nnz"))


def owners(assignment: DataFrame) -> DataFrame:
    """(part, first, last, rows): the range of ids of each part."""
    return assignment.groupBy("part").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("rows"))
