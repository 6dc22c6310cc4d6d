"""Graphs derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..operators.graph import Graph
from ..operators.placement import running_sum

#: Offset of the ids of a graph's second kind of nodes.
SECOND = 1_000_000
#: Nations have the ids below this; regions come after.
NATIONS = 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade(spark: SparkSession, sf_dir: str) -> Graph:
    """Nations: customer's to supplier's, by quantity; regions, whose ids follow, neither buy nor sell."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    joined = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    edges = joined.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.sum("l_quantity").alias("w"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"))
    return Graph.of(edges, nations.union(table(spark, sf_dir, "region").select(F.col("r_regionkey") + NATIONS)))


def supply(spark: SparkSession, sf_dir: str, merged: bool = True) -> Graph:
    """Customers to suppliers, by order lines; all customers and suppliers are nodes.

    Without ``merged`` each line is an edge: they add up to the same matrix, and few pairs have several lines, so merging costs a shuffle of nearly all of them.
    """
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    edges = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + SECOND).alias("dst"))
    if merged:
        edges = edges.groupBy("src", "dst").agg(F.count("*").alias("w"))
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).union(table(spark, sf_dir, "supplier").select(F.col("s_suppkey") + SECOND))
    return Graph.of(edges, nodes)


def copurchase(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts that share an order, by order lines; symmetric."""
    line = table(spark, sf_dir, "lineitem")
    a = line.select("l_orderkey", F.col("l_partkey").alias("src"))
    b = line.select("l_orderkey", F.col("l_partkey").alias("dst"))
    edges = a.join(b, "l_orderkey").where("src != dst").groupBy("src", "dst").agg(F.count("*").alias("w"))
    return Graph.of(edges, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")))


def event_transitions(spark: SparkSession, sf_dir: str) -> tuple[Graph, DataFrame]:
    """Event types, by how often a user's next event has the other type; and the types' names (id, name)."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    names = events.select(F.col("event_type").alias("name")).distinct()
    names = running_sum(names.withColumn("one", F.lit(1)), "name", "one", "id").select(F.col("id").cast("long").alias("id"), "name")
    following = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    steps = events.withColumn("next", following).where("next is not null").groupBy("event_type", "next").agg(F.count("*").alias("w"))
    src, dst = names.select(F.col("id").alias("src"), F.col("name").alias("event_type")), names.select(F.col("id").alias("dst"), F.col("name").alias("next"))
    return Graph.of(steps.join(src, "event_type").join(dst, "next"), names), names


def page_links(spark: SparkSession, sf_dir: str) -> tuple[Graph, DataFrame]:
    """Pages to the paths that they link, by links; and the paths (id, path)."""
    pages = table(spark, sf_dir, "pages")
    links = pages.select(F.col("page_id").alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("path"))
    links = links.groupBy("src", "path").agg(F.count("*").alias("w"))
    paths = running_sum(links.select("path").distinct().withColumn("one", F.lit(1)), "path", "one", "id").select((F.col("id") + SECOND).cast("long").alias("id"), "path")
    nodes = pages.select(F.col("page_id").alias("id")).union(paths.select("id"))
    return Graph.of(links.join(paths.withColumnRenamed("id", "dst"), "path"), nodes), paths
