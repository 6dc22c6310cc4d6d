"""Graphs from files by hint, extension or content, and from tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import split_filename
from ..operators.graph import Graph
from .bsmat import read_bsmat
from .bvgraph import read_bvgraph
from .files import exists, guess_filetype, head, is_gzip

TABLES = ("parquet", "csv", "json", "orc")


def pick_format(path: str, hint: str | None = None) -> str:
    """``bsmat``, ``bvgraph``, ``smat`` or a table format; raises ValueError if nothing fits.

    A known hint wins; else the extension, without .gz, decides; a .graph file must have binary content.
    """
    if hint in ("bsmat", "bvgraph", "smat", *TABLES):
        return hint
    stem, extension = split_filename(path)
    if extension == "gz":
        extension = split_filename(stem)[1]
    if extension in ("bsmat", "smat", *TABLES):
        return extension
    if extension == "graph":
        if exists(path) and (is_gzip(path) or guess_filetype(head(path)) == "binary"):
            return "bvgraph"
        raise ValueError(f"{path} looks like a text graph, of which there is no reader")
    raise ValueError(f"can't tell the format of {path}")


def read_smat(spark: SparkSession, path: str) -> Graph:
    """Text matrices: a line "rows columns entries", then "row column value" lines, 0-based."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f"), F.monotonically_increasing_id().alias("n"), F.col("_metadata.file_block_start").alias("block"))
    first = lines.orderBy("block", "n").first()
    if first is None or len(first.f) < 3:
        raise ValueError(f"{path} has no header")
    rows, columns = int(first.f[0]), int(first.f[1])
    if rows != columns:
        raise ValueError(f"{path} is not square: {rows} x {columns}")
    entries = lines.where((F.col("n") != first.n) & (F.size("f") >= 3))
    return Graph(spark.range(rows), entries.select(F.col("f")[0].cast("long").alias("src"), F.col("f")[1].cast("long").alias("dst"), F.col("f")[2].cast("double").alias("w")))


def read_graph(spark: SparkSession, path: str, hint: str | None = None) -> Graph:
    kind = pick_format(path, hint)
    if kind == "bsmat":
        return read_bsmat(spark, path)
    if kind == "bvgraph":
        return read_bvgraph(spark, path)
    if kind == "smat":
        return read_smat(spark, path)
    reader = spark.read.option("header", True).option("inferSchema", True) if kind == "csv" else spark.read
    return graph_of_table(reader.format(kind).load(path))


def graph_of_table(edges: DataFrame, src: str = "src", dst: str = "dst", w: str | None = None, nodes: DataFrame | None = None) -> Graph:
    """A graph from any table: its source and target columns, a weight or 1, and perhaps all nodes (id)."""
    weight = F.col(w or "w").cast("double") if w or "w" in edges.columns else F.lit(1.0)
    return Graph.of(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"), weight.alias("w")), nodes)
