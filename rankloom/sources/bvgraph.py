"""Compressed web graphs: a bit stream of successor lists (.graph) with a .properties file; reader, writer, data source.

Lists are coded against an earlier one within a window (copied blocks), by intervals, and by gaps, in instantaneous
codes over bits from the most significant one.  Weights are 1.  Lists are decoded in order, so a file is one partition,
unless a side file of bit offsets (``.starts``, written by ``index``) lets tasks start inside: each then decodes back to
lists without a reference as far as it needs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.graph import Graph
from ..storage import ship
from .files import exists, filesystem, opened

BATCH = 1 << 17


class Properties(NamedTuple):
    nodes: int
    arcs: int
    windowsize: int = 7
    minintervallength: int = 3
    maxrefcount: int = 3
    zetak: int = 3


def properties_path(path: str) -> str:
    return path.removesuffix(".gz").removesuffix(".graph") + ".properties"


def parse_properties(text: str) -> Properties:
    """From key=value lines; unknown keys and comments are ignored, missing ones take their defaults, but for nodes and arcs."""
    found = {}
    for line in text.splitlines():
        key, eq, value = line.partition("=")
        if eq and not line.lstrip().startswith("#") and key.strip() in Properties._fields:
            found[key.strip()] = int(value)
    if "nodes" not in found or "arcs" not in found:
        raise ValueError("the properties lack nodes or arcs")
    if any(v < 0 for k, v in found.items() if k != "maxrefcount"):
        raise ValueError("the properties hold a negative size")
    return Properties(**found)


def read_properties(path: str) -> Properties:
    p = properties_path(path)
    if not exists(p):
        raise FileNotFoundError(p)
    with opened(p) as f:
        return parse_properties(f.read().decode())


class BitReader:
    """Codes from a string of bytes, from the most significant bit on; raises EOFError past its end."""

    def __init__(self, data: bytes, at: int = 0):
        self._data, self.at, self._end = data, at, 8 * len(data)

    def int(self, n: int) -> int:
        if not n:
            return 0
        if self.at + n > self._end:
            raise EOFError("the bit stream ends inside a code")
        first, last = self.at >> 3, self.at + n + 7 >> 3
        word = int.from_bytes(self._data[first:last], "big")
        word >>= 8 * last - self.at - n
        self.at += n
        return word & (1 << n) - 1

    def unary(self) -> int:
        start, byte = self.at, self.at >> 3
        if byte < len(self._data):
            rest = self._data[byte] & 0xFF >> (self.at & 7)
            while not rest:
                byte += 1
                if byte >= len(self._data):
                    break
                rest = self._data[byte]
            else:
                one = 8 * byte + 8 - rest.bit_length()
                self.at = one + 1
                return one - start
        raise EOFError("the bit stream ends inside a code")

    def gamma(self) -> int:
        m = self.unary()
        return (1 << m | self.int(m)) - 1

    def zeta(self, k: int) -> int:
        h = self.unary()
        left = 1 << h * k
        m = self.int(h * k + k - 1)
        return m + left - 1 if m < left else (m << 1 | self.int(1)) - 1


class BitWriter:
    def __init__(self):
        self._bits: list[str] = []
        self.at = 0

    def _put(self, bits: str) -> None:
        self._bits.append(bits)
        self.at += len(bits)

    def unary(self, n: int) -> None:
        self._put("0" * n + "1")

    def gamma(self, n: int) -> None:
        m = (n + 1).bit_length() - 1
        self.unary(m)
        if m:
            self._put(format(n + 1 - (1 << m), f"0{m}b"))

    def zeta(self, n: int, k: int) -> None:
        x = n + 1
        h = (x.bit_length() - 1) // k
        left, width = 1 << h * k, h * k + k
        self.unary(h)
        # values below left * (2^k - 1): those with a short code lie left below
        if x - left < left:
            if width > 1:
                self._put(format(x - left, f"0{width - 1}b"))
        else:
            self._put(format(x, f"0{width}b"))

    def bytes(self) -> bytes:
        bits = "".join(self._bits)
        bits += "0" * (-len(bits) % 8)
        return int(bits, 2).to_bytes(len(bits) // 8, "big") if bits else b""


def to_natural(x: int) -> int:
    return 2 * x if x >= 0 else -2 * x - 1


def from_natural(n: int) -> int:
    return n // 2 if n % 2 == 0 else -(n + 1) // 2


def decode_list(bits: BitReader, node: int, p: Properties, earlier) -> list[int]:
    """The successors of a node; earlier(d) is the list of the node d before."""
    degree = bits.gamma()
    if not degree:
        return []
    back = bits.unary() if p.windowsize else 0
    copied: list[int] = []
    if back:
        if back > node or back > p.windowsize:
            raise ValueError(f"node {node} refers {back} nodes back")
        source, lengths = earlier(back), []
        for i in range(bits.gamma()):
            lengths.append(bits.gamma() + (i > 0))
        at = 0
        for i, n in enumerate(lengths):
            if i % 2 == 0:
                copied += source[at : at + n]
            at += n
        if len(lengths) % 2 == 0:
            copied += source[at:]
    spans: list[int] = []
    extra = degree - len(copied)
    if extra > 0 and p.minintervallength:
        end = None
        for _ in range(bits.gamma()):
            left = node + from_natural(bits.gamma()) if end is None else bits.gamma() + end + 1
            end = left + bits.gamma() + p.minintervallength
            spans += range(left, end)
    rest: list[int] = []
    for i in range(extra - len(spans)):
        gap = bits.zeta(p.zetak)
        rest.append(node + from_natural(gap) if i == 0 else rest[-1] + 1 + gap)
    out = list(heapq.merge(copied, spans, rest))
    if len(out) != degree or (out and (out[0] < 0 or out[-1] >= p.nodes)):
        raise ValueError(f"the list of node {node} is damaged")
    return out


def decode(data: bytes, p: Properties) -> Iterator[tuple[int, list[int]]]:
    """(node, successors) of every node in order."""
    bits, window = BitReader(data), {}
    for node in range(p.nodes):
        window[node] = decode_list(bits, node, p, lambda d, node=node: window[node - d])
        window.pop(node - p.windowsize - 1, None)
        yield node, window[node]


def _blocks(source: list[int], wanted: set[int]) -> list[int]:
    """Lengths of alternating copied and skipped runs of source; the last run isn't written."""
    out, take, n = [], True, 0
    for x in source:
        if (x in wanted) != take:
            out.append(n)
            take, n = not take, 0
        n += 1
    return out


def _encode_list(w: BitWriter, node: int, lists: dict[int, list[int]], depth: dict[int, int], p: Properties) -> None:
    own = lists[node]
    w.gamma(len(own))
    depth[node] = 0
    if not own:
        return
    back = 0
    if p.windowsize:
        usable = [d for d in range(1, min(node, p.windowsize) + 1) if lists[node - d] and (p.maxrefcount < 0 or depth[node - d] < p.maxrefcount)]
        best = max(usable, key=lambda d: (len(set(lists[node - d]) & set(own)) - len(_blocks(lists[node - d], set(own))), -d), default=0)
        if best and len(set(lists[node - best]) & set(own)) > len(_blocks(lists[node - best], set(own))):
            back = best
        w.unary(back)
    copied: set[int] = set()
    if back:
        source = lists[node - back]
        runs = _blocks(source, set(own))
        copied = set(source) & set(own)
        depth[node] = depth[node - back] + 1
        w.gamma(len(runs))
        for i, n in enumerate(runs):
            w.gamma(n - (i > 0))
    extra = [x for x in own if x not in copied]
    if extra and p.minintervallength:
        spans, i = [], 0
        while i < len(extra):
            j = i
            while j + 1 < len(extra) and extra[j + 1] == extra[j] + 1:
                j += 1
            if j - i + 1 >= p.minintervallength:
                spans.append((extra[i], extra[j] + 1))
            i = j + 1
        w.gamma(len(spans))
        end = None
        for a, b in spans:
            w.gamma(to_natural(a - node) if end is None else a - end - 1)
            w.gamma(b - a - p.minintervallength)
            end = b
        extra = [x for x in extra if not any(a <= x < b for a, b in spans)]
    for i, x in enumerate(extra):
        w.zeta(to_natural(x - node) if i == 0 else x - extra[i - 1] - 1, p.zetak)


def encode(lists: Iterator[tuple[int, list[int]]], p: Properties) -> tuple[bytes, list[int]]:
    """(bit stream, bit at which each node's list starts) of successor lists, in order of nodes 0..n-1, ascending."""
    w, window, depth, starts = BitWriter(), {}, {}, []
    for node, own in lists:
        starts.append(w.at)
        window[node] = own
        _encode_list(w, node, window, depth, p)
        window.pop(node - p.windowsize, None)
    return w.bytes(), starts


class _Nodes(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.split = int(options.get("split", 1 << 20))
        self.properties = read_properties(self.path)
        self.starts = self.path.removesuffix(".gz") + ".starts"

    def partitions(self) -> list[_Nodes]:
        n = self.properties.nodes
        step = max(1, self.split if exists(self.starts) else n)
        return [_Nodes(a, min(n, a + step)) for a in range(0, n, step)] or [_Nodes(0, 0)]

    def _lists(self, part: _Nodes) -> Iterator[tuple[int, list[int]]]:
        p = self.properties
        if part.first == 0 and part.last == p.nodes:
            with opened(self.path) as f:
                data = f.read()
            total = 0
            for node, own in decode(data, p):
                total += len(own)
                yield node, own
            if total != p.arcs:
                raise ValueError(f"{self.path} holds {total} arcs, its properties say {p.arcs}")
            return
        fs, name = filesystem(self.starts)
        with fs.open_input_file(name) as f:
            low = max(0, part.first - p.windowsize * max(1, p.maxrefcount + 1))  # as far back as references reach
            f.seek(8 * low)
            starts = np.frombuffer(f.read(8 * (part.last - low + 1)), "<u8")
        fs, name = filesystem(self.path)
        with fs.open_input_file(name) as f:
            f.seek(int(starts[0]) // 8)
            end = int(starts[-1]) if len(starts) > part.last - low else None
            data = f.read() if end is None else f.read(-(-end // 8) - int(starts[0]) // 8)
        base, known = int(starts[0]) // 8 * 8, {}

        def get(node: int) -> list[int]:
            if node not in known:
                if node < low:
                    raise ValueError(f"a chain of references leaves the range of node {part.first}")
                known[node] = decode_list(BitReader(data, int(starts[node - low]) - base), node, p, lambda d: get(node - d))
            return known[node]

        for node in range(part.first, part.last):
            yield node, get(node)
            known.pop(node - p.windowsize * max(1, p.maxrefcount + 1) - 1, None)

    def read(self, partition: _Nodes) -> Iterator[pa.RecordBatch]:
        src, dst, n = [], [], 0

        def batch():
            to = np.concatenate([np.array(x, np.int64) for x in dst])
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(src, np.int64), [len(x) for x in dst])), pa.array(to), pa.array(np.ones(len(to)))], ["src", "dst", "w"])

        for node, own in self._lists(partition):
            if own:
                src.append(node)
                dst.append(own)
                n += len(own)
            if n >= BATCH:
                yield batch()
                src, dst, n = [], [], 0
        if n:
            yield batch()


class BVGraphDataSource(DataSource):
    """spark.read.format("bvgraph").load(path): (src, dst, w = 1); option split: nodes of a partition if there are starts."""

    @classmethod
    def name(cls) -> str:
        return "bvgraph"

    def schema(self) -> str:
        return "src long, dst long, w double"

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def read_bvgraph(spark: SparkSession, path: str, split: int = 1 << 20) -> Graph:
    ship(spark)
    spark.dataSource.register(BVGraphDataSource)
    return Graph(spark.range(read_properties(path).nodes), spark.read.format("bvgraph").option("split", split).load(path))


def graph_properties(spark: SparkSession, path: str) -> DataFrame:
    p = read_properties(path)
    return spark.createDataFrame([(path, *p)], "path string, nodes long, arcs long, windowsize int, minintervallength int, maxrefcount int, zetak int")


def write_bvgraph(g: Graph, path: str, windowsize: int = 7, minintervallength: int = 3, maxrefcount: int = 3, zetak: int = 3) -> None:
    """Write a graph with ids 0..n-1 (weights and repeated edges are dropped), its properties and its starts."""
    from pyspark.sql import functions as F

    n = g.nodes.count()
    rows = g.nodes.join(g.edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("to")), "id", "left").orderBy("id")
    p, arcs = Properties(n, 0, windowsize, minintervallength, maxrefcount, zetak), 0

    def lists():
        nonlocal arcs
        for i, r in enumerate(rows.toLocalIterator(prefetchPartitions=True)):
            if r.id != i:
                raise ValueError("ids must be 0 to n-1")
            arcs += len(r.to or ())
            yield i, list(r.to or ())

    data, starts = encode(lists(), p)
    fs, name = filesystem(path)
    text = "".join(f"{k}={v}\n" for k, v in p._replace(arcs=arcs)._asdict().items())
    for at, content in ((name, data), (properties_path(name), text.encode()), (f"{name}.starts", np.array(starts, "<u8").tobytes())):
        with fs.open_output_stream(at, compression=None) as f:
            f.write(content)
