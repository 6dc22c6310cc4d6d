from __future__ import annotations

import gzip
import random
import struct

import pytest

from rankloom.functions.scalars import lower_ascii, split_command_line, split_filename
from rankloom.operators.graph import Graph
from rankloom.sources import bsmat, bvgraph
from rankloom.sources.dispatch import pick_format, read_graph
from rankloom.sources.files import guess_filetype
from rankloom.sources.vector import read_vector, write_vector

G4_BSMAT = bytes.fromhex("0400000004000000040000000000000001000000000000000000f03f00000000020000000000000000000840010000000200000000000000000000400200000000000000000000000000f03f")
G4_DEGS = bytes.fromhex("02000000010000000100000000000000")
G4 = [(0, 1, 1.0), (0, 2, 3.0), (1, 2, 2.0), (2, 0, 1.0)]
B7 = bytes.fromhex("3534948b6afede")
B7_LISTS = [[1, 2, 3, 4, 6], [1, 2, 6], [], [0, 5], [], [], []]


def edges(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def g4(tmp_path):
    (tmp_path / "g.bsmat").write_bytes(G4_BSMAT)
    (tmp_path / "g.bsmat.degs").write_bytes(G4_DEGS)
    return tmp_path


@pytest.mark.parametrize("split", [1, 2, 100])
def test_bsmat(spark, g4, split):
    g = bsmat.read_bsmat(spark, str(g4 / "g.bsmat"), split)
    assert edges(g.edges) == G4 and g.nodes.count() == 4


def test_bsmat_gz(spark, g4):
    (g4 / "z.bsmat.gz").write_bytes(gzip.compress(G4_BSMAT))
    (g4 / "z.bsmat.degs.gz").write_bytes(gzip.compress(G4_DEGS))
    assert edges(read_graph(spark, str(g4 / "z.bsmat.gz")).edges) == G4


def test_bsmat_roundtrip_is_golden(spark, tmp_path):
    g = Graph.of(spark.createDataFrame(G4, "src long, dst long, w double"), spark.range(4))
    bsmat.write_bsmat(g, str(tmp_path / "w.bsmat"))
    written = (tmp_path / "w.bsmat").read_bytes()
    assert written[:12] == G4_BSMAT[:12] and sorted(written[i : i + 16] for i in range(12, 76, 16)) == sorted(G4_BSMAT[i : i + 16] for i in range(12, 76, 16))
    assert (tmp_path / "w.bsmat.degs").read_bytes() == G4_DEGS


@pytest.mark.parametrize("data,degs", [(G4_BSMAT[:-1], G4_DEGS), (G4_BSMAT, G4_DEGS[:-4]), (G4_BSMAT + b"\0" * 16, G4_DEGS), (b"\1", G4_DEGS), (G4_BSMAT[:12] + struct.pack("<IId", 9, 0, 1.0) + G4_BSMAT[28:], G4_DEGS)])
def test_bsmat_errors(spark, tmp_path, data, degs):
    (tmp_path / "b.bsmat").write_bytes(data)
    (tmp_path / "b.bsmat.degs").write_bytes(degs)
    with pytest.raises(Exception):
        bsmat.read_bsmat(spark, str(tmp_path / "b.bsmat")).edges.collect()


def test_bsmat_needs_degrees_and_a_square(spark, tmp_path):
    (tmp_path / "b.bsmat").write_bytes(G4_BSMAT)
    with pytest.raises(Exception):
        bsmat.read_bsmat(spark, str(tmp_path / "b.bsmat")).edges.collect()
    (tmp_path / "r.bsmat").write_bytes(struct.pack("<iiI", 1, 2, 1) + struct.pack("<IId", 0, 1, 2.0))
    (tmp_path / "r.bsmat.degs").write_bytes(struct.pack("<i", 1))
    with pytest.raises(ValueError):
        bsmat.read_bsmat(spark, str(tmp_path / "r.bsmat"))
    assert edges(bsmat.read_bsmat_entries(spark, str(tmp_path / "r.bsmat"))) == [(0, 1, 2.0)]


def test_bvgraph_golden(spark, tmp_path):
    p = bvgraph.parse_properties("#c\nnodes=7\narcs=10\nversion=0\nwindowsize=7\nminintervallength=3\nmaxrefcount=3\nzetak=3\n")
    assert [x for _, x in bvgraph.decode(B7, p)] == B7_LISTS
    assert bvgraph.encode(enumerate(B7_LISTS), p)[0] == B7
    (tmp_path / "b.graph").write_bytes(B7)
    (tmp_path / "b.properties").write_text("nodes=7\narcs=10\n")
    g = read_graph(spark, str(tmp_path / "b.graph"))
    assert edges(g.edges) == [(i, d, 1.0) for i, x in enumerate(B7_LISTS) for d in x] and g.nodes.count() == 7
    assert bvgraph.graph_properties(spark, str(tmp_path / "b.graph")).first().zetak == 3


@pytest.mark.parametrize("window,interval,refs,k", [(7, 3, 3, 3), (0, 3, 3, 3), (3, 0, 1, 1), (1, 2, -1, 5), (7, 4, 0, 2)])
def test_bvgraph_codec(window, interval, refs, k):
    rng = random.Random(window * 100 + k)
    lists, last = [], []
    for _ in range(200):
        own = {rng.randrange(200) for _ in range(rng.randrange(8))} | {x for x in last if rng.random() < 0.8}
        if rng.random() < 0.3:
            a = rng.randrange(180)
            own |= set(range(a, a + rng.randrange(2, 20)))
        lists.append(last := sorted(own))
    p = bvgraph.Properties(200, sum(map(len, lists)), window, interval, refs, k)
    data, starts = bvgraph.encode(enumerate(lists), p)
    assert [x for _, x in bvgraph.decode(data, p)] == lists
    assert starts == sorted(starts)
    with pytest.raises((EOFError, ValueError)):
        list(bvgraph.decode(data[: len(data) // 2], p))


def test_zeta_and_gamma():
    for k in range(1, 7):
        w = bvgraph.BitWriter()
        for n in range(500):
            w.zeta(n, k)
            w.gamma(n)
        r = bvgraph.BitReader(w.bytes())
        assert all((r.zeta(k), r.gamma()) == (n, n) for n in range(500))


def test_bvgraph_split(spark, tmp_path):
    g = Graph.of(spark.createDataFrame([(i, (i * 7 + j) % 60, 1.0) for i in range(60) for j in range(i % 9)], "src long, dst long, w double"), spark.range(60))
    bvgraph.write_bvgraph(g, str(tmp_path / "s.graph"))
    for split in (5, 1000):
        assert edges(bvgraph.read_bvgraph(spark, str(tmp_path / "s.graph"), split).edges) == edges(g.edges)


def test_bvgraph_errors(spark, tmp_path):
    for text in ("arcs=3", "nodes=x\narcs=1", "nodes=-1\narcs=1"):
        with pytest.raises(ValueError):
            bvgraph.parse_properties(text)
    (tmp_path / "b.graph").write_bytes(B7)
    with pytest.raises(FileNotFoundError):
        bvgraph.read_bvgraph(spark, str(tmp_path / "b.graph"))
    (tmp_path / "b.properties").write_text("nodes=7\narcs=11\n")
    with pytest.raises(Exception):
        bvgraph.read_bvgraph(spark, str(tmp_path / "b.graph")).edges.collect()


def test_vectors(spark, tmp_path):
    x = spark.createDataFrame([(1, 0.25), (0, 0.75)], "id long, v double")
    write_vector(x, str(tmp_path / "v.bin"))
    assert edges(read_vector(spark, str(tmp_path / "v.bin"))) == [(0, 0.75), (1, 0.25)]
    x.coalesce(1).write.parquet(str(tmp_path / "v.parquet"))
    assert edges(read_vector(spark, str(tmp_path / "v.parquet"))) == [(0, 0.75), (1, 0.25)]
    (tmp_path / "bad").write_bytes(b"123456789")
    with pytest.raises(ValueError):
        read_vector(spark, str(tmp_path / "bad"))


def test_dispatch(spark, tmp_path):
    (tmp_path / "t.graph").write_text("3 4\n1 2\n")
    for path, hint, kind in (("a.b/x.bsmat.gz", None, "bsmat"), ("x", "bvgraph", "bvgraph"), ("x.smat", "what", "smat"), ("e.parquet", None, "parquet")):
        assert pick_format(path, hint) == kind
    for path in ("x", "x.BSMAT", str(tmp_path / "t.graph"), "y.gz"):
        with pytest.raises(ValueError):
            pick_format(path)
    (tmp_path / "m.smat").write_text("3 3 2\n0 1 2.5\n2 0 1\n")
    g = read_graph(spark, str(tmp_path / "m.smat"))
    assert edges(g.edges) == [(0, 1, 2.5), (2, 0, 1.0)] and g.nodes.count() == 3


def test_scalars():
    assert split_filename("a.b/c") == ("a", "b/c") and split_filename("c") == ("c", "")
    assert lower_ascii("AbÉ") == "abÉ"
    assert split_command_line('a "b c" \\d "x\\"\\\\y" "" z"1"') == ["a", "b c", "\\d", 'x"\\y', "z1"]
    assert split_command_line('"open ended') == ["open ended"]
    assert [guess_filetype(x) for x in (b"1 2\n-3e4", b"abc\tdef\n", b"\x00\x01", b"\xff\xfe\xfdab", b"")] == ["numeric", "text", "binary", "binary", "text"]
