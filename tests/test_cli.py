from __future__ import annotations

import pytest

from rankloom.plans.cli import main, read_script
from tests.test_pagerank import G4
from tests.test_sources import G4_BSMAT, G4_DEGS


@pytest.fixture
def path(tmp_path):
    (tmp_path / "g.bsmat").write_bytes(G4_BSMAT)
    (tmp_path / "g.bsmat.degs").write_bytes(G4_DEGS)
    return tmp_path


def test_single_run(spark, path):
    said = []
    assert main(["-m", str(path / "g.bsmat"), "-alg", "inout", "-out", str(path / "r"), "-odd"], spark=spark, say=said.append) == 0
    ranks = [r.x for r in spark.read.parquet(str(path / "r")).orderBy("id").collect()]
    assert ranks == pytest.approx(G4[0.85], abs=1e-6)
    text = "\n".join(said)
    assert "unused argument: -odd" in text and "converged_tol" in text and "'nnz': 4" in text and "'norm1': 1.75" in text


def test_script(spark, path):
    said = []
    lines = ["-alpha 0.95 \r\n", "\n", "-alpha 0.95 -alg arnoldi\n", "-alg none\n"]
    assert main(["-m", str(path / "g.bsmat"), "-script", "-out", str(path / "r")], lines, spark, said.append) == 0
    found = spark.read.parquet(str(path / "r"))
    for run in ("run0", "run1"):
        assert [r.x for r in found.where(f"run_id = '{run}'").orderBy("id").collect()] == pytest.approx(G4[0.95], abs=1e-6)
    assert any("unknown algorithm" in x for x in said)


def test_help_and_errors(spark, path):
    said = []
    assert main([], say=said.append) == 1 and "python -m rankloom" in said[0]
    with pytest.raises(ValueError):
        main(["-m", str(path / "none.xyz")], spark=spark, say=said.append)
    assert read_script(["\t\n", " a \r\n"]) == [" a "]
