from __future__ import annotations

from collections import Counter

import corpus_pipeline as cp
import pytest

import __spark_entry__
from rankloom.llm import pii
from tests.llm.odd import ROWS
from tests.llm.test_ngram_join import brute

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_names_and_columns():
    assert [n for n, _ in cp.STAGES] == ["language_id", "ngram_jaccard_join", "decontamination", "pii_surrogates", "packing"]
    names = __spark_entry__.queries()
    assert names["pipeline"] is cp.run and all(any(k.startswith(f"op{i}_") for k in names) for i in range(1, 11))


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    out, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in cp.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        out.append((docs, docs := spark.read.parquet(path)))
    return out


def test_each_stage_against_its_input(spark, steps):
    texts = [{r.doc_id: r.text for r in s.collect()} for s in (steps[0][0], *(s for _, s in steps[:4]))]
    raw, identified, distinct, clean, private = texts
    assert all(s.columns == list(cp.COLUMNS) for _, s in steps[:4])
    assert set(identified) == {d for d, t in raw.items() if t and any(c.isalpha() for c in t)}
    kept = {c for _, _, c in brute(sorted(identified.items()), 5, 80)}
    assert set(distinct) == kept
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(clean) == {d for d, t in distinct.items() if not any(i in t for i in items)}
    assert set(private) == set(clean)
    for d, t in clean.items():
        assert (private[d] != t) == bool(pii.find(t))
    lengths = {r.doc_id: r.n_chars for r in steps[3][1].collect()}
    assert all(lengths[d] == len(t) for d, t in private.items())
    assert sorted(r.doc_id for r in steps[4][1].collect()) == sorted(private)


def test_rows_that_share_an_id_stay_or_go_by_themselves(spark):
    x, y = ("the people of the house and the water of the world are here", "where this was only one part of a much longer story")
    rows = [(1, x, "en", "s", 1), (9, x, "en", "s", 1), (9, y, "en", "s", 1), (None, x, "en", "s", 1)]
    got = cp.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), SF).collect()
    assert Counter(map(tuple, got)) == Counter([rows[0], rows[2]])


def test_the_key_reaches_the_surrogates(spark):
    df = spark.createDataFrame([(1, "mail jo@acme.de", "en", "s", 1)], SCHEMA)
    mine, other = (cp.replace_personal_data(spark, df, SF, key=k).first().text for k in (b"mine", b"other"))
    assert mine != other and "acme" not in mine + other


def test_run_gives_the_last_stage(spark, steps):
    assert sorted(map(tuple, cp.run(spark, SF).collect())) == sorted(map(tuple, steps[4][1].collect()))


def test_odd_rows(spark, tmp_path):
    rows = [(d, t, lang, "s", 1) for d, t, lang in ROWS]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in cp.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert {7, 8} <= {r.doc_id for r in docs.collect()}


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in cp.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() == 0
