from __future__ import annotations

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from rankloom.llm import secrets
from tests.llm.odd import ROWS, docs, empty

ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    t = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


@pytest.fixture(scope="module")
def table(spark):
    return secrets.train(secrets.labelled_sample(spark))


def places(spark, table, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: [(p["start"], p["kind"], p["end"], p["name"]) for p in r.places] for r in secrets.secret_scan(df, table).collect()}


def test_base_patterns_against_brute_force(spark, table):
    rng = random.Random(1)
    bits = ["password", "PassWd", "SECRET", "tokeN", "api_key", "apikey", "=", ":", " ", '"', "'", "AKIA", "ABCDEF0123456789", "0123456789abcdef", "deadbeef", "xyz", "é😀", "\n", "abc", "kſ", "."]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(400)] + ["secret=token: abcdefgh", "AKIA AKIAAKIA" + "A" * 20, "token=" + "a" * 24]
    got = places(spark, table, texts)
    for i, t in enumerate(texts):
        assert [p for p in got[i] if p[1] < 3] == base(t), t


def test_models_find_random_strings_and_leave_words(spark, table):
    rng = random.Random(2)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    noise = ["".join(rng.choice(alphabet) for _ in range(32)) for _ in range(40)]
    plain = ["get_user_name_from_config_file", "internationalizationSupportModule", "MAX_BUFFER_SIZE_FOR_STREAM_WORKERS", "usr/local/share/application/data", "donaudampfschifffahrtsgesellschaft", "thineationoutheringationstheand", "2024-01-15-report-of-the-northern-region"]
    got = places(spark, table, [f"see é {x} here" for x in noise + plain])
    assert sum(got[i] == [(6, 3, 38, "markov")] for i in range(40)) >= 38
    assert all(not got[40 + i] for i in range(len(plain)))


def test_models_yield_to_patterns(spark, table):
    text = "token = " + hashlib.sha256(b"x").hexdigest()
    assert [p[3] for p in places(spark, table, [text])[0]] == ["assign", "hex"]


def test_long_runs_and_many_matches_take_linear_time(spark, table):
    rng = random.Random(5)
    run = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(1_000_000))
    many = " ".join(f"{rng.getrandbits(96):024x}{'Z' * (i % 2)}" for i in range(100_000))
    mixed = " ".join(["secret=abcdefgh", run[:40], "ab" * 12] * 5000)
    t = time.perf_counter()
    got = places(spark, table, [run, many, mixed])
    assert time.perf_counter() - t < 120  # some 20 here; quadratic ways take hours
    assert got[0] == [(0, 3, 1_000_000, "markov")]
    assert [p for p in got[1] if p[1] < 3] == base(many) and len(got[1]) == 100_000
    assert [p[3] for p in got[2]] == ["assign", "markov", "hex"] * 5000 and [p for p in got[2] if p[1] < 3] == base(mixed)


def test_runs_that_overlap_a_match_are_left_out(spark, table):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    texts = [rng.choice([" ", ", "]).join(rng.choice([word(30), "token=" + word(25), "a1" * 13 + word(20), "AKIA" + "B" * 20, word(6)]) for _ in range(rng.randrange(400))) for _ in range(12)]
    for t, got in zip(texts, places(spark, table, texts).values()):
        plain = base(t)
        runs = [(m.start(), m.end()) for m in re.finditer(secrets.CANDIDATE, t)]
        free = {(a, e) for a, e in runs if not any(x < e and a < y for x, _, y, _ in plain)}
        assert [p for p in got if p[1] < 3] == plain and {(p[0], p[2]) for p in got if p[1] == 3} <= free
        assert len([p for p in got if p[1] == 3]) >= 0.9 * len([1 for a, e in free if e - a == 30])


def test_odd_rows(spark, table):
    found = secrets.secret_scan(docs(spark), table)
    assert found.columns == ["doc_id", "places"] and found.count() == len(ROWS)
    assert secrets.secret_scan(empty(spark), table).count() == 0
    assert secrets.train(spark.createDataFrame([(None, True), ("ab", None), ("x", False)], "text string, random boolean")) == [0.0] * (len(secrets.SYMBOLS) + 1) ** 2


def test_plan_has_no_python(spark, table):
    plan = secrets.secret_scan(docs(spark), table)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def test_query_digest(spark):
    df = secrets.op1_secret_scan(spark, "/root/testdata/sf0.001")
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.col("text")).collect()}
    rows = df.collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base(texts[r.doc_id])
        joined = ",".join(f"{n}:{a}:{e}" for a, _, e, n in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _, _ in want) for i in range(3))
