from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from rankloom import storage


def _sizes(batches):
    for b in batches:
        yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "bytes": [b.nbytes]})


def test_long_rows_come_in_small_batches_while_a_table_is_stored(spark):
    before = {k: spark.conf.get(k) for k in (storage._BATCH, storage._BYTES)}
    rows = spark.range(0, 40, 1, 1).select("id", F.expr("repeat('x', 1000000)").alias("text"))
    sizes = storage.cut(rows, by=_sizes, schema="n long, bytes long").collect()
    assert sum(r.n for r in sizes) == 40
    assert max(r.bytes for r in sizes) <= storage.BATCH_BYTES + 1_100_000
    assert {k: spark.conf.get(k) for k in before} == before


def test_a_row_beyond_the_bound_is_whole(spark):
    long = storage.BATCH_BYTES + 1000
    rows = spark.range(0, 3, 1, 1).select(F.expr(f"repeat('y', {long})").alias("text"))
    assert [r.n for r in storage.cut(rows).select(F.length("text").alias("n")).collect()] == [long] * 3


def test_bounds_of_the_session_are_respected(spark):
    before = {k: spark.conf.get(k) for k in (storage._BATCH, storage._BYTES)}
    try:
        spark.conf.set(storage._BATCH, 77)
        spark.conf.unset(storage._BYTES)
        storage.bound_batches(spark)
        assert spark.conf.get(storage._BATCH) == "77"
        assert spark.conf.get(storage._BYTES).rstrip("b") == str(storage.BATCH_BYTES)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_settings_come_back_after_a_failure(spark):
    before = {k: spark.conf.get(k, None) for k in (storage._BATCH, storage._BYTES, storage._CLEANUP)}

    def broken(batches):
        raise ValueError("on purpose")
        yield

    try:
        storage.cut(spark.range(3), by=broken, schema="id long")
    except Exception as e:
        assert "on purpose" in str(e)
    assert {k: spark.conf.get(k, None) for k in before} == before


def test_the_driver_hands_back_what_it_has_freed(spark, tmp_path, monkeypatch):
    """Many small jobs leave a driver's heap grown, and no executor's work collects it; not after each table, for a collection takes a while."""
    runtime = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    used = lambda: runtime.totalMemory() - runtime.freeMemory()
    monkeypatch.setattr(storage, "_relieved", {})
    monkeypatch.setattr(storage, "RELIEF_S", 1000)

    def litter() -> int:
        text = spark.sparkContext._jvm.org.apache.commons.lang3.StringUtils.repeat
        for _ in range(20):
            text("0123456789", 1_000_000).__len__()
        return used()

    def calm(what):
        spark.sparkContext._jvm.System.gc()
        return what()

    for relief in True, False:
        before = calm(litter)
        storage.store(spark.range(10), f"file://{tmp_path}/{relief}")
        assert (used() < before - (100 << 20)) == relief
