"""Tables and files in the shared folder that the session names in spark.checkpoint.dir.

Lineage is cut by tables that tasks write there through Arrow: a task writes one file under a hidden temporary name and
renames it, so a repeated or late attempt leaves the same file.  Tables made inside a ``scope`` go with it.
"""

from __future__ import annotations

import atexit
import ctypes
import io
import re
import shutil
import tempfile
import time
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from pathlib import Path

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from py4j.protocol import Py4JError
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, types as T

#: Rows of a narrow table for each file, where their number is known.
ROWS_PER_FILE = 50_000

#: Rows of a batch between Spark and Python while a table is written, unless the caller knows that they are wide.
BATCH_ROWS = 1000
#: The same for tables of a few numbers: each batch becomes a row group, and small ones cost more than their rows.
NARROW_ROWS = 1 << 16
#: Bytes of a batch, beyond which it closes after a row: very long texts come a few at a time.
BATCH_BYTES = 8 << 20
_BATCH, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Seconds for which the driver keeps what it has freed.
RELIEF_S = 8

_own: dict[str, str] = {}
_scopes: list[list[str]] = []
_shipped: set[str] = set()
_relieved: dict[str, float] = {}


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder.  Where none is set, a temporary one is made if all of Spark is one process; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        application = spark.sparkContext.applicationId
        if application not in _own:
            own = tempfile.mkdtemp(prefix="rankloom-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            _own[application] = f"file://{own}"
        found = _own[application]
    return found.rstrip("/")


def new_dir(spark: SparkSession, name: str, lasting: bool = False) -> str:
    """A new path below the shared folder; it goes with the innermost scope, a lasting one with that around it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if len(_scopes) > lasting:
        _scopes[-1 - lasting].append(path)
    return path


def drop_dir(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Paths made inside are dropped at the end, also after an error.  What is returned must not read them any more."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            drop_dir(spark, path)


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of every executor, also of those that join later."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    top = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    path = f"{shared_dir(spark)}/code-{uuid.uuid4().hex}/{top.name}.zip"
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(context._jsc.hadoopConfiguration()).create(at)
    out.write(packed.getvalue())
    out.close()
    context.addPyFile(path)


def give_back() -> None:
    """Hand freed memory back to the system: a worker lives on, and its next task may need none of it."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def relieve(spark: SparkSession) -> None:
    """The same for the driver, every RELIEF_S at most: plans and results of many small jobs make its heap grow long before it must collect.

    The Java process is asked to trim its native memory too, where it knows the command (from 17.0.9).
    """
    application, now = spark.sparkContext.applicationId, time.monotonic()
    if now - _relieved.get(application, -RELIEF_S) < RELIEF_S:
        return
    _relieved[application] = now
    give_back()
    jvm = spark.sparkContext._jvm
    jvm.System.gc()
    with suppress(Py4JError):
        # by reflection, for the server's own class isn't exported
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = spark.sparkContext._gateway.new_array(jvm.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)


@contextmanager
def _storing(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches between Spark and Python have so many rows and BATCH_BYTES at most: they are several times in memory.

    Shuffle files go as soon as the table is there, not when the driver next collects garbage.
    """
    ours = {_BATCH: rows, _BYTES: BATCH_BYTES, _CLEANUP: "true"}
    before = {k: spark.conf.get(k, None) if k == _CLEANUP else spark.conf.get(k) for k in ours}
    for k, v in ours.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def bound_batches(spark: SparkSession) -> None:
    """For tables computed later: a session with Spark's own bounds on batches gets ours for good."""
    for k, default, ours in ((_BATCH, "10000", BATCH_ROWS), (_BYTES, "67108864b", BATCH_BYTES)):
        if spark.conf.get(k) == default:
            spark.conf.set(k, ours)


def store(df: DataFrame, path: str, by: Callable | None = None, schema: str | None = None, batch: int = BATCH_ROWS) -> DataFrame:
    """Write df as Parquet below path and read it back; at most a file for each partition, none for an empty one.

    With ``by``, a function from batches to batches of ``schema``, its result is written, by the same worker.
    """
    spark, schema = df.sparkSession, T.StructType.fromDDL(schema) if schema else df.schema
    ship(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, writer, rows = TaskContext.get(), None, 0
        fs, top = filesystem(path)
        name, temporary = f"{top}/part-{task.partitionId():06d}.parquet", f"{top}/_{task.partitionId():06d}-{task.taskAttemptId()}.tmp"
        for b in by(batches) if by else batches:
            if b.num_rows:
                if writer is None:
                    fs.create_dir(top, recursive=True)
                    writer = pq.ParquetWriter(temporary, b.schema, filesystem=fs, compression="lz4", use_dictionary=False)
                writer.write_batch(b)
                rows += b.num_rows
        give_back()
        if writer is not None:
            writer.close()
            fs.move(temporary, name)
            yield pa.RecordBatch.from_pydict({"rows": pa.array([rows], pa.int64())})

    with _storing(spark, batch):
        written = df.mapInArrow(write, "rows long").collect()  # a row for each file
    relieve(spark)
    return spark.read.schema(schema).parquet(path) if written else spark.createDataFrame([], schema)


def gather(df: DataFrame, f: Callable, schema: str, batch: int = BATCH_ROWS) -> list:
    """The rows that f, from batches to batches of ``schema``, makes of df on the executors.  They must be few."""
    ship(df.sparkSession)
    with _storing(df.sparkSession, batch):
        return df.mapInArrow(f, schema).collect()


def cut(df: DataFrame, rows: int | None = None, lasting: bool = False, by: Callable | None = None, schema: str | None = None, batch: int = BATCH_ROWS) -> DataFrame:
    """df (or what ``by`` makes of it), computed once and read back from the shared folder: later stages survive lost executors.

    Where the caller knows how many rows there are at most, there are no more files than these need.
    """
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_PER_FILE)))
    return store(df, new_dir(df.sparkSession, "table", lasting), by, schema, batch)
