"""WARC archives: a deterministic sharded writer, and a reader.

Rows are range-sorted by identifier; each range's task appends one gzip member for each record and rolls to the next
file when the compressed size passes the limit.  Headers and digests are made anew from the payload.  Files are written
under temporary names, renamed when complete, and named with size and SHA-1 in a manifest written last; a repeated or
late attempt writes the same bytes to the same names, and what the manifest doesn't name doesn't count.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..storage import filesystem, new_dir, ship, store

ROLL = 64 << 20
DATE = "1970-01-01T00:00:00Z"
_SPACE = uuid.UUID("6f1d2c53-8d1e-5f6b-9d0c-0c8f8a4f3b11")


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}:{digest}')}>"


def _line(value: str) -> str:
    """A header value: control characters and non-ASCII as percent escapes of their UTF-8 bytes."""
    return re.sub(r"[^\x21-\x7e]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "replace")), value)


def encode_record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None, refers_url: str | None) -> bytes:
    """One record, uncompressed: a response with its payload, or a revisit with HTTP headers alone (payload None)."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if payload is None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_line(url) if url else 'about:blank'}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{digest32(block)}",
    ]
    if payload is None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
        if refers_url:
            head.append(f"WARC-Refers-To-Target-URI: {_line(refers_url)}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("ascii") + b"\r\n\r\n" + block + b"\r\n\r\n"


def decode_records(data: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, from the bytes of a file with a gzip member for each record."""
    unzip, held = zlib.decompressobj(31), bytearray()
    for piece in data:
        while piece:
            held += unzip.decompress(piece)
            piece = b""
            if unzip.eof:
                piece, unzip = unzip.unused_data, zlib.decompressobj(31)
                head, _, rest = bytes(held).partition(b"\r\n\r\n")
                lines = head.decode("ascii").split("\r\n")
                if lines[0] != "WARC/1.1":
                    raise ValueError("not a WARC record")
                headers = dict(x.split(": ", 1) for x in lines[1:])
                size = int(headers["Content-Length"])
                if rest[size:] != b"\r\n\r\n":
                    raise ValueError("a record's length is wrong")
                yield headers, rest[:size]
                held = bytearray()
    if held:
        raise ValueError("a record is cut off")


def payloads(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url") -> DataFrame:
    """(page_id, url, payload, size, sha1) of each row; the payload is UTF-8, a null an empty one."""
    d = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    return d.withColumn("size", F.octet_length("payload").cast("long")).withColumn("sha1", F.sha1("payload"))


def revisits(d: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, sha1, original, original_url) of the payloads() whose payload a smaller page_id has too, distinct.

    Only digests are moved: one aggregate with partial sums, and a join whose heavy keys Spark may split.
    """
    narrow = d.where(F.col("size") >= least).select("page_id", "url", "size", "sha1")
    first = narrow.where("page_id is not null").groupBy("sha1", "size").agg(F.min(F.struct("page_id", "url")).alias("first"))
    other = narrow.join(first, ["sha1", "size"]).where("page_id is null or page_id != first.page_id")
    return other.select("page_id", "sha1", F.col("first.page_id").alias("original"), F.col("first.url").alias("original_url")).distinct()


def write_warc(pages: DataFrame, path: str, least: int = 0, roll: int = ROLL, shards: int | None = None, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url") -> DataFrame:
    """Write a record for each row below ``path``; returns the manifest (file, records, bytes, sha1).

    Of rows with equal payloads of at least ``least`` bytes, that with the smallest page_id is a response and others
    revisit it; rows that repeat that page_id are responses too.  Null payloads are empty, null URLs about:blank, rows
    with a null page_id come first and carry none.  An empty table gives an empty manifest.
    """
    spark = pages.sparkSession
    ship(spark)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = payloads(pages, id_col, payload_col, url_col)
    found = revisits(d, least)
    # A row's decision travels as a row of its own just before it, so payloads are moved only once.
    both = d.select("page_id", "sha1", F.lit(1).alias("last"), "url", "payload", "size").unionByName(
        found.select("page_id", "sha1", F.lit(0).alias("last"), F.col("original_url").alias("url"), F.col("original").alias("size")), allowMissingColumns=True
    )
    d = both.repartitionByRange(shards, "page_id", "sha1").sortWithinPartitions("page_id", "sha1", "last", "url")

    def write(batches):
        shard, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        fs, top = filesystem(path)
        state, decided = {"out": None, "n": 0}, {}

        def start():
            fs.create_dir(top, recursive=True)
            state.update(name=f"part-{shard:06d}-{state['n']:05d}.warc.gz", records=0, bytes=0, sha1=hashlib.sha1(), n=state["n"] + 1)
            state["out"] = fs.open_output_stream(f"{top}/{state['name']}.{attempt}.tmp", compression=None)

        def finish():
            state["out"].close()
            state["out"] = None
            fs.move(f"{top}/{state['name']}.{attempt}.tmp", f"{top}/{state['name']}")
            return pa.RecordBatch.from_pydict({"file": [f"{path}/{state['name']}"], "records": pa.array([state["records"]], pa.int64()), "bytes": pa.array([state["bytes"]], pa.int64()), "sha1": [state["sha1"].hexdigest()]})

        for b in batches:
            for page_id, sha1, last, url, payload, size in zip(*(c.to_pylist() for c in b.columns[:4]), b.column(4), b.column(5).to_pylist()):
                if not last:
                    decided = {(page_id, sha1): (size, url)}
                    continue
                if state["out"] is None:
                    start()
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                refers_to, refers_url = decided.get((page_id, sha1), (None, None))
                payload = payload.as_py() if refers_to is None else None
                zipped = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = zipped.compress(encode_record(page_id, url, payload, size, digest, refers_to, refers_url)) + zipped.flush()
                state["out"].write(member)
                state["sha1"].update(member)
                state["records"] += 1
                state["bytes"] += len(member)
                if state["bytes"] >= roll:
                    yield finish()
        if state["out"] is not None:
            yield finish()

    return store(d, f"{path}/manifest", write, "file string, records long, bytes long, sha1 string", batch=250)


def read_warc(manifest: DataFrame) -> DataFrame:
    """(page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to) of each record of the files.

    Digests of payloads and blocks are made anew and held against the headers; a file that differs raises.
    """
    n = max(1, min(manifest.count(), 1 << 16))

    def read(batches):
        for b in batches:
            for file in b.column(0).to_pylist():
                fs, name = filesystem(file)
                rows = []
                with fs.open_input_stream(name, compression=None) as f:
                    for head, block in decode_records(iter(lambda f=f: f.read(1 << 20), b"")):
                        if head["WARC-Block-Digest"] != f"sha1:{digest32(block)}":
                            raise ValueError(f"damaged record in {file}")
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
                        if kind == "response" and digest != digest32(payload):
                            raise ValueError(f"damaged payload in {file}")
                        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                        page, to = head.get("X-Page-Id"), head.get("X-Refers-To-Page-Id")
                        rows.append((page and int(page), head["WARC-Target-URI"], kind, payload if kind == "response" else None, size, digest, to and int(to)))
                        if len(rows) == 256:
                            yield batch(rows)
                            rows = []
                if rows:
                    yield batch(rows)

    kinds = (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64())
    names = ["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return manifest.select("file").repartition(n).mapInArrow(read, "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), new_dir(spark, "warc"))
    return read_warc(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op8_warc": op8_warc}

SQL = {
    "op8_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::INTEGER >> (15 - 5 * (i % 4))) & 31)::INTEGER + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id != first THEN first END AS refers_to
FROM f"""
}
