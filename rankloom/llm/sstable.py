"""Token ids on disk: sorted-string-table shards with binary-search lookup.

A shard is a file of
  magic | data blocks | index | Bloom filter | footer
Keys are order-preserving bytes of the 64-bit identifier; a null is the empty key and comes first.  A data block is
zstd-compressed entries, each: varint length shared with the key before, varint length of the rest, varint length of
the value, rest of the key, value (ids, little-endian).  The index has each block's last key, place, size, number of
entries and CRC-32; the Bloom filter has all keys; the footer has places, totals and a CRC-32 of index and filter.

Shards are written by tasks under temporary names and renamed; only those in the manifest, written last, count.
A repeated or late attempt writes the same bytes to the same name.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..storage import filesystem, new_dir, ship, store
from .tokens import encoder

MAGIC = b"RLSST001"
FOOTER = struct.Struct("<QQQQQQIBxxx8s")  # index at, size; filter at, size; entries; ids; crc; width; magic
BLOCK = 1 << 17
BLOOM_BITS, BLOOM_HASHES = 10, 7


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, i: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[i]
        n |= (x & 127) << shift
        i, shift = i + 1, shift + 7
        if x < 128:
            return n, i


def _bloom_places(key: bytes, bits: int) -> list[int]:
    import xxhash

    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & ((1 << 64) - 1), h >> 64 | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class Writer:
    """One shard, from entries in ascending order of keys."""

    def __init__(self, out, width: int):
        import zstandard

        self._out, self._width, self._zip = out, width, zstandard.ZstdCompressor(level=1)
        self._at, self._index, self._keys = len(MAGIC), [], []
        self.ids, self._block, self._size, self._count, self._last = 0, [], 0, 0, b""
        out.write(MAGIC)

    def add(self, key: bytes, ids: bytes) -> None:
        last = self._last if self._count else b""
        if self._keys and key < self._keys[-1]:
            raise ValueError("keys must ascend")
        shared = 0
        while shared < min(len(key), len(last)) and key[shared] == last[shared]:
            shared += 1
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(ids)) + key[shared:] + ids
        self._block.append(entry)
        self._size += len(entry)
        self._count += 1
        self._last = key
        self._keys.append(key)
        self.ids += len(ids) // self._width
        if self._size >= BLOCK:
            self._flush()

    def _flush(self) -> None:
        if self._count:
            packed = self._zip.compress(b"".join(self._block))
            self._out.write(packed)
            self._index.append((self._last, self._at, len(packed), self._count, zlib.crc32(packed)))
            self._at += len(packed)
            self._block, self._size, self._count = [], 0, 0

    def close(self) -> int:
        self._flush()
        index = b"".join(_varint(len(k)) + k + struct.pack("<QIII", at, size, n, crc) for k, at, size, n, crc in self._index)
        bits = max(64, len(self._keys) * BLOOM_BITS)
        bloom = bytearray(-(-bits // 8))
        for k in self._keys:
            for p in _bloom_places(k, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        tail = index + struct.pack("<Q", bits) + bytes(bloom)
        self._out.write(tail)
        self._out.write(FOOTER.pack(self._at, len(index), self._at + len(index), len(tail) - len(index), len(self._keys), self.ids, zlib.crc32(tail), self._width, MAGIC))
        return len(self._keys)


class Reader:
    """One shard: scan in order, or look a key up by filter, index and one block."""

    def __init__(self, file):
        self._file = file
        size = file.size()
        file.seek(size - FOOTER.size)
        i_at, i_size, b_at, b_size, self.entries, self.ids, crc, self.width, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        file.seek(i_at)
        tail = file.read(i_size + b_size)
        if zlib.crc32(tail) != crc:
            raise ValueError("damaged index or filter")
        self.index, i = [], 0
        while i < i_size:
            n, i = _read_varint(tail, i)
            self.index.append((tail[i : i + n], *struct.unpack_from("<QIII", tail, i + n)))
            i += n + 20
        self._last = [x[0] for x in self.index]
        self._bits = struct.unpack_from("<Q", tail, i_size)[0]
        self._bloom = tail[i_size + 8 :]

    def _block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        import zstandard

        _, at, size, n, crc = self.index[i]
        self._file.seek(at)
        packed = self._file.read(size)
        if zlib.crc32(packed) != crc:
            raise ValueError("damaged block")
        b, p, key = zstandard.ZstdDecompressor().decompress(packed), 0, b""
        for _ in range(n):
            shared, p = _read_varint(b, p)
            rest, p = _read_varint(b, p)
            size, p = _read_varint(b, p)
            key = key[:shared] + b[p : p + rest]
            p += rest
            yield key, b[p : p + size]
            p += size

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.index)):
            yield from self._block(i)

    def get(self, key: bytes) -> list[bytes]:
        """The values of a key: none, or several if rows repeat it."""
        if not all(self._bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(key, self._bits)):
            return []
        found, i = [], bisect_left(self._last, key)
        while i < len(self.index):
            found += [v for k, v in self._block(i) if k == key]
            if self._last[i] != key:
                break
            i += 1
        return found


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of every whole text, with end_id after each, to shards below ``path``; returns the manifest.

    Shards are ranges of (identifier, hash of the text), so that one identifier on many rows is spread as well; each is
    sorted by (identifier, text), nulls first.  A null text counts as empty.  Repeated rows are all kept.  An empty
    table gives a manifest without shards.  ``tokenizer`` is the path of a tokenizer file that every executor has.
    """
    spark = docs.sparkSession
    ship(spark)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(shards, "id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"), "text")

    def write(batches):
        encode, fs, out, writer, first = encoder(tokenizer), None, None, None, None
        shard = TaskContext.get().partitionId()
        end = np.array([end_id], f"<u{encode.width}").tobytes()
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                if writer is None:
                    fs, top = filesystem(path)
                    fs.create_dir(top, recursive=True)
                    name = f"{top}/shard-{shard:06d}.sst"
                    temporary = f"{name}.{TaskContext.get().taskAttemptId()}.tmp"
                    out = fs.open_output_stream(temporary)
                    writer, first = Writer(out, encode.width), key_of(doc)
                writer.add(last := key_of(doc), encode(text.as_py()) + end)
        encode.rest()
        if writer:
            entries = writer.close()
            out.close()
            fs.move(temporary, name)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [f"{path}/shard-{shard:06d}.sst"], "entries": pa.array([entries], pa.int64()), "ids": pa.array([writer.ids], pa.int64()), "first": pa.array([first], pa.binary()), "last": pa.array([last], pa.binary())})

    return store(rows, f"{path}/manifest", write, "shard int, path string, entries long, ids long, first binary, last binary", batch=250)


def read_tokens(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the shards, from the files."""
    spark, at, rows = manifest.sparkSession, 0, []
    for r in manifest.orderBy("shard").collect():  # one row for each file
        rows.append((r.path, at))
        at += r.ids

    def read(batches):
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, name = filesystem(path)
                with fs.open_input_file(name) as f:
                    shard, cols = Reader(f), ([], [], [], [])
                    for key, ids in shard:
                        values = np.frombuffer(ids, f"<u{shard.width}").astype("<u4")
                        for col, x in zip(cols, (id_of(key), start, len(values), zlib.crc32(values.tobytes()))):
                            col.append(x)
                        start += len(values)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.createDataFrame(rows, "path string, start long")
    return files.repartition(max(1, len(rows))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, doc_id: int | None) -> list[list[int]]:
    """The ids of a document (one list for each row that has the identifier), by binary search in the files."""
    key, found = key_of(doc_id), []
    for r in manifest.where((F.col("first") <= F.lit(key)) & (F.col("last") >= F.lit(key))).orderBy("shard").collect():
        fs, name = filesystem(r.path)
        with fs.open_input_file(name) as f:
            shard = Reader(f)
            found += [np.frombuffer(v, f"<u{shard.width}").tolist() for v in shard.get(key)]
    return found


def op4_sstable_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_tokens(write_tokens(docs, new_dir(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json"), end_id=2))


QUERIES = {"op4_sstable_tokens": op4_sstable_tokens}
