"""Files of any scheme as byte streams, for readers that run on executors, and what a file looks like."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow.fs as pafs
from ..storage import filesystem

GZIP = b"\x1f\x8b"


def exists(uri: str) -> bool:
    fs, path = filesystem(uri)
    return fs.get_file_info(path).type == pafs.FileType.File


def size(uri: str) -> int:
    fs, path = filesystem(uri)
    info = fs.get_file_info(path)
    if info.type != pafs.FileType.File:
        raise FileNotFoundError(uri)
    return info.size


def head(uri: str, n: int = 1024) -> bytes:
    fs, path = filesystem(uri)
    with fs.open_input_stream(path, compression=None) as f:
        return f.read(n)


def is_gzip(uri: str) -> bool:
    """By the first two bytes, whatever the name."""
    return head(uri, 2) == GZIP


def opened(uri: str):
    """A binary stream of the file's content, gunzipped if need be."""
    fs, path = filesystem(uri)
    zipped = is_gzip(uri)
    raw = fs.open_input_stream(path, compression=None)
    return gzip.GzipFile(fileobj=raw) if zipped else io.BufferedReader(raw) if not hasattr(raw, "read1") else raw


def pieces(uri: str, n: int = 1 << 22) -> Iterator[bytes]:
    with opened(uri) as f:
        while piece := f.read(n):
            yield piece


def guess_filetype(data: bytes) -> str:
    """``numeric``, ``text`` or ``binary`` from a file's first bytes.

    Numeric: white space, digits, e, - and + alone.  Binary: control characters other than white space, or more than a
    quarter of the bytes beyond ASCII.
    """
    if not data:
        return "text"
    if all(b in b" \t\r\n0123456789e-+." for b in data):
        return "numeric"
    if any(b <= 0x10 and b not in b"\t\r\n" for b in data) or sum(b > 127 for b in data) * 4 > len(data):
        return "binary"
    return "text"
