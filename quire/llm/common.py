"""Shared helpers: tables and files in the folder that all machines see, splits."""

from __future__ import annotations

import posixpath
import uuid
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import shared_dir, written

__all__ = ["files_of", "read_file", "shared_dir", "split_of", "stored", "write_file"]


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    return written(df, name, codec)


def files_of(uri: str):
    """(filesystem, path) of a URI; pyarrow opens local, HDFS and object stores alike."""
    from pyarrow import fs

    if not urlsplit(uri).scheme:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, parts) -> int:
    """Write the byte strings in parts to a hidden name, then move it into place; return the length.

    A repeated or speculative attempt leaves one whole file, never a torn one.
    """
    store, path = files_of(uri)
    store.create_dir(posixpath.dirname(path), recursive=True)
    hidden = posixpath.join(posixpath.dirname(path), f".{posixpath.basename(path)}.{uuid.uuid4().hex}")
    size = 0
    with store.open_output_stream(hidden, compression=None) as out:
        for part in parts:
            out.write(part)
            size += len(part)
    store.move(hidden, path)
    return size


def read_file(uri: str, offset: int = 0, length: int | None = None) -> bytes:
    store, path = files_of(uri)
    with store.open_input_file(path) as f:
        f.seek(offset)
        return f.read() if length is None else f.read(length)


def split_of(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n
