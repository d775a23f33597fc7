"""Token ids in a wavelet matrix per shard: one compressed file that answers rank and select.

A shard holds the ids of a run of documents, in ascending doc_id. Bit-plane k (from the highest bit)
holds that bit of every id in the order left by the planes above it, zeros moved before ones. With a
count of ones before each block, a plane answers rank and select, and with them the file answers token
access, counting and occurrence lookup without being unpacked.

Defined results: null and empty texts have only the end id. A null doc_id sorts first. Rows that repeat a
doc_id are kept, ordered by text. An empty table gives no shard and no row. Other columns are ignored.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.bpe import loaded
from quire.llm.common import read_file, shared_dir, stored, write_file

MAGIC = b"QWM2"
BLOCK = 1 << 16  # bits of a plane that are compressed together and counted together
SHARD_TOKENS = 1 << 22  # a shard is closed once it holds so many; one document is never split


def build(ids: np.ndarray, bits: int) -> tuple[list[np.ndarray], list[int]]:
    """Bit-planes as booleans from the highest bit, and the zeros in each."""
    planes, zeros, a = [], [], ids
    for k in range(bits - 1, -1, -1):
        ones = (a & a.dtype.type(1 << k)).astype(bool)
        planes.append(ones)
        zeros.append(len(a) - int(np.count_nonzero(ones)))
        if k and 0 < zeros[-1] < len(a):
            a = _parted(a, ones, zeros[-1])
    return planes, zeros


def _parted(a: np.ndarray, ones: np.ndarray, zeros: int) -> np.ndarray:
    """a with what stands at zeros before what stands at ones, block by block, as a block stays in the processor's cache."""
    out, low, high = np.empty_like(a), 0, zeros
    for i in range(0, len(a), BLOCK):
        part, bits = a[i : i + BLOCK], ones[i : i + BLOCK]
        up = np.flatnonzero(bits)
        n = len(part) - len(up)
        part.take(np.flatnonzero(~bits), out=out[low : low + n], mode="clip")
        part.take(up, out=out[high : high + len(up)], mode="clip")
        low, high = low + n, high + len(up)
    return out


def packed(ids: np.ndarray, docs: list[tuple[int | None, int]], bits: int) -> bytes:
    """The file: magic, header length, header (JSON), document table, then the planes' blocks."""
    planes, zeros = build(ids, bits)
    compress = zstandard.ZstdCompressor(level=1).compress
    blocks, ends, ones, at = [], [], [], 0
    for plane in planes:
        before, end, count = [], [], 0
        for i in range(0, len(plane), BLOCK):
            part = plane[i : i + BLOCK]
            blocks.append(compress(np.packbits(part, bitorder="little").tobytes()))
            before.append(count)
            count += int(np.count_nonzero(part))
            at += len(blocks[-1])
            end.append(at)
        ends.append(end)
        ones.append(before)
    table = compress(b"".join(struct.pack("<?qQ", d is None, d or 0, n) for d, n in docs))
    head = json.dumps({"n": len(ids), "bits": bits, "zeros": zeros, "ends": ends, "ones": ones, "docs": len(docs), "table": len(table)}, separators=(",", ":")).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, table, *blocks])


class WaveletMatrix:
    """A file of packed(), queried in place: a block is unpacked when a query needs it."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token shard")
        size = struct.unpack_from("<I", data, 4)[0]
        head = json.loads(data[8 : 8 + size])
        self.n, self.bits, self.zeros, self.ends, self.ones = (head[k] for k in ("n", "bits", "zeros", "ends", "ones"))
        self.unpack = zstandard.ZstdDecompressor().decompress
        table = self.unpack(data[8 + size : 8 + size + head["table"]])
        self.docs = [(None if null else d, n) for null, d, n in struct.iter_unpack("<?qQ", table)]
        self.body = memoryview(data)[8 + size + head["table"] :]
        self.cached: dict[tuple[int, int], np.ndarray] = {}

    def block(self, k: int, j: int) -> np.ndarray:
        start = self.ends[k][j - 1] if j else self.ends[k - 1][-1] if k else 0
        raw = self.unpack(self.body[start : self.ends[k][j]])
        return np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little", count=min(BLOCK, self.n - j * BLOCK)).view(bool)

    def _block(self, k: int, j: int) -> np.ndarray:
        if (k, j) not in self.cached:
            if len(self.cached) >= 64:
                self.cached.clear()
            self.cached[k, j] = self.block(k, j)
        return self.cached[k, j]

    def rank1(self, k: int, i: int) -> int:
        """Ones of plane k before position i."""
        j, r = divmod(i, BLOCK)
        if not r:
            return self.ones[k][j] if j < len(self.ones[k]) else self.n - self.zeros[k]
        return self.ones[k][j] + int(np.count_nonzero(self._block(k, j)[:r]))

    def select(self, k: int, bit: int, r: int) -> int:
        """Position in plane k of the r-th (from 0) such bit."""
        lo, hi = 0, len(self.ones[k]) - 1
        before = (lambda j: self.ones[k][j]) if bit else (lambda j: j * BLOCK - self.ones[k][j])
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if before(mid) <= r else (lo, mid - 1)
        return lo * BLOCK + int(np.flatnonzero(self._block(k, lo) == bool(bit))[r - before(lo)])

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k in range(self.bits):
            j, r = divmod(i, BLOCK)
            bit, ones = bool(self._block(k, j)[r]), self.rank1(k, i)
            value = value << 1 | bit
            i = self.zeros[k] + ones if bit else i - ones
        return value

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        for k in range(self.bits):
            a, b = self.rank1(k, lo), self.rank1(k, hi)
            lo, hi = (self.zeros[k] + a, self.zeros[k] + b) if token >> self.bits - 1 - k & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of token at positions lo to hi (exclusive)."""
        lo, hi = max(lo, 0), self.n if hi is None else min(hi, self.n)
        if token < 0 or token >> self.bits or lo >= hi:
            return 0
        a, b = self._range(token, lo, hi)
        return b - a

    def occurrence(self, token: int, r: int) -> int:
        """Position of the r-th (from 0) occurrence of token."""
        if not 0 <= r < self.count(token):
            raise IndexError(r)
        i = self._range(token, 0, self.n)[0] + r
        for k in range(self.bits - 1, -1, -1):
            bit = token >> self.bits - 1 - k & 1
            i = self.select(k, bit, i - self.zeros[k] if bit else i)
        return i

    def all(self) -> np.ndarray:
        """Every id in order: the planes undone from the lowest."""
        a = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for k in range(self.bits - 1, -1, -1):
            a[self.zeros[k] :] |= a.dtype.type(1 << self.bits - 1 - k)
            whole, low, high = np.empty_like(a), 0, self.zeros[k]
            for j in range(len(self.ends[k])):
                bits = self.block(k, j)
                part, up = whole[j * BLOCK : j * BLOCK + len(bits)], np.flatnonzero(bits)
                n = len(bits) - len(up)
                part[np.flatnonzero(~bits)], part[up] = a[low : low + n], a[high : high + len(up)]
                low, high = low + n, high + len(up)
            a = whole
        return a


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, folder: str, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode docs(doc_id, text), write shard files into folder; a stored row for each: part, seq, path, n_tokens.

    (part, seq) is the shards' order. Each shard is written by one task from a range of doc_id.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, part, seq, held, table, size = loaded(tokenizer), TaskContext.get().partitionId(), 0, [], [], 0
        bits = max(bpe.whole.get_vocab_size(), end_id + 1).bit_length()
        kind = np.uint16 if bits <= 16 else np.uint32

        def close() -> pa.RecordBatch:
            path = f"{folder}/shard-{part:06d}-{seq:04d}.qwm"
            ids = np.concatenate(held)
            write_file(path, [packed(ids, table, bits)])
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "path": [path], "n_tokens": [len(ids)]}, pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_tokens", pa.int64())]))

        for batch in batches:
            for doc_id, ids in zip(batch.column(0), bpe.encode_all(x.as_py() for x in batch.column(1)), strict=True):
                held.append(np.append(ids, end_id).astype(kind))
                table.append((doc_id.as_py(), len(held[-1])))
                size += len(held[-1])
                if size >= shard_tokens:
                    yield close()
                    seq, held, table, size = seq + 1, [], [], 0
        if held:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(write, "part int, seq int, path string, n_tokens long"), "shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """A row for each document, from the files: doc_id, start, n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = WaveletMatrix(read_file(path))
                ids = shard.all()
                size = np.array([n for _, n in shard.docs], np.int64)
                starts = np.concatenate([[0], np.cumsum(size)[:-1]])
                crcs = [zlib.crc32(ids[a : a + n].astype("<u4").tobytes()) for a, n in zip(starts, size, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in shard.docs], pa.int64()), pa.array(starts + at), pa.array(size), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # One row a shard: its running total is a small window, whatever the corpus' size in documents.
    before = F.sum("n_tokens").over(W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1))
    placed = shards.select("path", F.coalesce(before, F.lit(0)).alias("at"))
    n = max(1, int(shards.count()))
    return placed.repartition(n, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_shards(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write docs as wavelet-matrix shards into the shared folder and read the files back."""
    return read_shards(write_shards(docs, tokenizer, end_id, shared_dir(spark, "tokens")))
