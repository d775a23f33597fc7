"""JPEG images read as a decoder reads them, for their size, their channels and whether they decode.

A sequential image's scans are decoded to the last block, without the transform. Of a progressive image only the
segments are read, not its scans.
"""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESULT = T.StructType().add("width", "long").add("height", "long").add("channels", "integer").add("error", "string")


def _codes(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    """(bits, code) -> symbol."""
    out, code, at = {}, 0, 0
    for bits, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            out[bits, code] = s
            code += 1
        at, code = at + n, code << 1
    return out


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def take(self, n: int) -> int:
        while self.n < n:
            if self.at >= len(self.data):
                raise ValueError("short Huffman data")
            self.held, self.n, self.at = (self.held << 8 | self.data[self.at]) & 0xFFFFFFFF, self.n + 8, self.at + 1
        self.n -= n
        return self.held >> self.n & (1 << n) - 1

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for bits in range(1, 17):
            code = code << 1 | self.take(1)
            if (bits, code) in codes:
                return codes[bits, code]
        raise ValueError("bad Huffman code")

    def block(self, dc: dict, ac: dict) -> None:
        size = self.symbol(dc)
        if size > 16:
            raise ValueError("excessive DC component")
        self.take(size)
        k = 1
        while k < 64:
            run, size = divmod(self.symbol(ac), 16)
            if size:
                k += run
                if k > 63:
                    break
                self.take(size)
                k += 1
            elif run != 15:
                break
            else:
                k += 16


def _scan(data: bytes, at: int, units: int, blocks: list[tuple[dict, dict]], interval: int) -> int:
    """Decode units groups of blocks from at; the place after the scan's data."""
    left, nth = units, 0
    while True:
        end = at
        while (end := data.index(b"\xff", end)) + 1 < len(data) and data[end + 1] == 0:
            end += 2
        bits = _Bits(data[at:end].replace(b"\xff\x00", b"\xff"))
        n = min(left, interval or left)
        for _ in range(n):
            for dc, ac in blocks:
                bits.block(dc, ac)
        left -= n
        if not left:
            return end
        if data[end + 1] != 0xD0 + nth % 8:
            raise ValueError("bad RST marker")
        at, nth = end + 2, nth + 1


def _ceil(a: int, b: int) -> int:
    return -(-a // b)


def read_jpeg(data: bytes) -> tuple[int, int, int]:
    """(width, height, channels); ValueError or IndexError where it does not decode."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("missing SOI marker")
    at, frame, scanned, interval = 2, None, False, 0
    parts: dict[int, tuple[int, int]] = {}
    tables: dict[tuple[int, int], dict] = {}
    width = height = 0
    while True:
        at = data.index(b"\xff", at)
        while data[at] == 0xFF:
            at += 1
        marker, at = data[at], at + 1
        if marker == 0xD9:
            if not scanned:
                raise ValueError("missing SOS marker")
            return width, height, len(parts)
        if marker == 0 or 0xD0 <= marker <= 0xD7:
            continue
        size = int.from_bytes(data[at : at + 2])
        body = data[at + 2 : at + size]
        if size < 2 or len(body) != size - 2:
            raise ValueError("short segment")
        at += size
        if marker in (0xC0, 0xC1, 0xC2):
            if frame is not None:
                raise ValueError("multiple SOF markers")
            if body[0] != 8 or body[5] not in (1, 3, 4) or len(body) != 6 + 3 * body[5]:
                raise ValueError("unsupported frame")
            frame, height, width = marker, int.from_bytes(body[1:3]), int.from_bytes(body[3:5])
            parts = {body[i]: divmod(body[i + 1], 16) for i in range(6, len(body), 3)}
            if len(parts) != body[5] or any(not (1 <= h <= 4 and 1 <= v <= 4) for h, v in parts.values()):
                raise ValueError("bad components")
            if len(parts) == 1:
                parts = dict.fromkeys(parts, (1, 1))
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                if len(body) < 17 + n:
                    raise ValueError("short Huffman table")
                tables[divmod(body[0], 16)] = _codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            interval = int.from_bytes(body)
        elif marker == 0xDA:
            if frame is None:
                raise ValueError("missing SOF marker")
            scanned, n = True, body[0]
            if not 1 <= n <= len(parts) or len(body) != 4 + 2 * n:
                raise ValueError("bad scan")
            if any(body[1 + 2 * i] not in parts for i in range(n)):
                raise ValueError("unknown component")
            if frame == 0xC2:
                continue
            hs, vs = max(h for h, _ in parts.values()), max(v for _, v in parts.values())
            blocks = []
            for i in range(n):
                h, v = parts[body[1 + 2 * i]]
                dc, ac = divmod(body[2 + 2 * i], 16)
                if (0, dc) not in tables or (1, ac) not in tables:
                    raise ValueError("uninitialized Huffman table")
                blocks += [(tables[0, dc], tables[1, ac])] * (h * v if n > 1 else 1)
            if n > 1:
                units = _ceil(width, 8 * hs) * _ceil(height, 8 * vs)
            else:
                units = _ceil(_ceil(width * h, hs), 8) * _ceil(_ceil(height * v, vs), 8)
            at = _scan(data, at, units, blocks, interval) if units else at
        elif not (marker == 0xDB or 0xE0 <= marker <= 0xEF or marker == 0xFE):
            raise ValueError("unknown marker")


@F.pandas_udf(RESULT)
def jpeg_of(content: pd.Series) -> pd.DataFrame:
    def one(data: bytes | None) -> tuple:
        try:
            return (*read_jpeg(bytes(data or b"")), None)
        except (ValueError, IndexError) as e:
            return None, None, None, str(e) or "short data"

    return pd.DataFrame([one(x) for x in content], columns=RESULT.names).astype({"width": "Int64", "height": "Int64", "channels": "Int32"})


@F.pandas_udf(T.BooleanType())
def image_header(data: pd.Series) -> pd.Series:
    """Whether the header of a JPEG, PNG or GIF image states a size; null for other data."""

    def stated(b: bytes | None) -> bool | None:
        b = b or b""
        if b[:8] == b"\x89PNG\r\n\x1a\n":
            return len(b) >= 33 and b[12:16] == b"IHDR" and zlib.crc32(b[12:29]) == int.from_bytes(b[29:33]) and all(int.from_bytes(b[i : i + 4]) for i in (16, 20))
        if b[:4] == b"GIF8":
            return len(b) >= 13
        if b[:2] != b"\xff\xd8":
            return None
        at = 2
        while at + 4 <= len(b) and b[at] == 255:
            marker, size = b[at + 1], int.from_bytes(b[at + 2 : at + 4])
            if marker in (0xC0, 0xC1, 0xC2):
                return size >= 8 and len(b) >= at + 2 + size
            if marker == 0xDA:
                break
            at += 1 if marker == 255 else 2 + size
        return False

    return data.map(stated)
