"""Media columns as MPEG transport streams: multiplex bytes, store the streams, demultiplex and describe them.

A stream carries one program. Program tables (PAT, PMT) precede every access unit; an access unit is one
PES packet of at most UNIT bytes with a presentation timestamp, and its first transport packet has a clock
reference and the random-access flag. Samples are 8-bit, RATE a second. Reading checks the tables' CRCs,
every sync byte and every continuity counter, and reassembles the elementary stream from its PES packets.

Defined results: a null text counts as empty; an empty payload is padded to 64 zero bytes; rows are kept
one for one whatever doc_id holds (null and repeated ids too); an empty table gives no rows; other columns
are ignored. A damaged stream is described, not fatal: errors are counted and damaged units are left out.
Texts are taken whole, however long: a task holds one stream and what is reassembled from it.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import stored

PACKET = 188
UNIT = 16_384
RATE = 8_000
PMT_PID, DATA_PID, PROGRAM = 0x1000, 0x100, 1
STREAM_TYPE, STREAM_ID = 0x06, 0xBD  # private data in PES packets
BATCH_BYTES = 8 << 20


@lru_cache(maxsize=1)
def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


def section_crc(data: bytes) -> int:
    """The CRC of program tables; 0 over a section that ends in its own."""
    table, c = _crc_table(), 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ table[c >> 24 ^ b]
    return c


def _section(table_id: int, ident: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | 5 + len(body) + 4, ident, 0xC1, 0, 0) + body
    return head + struct.pack(">I", section_crc(head))


@lru_cache(maxsize=1)
def _tables() -> tuple[bytes, bytes]:
    """Payloads of the PAT's and the PMT's packets."""
    pat = _section(0x00, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID))
    pmt = _section(0x02, PROGRAM, struct.pack(">HHBHH", 0xE000 | DATA_PID, 0xF000, STREAM_TYPE, 0xE000 | DATA_PID, 0xF000))
    return tuple((b"\0" + s).ljust(PACKET - 4, b"\xff") for s in (pat, pmt))


def _stamp(mark: int, t: int) -> bytes:
    """A 33-bit timestamp in five bytes."""
    return struct.pack(">BHH", mark << 4 | (t >> 30 & 7) << 1 | 1, (t >> 15 & 0x7FFF) << 1 | 1, (t & 0x7FFF) << 1 | 1)


@lru_cache(maxsize=64)
def _head(pid: int, start: bool, adapted: bool, counter: int) -> bytes:
    return struct.pack(">BHB", 0x47, start << 14 | pid, 0x10 | adapted << 5 | counter)


def mux(payload: bytes) -> bytes:
    """The transport stream of a payload."""
    pat, pmt = _tables()
    out, counter = [], 0
    for n, at in enumerate(range(0, len(payload), UNIT)):
        out += [_head(0, True, False, n & 15), pat, _head(PMT_PID, True, False, n & 15), pmt]
        chunk = payload[at : at + UNIT]
        t = at * 90_000 // RATE & (1 << 33) - 1
        pes = struct.pack(">IHBBB", 0x100 | STREAM_ID, 8 + len(chunk), 0x84, 0x80, 5) + _stamp(2, t) + chunk
        room = min(PACKET - 12, len(pes))
        clock = bytes([0x50]) + struct.pack(">IH", t >> 1, (t & 1) << 15 | 0x7E00)
        out += [_head(DATA_PID, True, True, counter), bytes([183 - room]), clock, b"\xff" * (176 - room), pes[:room]]
        counter = counter + 1 & 15
        last = room + (len(pes) - room) // 184 * 184
        for i in range(room, last, 184):
            out += [_head(DATA_PID, False, False, counter), pes[i : i + 184]]
            counter = counter + 1 & 15
        if rest := len(pes) - last:
            stuffing = bytes([183 - rest]) + (b"\0" + b"\xff" * (182 - rest) if rest < 183 else b"")
            out += [_head(DATA_PID, False, True, counter), stuffing, pes[last:]]
            counter = counter + 1 & 15
    return b"".join(out)


def demux(stream: bytes) -> dict:
    """What a stream holds: payload, timestamps and byte offsets of its access units, counts and errors."""
    programs: dict[int, int] = {}
    streams: dict[int, int] = {}
    counters: dict[int, int] = {}
    units: list[list[bytes]] = []
    access: list[int] = []
    errors = {"sync": 0, "continuity": 0, "crc": 0, "unit": 0}
    whole = True  # no packet of the open unit is missing
    found: list[tuple[int, bytes]] = []

    def close() -> None:
        if not units:
            return
        pes = b"".join(units.pop())
        if not whole or len(pes) < 14 or pes[:3] != b"\0\0\1" or struct.unpack_from(">H", pes, 4)[0] != len(pes) - 6 or pes[7] >> 6 < 2:
            errors["unit"] += 1
            return
        a, b, c = struct.unpack_from(">BHH", pes, 9)
        found.append(((a >> 1 & 7) << 30 | b >> 1 << 15 | c >> 1, pes[9 + pes[8] :]))

    def table(body: bytes) -> bytes | None:
        section = body[1 + body[0] :]
        section = section[: 3 + (struct.unpack_from(">H", section, 1)[0] & 0xFFF)]
        if section_crc(section):
            errors["crc"] += 1
            return None
        return section[8:-4] if section[0] == 0 else section[12 + (struct.unpack_from(">H", section, 10)[0] & 0xFFF) : -4]

    for at in range(0, len(stream), PACKET):
        packet = stream[at : at + PACKET]
        if len(packet) < PACKET or packet[0] != 0x47:
            errors["sync"] += 1
            continue
        pid, flags = (packet[1] & 0x1F) << 8 | packet[2], packet[3]
        start, counter = packet[1] & 0x40, flags & 15
        if not flags & 0x10:
            continue
        kept = pid not in counters or counters[pid] + 1 & 15 == counter
        counters[pid] = counter
        if not kept:
            errors["continuity"] += 1
        body = 4
        random_access = False
        if flags & 0x20:
            body += 1 + packet[4]
            random_access = packet[4] > 0 and bool(packet[5] & 0x40)
        if pid == 0 or pid in programs.values():
            if start and (rows := table(packet[body:])) is not None:
                if pid == 0:
                    programs |= {p: q & 0x1FFF for p, q in struct.iter_unpack(">HH", rows)}
                else:
                    while len(rows) >= 5:
                        kind, where, more = struct.unpack_from(">BHH", rows)
                        streams[where & 0x1FFF] = kind
                        rows = rows[5 + (more & 0xFFF) :]
        elif pid in streams:
            if start:
                close()
                units.append([])
                whole = True
                if random_access:
                    access.append(at)
            elif not kept:
                whole = False
            if units:
                units[-1].append(packet[body:])
    close()
    return {
        "payload": b"".join(x for _, x in found), "pts": [t for t, _ in found], "unit_bytes": [len(x) for _, x in found], "random_access": access,
        "packets": len(stream) // PACKET, "programs": programs, "streams": streams, "errors": errors,
    }


def padded(text: str | None) -> tuple[int, bytes]:
    """Bytes of a text, and them padded to a positive multiple of 64."""
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


def feature_of(found: dict) -> str:
    """The stream's shape in a few numbers, as JSON: of the timestamps and the random-access points above all."""
    x = found["payload"]
    return json.dumps(
        {
            "packets": found["packets"], "units": len(found["pts"]), "first_pts": found["pts"][0] if found["pts"] else None, "last_pts": found["pts"][-1] if found["pts"] else None,
            "access_points": found["random_access"][:1] + found["random_access"][1:][-1:], "n_access_points": len(found["random_access"]), "programs": len(found["programs"]),
            "duration_ms": len(x) * 1000 // RATE, "zero_bytes": x.count(0), "spaces": x.count(32), "errors": sum(found["errors"].values()),
        },
        separators=(",", ":"),
    )


def to_media(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, media (a transport stream)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                n, payload = padded(text.as_py())
                rows.append((doc_id.as_py(), n, mux(payload)))
                size += len(rows[-1][2])
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(write, "doc_id long, n_bytes long, media binary")


def describe(media: DataFrame) -> DataFrame:
    """media(doc_id, n_bytes, media) -> digests of what was read back, and features."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pts", "access_points"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, n, media in zip(*batch.columns, strict=True):
                stream = media.as_py()
                found = demux(stream)
                x = found["payload"]
                rows.append((doc_id.as_py(), n.as_py(), len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-64:]), len(stream), hashlib.sha256(stream).hexdigest(), feature_of(found), found["pts"], found["random_access"]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pts array<long>, access_points array<long>"
    )


def media_columns(docs: DataFrame) -> DataFrame:
    """Store every text as a transport stream in the shared folder, read the streams back and describe them."""
    return describe(stored(to_media(docs), "media"))
