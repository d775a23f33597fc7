"""WARC archives with a capture index merged from sorted runs.

Writing: each task writes archives of gzip members, one record each. Of equal payloads of at least
MIN_PAYLOAD bytes the one with the smallest page_id is a response, the others are revisits of it.
Reading: each archive is read back record by record, digests are recomputed, and its captures are sorted
by (URL key, timestamp, page_id) into a run: a file of small compressed blocks.
Merging: while there are more than FAN runs, groups of them are merged into longer ones. Then the key space is
cut into ranges at keys of blocks; a task per range merges the runs' blocks of that range. Either merge is a
loser tree that reads one block of each run at a time, so a task holds FAN blocks, whatever the corpus. The
result is globally ordered by range. Keys hold timestamp and page_id, so one busy URL is cut into ranges as well.

Defined results: a null html is an empty payload. A null url has the key "-". A null page_id is a
response and is never referred to. Rows that repeat a page_id with the same payload have the same type.
An empty table gives no archive and no row. Other columns are ignored. Pages are taken whole, however long: a
task holds one record at a time besides the compressed records of an archive.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import zlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime, timedelta
from itertools import chain
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import files_of, read_file, shared_dir, stored, write_file

MIN_PAYLOAD = 100
ARCHIVE_BYTES = 64 << 20  # of payload and heads, after which a task starts another archive
RECORD_BYTES = 512  # of a record's head, about
RUN_BLOCK = 256  # captures of a run that are compressed together
FAN = 256  # runs that one loser tree merges
MERGE_ROWS = 100_000  # captures of a merge range, about
SPLIT_KEYS = 10_000  # block keys that the driver sees at most when it cuts ranges; only balance depends on it
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """Host labels reversed, then path and query: captures of a site sort together."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return quote(url, safe="")
    tail = (parts.path or "/") + ("?" + parts.query if parts.query else "")
    return f"{','.join(reversed(host.split('.')))}{f':{port}' if port else ''}){tail}".lower()


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, compressed as a gzip member. A revisit holds the response's HTTP head, no payload."""
    date = (EPOCH + timedelta(seconds=(page_id or 0) % 3_000_000_000)).strftime("%Y-%m-%dT%H:%M:%SZ")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}"]
    head.append(f"WARC-Record-ID: <urn:x-page:{'none' if page_id is None else page_id}>")
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=_URL_SAFE)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


_URL_SAFE = "".join(map(chr, range(33, 127)))


def members(path: str) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member of a file, read in pieces."""
    store, name = files_of(path)
    with store.open_input_stream(name, compression=None) as f:
        at, start, z, out = 0, 0, zlib.decompressobj(31), []
        rest = b""
        while data := rest or f.read(1 << 16):
            out.append(z.decompress(data))
            rest = z.unused_data
            at += len(data) - len(rest)
            if z.eof:
                yield start, at - start, b"".join(out)
                start, z, out = at, zlib.decompressobj(31), []
        if out:
            raise ValueError(f"{path}: the last record is cut off")


def parsed(content: bytes) -> dict:
    """Fields of a record; the payload of a response is digested anew and must equal the digest stated."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = int(next(v for k, v in (line.split(": ", 1) for line in http.decode().split("\r\n")[1:]) if k == "Content-Length"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != stated or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload differs from its digest")
    page = lambda x: None if x is None or x == "<urn:x-page:none>" else int(x[12:-1])
    return {
        "page_id": page(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "date": fields["WARC-Date"], "record_type": kind,
        "payload": payload, "payload_bytes": stated, "payload_digest": digest, "refers_to": page(fields.get("WARC-Refers-To")),
    }


class LoserTree:
    """Merges k sorted iterators: each step replays one leaf's path, with one comparison a level."""

    def __init__(self, runs: Iterable[Iterator]):
        self.runs = list(runs)
        k = len(self.runs)
        self.heads = [next(r, None) for r in self.runs]
        self.losers = [-1] * max(k, 1)  # inner nodes; losers[0] is the winner
        for leaf in range(k):
            self._enter(leaf)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and (x[0], a) < (y[0], b)

    def _enter(self, leaf: int) -> None:
        """First round: a leaf waits at the first free node above it, else it plays on."""
        node, winner = (leaf + len(self.runs)) // 2, leaf
        while node:
            if self.losers[node] < 0:
                self.losers[node] = winner
                return
            if self._less(self.losers[node], winner):
                self.losers[node], winner = winner, self.losers[node]
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator:
        k = len(self.runs)
        while k and self.heads[w := self.losers[0]] is not None:
            yield self.heads[w]
            self.heads[w] = next(self.runs[w], None)
            node, winner = (w + k) // 2, w
            while node:
                if self._less(self.losers[node], winner):
                    self.losers[node], winner = winner, self.losers[node]
                node //= 2
            self.losers[0] = winner


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """pages(page_id, url, html) -> archive files; a stored row for each file: path, records, bytes."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            path = f"{folder}/part-{part:06d}-{seq:04d}.warc.gz"
            length = write_file(path, held)
            return pa.RecordBatch.from_pydict({"path": [path], "records": [len(held)], "bytes": [length]})

        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*batch.columns, strict=True):
                payload = (html.as_py() or "").encode()
                held.append(record(page_id.as_py(), url.as_py(), payload, len(payload), digest.as_py(), refers_to.as_py()))
                size += len(payload) + RECORD_BYTES
                if size >= ARCHIVE_BYTES:
                    yield close()
                    seq, held, size = seq + 1, [], 0
        if held:
            yield close()

    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    # Only ids and digests are grouped and joined; payloads move once, by page_id, so a payload with very many copies stays spread.
    light = rows.where(F.octet_length("html") >= MIN_PAYLOAD).where(F.col("page_id").isNotNull()).select("page_id", "digest")
    firsts = light.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("last > refers_to").drop("last")
    revisits = light.join(firsts, "digest").where("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()
    typed = rows.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to")
    return stored(typed.mapInArrow(write, "path string, records long, bytes long"), "archives")


_CAPTURE = "url_key string, timestamp string, page_id long, archive string, offset long, length long, record_type string, payload_bytes long, payload_digest string, refers_to long"
_NAMES = [x.split()[0] for x in _CAPTURE.split(", ")]


def _key(row: list) -> list:
    """url_key, timestamp, page_id (null first), then the place, so that no two captures tie."""
    return [row[0], row[1], row[2] is not None, row[2] or 0, row[3], row[4]]


class RunWriter:
    """Writes sorted captures as a run's blocks and keeps their places."""

    def __init__(self, run: str):
        self.run, self.places, self.at = run, [], 0

    def blocks(self, rows: Iterable[list]) -> Iterator[bytes]:
        held: list[list] = []
        for row in chain(rows, [None]):
            if held and (row is None or len(held) == RUN_BLOCK):
                block = zlib.compress(json.dumps(held).encode(), 1)
                self.places.append((self.run, self.at, len(block), json.dumps(_key(held[0])), json.dumps(_key(held[-1])), len(held)))
                self.at += len(block)
                yield block
                held = []
            if row is not None:
                held.append(row)

    def write(self, rows: Iterable[list]) -> pa.RecordBatch:
        write_file(self.run, self.blocks(rows))
        columns = zip(*self.places, strict=True) if self.places else [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], [x.split()[0] for x in _BLOCK.split(", ")])


_BLOCK = "run string, offset long, length long, first string, last string, rows long"


def write_runs(archives: DataFrame, folder: str) -> DataFrame:
    """Read each archive back into one sorted run; a stored row for each block: run, offset, length, first and last key, rows."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for offset, length, content in members(path):
                    r = parsed(content)
                    stamp = r["date"].translate(str.maketrans("", "", "-T:Z"))
                    rows.append([url_key(r["url"]), stamp, r["page_id"], path, offset, length, r["record_type"], r["payload_bytes"], r["payload_digest"], r["refers_to"]])
                rows.sort(key=_key)
                yield RunWriter(f"{folder}/{path.rpartition('/')[2]}.run").write(rows)

    n = max(1, archives.count())
    return stored(archives.select("path").repartition(n, "path").mapInArrow(read, _BLOCK), "runs")


def captures_of(run: str, where: list[tuple[int, int]], low: list | None = None, high: list | None = None) -> Iterator[tuple[list, list]]:
    """(key, capture) of a run's blocks from key low to key high (exclusive), one block in memory."""
    for offset, length in where:
        for row in json.loads(zlib.decompress(read_file(run, offset, length))):
            key = _key(row)
            if (low is None or key >= low) and (high is None or key < high):
                yield key, row


def longer_runs(blocks: DataFrame, folder: str) -> DataFrame:
    """blocks of runs -> blocks of FAN runs at most: groups of runs are merged, in several passes if need be."""
    while (runs := blocks.select("run").distinct().count()) > FAN:
        groups = -(-runs // min(FAN, -(-runs // FAN) + 1))
        made = f"{folder}/{runs:09d}"

        def merge(batches: Iterator[pa.RecordBatch], made: str = made) -> Iterator[pa.RecordBatch]:
            plan: dict[int, dict[str, list[tuple[int, int]]]] = {}
            for batch in batches:  # places of blocks, not their rows
                for group, run, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    plan.setdefault(group, {}).setdefault(run, []).append((offset, length))
            for group in sorted(plan):
                tree = LoserTree(captures_of(run, sorted(where)) for run, where in sorted(plan[group].items()))
                yield RunWriter(f"{made}-{group:06d}.run").write(row for _, row in tree)

        group = F.pmod(F.xxhash64("run"), F.lit(groups))
        blocks = stored(blocks.select(group.alias("group"), "run", "offset", "length").repartition(groups, "group").mapInArrow(merge, _BLOCK), "runs")
    return blocks


def merged(blocks: DataFrame) -> DataFrame:
    """All captures of the runs in global order: range by range, each merged in a loser tree."""
    total, n_blocks = blocks.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.count("*")).first()
    ranges = max(1, min(n_blocks, SPLIT_KEYS // 4, max(total // MERGE_ROWS, blocks.sparkSession.sparkContext.defaultParallelism)))
    seen = blocks.select("first", F.xxhash64("run", "offset").alias("h")).orderBy("h").limit(SPLIT_KEYS).select("first").collect()
    keys = sorted(json.loads(r[0]) for r in seen)
    cuts = sorted(json.dumps(keys[i * len(keys) // ranges]) for i in range(1, ranges)) if keys else []
    cuts = sorted((json.loads(c) for c in set(cuts)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (r, run, offset, length)
                for run, offset, length, first, last in zip(*(c.to_pylist() for c in batch.columns), strict=True)
                for r in range(bisect.bisect_right(cuts, json.loads(first)), bisect.bisect_right(cuts, json.loads(last)) + 1)
            ]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["range", "run", "offset", "length"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan: dict[int, dict[str, list[tuple[int, int]]]] = {}
        for batch in batches:  # places of the blocks of this task's ranges, not their rows
            for r, run, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                plan.setdefault(r, {}).setdefault(run, []).append((offset, length))
        schema = pa.schema([(n, pa.int64() if n in ("page_id", "offset", "length", "payload_bytes", "refers_to") else pa.string()) for n in _NAMES])
        for r in sorted(plan):
            out = []
            for _, row in LoserTree(captures_of(run, sorted(where), cuts[r - 1] if r else None, cuts[r] if r < len(cuts) else None) for run, where in sorted(plan[r].items())):
                out.append(row)
                if len(out) == 8192:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    placed = blocks.select("run", "offset", "length", "first", "last").mapInArrow(place, "range long, run string, offset long, length long")
    return placed.repartitionByRange(len(cuts) + 1, "range").mapInArrow(merge, _CAPTURE)


def capture_histories(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write pages as archives into the shared folder, read them back and merge their capture index."""
    folder = shared_dir(spark, "warc")
    archives = write_archives(pages, f"{folder}/archives")
    history = merged(longer_runs(write_runs(archives, f"{folder}/runs"), f"{folder}/merged"))
    return history.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "timestamp", "archive", "offset", "length")
