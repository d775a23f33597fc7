"""Packing documents into sequences: linear grouping, configurations, substitution, best fit.

Lengths are bounded by the sequence length, so a histogram of them (at most `capacity` rows, whatever the
corpus) is all the driver needs. On it: lengths above 4/9 of the capacity are sorted and cut into groups of equal
cardinality, each rounded up to its longest; a linear program over configurations of these few sizes is
solved by column generation and rounded down; the actual lengths of each group take the configurations'
places; what is left over and the small lengths follow by best fit, longest first. The plan is a list of
segments, "ranks a to b of length n go to these sequences", and every piece finds its own place by its rank
among the pieces of its length. Ranks are counted by partition, so a length that a third of all pieces
share is no hot key.

Defined results: null and empty texts are the end id alone. Rows are kept one for one, repeated and null
ids too. A text of more than `capacity` ids is cut into full pieces and a rest. Equal lengths are taken in
the order of their partitions. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.bpe import loaded
from quire.llm.common import stored

CAPACITY = 4096
GROUPS = 128
SMALL = 4 / 9  # of capacity: shorter lengths are left to best fit
UNIT = 8  # grouped lengths are rounded up to a multiple of it
ROUNDS = 600  # columns generated at most; more would only bring the program nearer to its optimum


def _best_column(price: np.ndarray, size: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The configuration of most value that fits: a knapsack over the number of places taken."""
    best = np.zeros(room + 1)
    choices = []
    for _ in range(room // int(size.min())):
        step, pick = best.copy(), np.full(room + 1, -1)
        for g, s in enumerate(size):
            v = best[: room + 1 - s] + price[g]
            better = v > step[s:] + 1e-12
            step[s:][better], pick[s:][better] = v[better], g
        choices.append(pick)
        best = step
    column, at = np.zeros(len(size)), room
    for pick in reversed(choices):
        if pick[at] >= 0:
            column[pick[at]] += 1
            at -= size[pick[at]]
    return float(best[room]), column


def configurations(size: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """(places by size, how often), rounded down, of a linear program that covers demand with fewest bins."""
    basis = np.diag((room // size).astype(float))
    x = demand / np.diag(basis)
    for _ in range(ROUNDS):
        price = np.linalg.solve(basis.T, np.ones(len(size)))
        value, column = _best_column(price, size, room)
        if value <= 1 + 1e-6:
            break
        along = np.linalg.solve(basis, column)
        ratio = np.where(along > 1e-9, x / np.where(along > 1e-9, along, 1), np.inf)
        out = int(np.argmin(ratio))
        x = np.maximum(x - ratio[out] * along, 0)
        x[out] = ratio[out]
        basis[:, out] = column
    return [(basis[:, j].astype(int), int(x[j] + 1e-9)) for j in range(len(size)) if int(x[j] + 1e-9) > 0]


class _Plan:
    def __init__(self, capacity: int):
        self.capacity, self.bins = capacity, 0
        self.segments: list[tuple[int, int, int, int, int, int]] = []  # length, rank, count, per bin, first bin, offset
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free room -> (first bin, bins)
        self.gaps: list[int] = []

    def put_open(self, gap: int, first: int, n: int) -> None:
        if n and gap:
            if not self.open[gap]:
                bisect.insort(self.gaps, gap)
            self.open[gap].append((first, n))

    def new_bins(self, n: int) -> int:
        self.bins += n
        return self.bins - n

    def best_fit(self, length: int, rank: int, count: int) -> None:
        """Place ranks rank to rank+count of length, each where least room is left over."""
        while count:
            i = bisect.bisect_left(self.gaps, length)
            if i < len(self.gaps):
                gap = self.gaps[i]
                first, n = self.open[gap].pop()
                if not self.open[gap]:
                    del self.gaps[i]
            else:
                gap, n = self.capacity, -(-count // (self.capacity // length))
                first = self.new_bins(n)
            each = gap // length
            full = min(n, count // each)
            if full:
                self.segments.append((length, rank, full * each, each, first, self.capacity - gap))
                self.put_open(gap - each * length, first, full)
                rank, count = rank + full * each, count - full * each
            if full < n and count:
                self.segments.append((length, rank, count, count, first + full, self.capacity - gap))
                self.put_open(gap - count * length, first + full, 1)
                full, count = full + 1, 0
            self.put_open(gap, first + full, n - full)


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int = 0) -> tuple[np.ndarray, int]:
    """Segments (length, rank, count, per bin, first bin, offset), sorted by length and rank; number of bins."""
    p = _Plan(capacity)
    small = small or int(capacity * SMALL)
    left: list[tuple[int, int, int]] = []
    large = sorted((n for n in histogram if small < n < capacity), reverse=True)
    if full := histogram.get(capacity, 0):
        p.segments.append((capacity, 0, full, 1, p.new_bins(full), 0))
    total = sum(histogram[n] for n in large)
    if total:
        each = -(-total // groups)
        members: list[list[list[int]]] = [[]]  # of a group: [length, rank, count]
        free = each
        for n in large:
            rank, count = 0, histogram[n]
            while count:
                if not free:
                    members.append([])
                    free = each
                take = min(count, free)
                members[-1].append([n, rank, take])
                rank, count, free = rank + take, count - take, free - take
        by_size: dict[int, list[list[int]]] = {}
        for m in members:
            by_size.setdefault(min(-(-m[0][0] // UNIT), capacity // UNIT), []).extend(m)
        size = np.array(list(by_size))
        queues = [q[::-1] for q in by_size.values()]
        demand = np.array([sum(c for _, _, c in q) for q in queues], float)
        for places, times in configurations(size, demand, capacity // UNIT):
            first = p.new_bins(times)
            cover = [(first, times, 0)]  # bins of this configuration by how full they are
            for g in np.repeat(np.arange(len(size)), places):
                after = []
                for b, n, used in cover:
                    while n and queues[g]:
                        length, rank, count = queues[g][-1]
                        take = min(n, count)
                        p.segments.append((length, rank, take, 1, b, used))
                        after.append((b, take, used + length))
                        b, n = b + take, n - take
                        queues[g].pop()
                        if take < count:
                            queues[g].append([length, rank + take, count - take])
                    if n:
                        after.append((b, n, used))
                cover = after
            for b, n, used in cover:
                p.put_open(capacity - used, b, n)
        left = [(length, rank, count) for q in queues for length, rank, count in q]
    left += [(n, 0, c) for n, c in histogram.items() if n <= small]
    for length, rank, count in sorted(left, reverse=True):
        p.best_fit(length, rank, count)
    return np.array(sorted(p.segments), np.int64).reshape(-1, 6), p.bins


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def cut(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """docs(doc_id, text) -> pieces, stored, with the rank of each among its partition's pieces of its length."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("rank", pa.int64())])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, end, part, seen = loaded(tokenizer), struct.pack("<I", end_id), TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = bpe.encode(text.as_py()) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    n = len(own) // 4
                    rows.append((doc_id.as_py(), piece, at // 4, n, zlib.crc32(own), part, seen[n]))
                    seen[n] += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(pieces, _PIECE), "pieces")


def place(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """pieces of cut() -> each piece's sequence_id and offset."""
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = stored(counts, "lengths")
    histogram = {int(r[0]): int(r[1]) for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    segments, _ = plan(histogram, capacity, groups)
    keys = segments[:, 0] << 40 | segments[:, 1]
    before = F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    bases = counts.select(F.col("length").alias("b_length"), F.col("part").alias("b_part"), F.coalesce(before, F.lit(0)).alias("base"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(batch.schema.get_field_index(c))).astype(np.int64) for c in ("length", "rank"))
            s = segments[np.searchsorted(keys, length << 40 | rank, "right") - 1]
            nth = rank - s[:, 1]
            kept = [batch.column(i) for i in range(5)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(s[:, 4] + nth // s[:, 3]), pa.array(s[:, 5] + nth % s[:, 3] * length)], [*batch.schema.names[:5], "sequence_id", "offset"])

    # A row for each length and partition grows with the pieces, so it is joined by shuffle, not sent.
    ranked = pieces.join(bases.hint("merge"), (F.col("length") == F.col("b_length")) & (F.col("part") == F.col("b_part")))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank"))
    return ranked.mapInArrow(put, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """docs(doc_id, text) -> a row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return place(cut(docs, tokenizer, end_id, capacity), capacity, groups)
