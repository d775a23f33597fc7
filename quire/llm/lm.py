"""Language-model scores from an Elias-Fano n-gram trie in memory-mapped files.

Level 1 holds the words: their 64-bit hashes (63 bits kept) as an Elias-Fano sequence, so a word's id is its
rank, and running totals of their counts as another. Level 2 holds pairs: a shard's contexts, pointers to
where each one's successors begin, and the successors as `context * V + word id`, all monotone and in
Elias-Fano form, with one byte a pair for its smoothed probability. A pair is looked up by a successor
search relative to its context. Level 3 (order 3) lies in its pairs' shards: running totals of the pairs'
counts, and the successors as `pair's place * V + word id`, with one byte each. A pair at a text's end has none.

Each byte counts steps of one logarithmic quantiser, which the largest count of the corpus fixes for all shards
and levels; it rounds towards the smaller probability. So the probabilities after a context add up to 1 at most,
none is above 1, and scores do not depend on the number of shards. Level 1 keeps exact counts, which the base
score needs, and its probabilities follow from them.

A pair's probability is c(uv) / (c(u) + PRIOR), quantised, plus PRIOR / (c(u) + PRIOR) times the word's own:
(c - d) / N for a known word, with the mass d * V / N of all unknown words for an unknown one; d is set by
how many words occur once and twice. After a pair that was seen, order 3 adds c(uvw) / (c(uv) + PRIOR),
quantised, to PRIOR / (c(uv) + PRIOR) times that. op6 has order 3.

Levels are cut into as many shards as spark.sql.shuffle.partitions says, each counted and built by one task
from counts that were added up before the shuffle. Words go to shards by hash. Pairs go by context; a
context with more than a shard's share of tokens is cut by successor into as many parts as it has shares, so
no word fills a shard. The number of parts follows from the context's count, so a look-up needs no table.
Level 3 is counted with level 2, in one pass; the successors of one pair stay together.

Words are runs without ASCII white space, A-Z lower-cased; each text has an end token. Defined results: null
and empty texts are the end token alone. A null doc_id counts as held out and is not learnt. Rows are kept
one for one. Without training texts, all scores are 0. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import files_of, read_file, shared_dir, split_of, stored, write_file
from quire.llm.eliasfano import Sequence, encode
from quire.llm.words import HASHES, hashed

PRIOR = 5.0
HASHED = 1 << 63
START, END = (int(HASHES[w]) >> 1 for w in (b"  ", b" "))  # no word holds a space
BYTES = 6_000_000  # characters of texts that are scored or counted at once: about a million tokens
CUTS = 8  # parts into which order 3 cuts a shard's share of a frequent context, so that shards are alike
PENDING = 3_000_000  # distinct counts that a task holds before it passes them on


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of whole texts' words, each text with the end token, joined end to end; and the tokens of each text."""
    h, n = hashed([(x or "").encode() for x in texts])
    return np.insert(h >> np.uint64(1), np.cumsum(n), np.uint64(END)), n + 1


def by_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(rows without text, their tokens joined end to end, the tokens of each) in groups of about BYTES of text; text is the last column."""
    rows, held, size = [], [], 0
    for batch in batches:
        for *rest, text in zip(*batch.columns, strict=True):
            rows.append([x.as_py() for x in rest])
            held.append(text.as_py())
            size += len(held[-1] or "") + 1
            if size >= BYTES:
                yield rows, *tokens(held)
                rows, held, size = [], [], 0
    if rows:
        yield rows, *tokens(held)


def pairs_of(u: np.ndarray, v: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """Distinct pairs in order, their summed counts, and (if n is None) each row's place among them."""
    if not len(u):
        return u, v, np.zeros(0, np.int64), np.zeros(0, np.int64)
    if max(int(u.max()), int(v.max())) < 1 << 32:
        order = np.argsort(u.astype(np.uint64) << np.uint64(32) | v.astype(np.uint64))
    else:
        order = np.lexsort((v, u))
    a, b = u[order], v[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    first = np.flatnonzero(new)
    if n is None:
        inverse = np.empty(len(u), np.int64)
        inverse[order] = np.cumsum(new) - 1
        return a[first], b[first], np.diff(np.append(first, len(u))), inverse
    return a[first], b[first], np.add.reduceat(n[order], first), None


@lru_cache(maxsize=4096)
def _mapped(uri: str) -> np.ndarray:
    """A file's bytes: memory-mapped where the shared folder is mounted, else read."""
    from pyarrow.fs import LocalFileSystem

    store, path = files_of(uri)
    return np.memmap(path, np.uint8, "r").view(np.ndarray) if isinstance(store, LocalFileSystem) else np.frombuffer(read_file(uri), np.uint8)


@lru_cache(maxsize=4096)
def _sequences(uri: str, n: int) -> tuple[tuple[Sequence, ...], np.ndarray]:
    """The first n sequences of a level's file, and the bytes after them."""
    data, out = _mapped(uri), []
    for _ in range(n):
        out.append(Sequence(data))
        data = data[out[-1].size :]
    return tuple(out), data


@dataclass
class Words:
    """Level 1: words by hash."""

    folder: str
    sizes: np.ndarray  # words of each shard
    total: int  # N
    docs: int
    discount: float
    most: int = 0  # the largest count
    cuts: int = 1  # parts a share of a frequent context

    def __post_init__(self):
        self.base = np.concatenate([[0], np.cumsum(self.sizes)])
        self.pairs = np.zeros(len(self.sizes), np.int64)  # of each shard of level 2
        self.shards, self.count = len(self.sizes), int(self.base[-1])  # V
        # One quantiser for all shards and levels: no share is smaller than 1 / (most + PRIOR), which 255 steps reach.
        self.step = float(np.log10(max(self.most, self.docs) + PRIOR)) / 255

    def shard_of(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(31)) * np.uint64(self.shards) >> np.uint64(32)

    def _shard(self, s: int) -> tuple[Sequence, Sequence]:
        return _sequences(f"{self.folder}/words-{s:06d}.ef", 2)[0]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of sorted hashes; id -1 and count 0 where unknown."""
        ids, counts = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        edges = np.searchsorted(self.shard_of(h), np.arange(self.shards + 1))
        for s in range(self.shards):
            a, b = edges[s], edges[s + 1]
            if a < b and self.sizes[s]:
                hashes, totals = self._shard(s)
                at = hashes.find(h[a:b], HASHED)
                known = np.flatnonzero(at >= 0)
                ids[a + known] = self.base[s] + at[known]
                counts[a + known] = self._between(totals, at[known])
        return ids, counts

    @staticmethod
    def _between(totals: Sequence, at: np.ndarray) -> np.ndarray:
        return (totals.get(at + 1) - totals.get(at)).astype(np.int64)

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Counts of sorted ids; V stands for the start of a text."""
        out = np.full(len(ids), self.docs, np.int64)
        edges = np.searchsorted(ids, self.base)
        for s in range(self.shards):
            if edges[s] < edges[s + 1]:
                out[edges[s] : edges[s + 1]] = self._between(self._shard(s)[1], ids[edges[s] : edges[s + 1]] - self.base[s])
        return out

    def own(self, counts: np.ndarray) -> np.ndarray:
        """The words' own probabilities, by count."""
        return np.where(counts > 0, counts - self.discount, self.discount * self.count) / self.total

    def pair_shard(self, u: np.ndarray, v: np.ndarray, count_u: np.ndarray) -> np.ndarray:
        parts = np.maximum(1, -(-count_u * self.shards * self.cuts // self.total))
        return ((u * 2654435761 & 0xFFFFFFFF) + v * parts // max(self.count, 1)) % self.shards


def _by_shard(shard: np.ndarray) -> np.ndarray:
    """A stable order by shard; narrow numbers are sorted by digits."""
    return np.argsort(shard.astype(np.uint16) if len(shard) and shard.max() < 1 << 16 else shard, kind="stable")


def _rows(shard: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """A row for each shard, with its part of the columns as bytes."""
    order = _by_shard(shard)
    shard = shard[order]
    first = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
    edges = np.append(first, len(shard))
    cut = {k: [c[order[a:b]].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)] for k, c in columns.items()}
    return pa.RecordBatch.from_pydict({"shard": pa.array(shard[first].astype(np.int32))} | {k: pa.array(x, pa.binary()) for k, x in cut.items()})


def _gathered(batches: Iterator[pa.RecordBatch], types: list[str]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Each shard of a task with its columns joined; rows come sorted by shard."""
    shard, held = None, []
    for batch in batches:
        for s, *rest in zip(*batch.columns, strict=True):
            if s.as_py() != shard:
                if held:
                    yield shard, [np.concatenate([x[i] for x in held]) for i in range(len(types))]
                shard, held = s.as_py(), []
            held.append([np.frombuffer(x.as_buffer(), t) for x, t in zip(rest, types, strict=True)])
    if held:
        yield shard, [np.concatenate([x[i] for x in held]) for i in range(len(types))]


def count_words(texts: DataFrame, folder: str, shards: int) -> Words:
    """Level 1 of texts(text)."""
    place = Words("", np.zeros(shards, np.int64), 0, 0, 0.0).shard_of

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for _, held, _ in by_tokens(batches):
            a, b = np.unique(held, return_counts=True)
            h, at = np.unique(np.concatenate([h, a]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n, b])).astype(np.int64)
            if len(h) > PENDING:
                yield _rows(place(h), h=h, n=n)
                h, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(h):
            yield _rows(place(h), h=h, n=n)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, (h, n) in _gathered(batches, ["<u8", "<i8"]):
            h, at = np.unique(h, return_inverse=True)
            totals = np.zeros(len(h) + 1, np.int64)
            np.add.at(totals, at + 1, n)
            n, totals = totals[1:].copy(), np.cumsum(totals)
            write_file(f"{folder}/words-{shard:06d}.ef", [encode(h, HASHED), encode(totals, int(totals[-1]) + 1)])
            docs = int(n[h == END].sum())
            yield pa.RecordBatch.from_pydict({k: [int(v)] for k, v in (("shard", shard), ("words", len(h)), ("tokens", totals[-1]), ("once", (n == 1).sum()), ("twice", (n == 2).sum()), ("docs", docs), ("most", n.max()))})

    counted = texts.select("text").mapInArrow(count, "shard int, h binary, n binary")
    made = counted.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(build, "shard long, words long, tokens long, once long, twice long, docs long, most long")
    rows = stored(made, "lm-words").collect()  # a row for each shard
    sizes = np.zeros(shards, np.int64)
    for r in rows:
        sizes[r["shard"]] = r["words"]
    once, twice = (sum(r[k] for r in rows) for k in ("once", "twice"))
    return Words(folder, sizes, sum(r["tokens"] for r in rows), sum(r["docs"] for r in rows), once / (once + 2 * twice) if once and twice else 0.5, max((r["most"] for r in rows), default=0))


def _known(words: Words, held: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts joined end to end: word ids and counts, context ids (V at a start, -1 unknown) and counts, and text ends."""
    h, inverse = np.unique(held, return_inverse=True)
    ids, counts = words.find(h)
    ids, counts = ids[inverse], counts[inverse]
    ends = np.cumsum(sizes)
    before, before_counts = np.roll(ids, 1), np.roll(counts, 1)
    starts = np.append(0, ends[:-1])
    before[starts], before_counts[starts] = words.count, words.docs
    return ids, counts, before, before_counts, ends


def _shares(words: Words, share: np.ndarray) -> bytes:
    """Logarithms of probabilities, one byte each: steps below 1, towards the smaller probability."""
    return np.minimum(np.ceil(-share / words.step - 1e-9), 255).astype(np.uint8).tobytes()


def _share(words: Words, tail: np.ndarray, at: np.ndarray) -> np.ndarray:
    return 10.0 ** (-words.step * tail[at])


def count_pairs(texts: DataFrame, words: Words, order: int = 2) -> None:
    """Level 2 of texts(text) and, in order 3, level 3, written beside level 1; words learns which shards have pairs."""
    narrow = "<u4" if words.count < 1 << 32 else "<i8"
    pending = PENDING * 2 // order
    if order > 2:
        words.cuts = CUTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_rows = [np.zeros(0, np.int64)] * 5
        for _, held, sizes in by_tokens(batches):
            ids, _, before, counts, ends = _known(words, held, sizes)
            u, v, n, inverse = pairs_of(before, ids)
            own = np.zeros(len(u), np.int64)
            own[inverse] = counts
            w = np.full(len(u), words.count)  # V: no word, after the end of a text and in order 2
            if order > 2:
                after = np.roll(ids, -1)
                after[ends - 1] = words.count
                at, w, n, _ = pairs_of(inverse, after)
                u, v, own = u[at], v[at], own[at]
            held_rows = [np.concatenate(x) for x in zip(held_rows, (u, v, w, n, own), strict=True)]
            if len(held_rows[0]) > pending:
                yield passed(*held_rows)
                held_rows = [np.zeros(0, np.int64)] * 5
        if len(held_rows[0]):
            yield passed(*held_rows)

    def passed(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        u, v, _, inverse = pairs_of(u, v)
        own = np.zeros(len(u), np.int64)
        own[inverse] = c
        at, w, n, _ = pairs_of(inverse, w, n)
        # Small numbers in narrow columns: the shuffle compresses them.
        return _rows(words.pair_shard(u, v, own)[at], u=u.astype(narrow)[at], v=v.astype(narrow)[at], w=w.astype(narrow), n=n)

    def write_pairs(shard: int, u: np.ndarray, v: np.ndarray, totals: np.ndarray) -> None:
        contexts, begin, at = np.unique(u, return_index=True, return_inverse=True)
        share = np.log10(totals / (words.counts(contexts)[at] + PRIOR))
        parts = [encode(contexts, words.count + 1), encode(np.append(begin, len(u)), len(u) + 1), encode(at * words.count + v, len(contexts) * words.count)]
        write_file(f"{words.folder}/pairs-{shard:06d}.ef", [*parts, _shares(words, share)])

    def write_triples(shard: int, at: np.ndarray, w: np.ndarray, n: np.ndarray, totals: np.ndarray) -> None:
        tail = _shares(words, np.log10(n / (totals[at] + PRIOR)))
        at = at * words.count + w
        parts = [encode(np.append(0, np.cumsum(totals)), int(totals.sum()) + 1), encode(at, len(totals) * words.count)]
        write_file(f"{words.folder}/triples-{shard:06d}.ef", [*parts, tail])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, (u, v, w, n) in _gathered(batches, [narrow, narrow, narrow, "<i8"]):
            u, v, _, pair = pairs_of(u, v)
            totals = np.bincount(pair, n, len(u)).astype(np.int64)
            inside = np.flatnonzero(w < words.count)
            pair, w, n = pair[inside], w[inside], n[inside]
            write_pairs(shard, u.astype(np.int64), v.astype(np.int64), totals)
            if order > 2:
                write_triples(shard, *pairs_of(pair, w, n)[:3], totals)
            yield pa.RecordBatch.from_pydict({"shard": [shard], "pairs": [len(u)]})

    counted = texts.select("text").mapInArrow(count, "shard int, u binary, v binary, w binary, n binary")
    made = counted.repartitionById(words.shards, "shard").sortWithinPartitions("shard").mapInArrow(build, "shard long, pairs long")
    for r in stored(made, "lm-pairs").collect():  # a row for each shard
        words.pairs[r["shard"]] = r["pairs"]


def pair_shares(words: Words, u: np.ndarray, v: np.ndarray, count_u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each distinct pair: the quantised part of its probability (0 where it was not seen), its shard, and its place there (-1)."""
    out, place = np.zeros(len(u)), np.full(len(u), -1, np.int64)
    shard = words.pair_shard(u, v, count_u)
    order = _by_shard(shard)
    edges = np.searchsorted(shard[order], np.arange(words.shards + 1))
    for s in range(words.shards):
        rows = order[edges[s] : edges[s + 1]]
        if not len(rows) or not words.pairs[s]:
            continue
        (contexts, pointers, successors), tail = _sequences(f"{words.folder}/pairs-{s:06d}.ef", 3)
        own, at = np.unique(u[rows], return_inverse=True)
        i = contexts.find(own, words.count + 1)
        begin, end = pointers.get(np.maximum(i, 0)), pointers.get(np.maximum(i, 0) + 1)
        i, begin, end = i[at], begin[at], end[at]
        seen = np.flatnonzero(i >= 0)
        j = successors.find(i[seen] * words.count + v[rows[seen]], contexts.n * words.count)
        inside = (j >= 0) & (j >= begin[seen].astype(np.int64)) & (j < end[seen].astype(np.int64))
        place[rows[seen[inside]]] = j[inside]
        out[rows[seen[inside]]] = _share(words, tail, j[inside])
    return out, shard, place


def triple_shares(words: Words, shard: np.ndarray, place: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of seen pairs, by shard and place, each with a word (-1 unknown): the quantised part of its probability after the pair, and the pair's count."""
    out, counts = np.zeros(len(w)), np.zeros(len(w), np.int64)
    order = _by_shard(shard)
    edges = np.searchsorted(shard[order], np.arange(words.shards + 1))
    for s in range(words.shards):
        rows = order[edges[s] : edges[s + 1]]
        if not len(rows):
            continue
        (totals, successors), tail = _sequences(f"{words.folder}/triples-{s:06d}.ef", 2)
        own, at = np.unique(place[rows], return_inverse=True)
        counts[rows] = (totals.get(own + 1) - totals.get(own)).astype(np.int64)[at]
        known = rows[w[rows] >= 0]
        j = successors.find(place[known] * words.count + w[known], int(words.pairs[s]) * words.count)
        out[known[j >= 0]] = _share(words, tail, j[j >= 0])
    return out, counts


def scored(docs: DataFrame, words: Words, order: int = 2) -> DataFrame:
    """docs(doc_id, held_out, text) -> n_tokens, n_known, base_score and score of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, held, sizes in by_tokens(batches):
            if words.total:
                ids, counts, before, before_counts, ends = _known(words, held, sizes)
                base = np.log10((counts + 1) / (words.total + words.count + 1))
                p = words.own(counts)
                after = np.flatnonzero(before >= 0)
                p[after] *= PRIOR / (before_counts[after] + PRIOR)
                both = after[ids[after] >= 0]
                u, v, _, inverse = pairs_of(before[both], ids[both])
                own = np.zeros(len(u), np.int64)
                own[inverse] = before_counts[both]
                share, shard, place = pair_shares(words, u, v, own)
                p[both] += share[inverse]
                if order > 2:
                    pair = np.full(len(ids), -1, np.int64)
                    pair[both] = np.where(place >= 0, np.arange(len(u)), -1)[inverse]
                    pair = np.roll(pair, 1)
                    pair[np.append(0, ends[:-1])] = -1
                    after = np.flatnonzero(pair >= 0)
                    at, w, _, inverse = pairs_of(pair[after], ids[after] + 1)  # 0: unknown
                    share, total = triple_shares(words, shard[at], place[at], w - 1)
                    p[after] = p[after] * (PRIOR / (total + PRIOR))[inverse] + share[inverse]
                sums = lambda x: np.add.reduceat(x, np.append(0, ends[:-1]))
                columns = [sums((counts > 0).astype(np.int64)), sums(base), sums(np.log10(p))]
            else:
                columns = [np.zeros(len(rows), np.int64), np.zeros(len(rows)), np.zeros(len(rows))]
            ids, out = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.bool_()), pa.array(sizes, pa.int64()), *map(pa.array, columns)], schema=schema)

    return docs.select("doc_id", "held_out", "text").mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def language_model(spark: SparkSession, docs: DataFrame, n: int = 7, held_out: int = 2, order: int = 2) -> DataFrame:
    """docs(doc_id, text) -> scores of every row in order 2 or 3, learnt from rows whose crc32(doc_id) mod n is not held_out."""
    held = F.coalesce(split_of(F.col("doc_id").cast("long"), n) == held_out, F.lit(True))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    words = count_words(rows.where("not held_out"), shared_dir(spark, "lm"), shards)
    if words.total:
        count_pairs(rows.where("not held_out"), words, order)
    return scored(rows, words, order).withColumn("train_tokens", F.lit(words.total).cast("long"))
