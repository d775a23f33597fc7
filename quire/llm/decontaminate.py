"""Benchmark decontamination: BM25 over test items with block-max WAND, then a check of question and answer.

The index holds the test items; its queries are passages of training documents: windows of twice the longest
item's words, each starting one longest item after the last, so any copy of an item lies whole in some
window. A term's impact on an item is its BM25 weight divided by the item's score for its own text: an item
scores 1 for a passage that holds all of it, and THRESHOLD is a share of that. Every item above it is
retrieved by block-max WAND. Blocks are runs of ITEM_BLOCK items, the same for all lists, with each term's
largest impact in each block; a block whose maxima stay under the threshold for the passage's terms is never
entered, and within the others WAND moves from pivot to pivot.

A retrieved item is confirmed on whole five-word shingles of the passage: its question (all sentences but
the last; of a single sentence, the first two thirds) and its answer (the rest) are each covered by at least
OVERLAP, or the whole item is and at least ANSWER of its answer. Never without its answer.

Statistics (number of items, document frequencies, mean and largest length) are of the whole item table. The
index is written to the shared folder in parts of about ITEMS items; tasks hold PARTS of them at a time and
search all of them for each group of documents, so documents are read once whatever the number of parts, and
scores do not depend on it. Words are runs without ASCII white space or punctuation, A-Z lower-cased. Defined
results: null and empty texts and items are never contaminated. Of an item or part with fewer than five words,
the longest run of its words counts; an item of one or two words has no answer to find. Item rows that repeat id and text are one item; documents that repeat
an id are reported for each row. Empty tables give no rows. Other columns are ignored by `contaminations`
and carried by `decontaminated`.
"""

from __future__ import annotations

import bisect
import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import read_file, shared_dir, stored, write_file

ITEMS = 1_000  # of a part of the index
PARTS = 4  # that a task holds at a time
THRESHOLD = 0.5
OVERLAP = 0.8
ANSWER = 0.5
SHINGLE = 5
K1, B = 1.2, 0.75
ITEM_BLOCK = 4
GROUP = 4 << 20  # characters of documents that are searched together

_TABLE = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 128 and not chr(b).isalnum() else b for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def shingles(w: list[bytes], k: int = SHINGLE) -> set[tuple[bytes, ...]]:
    """Distinct k-word shingles; all words as one when there are fewer."""
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    parts = [p for p in re.split(r"(?<=[.!?])\s+", text.strip()) if words(p)]
    if len(parts) > 1:
        return words(" ".join(parts[:-1])), words(parts[-1])
    w = words(text)
    cut = -(-2 * len(w) // 3)
    return w[:cut], w[cut:]


class Index:
    """Lists of impacts of some items, with a maximum for each list and for each block of items in it.

    df, n and mean are the document frequencies, number and mean length of all items, longest their largest length.
    """

    def __init__(self, items: list[tuple[int, str]], df: dict[bytes, int], n: int, mean: float, longest: int):
        kept = [(i, w, text) for i, text in sorted(items) if (w := words(text))]
        self.ids, self.longest = [i for i, _, _ in kept], longest
        self.terms = {t: i for i, t in enumerate(sorted({x for _, w, _ in kept for x in w}))}
        idf = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) for t in self.terms}
        self.docs: list[list[int]] = [[] for _ in self.terms]
        self.impacts: list[list[float]] = [[] for _ in self.terms]
        for d, (_, w, _) in enumerate(kept):
            weight = {t: idf[t] * c * (K1 + 1) / (c + K1 * (1 - B + B * len(w) / mean)) for t, c in Counter(w).items()}
            own = sum(weight.values())
            for t, x in weight.items():
                self.docs[self.terms[t]].append(d)
                self.impacts[self.terms[t]].append(x / own)
        self.most = np.array([max(v) for v in self.impacts] or [0.0])
        self.block_most = np.zeros((max(1, len(self.terms)), -(-max(1, len(kept)) // ITEM_BLOCK)), np.float32)
        for t, (docs, impacts) in enumerate(zip(self.docs, self.impacts, strict=True)):
            np.maximum.at(self.block_most[t], np.array(docs) // ITEM_BLOCK, impacts)
        self.parts = [(*map(shingles, question_and_answer(text)), shingles(w)) for _, w, text in kept]

    def search(self, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """(item number, score) of every item of at least threshold, by block-max WAND over distinct terms."""
        bounds = self.block_most[terms]
        live = (bounds.sum(0) >= threshold - 1e-4).nonzero()[0]  # single precision
        out, end = [], len(self.ids)
        if not len(live):
            return out
        terms, live = terms[bounds[:, live].any(1)].tolist(), live.tolist()  # lists that reach into live blocks
        cursors = []  # current item, term, position

        def forward(c: list, item: int) -> None:
            docs = self.docs[c[1]]
            c[2] = bisect.bisect_left(docs, item, c[2])
            c[0] = docs[c[2]] if c[2] < len(docs) else end

        for t in terms:
            c = [0, t, 0]
            forward(c, live[0] * ITEM_BLOCK)
            cursors.append(c)
        while True:
            cursors.sort()
            while cursors and cursors[-1][0] == end:
                cursors.pop()
            bound, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                bound += self.most[c[1]]
                if bound >= threshold - 1e-9:
                    pivot = i
                    break
            if pivot < 0:
                return out
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            upto, block = cursors[: pivot + 1], item // ITEM_BLOCK
            if (i := bisect.bisect_left(live, block)) == len(live):
                return out
            if live[i] != block:  # on to the next block that can hold one
                for c in cursors:
                    if c[0] < live[i] * ITEM_BLOCK:
                        forward(c, live[i] * ITEM_BLOCK)
            elif sum(self.block_most[c[1], block] for c in upto) < threshold - 1e-4:  # no item here before the next list begins
                stop = min((block + 1) * ITEM_BLOCK, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else end)
                for c in upto:
                    forward(c, stop)
            else:
                score = 0.0
                for c in upto:
                    if c[0] < item:
                        forward(c, item)
                    if c[0] == item:
                        score += self.impacts[c[1]][c[2]]
                        forward(c, item + 1)
                if score >= threshold - 1e-9:
                    out.append((item, score))

    def hits(self, w: list[bytes], threshold: float, overlap: float) -> list[tuple[int, float, int, float, float]]:
        """(item_id, best score, first word of that passage, question and answer overlap) of a whole text's confirmed items."""
        if not w or not self.ids:
            return []
        stride = self.longest
        ids = np.fromiter(map(self.terms.get, w, repeat(-1)), np.int64, len(w))
        at = np.flatnonzero(ids >= 0)
        pairs = np.unique(at // stride * len(self.terms) + ids[at])
        segment, term = pairs // len(self.terms), pairs % len(self.terms)
        n = -(-len(w) // stride)
        bound = np.bincount(segment, self.most[term], n)
        windows = bound[:-1] + bound[1:] if n > 1 else bound
        edges = np.searchsorted(segment, np.arange(n + 1))
        found: dict[int, tuple[int, float, int, float, float]] = {}
        for j in np.flatnonzero(windows >= threshold - 1e-9):
            own, passage = np.unique(term[edges[j] : edges[min(j + 2, n)]]), None
            for item, score in self.search(own, threshold):
                passage = passage or shingles(w[j * stride : (j + 2) * stride])
                in_q, in_a, whole = (self._covered(part, passage, w, j) for part in self.parts[item])
                if (min(in_q, in_a) >= overlap or whole >= overlap and in_a >= ANSWER) and score > found.get(item, (0, -1.0))[1]:
                    found[item] = (self.ids[item], score, int(j) * stride, in_q, in_a)
        return list(found.values())

    def _covered(self, part: set, passage: set, w: list[bytes], j: int) -> float:
        """The share of a part's shingles that the passage holds; of a part of fewer words, that of its longest run."""
        size = len(next(iter(part))) if part else 0
        if size in (0, SHINGLE):
            return len(part & passage) / len(part) if part else 1.0
        (run,) = part
        window = w[j * self.longest : (j + 2) * self.longest]
        for k in range(size, 0, -1):
            have = shingles(window, k) if len(window) >= k else set()
            if any(run[i : i + k] in have for i in range(size - k + 1)):
                return k / size
        return 0.0


_HITS = "doc_id long, item_id long, score double, start_word long, question_overlap double, answer_overlap double"


def indexed(items: DataFrame) -> list[str]:
    """items(item_id, text) -> files of an index in the shared folder, one for each part."""
    spark = items.sparkSession

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i.as_py(), text.as_py(), len(w), sorted(set(w))) for i, text in zip(*batch.columns, strict=True) if (w := words(text.as_py()))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.list_(pa.binary())), strict=True)], ["item_id", "text", "n_words", "terms"])

    tests = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    known = stored(tests.mapInArrow(counted, "item_id long, text string, n_words long, terms array<binary>"), "items")
    n, total, longest = known.agg(F.count("*"), F.sum("n_words"), F.max("n_words")).first()
    if not n:
        return []
    parts, folder = -(-n // ITEMS), shared_dir(spark, "index")
    known = known.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
    terms = known.select("part", F.explode("terms").alias("term"))
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    # A part's terms with their frequencies come before its items.
    none = F.lit(None)
    rows = terms.distinct().join(df, "term").select("part", "term", "df", none.cast("long").alias("item_id"), none.cast("string").alias("text"))
    rows = rows.union(known.select("part", none.cast("binary"), none.cast("long"), "item_id", "text"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, own, held = None, {}, []

        def close() -> pa.RecordBatch:
            write_file(path := f"{folder}/part-{part:06d}.index", [pickle.dumps(Index(held, own, n, total / n, longest))])
            return pa.RecordBatch.from_pydict({"path": [path]})

        for batch in batches:
            for p, term, count, item_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != part:
                    if part is not None:
                        yield close()
                    part, own, held = p, {}, []
                if term is not None:
                    own[term] = count
                else:
                    held.append((item_id, text))
        if part is not None:
            yield close()

    made = rows.repartition(parts, "part").sortWithinPartitions("part", F.col("term").asc_nulls_last()).mapInArrow(build, "path string")
    return sorted(r[0] for r in stored(made, "parts").collect())  # a row for each part


@lru_cache(maxsize=PARTS)
def _opened(path: str) -> Index:
    return pickle.loads(read_file(path))


def contaminations(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """docs(doc_id, text), items(item_id, text) -> a row for each document and item that it holds."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    paths = indexed(items)
    names, types = [x.split()[0] for x in _HITS.split(", ")], (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.float64())

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int | None, list[bytes]]]]:
        held, size = [], 0
        for batch in batches:
            for doc_id, text in zip(*batch.columns, strict=True):
                t = text.as_py()
                held.append((doc_id.as_py(), words(t)))
                size += len(t or "")
                if size >= GROUP:
                    yield held
                    held, size = [], 0
        yield held

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in groups(batches):
            for path in paths:
                index = _opened(path)
                out = [(doc_id, *hit) for doc_id, w in held for hit in index.hits(w, threshold, overlap)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return rows.mapInArrow(search, _HITS)


def decontaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """All columns of docs, without the documents that hold a test item."""
    gone = stored(contaminations(docs, items, threshold, overlap).where("doc_id is not null").select(F.col("doc_id").alias("_quire_gone")).distinct(), "contaminated")
    return docs.join(gone, docs["doc_id"].cast("long") == F.col("_quire_gone"), "left_anti")
