"""Near-duplicate documents by MinHash with tensored banding, every link confirmed on full shingle sets.

A document is the set of its distinct k-word shingles, as 64-bit hashes. Two small collections of SIDE
values each (a value hashes ROWS minima) are computed; a table's key pairs one value of the left collection
with one of the right, so SIDE * SIDE tables cost the minima of 2 * SIDE values. Documents that share a
key of any table are candidates. With similarity s, a link is a candidate with probability
(1 - (1 - s^ROWS)^SIDE)^2: 0.99995 at s = 0.8, and more above.

Equal sets are folded into one node first, so copies cost a row each and no pairs, and take no part in what
follows. Candidates are compared twice. First each node with the least node of a bucket: the star of a least
node is cut into units of about BLOCK nodes that all hold it, so the first comparison is linear in the rows, and
near copies end up in one component. Then only buckets whose nodes are still in several components matter: their
nodes' groups are cut into units of at most 2 * BLOCK documents, by set size (sizes that differ too much cannot
link), then by hash; nodes of a group's largest component are not compared with each other again. Within a
unit all pairs are compared exactly as a matrix product over shared shingles, and a unit returns a forest of its
links. No pair is skipped: two nodes that share a bucket and could be linked are in one component already or meet
in some unit. No step holds a group of unbounded size.

Defined results: a null text or one without words has an empty set and is linked with nothing. With fewer
than k words, the whole sequence is the only shingle. Rows that repeat a doc_id count as one document of
several texts. A null doc_id is linked with nothing: its component is null and it is kept. An empty table
gives no rows. Other columns are ignored by `near_duplicates` and carried by `deduplicated`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import stored
from quire.llm.graph import components
from quire.llm.words import HASHES

SIDE, ROWS = 20, 4
BLOCK = 256
SENT_ROWS = 1_000_000  # candidates up to which their ids are broadcast (16 MB); beyond it they are joined by shuffle


_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Odd multipliers of the minima, from a fixed seed.
_FUNCTIONS = np.random.default_rng(20).integers(0, 1 << 31, 2 * SIDE * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
_SALTS = np.random.default_rng(21).integers(0, 1 << 63, 2 * SIDE, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ x >> np.uint64(33)


def shingles(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct shingles of a whole text, as hashes. Words are runs without ASCII white space, A-Z lower-cased."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))
    width = min(k, len(h))
    s = np.full(len(h) - width + 1, width, np.uint64)
    for j in range(width):
        s = _mixed(s * _MIX + h[j : len(h) - width + 1 + j])
    return np.unique(s)


def keys(s: np.ndarray) -> np.ndarray:
    """The 2 * SIDE values of a non-empty set, left collection first."""
    a, b = (s >> np.uint64(32)).astype(np.uint32), s.astype(np.uint32)
    low = np.full(len(_FUNCTIONS), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(s), 512):
        low = np.minimum(low, (_FUNCTIONS[:, None] * b[None, i : i + 512] + a[None, i : i + 512]).min(1))
    rows = low.reshape(2 * SIDE, ROWS).astype(np.uint64)
    out = _SALTS
    for j in range(ROWS):
        out = _mixed(out * _MIX + rows[:, j])
    return out.astype(np.int64)


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, hi and lo (a digest of the set), left and right values."""
    from xxhash import xxh3_128_intdigest

    names = ["doc_id", "n_shingles", "hi", "lo", "left", "right"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def signed(x: int) -> int:
        return x - (1 << 64) if x >> 63 else x

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(*batch.columns, strict=True):
                s = shingles(text.as_py(), k)
                digest = xxh3_128_intdigest(s.tobytes())
                v = keys(s) if len(s) else np.zeros(0, np.int64)
                rows.append((doc_id.as_py(), len(s), signed(digest >> 64), signed(digest & (1 << 64) - 1), v[:SIDE], v[SIDE:]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(sketch, "doc_id long, n_shingles long, hi long, lo long, left array<long>, right array<long>")


def buckets(nodes: DataFrame) -> DataFrame:
    """nodes(node, left, right) -> (node, key), stored: the tables' keys that a node may share with another.

    What is shared is written before it is joined, so that both sides are plain tables and a hot value can be split.
    """
    values = nodes.select("node", F.explode("left").alias("value"), F.lit(True).alias("is_left")).union(nodes.select("node", F.explode("right"), F.lit(False)))
    # Only values that some other document has can make a shared key; nearly all documents end here.
    shared = stored(values.groupBy("value").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("value"), "values")
    sides = values.join(shared, "value").groupBy("node").agg(F.collect_set(F.when(F.col("is_left"), F.col("value"))).alias("l"), F.collect_set(F.when(~F.col("is_left"), F.col("value"))).alias("r"))
    tables = sides.select("node", "r", F.explode("l").alias("x")).select("node", "x", F.explode("r").alias("y")).select("node", F.xxhash64("x", "y").alias("key"))
    return stored(tables, "tables")


def stars(tables: DataFrame) -> DataFrame:
    """(node, key) -> (node, unit): each node beside the least of all nodes that are least in one of its buckets."""
    least = stored(tables.groupBy("key").agg(F.min("node").alias("v"), F.max("node").alias("last")).where("v <> last").select("key", "v"), "least")
    chosen = stored(tables.join(least, "key").where("node <> v").groupBy("node").agg(F.min("v").alias("v")), "chosen")
    sizes = stored(chosen.groupBy("v").agg(F.ceil(F.count("*") / BLOCK).alias("chunks")), "stars")
    members = chosen.join(sizes, "v").select("node", F.xxhash64("v", F.pmod(F.xxhash64("node"), F.col("chunks"))).alias("unit"))
    centres = sizes.select("v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    return members.union(centres.select("v", F.xxhash64("v", "chunk")))


def mixed(tables: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, key), (node, label of its component) -> node, own, v, stored: nodes of buckets that hold several components, with a bucket's least node."""
    known = stored(tables.join(labels, "node", "left").select("node", "key", F.coalesce("label", "node").alias("own")), "owned")
    open_ = stored(known.groupBy("key").agg(F.min("own").alias("a"), F.max("own").alias("b"), F.min("node").alias("v")).where("a <> b").select("key", "v"), "open")
    return stored(known.join(open_, "key").select("node", "own", "v").distinct(), "mixed")


def units(groups: DataFrame, num: int, den: int) -> DataFrame:
    """groups(node, label, own, n) -> (node, unit): the units of a group in which a node is compared.

    A small group is one unit. The nodes of a larger one are of several kinds, by size (sizes of a link differ by
    at most den/num, so its ends lie in one band or in neighbouring ones) and by whether they are of the group's
    largest component `own`; each kind is cut by hash into blocks. A unit holds two blocks of kinds that can link.
    """
    sizes = groups.groupBy("label", "own").agg(F.count("*").alias("n_own"))
    sizes = stored(sizes.groupBy("label").agg(F.sum("n_own").alias("all"), F.max_by("own", F.struct("n_own", "own")).alias("largest")), "groups")
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(den / num) + 1e-9)
    rows = stored(groups.join(sizes, "label").select("node", "label", "all", F.struct(band.alias("band"), (F.col("own") == F.col("largest")).alias("major")).alias("kind")), "kinds")
    small = rows.where(F.col("all") <= BLOCK).select("node", F.xxhash64("label").alias("unit"))
    large = rows.where(F.col("all") > BLOCK)
    blocks = stored(large.groupBy("label", "kind").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "blocks")
    near = blocks.select("label", F.col("kind").alias("other"), F.col("blocks").alias("more"), F.explode(F.array(*[F.col("kind.band") + i for i in (-1, 0, 1)])).alias("band"))
    pairs = blocks.withColumn("band", F.col("kind.band")).join(near, ["label", "band"]).where("not (kind.major and other.major)")
    pairs = stored(pairs.select("label", "kind", "blocks", "other", "more"), "pairs")
    met = large.select("node", "label", "kind").join(pairs, ["label", "kind"])
    met = met.select("node", "label", "other", F.struct("kind", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block")).alias("here"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("more") - 1)).alias("block"))
    there = F.struct(F.col("other").alias("kind"), "block")
    return small.union(met.select("node", F.xxhash64("label", F.least("here", there), F.greatest("here", there)).alias("unit"))).distinct()


def links(nodes: list[int], sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """A forest of the links among a unit's sets: den * intersection >= num * union, counted exactly."""
    n = np.array([len(s) for s in sets], np.int64)
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    run = np.concatenate([[0], np.cumsum(values[1:] != values[:-1])])
    often = np.bincount(run)[run] > 1
    _, run = np.unique(run[often], return_inverse=True)
    owner = owner[often]
    both = np.zeros((len(sets), len(sets)))
    for i in range(0, int(run[-1]) + 1 if len(run) else 0, 8192):
        a, b = np.searchsorted(run, [i, i + 8192])
        m = np.zeros((8192, len(sets)), np.float32)
        m[run[a:b] - i, owner[a:b]] = 1
        both += m.T @ m
    linked = den * both >= num * (n[:, None] + n[None, :] - both)
    out, seen = [], np.zeros(len(sets), bool)
    for root in np.argsort(nodes, kind="stable"):
        if seen[root]:
            continue
        seen[root] = True
        todo = [root]
        while todo:
            for j in np.flatnonzero(linked[todo.pop()] & ~seen):
                seen[j] = True
                todo.append(j)
                out.append((nodes[j], nodes[root]))
    return out


def confirmed(docs: DataFrame, placed: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """docs(doc_id, text), placed(node, unit) -> (u, v): links confirmed on full sets."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py(), k).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["unit", "node", "shingles"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, out = None, {}, []

        def close() -> None:
            if len(held) > 1:
                out.extend(links([node for node, _ in held], [np.frombuffer(s, np.uint64) for _, s in held], num, den))

        for batch in batches:
            for u, node, s in zip(*batch.columns, strict=True):
                if u.as_py() != unit:
                    close()
                    unit, held = u.as_py(), {}
                if value := s.as_py():
                    held[node.as_py(), value] = None
            if len(out) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["u", "v"])
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["u", "v"])

    small = placed.count() <= SENT_ROWS
    rows = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
    met = rows.join(F.broadcast(placed) if small else placed, "node").select("unit", "node", "text")
    made = met.mapInArrow(sets, "unit long, node long, shingles binary")
    return made.repartition("unit").sortWithinPartitions("unit").mapInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, k: int, num: int = 80, den: int = 100) -> DataFrame:
    """docs(doc_id, text) -> a row for each document: doc_id, n_shingles, component_id, kept."""
    sig = stored(sketches(docs, k), "sketches")
    known = sig.where("n_shingles > 0 and doc_id is not null")
    nodes = stored(known.groupBy("hi", "lo").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("left").alias("left"), F.first("right").alias("right")), "nodes")
    tables = buckets(nodes)
    labels = components(confirmed(docs, stored(stars(tables), "units"), k, num, den), "links")
    left = mixed(tables, labels)
    groups = components(left.select(F.col("node").alias("u"), "v"), "candidates")
    again = left.select("node", "own").distinct().join(groups, "node").join(nodes.select("node", "n"), "node")
    found = confirmed(docs, stored(units(again, num, den), "units"), k, num, den)
    # A document stands for its set: the least document with the same set is the node. One id with several sets ties them.
    at = sig.join(nodes.select("hi", "lo", "node"), ["hi", "lo"], "left")
    at = stored(at.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")), "placed")
    several = at.where("node is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("doc_id", F.col("a").alias("v"))
    tied = at.where("node is not null").join(stored(several, "several"), "doc_id").select(F.col("node").alias("u"), "v")
    labels = components(labels.select(F.col("node").alias("u"), F.col("label").alias("v")).union(found).union(tied), "components")
    full = at.where("node is not null").join(labels, "node", "left").select("doc_id", "n_shingles", F.coalesce("label", "node").alias("component_id"))
    # A row without a set is alone, unless other rows of its id have one.
    bare = at.where("node is null").select("doc_id", "n_shingles")
    own = full.join(bare.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("c"))
    out = full.union(bare.join(own, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("c", "doc_id")))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def deduplicated(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """All columns of docs(doc_id, text, ...), one document of each group: the smallest doc_id."""
    found = near_duplicates(docs, k, num, den)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("_quire_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == F.col("_quire_gone"), "left_anti")
