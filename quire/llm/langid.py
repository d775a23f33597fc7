"""Language of a text: the nearest of several centroids per language, by cosine over TF-IDF n-grams.

A text's vector counts its byte n-grams (N_GRAMS, of the lower-cased text's letters and spaces in UTF-8) in DIM hashed places,
weighs them by inverse document frequency and scales them to length 1. Training clusters each language's
vectors into at most CENTROIDS spherical means. A text takes the language of the nearest centroid; it is
rejected when its cosine is below what nearly all training texts of that language reach. Training is
bounded: about SAMPLE texts of each language, chosen by a hash of doc_id; every text is scored whole.

Defined results: a null or empty text and one without a letter are `und` with score 0 and rejected. Without
a labelled training text all are `und`. Rows are kept one for one; a null doc_id is never trained on and
counts as held out. Null labels are not learnt. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import split_of, stored

N_GRAMS = (1, 2, 3)
DIM = 4096
SAMPLE = 800
CENTROIDS = 3
SHARPNESS = 12.0  # of the score: softmax of cosines times this
UNKNOWN = "und"
TASKS = 64  # that add up frequencies
MAX_LANGS = 500  # languages that a model may hold; more is an error, not a cut

#: ASCII white space is one kind of space; ASCII digits and signs are left out, as they are of no language.
_SPACES = bytes(32 if b in b"\t\n\v\f\r" else b for b in range(256))
_OTHERS = bytes(b for b in range(128) if not chr(b).isalpha() and b not in b"\t\n\v\f\r ")


def counts(text: str) -> np.ndarray:
    """n-gram counts of a whole text in DIM places."""
    a = np.frombuffer(text.lower().encode().translate(_SPACES, _OTHERS), np.uint8).astype(np.uint32)
    out = np.zeros(DIM, np.int64)
    gram = np.zeros(len(a), np.uint32)
    for n in range(1, max(N_GRAMS) + 1):
        if len(a) < n:
            break
        gram = gram[: len(a) - n + 1] * np.uint32(257) + a[n - 1 :] + np.uint32(1)
        if n in N_GRAMS:
            out += np.bincount((gram * np.uint32(2654435761)) >> np.uint32(20), minlength=DIM)
    return out


def has_letter(text: str | None) -> bool:
    import regex

    return bool(text) and regex.search(r"\p{L}", text) is not None


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]  # of each centroid
    floors: dict[str, float]  # cosine below which a text is rejected

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        x = rows * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def predict(self, rows: np.ndarray) -> list[tuple[str, float, float, bool]]:
        """(language, score, cosine, rejected) of each row of counts."""
        names = sorted(set(self.langs))
        if not names:
            return [(UNKNOWN, 0.0, 0.0, True)] * len(rows)
        cos = self.vectors(rows) @ self.centroids.T
        best = np.stack([cos[:, [i for i, x in enumerate(self.langs) if x == n]].max(1) for n in names], 1)
        pick = best.argmax(1)
        score = np.exp((best - best.max(1, keepdims=True)) * SHARPNESS)
        score = score.max(1) / score.sum(1)
        near = best[np.arange(len(rows)), pick]
        return [(names[p], float(s), float(c), bool(c < self.floors[names[p]])) for p, s, c in zip(pick, score, near, strict=True)]


def _clusters(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from farthest-first seeds; the same rows give the same means."""
    seeds = [int(np.argmax(x @ x.mean(0)))]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(np.argmin((x @ x[seeds].T).max(1))))
    means = x[seeds]
    for _ in range(15):
        own = (x @ means.T).argmax(1)
        means = np.stack([x[own == j].sum(0) if (own == j).any() else means[j] for j in range(len(means))])
        means = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)
    return means


def train(labelled: DataFrame) -> Model:
    """labelled(doc_id, text, lang), null langs and ids left out -> a model. Two light passes, one over the sample's texts.

    The sample stays sparse and in tasks: frequencies are added up, and each language is clustered in a task of
    its own, which holds its SAMPLE. The driver sees a row for each centroid. Rows are taken in order of doc_id and
    text, and languages that score alike in that of their names.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().limit(MAX_LANGS + 1).collect()}
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not sizes:
        return Model(np.ones(DIM), np.zeros((0, DIM)), [], {})
    share = F.create_map(*[F.lit(v) for k, n in sorted(sizes.items()) for v in (k, min(1.0, SAMPLE / n))])
    picked = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, lang, text in zip(*batch.columns, strict=True):
                if has_letter(t := text.as_py()):
                    c = counts(t)
                    at = np.flatnonzero(c)
                    out.append((doc_id.as_py(), lang.as_py(), at.astype("<u2").tobytes(), c[at].astype("<f4").tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["doc_id", "lang", "at", "n"])

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(DIM, np.int64)
        for batch in batches:
            for at in batch.column(0):
                n += 1
                df[np.frombuffer(at.as_buffer(), "<u2")] += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([df.tobytes()], pa.binary())], ["n", "df"])

    sample = stored(picked.select("doc_id", "lang", "text").mapInArrow(sparse, "doc_id long, lang string, at binary, n binary"), "languages")
    sums = sample.select("at").coalesce(TASKS).mapInArrow(frequencies, "n long, df binary").collect()
    total, df = sum(r["n"] for r in sums), sum((np.frombuffer(r["df"], np.int64) for r in sums), np.zeros(DIM, np.int64))
    model = Model(np.log((1 + total) / (1 + df)) + 1, np.zeros((0, DIM)), [], {})

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        order = sorted(range(len(pdf)), key=lambda i: (pdf["doc_id"].iloc[i], pdf["at"].iloc[i], pdf["n"].iloc[i]))
        x = np.zeros((len(pdf), DIM), np.float32)
        for row, i in enumerate(order):
            x[row, np.frombuffer(pdf["at"].iloc[i], "<u2")] = np.frombuffer(pdf["n"].iloc[i], "<f4")
        x = model.vectors(x)
        means = _clusters(x, CENTROIDS)
        floor = 0.8 * float(np.quantile((x @ means.T).max(1), 0.01))
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]] * len(means), "place": range(len(means)), "mean": [m.astype("<f8").tobytes() for m in means], "floor": floor})

    found = sample.groupBy("lang").applyInPandas(cluster, "lang string, place int, mean binary, floor double").collect()
    for r in sorted(found, key=lambda r: (r["lang"], r["place"])):
        model.langs.append(r["lang"])
        model.floors[r["lang"]] = r["floor"]
    if found:
        model.centroids = np.stack([np.frombuffer(r["mean"], "<f8") for r in sorted(found, key=lambda r: (r["lang"], r["place"]))])
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text) -> doc_id, lang_pred, score, cosine, rejected."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a in range(0, len(batch), 256):
                rows = [(UNKNOWN, 0.0, 0.0, True)] * len(texts[a : a + 256])
                known, vectors = [], []
                for i, text in enumerate(texts[a : a + 256]):
                    if has_letter(t := text.as_py()):
                        known.append(i)
                        vectors.append(counts(t))
                for i, r in zip(known, model.predict(np.array(vectors)) if known else [], strict=True):
                    rows[i] = r
                columns = list(zip(*rows, strict=True))
                types = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([ids[a : a + 256], *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", "lang_pred", "score", "cosine", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, lang_pred string, score double, cosine double, rejected boolean")


def identify(docs: DataFrame, n: int = 4, held_out: int = 2) -> DataFrame:
    """docs(doc_id, text, lang) -> a prediction for every row, learnt from rows whose crc32(doc_id) mod n is not held_out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = train(rows.where(split_of(F.col("doc_id"), n) != held_out))
    held = F.coalesce(split_of(F.col("doc_id"), n) == held_out, F.lit(True))
    return predict(rows, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "cosine", "rejected")
