"""Document quality: a sparse ensemble of rules over text statistics, compiled into Spark columns.

Boosted shallow trees are grown on the statistics of labelled texts; every path from a root to a node is a
rule, a conjunction of bounds. A logistic regression with an L1 penalty weighs the rules and leaves most of
them out; the penalty is the one of PENALTIES that predicts a quarter of the training texts best from the
others. What remains is one Spark expression over the statistics, which are Spark expressions over the text,
so scoring runs no Python. Training is bounded: at most TRAIN labelled texts, chosen by a hash of doc_id.

The statistics describe any text: its size, shares of kinds of characters, number and variety of signs, length
and variety of words, repeated word pairs, and length, endings and repetition of lines.

Defined results: a null text counts as empty and is scored like any other; texts are read whole, however long.
Labels other than 0 and 1 are not learnt; a doc_id with several labels is learnt once for each, and rows that
repeat a doc_id in documents share its place, and the one with the least statistics is learnt. With no label, with one class only, or
with too few texts to split, the score is the mean label (0.5 without any). Rows are kept one for one; a null
doc_id counts as held out. Other columns are ignored.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import split_of

TRAIN = 20_000
TREES, DEPTH, SHRINK = 36, 3, 0.3
PENALTIES = (0.01, 0.003, 0.001, 0.0003, 0.0001)
SIGNS = string.punctuation
SENTENCE = ".,;:!?'\"-()"  # signs of running text; the others are symbols
LONG, SHORT = 16, 3  # bytes of a long and of a short word
NAMES = (
    "log_bytes", "capitals", "digits", "spaces", "beyond_ascii", "signs", "symbols", "sign_entropy", "top_sign", "word_bytes", "long_words", "short_words", "distinct_words", "distinct_share", "repeated_pairs",
    "lines", "line_spread", "repeated_lines", "ended_lines",
)


def described(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of docs, and the statistics NAMES of its text with _quire_ in front."""
    t = F.coalesce(docs[text].cast("string"), F.lit(""))
    without = lambda c: F.octet_length(F.col("_quire_t")) - F.octet_length(c)
    rows = docs.select("*", t.alias("_quire_t"))
    counts = F.array(*[without(F.replace(F.col("_quire_t"), F.lit(c))) for c in SIGNS])
    hashes = F.transform(F.split("_quire_t", "[ \n]"), lambda w: F.xxhash64(w))
    lengths = F.transform(F.split("_quire_t", "[ \n]"), lambda w: F.octet_length(w))
    rows = rows.select("*", counts.alias("_quire_c"), hashes.alias("_quire_w"), lengths.alias("_quire_l"), F.split("_quire_t", "\n").alias("_quire_n"))
    n, n_words, n_lines = F.greatest(F.octet_length("_quire_t"), F.lit(1)), F.size("_quire_w"), F.size("_quire_n")
    total = lambda signs: sum((F.col("_quire_c")[SIGNS.index(c)] for c in signs), F.lit(0))
    signs = total(SIGNS)
    entropy = F.log(F.greatest(signs, F.lit(1))) - F.aggregate("_quire_c", F.lit(0.0), lambda s, c: s + F.when(c > 0, c * F.log(c.cast("double"))).otherwise(0.0)) / F.greatest(signs, F.lit(1))
    pairs = F.zip_with(F.slice("_quire_w", 1, F.greatest(n_words - 1, F.lit(1))), F.slice("_quire_w", 2, F.greatest(n_words - 1, F.lit(1))), lambda x, y: F.xxhash64(x, y))
    mean = (F.octet_length("_quire_t") - n_lines + 1) / n_lines
    spread = F.sqrt(F.aggregate("_quire_n", F.lit(0.0), lambda s, x: s + F.pow(F.octet_length(x) - mean, 2)) / n_lines)
    stats = {
        "log_bytes": F.log1p(F.octet_length("_quire_t").cast("double")),
        "capitals": without(F.translate("_quire_t", string.ascii_uppercase, "")) / n,
        "digits": without(F.translate("_quire_t", string.digits, "")) / n,
        "spaces": without(F.translate("_quire_t", string.whitespace, "")) / n,
        "beyond_ascii": (F.octet_length("_quire_t") - F.length("_quire_t")) / n,
        "signs": signs / n,
        "symbols": total([c for c in SIGNS if c not in SENTENCE]) / n,
        "sign_entropy": entropy,
        "top_sign": F.array_max("_quire_c") / F.greatest(signs, F.lit(1)),
        "word_bytes": F.octet_length("_quire_t") / n_words,
        "long_words": F.size(F.filter("_quire_l", lambda x: x >= LONG)) / n_words,
        "short_words": F.size(F.filter("_quire_l", lambda x: x <= SHORT)) / n_words,
        "distinct_words": F.size(F.array_distinct("_quire_w")) / F.sqrt(n_words.cast("double")),
        "distinct_share": F.size(F.array_distinct("_quire_w")) / n_words,
        "repeated_pairs": 1 - F.size(F.array_distinct(pairs)) / F.size(pairs),
        "lines": n_lines / n,
        "line_spread": spread / F.greatest(mean, F.lit(1.0)),
        "repeated_lines": 1 - F.size(F.array_distinct("_quire_n")) / n_lines,
        "ended_lines": F.size(F.filter("_quire_n", lambda x: F.substring(x, -1, 1).isin(".", "!", "?"))) / n_lines,
    }
    return rows.select(*[docs[c] for c in docs.columns], *[stats[k].alias(f"_quire_{k}") for k in NAMES])


@dataclass
class Rule:
    bounds: tuple[tuple[int, bool, float], ...]  # (statistic, above, at): above means > at, else <= at
    weight: float = 0.0

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for j, above, at in self.bounds:
            out &= (x[:, j] > at) == above
        return out


@dataclass
class Model:
    names: list[str]
    rules: list[Rule]
    bias: float

    def column(self) -> Column:
        """The score as a Spark expression over columns of described()."""
        z = F.lit(float(self.bias))
        for r in self.rules:
            held = F.lit(True)
            for j, above, at in r.bounds:
                c = F.col(f"_quire_{self.names[j]}")
                held = held & (c > at if above else c <= at)
            z = z + F.when(held, F.lit(float(r.weight))).otherwise(0.0)
        return 1 / (1 + F.exp(-z))

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for r in self.rules:
            z += np.where(r.holds(x), r.weight, 0.0)
        return 1 / (1 + np.exp(-z))


def _grow(x: np.ndarray, pull: np.ndarray, rows: np.ndarray, cuts: list[np.ndarray], bounds: tuple, depth: int, rules: list, out: np.ndarray) -> None:
    """A regression tree on pull; each node below the root adds its path to rules."""
    value = pull[rows].mean()
    best = (1e-9, 0, 0.0)
    if depth and len(rows) >= 20:
        total = pull[rows].sum()
        for j, at in enumerate(cuts):
            if not len(at):
                continue
            bin_of = np.searchsorted(at, x[rows, j], "left")  # bin b: at[b-1] < value <= at[b]
            n = np.bincount(bin_of, minlength=len(at) + 1).cumsum()[:-1]
            s = np.bincount(bin_of, pull[rows], len(at) + 1).cumsum()[:-1]
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = s * s / n + (total - s) ** 2 / (len(rows) - n) - total * total / len(rows)
            gain[(n < 5) | (len(rows) - n < 5)] = 0
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), j, float(at[k]))
    if best[0] <= 1e-9:
        out[rows] += SHRINK * value
        return
    _, j, at = best
    for above in (False, True):
        path = (*bounds, (j, above, at))
        rules.append(tuple(sorted(path)))
        _grow(x, pull, rows[(x[rows, j] > at) == above], cuts, path, depth - 1, rules, out)


def lasso(a: np.ndarray, n: np.ndarray, ones: np.ndarray, penalty: float, w: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise mean logistic loss + penalty * |w|, by accelerated proximal gradient.

    A row of a stands for n texts, of which `ones` have label 1; columns of a are centred. w, bias: where to begin.
    """
    total = n.sum()
    step = 4 * total / (np.linalg.norm(a * np.sqrt(n)[:, None], 2) ** 2 + total)
    v, u, t = w, bias, 1.0
    for _ in range(2000):
        slope = n / (1 + np.exp(-(a @ v + u))) - ones
        new = v - step * (a.T @ slope) / total
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        up = u - step * slope.sum() / total
        moved = max(np.abs(new - w).max(initial=0.0), abs(up - bias))
        t, was = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, u = new + (was - 1) / t * (new - w), up + (was - 1) / t * (up - bias)
        w, bias = new, up
        if moved < 1e-5:
            break
    return w, bias


def _patterns(a: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows of a, how many rows are like each, and how many of them have label 1."""
    bits = np.ascontiguousarray(np.packbits(a, axis=1))
    _, first, at = np.unique(bits.view([("", np.void, bits.shape[1])]).ravel(), return_index=True, return_inverse=True)
    return a[first].astype(float), np.bincount(at).astype(float), np.bincount(at, y)


def fit(x: np.ndarray, y: np.ndarray, names: list[str]) -> Model:
    """Rules from boosted trees, weighted by an L1-penalised logistic regression; its penalty is chosen on every fourth row."""
    mean = float(y.mean()) if len(y) else 0.5
    constant = Model(names, [], float(np.log((mean + 1e-3) / (1 - mean + 1e-3))))
    if not len(y) or y.min() == y.max():
        return constant
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.01, 0.99, 60), method="lower"))[:-1] for j in range(x.shape[1])]
    cuts = [np.unique(np.concatenate([c, [x[:, j].min()]])) if x[:, j].min() < x[:, j].max() else c[:0] for j, c in enumerate(cuts)]
    aside = np.arange(len(y)) % 4 == 3
    inside = np.flatnonzero(~aside)
    paths: list[tuple] = []
    z = np.zeros(len(y))
    for i in range(TREES):  # each tree sees a third of the statistics, so that no one of them makes all rules
        own = [c if (j + i) % 3 == 0 or len(cuts) < 3 else c[:0] for j, c in enumerate(cuts)]
        _grow(x, (y - 1 / (1 + np.exp(-z))) * 4, inside, own, (), DEPTH, paths, z)
    rules = [Rule(p) for p in dict.fromkeys(paths)]
    if not rules:  # too few texts to split
        return constant
    a = np.stack([r.holds(x) for r in rules], 1)
    keep = sorted(np.unique(a, axis=1, return_index=True)[1])  # rules that hold for the same rows count once
    rules, a = [rules[i] for i in keep], a[:, keep]
    centre = a.mean(0)
    b, n, ones = _patterns(a[inside], y[inside])
    w, bias, best = np.zeros(len(rules)), float(np.log((mean + 1e-3) / (1 - mean + 1e-3))), (np.inf, 0.0)
    for penalty in PENALTIES:
        w, bias = lasso(b - centre, n, ones, penalty, w, bias)
        z = (a[aside] - centre) @ w + bias
        loss = float(np.mean(np.logaddexp(0, z) - y[aside] * z)) if aside.any() else 0.0
        best = min(best, (loss, penalty))
    b, n, ones = _patterns(a, y)
    w, bias = lasso(b - centre, n, ones, best[1], w, bias)
    kept = [Rule(r.bounds, float(c)) for r, c in zip(rules, w, strict=True) if c]
    return Model(names, kept, float(bias - centre @ w))


def train(docs: DataFrame, labels: DataFrame, n: int = 3, held_out: int = 1, rows: int = TRAIN) -> Model:
    """docs(doc_id, text) and labels(doc_id, quality) -> a model, from ids whose crc32 mod n is not held_out."""
    known = labels.select(F.col("doc_id").cast("long").alias("l_id"), F.col("quality").cast("int").alias("l_quality")).where("l_quality in (0, 1)")
    known = known.where(split_of(F.col("l_id"), n) != held_out).orderBy(F.xxhash64("l_id"), "l_id", "l_quality").limit(rows)
    # At most `rows` labels: bounded, so the labels are what is sent, and only their texts are looked at. A row
    # of labels has a number, so that repeated rows of documents do not add to them.
    known = known.withColumn("l_row", F.monotonically_increasing_id())
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), F.col("doc_id") == F.col("l_id"))
    stats = [f"_quire_{k}" for k in NAMES]
    found = described(joined).select("l_row", "l_quality", F.struct(*stats).alias("s")).groupBy("l_row").agg(F.min(F.struct("l_quality", "s")).alias("m"))
    found = found.select("m.l_quality", *[F.col(f"m.s.{k}") for k in stats]).toPandas()
    found = found.sort_values(list(found.columns)).to_numpy(float)
    return fit(found[:, 1:], found[:, 0], list(NAMES))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All columns of docs(text, ...), and the score."""
    scored = described(docs).select(*[F.col(c) for c in docs.columns], model.column().alias("_quire_value"))
    # The score comes out of a one-row generator: a filter on it would otherwise be pushed below the
    # statistics, where each mention of a statistic computes it again.
    return scored.select(*[F.col(c) for c in docs.columns], F.inline(F.array(F.struct(F.col("_quire_value").alias(name)))))


def classify(docs: DataFrame, labels: DataFrame, n: int = 3, held_out: int = 1) -> DataFrame:
    """A row for each document: doc_id, held_out, score, predicted."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = score(rows, train(rows, labels, n, held_out))
    held = F.coalesce(split_of(F.col("doc_id"), n) == held_out, F.lit(True))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
