import itertools
import math
from collections import Counter

import numpy as np
import pytest

from quire.llm import decontaminate, langid, lm, quality
from quire.llm.eliasfano import Sequence, encode
from quire.llm.words import hashed
from tests.llm.fixtures import crc, documents, empty, rows

DATA = "/root/testdata/sf0.01"


def test_words_of_many_texts_have_one_hash_each():
    texts = ["", " \t\n", "Aa aA\x0b\x0c aa\r", "a" * 8, "a" * 7 + " " + "a" * 9, "a" * 64 + " " + "a" * 65, "\0 \0\0", "É é\x1c", "x" * 200 + " b", " b"]
    h, n = hashed([t.encode() for t in texts])
    words = [w for t in texts for w in t.encode().lower().split()]
    assert n.tolist() == [len(t.encode().split()) for t in texts] and len(h) == len(words)
    assert len(set(zip(words, h.tolist(), strict=True))) == len(set(words)) == len(set(h.tolist()))
    assert [x.tolist() for x in hashed([])] == [[], []]


@pytest.mark.parametrize("universe,n", [(100, 50), (1 << 40, 1000), (5000, 4999), (1 << 63, 2000), (10, 1), (7, 30)])
def test_elias_fano(universe, n):
    r = np.random.default_rng(universe % 97)
    v = np.sort(r.integers(0, universe, n, dtype=np.uint64))
    s = Sequence(np.frombuffer(encode(v, universe), np.uint8))
    q = np.sort(np.concatenate([v[:200], r.integers(0, universe, 200, dtype=np.uint64)]))
    at = np.searchsorted(v, q)
    assert (s.successor(q) == at).all() and (s.get(np.arange(n)) == v).all()
    assert (s.find(q, universe) == np.where((at < n) & (v[np.minimum(at, n - 1)] == q), at, -1)).all()


def test_language_model_equals_brute_force(spark):
    data = [(r[0], r[1]) for r in rows()]
    words = lambda t: [*(t or "").encode().lower().split(), b"</s>"]
    learnt = [words(t) for i, t in data if i is not None and crc(i, 7) != 2]
    c, pairs = Counter(w for t in learnt for w in t), Counter(p for t in learnt for p in zip([b"<s>", *t], t, strict=False))
    n, v = sum(c.values()), len(c)
    once, twice = (sum(x == k for x in c.values()) for k in (1, 2))
    d = once / (once + 2 * twice)
    context = dict(c) | {b"<s>": len(learnt)}
    got = lm.language_model(spark, documents(spark)).collect()
    assert len(got) == len(data)
    by = dict(data)
    for r in got:
        t = words(by[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(w in c for w in t), n)
        assert r.held_out == (r.doc_id is None or crc(r.doc_id, 7) == 2)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))
        score = 0.0
        for u, w in zip([b"<s>", *t], t, strict=False):
            p = (c[w] - d) / n if w in c else d * v / n
            if u in context:
                p = p * lm.PRIOR / (context[u] + lm.PRIOR) + pairs[u, w] / (context[u] + lm.PRIOR)
            score += math.log10(p)
        assert r.score == pytest.approx(score, abs=0.02 * len(t))


def test_language_model_of_order_3_equals_brute_force(spark, monkeypatch):
    data = [(r[0], r[1]) for r in rows()]
    words = lambda t: [*(t or "").encode().lower().split(), b"</s>"]
    learnt = [words(t) for i, t in data if i is not None and crc(i, 7) != 2]
    c, starts = Counter(w for t in learnt for w in t), [[b"<s>", *t] for t in learnt]
    pairs, triples = (Counter(tuple(t[i : i + k]) for t in starts for i in range(len(t) - k + 1)) for k in (2, 3))
    n, v, context = sum(c.values()), len(c), dict(c) | {b"<s>": len(learnt)}
    once, twice = (sum(x == k for x in c.values()) for k in (1, 2))
    d = once / (once + 2 * twice)
    got = lm.language_model(spark, documents(spark), order=3).collect()
    by, deeper = dict(data), 0
    assert len(got) == len(data)
    for r in got:
        t, score = [b"<s>", *words(by[r.doc_id])], 0.0
        for i in range(1, len(t)):
            p = (c[t[i]] - d) / n if t[i] in c else d * v / n
            for k, seen, above in ((1, context, pairs), (2, pairs, triples)):
                before = tuple(t[i - k : i]) if i >= k else None
                before = before[0] if k == 1 else before
                if before in seen:
                    p = (p * lm.PRIOR + above[tuple(t[i - k : i + 1])]) / (seen[before] + lm.PRIOR)
                    deeper += k == 2
            score += math.log10(p)
        assert r.score == pytest.approx(score, abs=0.02 * (len(t) - 1))
    assert deeper > 1000
    monkeypatch.setattr(lm, "PENDING", 100)
    again = {(r.doc_id, r.n_tokens): r.score for r in lm.language_model(spark, documents(spark), order=3).collect()}
    assert all(again[r.doc_id, r.n_tokens] == pytest.approx(r.score) for r in got)


@pytest.mark.parametrize("order", [2, 3])
def test_probabilities_after_a_context_add_up_to_one_at_most(spark, order):
    vocabulary = ["a", "b", "c", "unseen"]
    data = [(i, "a b " * (5 + i % 3) + "c") for i in range(40)]
    texts = [" ".join(x) for k in range(3) for x in itertools.product(vocabulary, repeat=k)] + ["a b " * 500, "a b " * 1000]
    ids = {}
    for i in range(1000, 2000):
        if crc(i, 7) == 2 and len(ids) < len(texts):
            ids[i] = texts[len(ids)]
    got = lm.language_model(spark, spark.createDataFrame([x for x in data if crc(x[0], 7) != 2] + list(ids.items()), "doc_id long, text string"), order=order).collect()
    score = {ids[r.doc_id]: r.score for r in got if r.doc_id in ids}
    assert all(s <= 0 for s in score.values()) and score["a b " * 1000] < score["a b " * 500]
    # A text's probability ends with the end token's: over all texts of one and two words they add up to less than 1.
    assert sum(10**s for t, s in score.items() if len(t) < 20) < 1


def test_scores_do_not_depend_on_the_number_of_shards(spark):
    docs, found = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), []
    for n in ("1", "8", "31"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            found.append({r.doc_id: r.score for r in lm.language_model(spark, docs, order=3).collect()})
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert all(f == {i: pytest.approx(s) for i, s in found[0].items()} for f in found[1:])


def test_registered_language_model_has_order_3(spark, monkeypatch):
    from quire.llm import registry

    data = [(i, "a b c" if i % 2 else "d b e") for i in range(100)] + [(i, "a b c" if i % 2 else "a b e") for i in range(1000, 1200)]
    docs = spark.createDataFrame([x for x in data if x[0] < 100 or crc(x[0], 7) == 2], "doc_id long, text string")
    monkeypatch.setattr(registry, "table", lambda *_: docs)
    score = {i: r.score for r in registry.op6_language_model(spark, "").collect() for i in [dict(data)[r.doc_id]] if r.doc_id >= 1000}
    assert score["a b c"] > score["a b e"] + 0.5  # after one word, c and e are equally frequent


def test_language_model_without_training(spark):
    assert lm.language_model(spark, empty(spark)).count() == 0
    only = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    assert [(r.score, r.base_score, r.n_known, r.train_tokens) for r in lm.language_model(spark, only).collect()] == [(0.0, 0.0, 0, 0)]


def test_frequent_context_is_cut_by_successor():
    w = lm.Words("", np.full(8, 100), 1000, 10, 0.5)
    u, v, c = np.zeros(800, np.int64), np.arange(800), np.full(800, 500)
    assert len(set(w.pair_shard(u, v, c).tolist())) == 4 and len(set(w.pair_shard(u, v, c // 500).tolist())) == 1


def test_languages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(got) == 1000 and (held.lang_pred == held.lang).mean() > 0.97 and got.score.between(0, 1).all()
    rough = langid.identify(documents(spark)).collect()
    assert len(rough) == len(rows())
    for r in rough:
        text = dict((x[0], x[1]) for x in rows())[r.doc_id]
        assert (r.lang_pred == "und") == (not text or not any(ch.isalpha() for ch in text))
    assert {r.lang_pred for r in langid.identify(documents(spark).withColumn("lang", langid.F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(empty(spark)).count() == 0


def test_languages_equal_plain_cosines(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.train(docs.select("doc_id", "text", "lang"))
    assert [sorted(set(model.langs))[0], len(model.langs)] == ["de", 12]

    def plain(text):
        grams = Counter()
        data = bytes(32 if b in b"\t\n\v\f\r" else b for b in text.lower().encode() if b >= 128 or chr(b).isalpha() or b in b"\t\n\v\f\r ")
        for n in (1, 2, 3):
            for i in range(len(data) - n + 1):
                h = 0
                for b in data[i : i + n]:
                    h = (h * 257 + b + 1) % 2**32
                grams[h * 2654435761 % 2**32 >> 20] += 1
        v = {k: c * model.idf[k] for k, c in grams.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        cos = [sum(x * m[k] for k, x in v.items()) / norm for m in model.centroids]
        best = {lang: max(c for c, x in zip(cos, model.langs, strict=True) if x == lang) for lang in model.langs}
        top = min(best, key=lambda x: (-best[x], x))
        return top, 1 / sum(math.exp((b - best[top]) * langid.SHARPNESS) for b in best.values()), best[top], best[top] < model.floors[top]

    rows_of = {i: t for i, t in [(r[0], r[1]) for r in rows()][:60] if i is not None and len(t or "") < 5000}
    got = langid.predict(spark.createDataFrame(list(rows_of.items()), "doc_id long, text string"), model).collect()
    for r in got:
        if langid.has_letter(rows_of[r.doc_id]):
            lang, score, cosine, rejected = plain(rows_of[r.doc_id])
            assert (r.lang_pred, r.rejected) == (lang, rejected) and r.score == pytest.approx(score, abs=1e-5) and r.cosine == pytest.approx(cosine, abs=1e-5)
    assert len({r.lang_pred for r in got}) > 2


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.95 and got.score.between(0, 1).all()
    rough = quality.classify(documents(spark), labels).collect()
    assert len(rough) == len(rows()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rough)
    assert {r.score for r in quality.classify(documents(spark), labels.limit(0)).collect()} == {0.5}
    assert quality.classify(empty(spark), labels).count() == 0
    model = quality.train(docs, labels)
    assert model.rules and quality.score(docs, model).columns[-1] == "score"
    stats = quality.described(docs).select(*[f"_quire_{k}" for k in quality.NAMES], model.column().alias("s")).toPandas().to_numpy(float)
    assert np.allclose(model.scores(stats[:, :-1]), stats[:, -1])
    assert len(model.rules) > 8 and len(set(got.score.round(6))) > 30
    again = labels.union(labels)  # a label that is repeated is learnt twice, a text that is repeated once
    assert [r.bounds for r in quality.train(docs.union(docs), labels).rules] == [r.bounds for r in model.rules] and quality.train(docs, again).rules


def test_penalised_regression_equals_a_plain_solver():
    r = np.random.default_rng(3)
    a = r.integers(0, 2, (400, 6)).astype(bool)
    y = (r.random(400) < 1 / (1 + np.exp(-(3.0 * a[:, 0] - 2.0 * a[:, 1])))).astype(float)
    centre = a.mean(0)
    b, n, ones = quality._patterns(a, y)
    w, bias = quality.lasso(b - centre, n, ones, 0.01, np.zeros(6), 0.0)
    v, u, x = np.zeros(6), 0.0, a - centre
    for _ in range(20_000):
        slope = 1 / (1 + np.exp(-(x @ v + u))) - y
        v = v - 0.3 * (x.T @ slope) / 400
        v, u = np.sign(v) * np.maximum(np.abs(v) - 0.3 * 0.01, 0), u - 0.3 * slope.mean()
    assert np.allclose(w, v, atol=5e-3) and abs(bias - u) < 5e-3 and (v == 0).any() and ((w == 0) == (v == 0)).all()


def test_quality_ranks_within_what_one_sign_tells():
    r = np.random.default_rng(4)
    x = np.stack([r.random(4000), r.random(4000)], 1)
    y = (r.random(4000) < np.where(x[:, 0] > 0.5, 0.5 + 0.4 * x[:, 1], 0.1 + 0.3 * x[:, 1])).astype(float)
    model = quality.fit(x[:3000], y[:3000], ["a", "b"])
    s, held = model.scores(x[3000:]), x[3000:]
    for side in (held[:, 0] > 0.5, held[:, 0] <= 0.5):
        assert np.corrcoef(s[side], held[side, 1])[0, 1] > 0.6 and len(set(s[side].round(6))) > 5


ITEMS = [(1, "The quick brown fox jumps over the lazy dog today. It then slept for nine hours straight."), (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (3, None), (4, ""), (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (None, "a b c d e f"), (5, "short one")]


def test_decontamination(spark):
    filler = " ".join(f"f{i}" for i in range(200))
    data = [
        (1, f"{filler} the QUICK brown fox; jumps over the lazy dog today - it then slept for nine hours straight {filler}"), (2, f"{filler} alpha beta gamma delta epsilon zeta eta theta iota"),
        (3, "alpha beta gamma only"), (4, None), (5, ""), (None, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (6, filler), (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (7, f"{filler} Short one."),
    ]
    docs, items = spark.createDataFrame(data, "doc_id long, text string").withColumn("item_id", langid.F.lit("x")), spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminations(docs, items).collect()}
    assert got == {(1, 1), (1, 2), (2, 2), (None, 2), (7, 5)}
    kept = decontaminate.decontaminated(docs, items)
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [3, 4, 5, 6] and kept.columns == docs.columns
    assert decontaminate.contaminations(docs.limit(0), items).count() == 0 and decontaminate.contaminations(docs, items.limit(0)).count() == 0


def confirmed(text, passage, overlap):
    """Whether a passage (words) holds a test item, by counting shingles and runs one by one."""
    parts = [*decontaminate.question_and_answer(text), decontaminate.words(text)]

    def share(part):
        held = lambda run: any(passage[i : i + len(run)] == run for i in range(len(passage) - len(run) + 1))
        if len(part) >= 5:
            runs = {tuple(part[i : i + 5]) for i in range(len(part) - 4)}
            return sum(held(list(r)) for r in runs) / len(runs)
        return max([k / len(part) for k in range(1, len(part) + 1) if any(held(part[i : i + k]) for i in range(len(part) - k + 1))], default=0.0) if part else 1.0

    q, a, whole = map(share, parts)
    return min(q, a) >= overlap or whole >= overlap and a >= 0.5


def plain_scores(items):
    """doc words -> {item: score of its best window that reaches least and is confirmed}, by plain BM25 sums over every window and item."""
    texts = sorted({(i, t) for i, t in items if i is not None and t is not None and decontaminate.words(t)})
    bags = [decontaminate.words(t) for _, t in texts]
    n, mean, longest = len(bags), sum(map(len, bags)) / len(bags), max(map(len, bags))
    df = Counter(x for w in bags for x in set(w))
    weights = []
    for w in bags:
        own = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t, c in Counter(w).items()}
        weights.append({t: x / sum(own.values()) for t, x in own.items()})

    def of(w, least):
        out = {}
        for at in range(0, max(1, len(w) - longest), longest) if w else ():
            window = w[at : at + 2 * longest]
            terms = set(window)
            for (i, text), own in zip(texts, weights, strict=True):
                score = sum(x for t, x in own.items() if t in terms)
                if score >= least and confirmed(text, window, least):
                    out[i] = max(score, out.get(i, 0.0))
        return out

    return of


@pytest.mark.parametrize("size", [15, 1000])
def test_hits_equal_plain_bm25_whatever_the_parts(spark, monkeypatch, size):
    monkeypatch.setattr(decontaminate, "ITEMS", size)
    docs, items = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    of = plain_scores([tuple(r) for r in items.select("item_id", "text").collect()])
    want = {}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id % 3 == 0}
    for i, text in texts.items():
        want |= {(i, k): s for k, s in of(decontaminate.words(text), 0.3).items()}
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminations(docs.where("doc_id % 3 = 0"), items, 0.3, 0.3).collect()}
    assert got == {k: pytest.approx(s) for k, s in want.items()} and want


def test_an_item_without_its_answer_is_not_reported(spark):
    item = " ".join(f"q{i}" for i in range(26)) + ". one two three four five"
    docs = spark.createDataFrame([(1, item), (2, item.partition(".")[0]), (3, "one two three four five")], "doc_id long, text string")
    items = spark.createDataFrame([(1, item)] + [(i, f"other{i} words of item {i}") for i in range(2, 40)], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.answer_overlap) for r in decontaminate.contaminations(docs, items).collect()] == [(1, 1, 1.0)]


def test_wand_equals_plain_sums():
    r = np.random.default_rng(5)
    items = [(i, " ".join(f"w{x}" for x in r.zipf(1.5, r.integers(5, 40)) % 60)) for i in range(70)]
    df = Counter(x for _, t in items for x in set(decontaminate.words(t)))
    index = decontaminate.Index(items, df, 70, 20.0, 40)
    entered = 0
    for _ in range(60):
        terms = sorted(set(r.integers(0, len(index.terms), 20).tolist()))
        sums = {}
        for t in terms:
            for d, v in zip(index.docs[t], index.impacts[t], strict=True):
                sums[d] = sums.get(d, 0.0) + v
        for threshold in (0.1, 0.3, 0.6):
            want = sorted((d, round(v, 9)) for d, v in sums.items() if v >= threshold - 1e-9)
            assert sorted((d, round(v, 9)) for d, v in index.search(np.array(terms), threshold)) == want
            entered += len(want)
    assert entered
