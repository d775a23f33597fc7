from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from quire.llm import lines, minhash
from quire.llm.graph import components
from tests.llm.fixtures import documents, empty, rows


def sets_of(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(pairs, k, num=80, den=100):
    """doc_id -> (set size, component) by comparing everything with everything."""
    known = [(i, sets_of(t, k)) for i, t in pairs if i is not None]
    parent = {i: i for i, _ in known}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(known):
        for j, t in known[:a]:
            if s and t and den * len(s & t) >= num * len(s | t):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: (len(s), find(i)) for i, s in known}


@pytest.mark.parametrize("k", [4, 5])
def test_components_equal_brute_force(spark, k):
    want = brute([(r[0], r[1]) for r in rows()], k)
    got = minhash.near_duplicates(documents(spark), k).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows())
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.component_id == r.doc_id)


def test_empty_table(spark):
    assert minhash.near_duplicates(empty(spark), 4).count() == 0
    assert lines.line_report(empty(spark), "doc_id", "source", "text").count() == 0


def test_large_group_of_near_copies_is_cut_into_units(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    base = [f"w{i}" for i in range(60)]
    data = []
    for i in range(60):
        w = list(base)
        w[i] = f"only{i}"
        data.append((i, " ".join(w)))
    want = brute(data, 4)
    got = minhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), 4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_one_document_of_each_group_stays(spark):
    kept = {r.doc_id for r in minhash.deduplicated(documents(spark)).collect()}
    want = {i for i, (_, c) in brute([(r[0], r[1]) for r in rows()], 5).items() if c == i}
    assert kept - {None} == want and minhash.deduplicated(documents(spark)).columns == documents(spark).columns


def test_tensored_keys_cost_a_square_root():
    assert len(minhash.keys(np.arange(10, dtype=np.uint64))) == 2 * minhash.SIDE
    a = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 500).astype(np.uint64))
    assert (minhash.keys(a) == minhash.keys(a)).all() and (minhash.keys(a) != minhash.keys(a[:50])).any()


def test_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "u long, v long")
    got = {r.node: r.label for r in components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_lines_equal_sql(spark):
    shared = "shared line\nkept line"
    data = [(i, f"text {i}\n{shared if i % 2 else 'other'}\n\n  ", "host" if i < 12 else None) for i in range(20)]
    data += [(50, None, "host"), (51, "", "host"), (52, "shared line", "host"), (53, "shared line", "host"), (None, "shared line\nx", "host"), (1, data[1][1], "host")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("n_lines", lines.F.lit("clash"))
    got = lines.line_report(docs, "doc_id", "source", "text").toPandas()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(data, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"}))
    want = con.sql(lines.LINE_SQL).df()
    norm = lambda d: sorted(tuple(None if pd.isna(v) else v for v in r) for r in d[["doc_id", "n_lines", "n_dropped", "text"]].astype(object).fillna(np.nan).values.tolist())
    key = lambda x: str(x)
    assert sorted(norm_rows(got), key=key) == sorted(norm_rows(want), key=key)
    assert got.n_dropped.sum() > 10


def norm_rows(d):
    return [tuple("" if pd.isna(v) else (v if isinstance(v, str) else int(v)) for v in r) for r in d[["doc_id", "n_lines", "n_dropped", "text"]].itertuples(index=False)]


def test_lines_salted_join_gives_the_same(spark, monkeypatch):
    data = [(i, f"text {i}\nshared", "h") for i in range(10)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    want = sorted(lines.line_report(docs, "doc_id", "source", "text").collect())
    monkeypatch.setattr(lines, "SENT_LINES", -1)
    assert sorted(lines.line_report(docs, "doc_id", "source", "text").collect()) == want and want[0].n_dropped == 1
    assert lines.deduplicated(docs, "source", "text").columns == docs.columns


def test_unit_rows_of_near_copies_grow_with_their_number(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    placed, plain = [], minhash.confirmed
    monkeypatch.setattr(minhash, "confirmed", lambda docs, units, *a: placed.append(units.count()) or plain(docs, units, *a))
    base = [f"w{i}" for i in range(60)]
    copy = lambda i: " ".join(base[: i % 60] + [f"only{i}"] + base[i % 60 + 1 :])
    data = [(i, copy(i)) for i in range(600)] + [(1000 + i, " ".join(base[:45]) + f" {i}" * 20) for i in range(5)]
    got = minhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), 4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(data, 4)
    assert sum(placed) < 3 * len(data), placed


def test_a_repeated_id_ties_its_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    data = [(5, a), (5, b), (5, None), (2, b), (7, c), (9, a), (8, ""), (None, a), (3, c), (3, a)]
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), 4).collect()}
    assert got == {(5, 27, 2, False), (5, 0, 2, False), (2, 27, 2, True), (7, 27, 2, False), (9, 27, 2, False), (8, 0, 8, True), (None, 27, None, True), (3, 27, 2, False)}


def test_joined_candidates_give_the_same(spark, monkeypatch):
    want = sorted(map(str, minhash.near_duplicates(documents(spark), 4).collect()))
    monkeypatch.setattr(minhash, "SENT_ROWS", -1)
    assert sorted(map(str, minhash.near_duplicates(documents(spark), 4).collect())) == want
