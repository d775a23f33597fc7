"""The pipeline on the smallest tables, every stage held against a plain version on the stage's own input."""

import re
import string

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quire import session
from quire.llm import bpe, decontaminate, lines, quality
from tests.llm.fixtures import documents
from tests.llm.test_dedup import brute
from tests.llm.test_models import confirmed

pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = [spark.read.parquet(f"{SF}/documents.parquet").cache()]
    for _, stage in corpus_pipeline.STAGES:
        docs.append(stage(spark, docs[-1], SF).cache())
    return docs


def test_columns_are_kept(stages):
    assert all(d.columns == stages[0].columns for d in stages[:5])


def test_quality(spark, stages):
    x = stages[0].toPandas()
    model = quality.train(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))

    def stats(t):
        b, words, lines = t.encode(), re.split("[ \n]", t), t.split("\n")
        n, sizes, k = max(len(b), 1), [len(w.encode()) for w in words], len(words)
        signs = [t.count(c) for c in quality.SIGNS]
        p = np.array([c / sum(signs) for c in signs if c])
        share = lambda chars: sum(c in chars for c in t) / n
        pairs, mean = list(zip(words, words[1:], strict=False)) or [0], sum(len(x.encode()) for x in lines) / len(lines)
        return [
            np.log1p(len(b)), share(string.ascii_uppercase), share(string.digits), share(string.whitespace), (len(b) - len(t)) / n, sum(signs) / n, share(set(string.punctuation) - set(quality.SENTENCE)),
            -(p * np.log(p)).sum(), p.max(initial=0), len(b) / k, sum(z >= 16 for z in sizes) / k, sum(z <= 3 for z in sizes) / k, len(set(words)) / k**0.5, len(set(words)) / k, 1 - len(set(pairs)) / len(pairs),
            len(lines) / n, np.mean([(len(x.encode()) - mean) ** 2 for x in lines]) ** 0.5 / max(mean, 1), 1 - len(set(lines)) / len(lines), sum(x[-1:] in (".", "!", "?") for x in lines if x) / len(lines),
        ]

    got = quality.described(stages[0].select("text")).select("text", *[f"_quire_{k}" for k in quality.NAMES]).collect()
    for r in got:
        assert np.allclose(stats(r[0] or ""), r[1:]), r[0]
    want = set(x.doc_id[model.scores(np.array([stats(t or "") for t in x.text])) >= 0.5])
    assert {r.doc_id for r in stages[1].collect()} == want and 0 < len(want) < len(x)


def test_lines(stages):
    con = duckdb.connect()
    con.register("documents", stages[1].toPandas())
    want = {r[0]: r[3] for r in con.sql(lines.LINE_SQL).fetchall()}
    got = {r.doc_id: (r.text, r.n_chars) for r in stages[2].collect()}
    assert got == {i: (t, len(t)) for i, t in want.items()}


def test_near_duplicates(stages):
    want = {i for i, (_, c) in brute([(r.doc_id, r.text) for r in stages[2].collect()], 5).items() if c == i}
    assert {r.doc_id for r in stages[3].collect()} == want


def test_decontamination(spark, stages):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = set()
    for r in stages[3].collect():
        w = decontaminate.words(r.text)
        have = decontaminate.shingles(w, 3)
        gone |= {r.doc_id for t in items if decontaminate.shingles(decontaminate.words(t), 3) & have and confirmed(t, w, 0.8)}
    assert {r.doc_id for r in stages[4].collect()} == {r.doc_id for r in stages[3].collect()} - gone


def test_packing(stages):
    library = Tokenizer.from_file(bpe.path_of("word_bpe_49k.json"))
    want = {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in stages[4].collect()}
    rows = stages[5].toPandas()
    assert rows.groupby("doc_id").length.sum().to_dict() == want
    assert (rows.groupby("sequence_id").length.sum() <= 4096).all() and rows.sequence_id.nunique() <= sum(want.values()) / 4096 * 1.05 + 2


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(tuple, stages[5].select("doc_id", "piece", "ids_crc32").collect()))


def test_awkward_documents(spark):
    docs = documents(spark).drop("n_shingles", "component_id", "score", "start")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        assert docs.count() > 0, name


def test_empty_documents_give_no_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.count() == 0 and out.columns == docs.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0


def test_python_workers_get_tables_in_small_batches(spark):
    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "bytes": [b.nbytes]})

    docs = session.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", F.repeat("text", 20).alias("text"))
    got = docs.mapInArrow(sizes, "n long, bytes long").collect()
    assert sum(r.n for r in got) == docs.count() and max(r.n for r in got) <= 2000
    longest = docs.agg(F.max(F.octet_length("text"))).first()[0]
    assert max(r.bytes for r in got) < (4 << 20) + longest + 100_000
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    try:
        spark.conf.set(key, "77")
        session.bounded(spark)
        assert spark.conf.get(key) == "77"
    finally:
        spark.conf.unset(key)
