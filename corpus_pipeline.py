"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each result as Parquet into the
shared folder and reads it again as the next stage's docs. All stages but the last return the columns of
`documents`. There is no SQL for these rows (a trained classifier, WAND and a packing plan); tests hold the
pipeline against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, decontaminate, lines, minhash, packing, quality
from quire.llm.common import stored
from quire.session import table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the rule ensemble scores under 0.5; it learns from labelled ids whose crc32 mod 3 is not 1."""
    model = quality.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return quality.score(docs, model, "_quire_score").where("_quire_score >= 0.5").select(*docs.columns)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take lines out that are boilerplate of their source; n_chars follows the text."""
    cut = lines.deduplicated(docs, "source", "text")
    return cut.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else cut[c] for c in docs.columns])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return minhash.deduplicated(docs, k=5)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a test item."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 4096 tokens."""
    return packing.pack(docs, bpe.path_of("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", without_boilerplate),
    ("MinHash near-dedup", one_of_each),
    ("benchmark decontamination", without_benchmarks),
    ("best-fit packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; the packed pieces."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
