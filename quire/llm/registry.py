"""The subpackage's queries, by name, with SQL where SQL can express them."""

from __future__ import annotations

from quire.llm import bpe, decontaminate, langid, lines, lm, minhash, packing, quality, transport, warc, wavelet
from quire.session import table


def op1_minhash_dedup(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=4)


def op2_benchmark_decontamination(spark, sf_dir):
    return decontaminate.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), bpe.path_of("word_bpe_49k.json"), end_id=1)


def op5_warc_histories(spark, sf_dir):
    return warc.capture_histories(spark, table(spark, sf_dir, "pages"))


def op6_language_model(spark, sf_dir):
    return lm.language_model(spark, table(spark, sf_dir, "documents"), order=3)


def op7_line_dedup(spark, sf_dir):
    return lines.line_report(table(spark, sf_dir, "documents"), "doc_id", "source", "text")


def op8_wavelet_shards(spark, sf_dir):
    return wavelet.token_shards(spark, table(spark, sf_dir, "documents"), bpe.path_of("byte_bpe_50k.json"), end_id=0)


def op9_quality_rules(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_transport_streams(spark, sf_dir):
    return transport.media_columns(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_language_id": op3_language_id,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_warc_histories": op5_warc_histories,
    "op6_language_model": op6_language_model,
    "op7_line_dedup": op7_line_dedup,
    "op8_wavelet_shards": op8_wavelet_shards,
    "op9_quality_rules": op9_quality_rules,
    "op10_transport_streams": op10_transport_streams,
}
ORACLES: dict[str, str] = {"op7_line_dedup": lines.LINE_SQL}
