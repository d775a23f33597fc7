"""Registered queries over the validation rules: every customer has a package of each family of cases (see corpus).

A package's findings are counted by code and path. Its SQL joins the customers with the findings that the
conditions of the rules ask for, so each query holds a family of rules against them on the whole table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans import corpus, package_rules
from quire.session import table

RULES = {
    "container": package_rules.container_rules, "metadata": package_rules.metadata_rules, "manifest": package_rules.manifest_rules, "content": package_rules.content_rules,
    "elements": package_rules.structure_rules, "resources": package_rules.resource_rules, "own": package_rules.own_rules,
}


def packages(spark: SparkSession, sf_dir: str, family: str) -> DataFrame:
    """package_id, content: the case of each customer."""
    n = len(corpus.FAMILIES[family])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                keys = batch.column(0)[at : at + 256].to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array(map(str, keys), pa.string()), pa.array([corpus.package(family, k % n) for k in keys], pa.binary())], ["package_id", "content"])

    return table(spark, sf_dir, "customer").select("c_custkey").mapInArrow(build, "package_id string, content binary")


def _query(family: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = package_rules.reported(RULES[family](package_rules.tables(packages(spark, sf_dir, family))))
        return found.groupBy("package_id", "code", "severity_name", "path").agg(F.count("*").alias("n"))

    run.__doc__ = f"Findings of the {family} rules on the model packages of that family."
    return run


def _sql(family: str) -> str:
    severity = " ".join(f"WHEN code IN ({', '.join(repr(c) for c in codes)}) THEN '{name}'" for name, codes in package_rules.CODES.items())
    return f"""SELECT CAST(c_custkey AS VARCHAR) AS package_id, code, CASE {severity} END AS severity_name, path, CAST(n AS BIGINT) AS n
FROM customer JOIN (VALUES {corpus.expected(family)}) v(k, code, path, n) ON c_custkey % {len(corpus.FAMILIES[family])} = k"""


QUERIES = {f"package_{f}": _query(f) for f in RULES}
ORACLES = {f"package_{f}": _sql(f) for f in RULES}
