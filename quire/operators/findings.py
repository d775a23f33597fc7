"""Findings as rows: filters, order, tallies, comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Severities in their order.
SEVERITIES = ("SUPPRESSED", "USAGE", "INFO", "WARNING", "ERROR", "FATAL")


def shown(findings: DataFrame, least: str = "USAGE") -> DataFrame:
    """findings(severity code, ...) of at least that severity."""
    return findings.where(F.col("severity") >= SEVERITIES.index(least))


def ordered(findings: DataFrame, package: str) -> DataFrame:
    """A place for each finding of a package: by path, line and column, then as emitted (emit_seq)."""
    return findings.withColumn("place", F.row_number().over(W.partitionBy(package).orderBy("path", "line", "col", "emit_seq")))


def tally(findings: DataFrame, code: str) -> DataFrame:
    """code, n and rank: most frequent first, then by code."""
    counts = findings.groupBy(code).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), code)))


def exit_status(findings: DataFrame, package: str) -> DataFrame:
    """Counts by severity and the status of each package: 1 if anything is an error."""
    counts = [F.count_if(F.col("severity") == i).alias(s.lower()) for i, s in enumerate(SEVERITIES) if i]
    return findings.groupBy(package).agg(*counts, F.max((F.col("severity") >= SEVERITIES.index("ERROR")).cast("int")).alias("status"))


def normalised(findings: DataFrame, package: str) -> DataFrame:
    """Distinct (package, code, severity, path) of warnings and worse: what comparisons look at."""
    return shown(findings, "WARNING").select(package, "code", "severity", "path").distinct()


def compared(got: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows that only one side has, with `side`: extra or missing. Counts of equal rows matter."""
    return got.exceptAll(wanted).withColumn("side", F.lit("extra")).unionByName(wanted.exceptAll(got).withColumn("side", F.lit("missing")))


def first_lines(lines: DataFrame, package: str, order: str, line: str, n: int = 5, size: int = 200) -> DataFrame:
    """The first n lines of each package, each cut after `size` bytes with `...` behind; a character that is cut is left out."""
    from quire.functions.scalars import whole_characters

    place = F.row_number().over(W.partitionBy(package).orderBy(order))
    data = F.col(line).cast("binary")
    short = F.when(F.octet_length(line) > size, F.concat(whole_characters(F.substring(data, 1, size)), F.lit("..."))).otherwise(F.col(line))
    return lines.select(package, order, short.alias(line), place.alias("place")).where(F.col("place") <= n)
