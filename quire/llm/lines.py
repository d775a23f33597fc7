"""Boilerplate lines by site-relative frequency, with DataFrame functions alone.

Pages are grouped by host. A line is boilerplate of a host when at least MIN_PAGES of the host's pages hold
it and they are more than RATIO of all the host's pages; it is dropped from every page of that host. Every
row is a page, copies too. A line is known by a 64-bit hash of its whole bytes within its host.

Work follows the hot host by rows, not by groups: lines are counted with partial sums before the shuffle, and
a host's boilerplate lines are few by definition (at most its mean number of lines a page, divided by RATIO).
They are broadcast while all of them are under SENT_LINES, else joined by host and salt.

Defined results: a blank line (empty or spaces) is never boilerplate. A null text stays null, has no
line and is no page; an empty text is one blank line. Null hosts are one host. A line that a page repeats
counts once for it, whatever the text's length. Rows are kept one for one, repeated ones too. An empty table
gives no rows. `deduplicated` carries all columns; `line_report` only its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import stored

RATIO = 0.1
MIN_PAGES = 3
SENT_LINES = 500_000
SALTS = 64


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """A stored row for each host that has some: b_host, b_lines (hashes), n_lines."""
    t = F.col(text).cast("string")
    lines = F.filter(_lines(t), lambda x: F.trim(x) != "")
    rows = pages.where(t.isNotNull()).select(F.col(host).cast("string").alias("host"), F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x))).alias("lines"))
    totals = pages.where(t.isNotNull()).groupBy(F.col(host).cast("string").alias("host")).agg(F.count("*").alias("pages"))
    counts = rows.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    found = counts.join(totals.select(F.col("host").alias("t_host"), "pages"), F.col("host").eqNullSafe(F.col("t_host"))).where(F.col("n") > F.col("pages") * ratio)
    return stored(found.groupBy("host").agg(F.collect_list("line").alias("b_lines")).select(F.col("host").alias("b_host"), "b_lines", F.size("b_lines").alias("n_lines")), "boilerplate")


def _marked(pages: DataFrame, host: str, text: str, ratio: float, min_pages: int) -> tuple[DataFrame, Column]:
    """pages with a column _quire_lines of their host's boilerplate (null: none), and the kept lines."""
    found = boilerplate(pages, host, text, ratio, min_pages)
    found = found.select(F.col("b_host").alias("_quire_host"), F.col("b_lines").alias("_quire_lines"), "n_lines")
    total = found.agg(F.sum("n_lines")).first()[0] or 0
    found = found.drop("n_lines")
    same = pages[host].cast("string").eqNullSafe(F.col("_quire_host"))
    if total <= SENT_LINES:
        joined = pages.join(F.broadcast(found), same, "left")
    else:
        salted = found.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_quire_salt"))
        salt = F.pmod(F.xxhash64(pages[text]), F.lit(SALTS)).cast("int")
        joined = pages.join(salted, same & (salt == F.col("_quire_salt")), "left")
    kept = F.filter(_lines(pages[text].cast("string")), lambda x: ~F.array_contains(F.col("_quire_lines"), F.xxhash64(x)) | (F.trim(x) == ""))
    return joined, F.when(F.col("_quire_lines").isNull(), _lines(pages[text].cast("string"))).otherwise(kept)


def deduplicated(pages: DataFrame, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """All columns of pages, with boilerplate lines taken out of text."""
    joined, kept = _marked(pages, host, text, ratio, min_pages)
    return joined.select(*[F.array_join(kept, "\n").alias(c) if c == text else pages[c] for c in pages.columns])


def line_report(pages: DataFrame, key: str, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """key, n_lines, n_dropped and the remaining text of each page."""
    joined, kept = _marked(pages, host, text, ratio, min_pages)
    rows = joined.select(pages[key], F.size(_lines(pages[text].cast("string"))).cast("long").alias("all"), kept.alias("kept"))
    n = F.when(F.col("kept").isNull(), 0).otherwise(F.col("all"))
    return rows.select(key, n.cast("long").alias("n_lines"), (n - F.when(F.col("kept").isNull(), 0).otherwise(F.size("kept"))).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("text"))


LINE_SQL = f"""
WITH pages AS (SELECT source, text FROM documents WHERE text IS NOT NULL),
totals AS (SELECT source, count(*) AS pages FROM pages GROUP BY source),
counts AS (SELECT source, line, count(*) AS n
           FROM (SELECT source, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM pages)
           WHERE trim(line) <> '' GROUP BY source, line),
boilerplate AS (SELECT c.source, list(c.line) AS lines
                FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
                WHERE c.n >= {MIN_PAGES} AND c.n > t.pages * CAST({RATIO} AS DOUBLE) GROUP BY c.source),
cut AS (SELECT d.doc_id, string_split(d.text, chr(10)) AS lines,
               list_filter(string_split(d.text, chr(10)), lambda x: NOT coalesce(list_contains(b.lines, x), false)) AS kept
        FROM documents d LEFT JOIN boilerplate b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(lines) - len(kept), 0) AS BIGINT) AS n_dropped, array_to_string(kept, chr(10)) AS text
FROM cut
"""
