"""Keyed look-ups between manifest, spine, archive and documents, as joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import shuffled, written


def undeclared(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of left whose key right does not have."""
    return left.join(right.select(*on).distinct(), on, "left_anti")


def reference_status(refs: DataFrame, entries: DataFrame, manifest: DataFrame, spine: DataFrame, package: str) -> DataFrame:
    """refs(package, target, element) -> status, by where the target is found; the order of the cases decides.

    declared_only: in the manifest but not in the archive (reported with the manifest); missing: in neither;
    undeclared: only in the archive; not_in_spine: an `a` to a content document outside the spine; else ok.
    """
    def flag(df: DataFrame, name: str) -> DataFrame:
        return df.select(package, F.col("path").alias("target"), F.lit(True).alias(name)).distinct()

    kinds = manifest.groupBy(package, F.col("path").alias("target")).agg(F.max_by("media_type", "ord").alias("media_type")).withColumn("in_manifest", F.lit(True))
    found = reduce(lambda a, b: a.join(shuffled(b), [package, "target"], "left"), [flag(entries, "in_zip"), kinds, flag(spine, "in_spine")], refs)
    in_zip, in_manifest, in_spine = (F.coalesce(F.col(c), F.lit(False)) for c in ("in_zip", "in_manifest", "in_spine"))
    status = (
        F.when(~in_zip & in_manifest, "declared_only").when(~in_zip, "missing").when(~in_manifest, "undeclared")
        .when((F.col("element") == "a") & (F.col("media_type") == "application/xhtml+xml") & ~in_spine, "not_in_spine").otherwise("ok")
    )
    return found.select(*refs.columns, status.alias("status"))


def fallback_end(items: DataFrame, core: list[str], hops: int = 32) -> DataFrame:
    """items(package, id, media_type, fallback) -> package, id, end: the first item of a core type along the fallbacks, null if none within `hops`.

    Pointer doubling: each step joins every open chain with the chain it has reached and adds up their lengths, so
    32 hops take six joins, and a cycle ends with them. What is found farther away than `hops` is dropped. Each
    step is written, as a plan of all steps would scan items 64 times.
    """
    is_core = F.col("media_type").isin(core)
    now = items.select("package", "id", F.when(is_core, F.col("id")).alias("end"), F.lit(0).alias("far"), F.when(~is_core, F.col("fallback")).alias("next"), F.lit(1).alias("step"))
    reach = 1
    while reach <= hops:
        ahead = now.select(F.col("package").alias("p"), F.col("id").alias("i"), F.col("end").alias("e"), F.col("far").alias("f"), F.col("next").alias("n"), F.col("step").alias("s"))
        met = now.join(shuffled(ahead), (F.col("package") == F.col("p")) & (F.col("next") == F.col("i")), "left")
        far = F.when(F.col("end").isNotNull(), F.col("far")).otherwise(F.col("step") + F.col("f"))
        now = written(met.select("package", "id", F.coalesce("end", "e").alias("end"), far.alias("far"), F.when(F.col("end").isNull() & F.col("e").isNull(), F.col("n")).alias("next"), (F.col("step") + F.col("s")).alias("step")), "fallbacks")
        reach *= 2
    return now.select("package", "id", F.when(F.col("far") <= hops, F.col("end")).alias("end"))


def contents_at(pages: DataFrame, entries: DataFrame, book: str) -> DataFrame:
    """pages(book, cur), entries(book, ord, page, title) -> the last entry in document order that begins at or before cur.

    Document order, not page order, decides: along a book's pages, the largest ord so far. Pages and entries are
    put in one column and read in one window, so no page meets every entry. A null cur has no entry.
    """
    from pyspark.sql import Window as W

    rows = entries.where("page is not null").select(book, F.col("page").alias("cur"), F.struct("ord", "title").alias("entry"), F.lit(False).alias("asked"))
    rows = rows.unionByName(pages.select(book, "cur", F.lit(True).alias("asked")), allowMissingColumns=True)
    last = F.max("entry").over(W.partitionBy(book).orderBy("cur").rangeBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumn("last", last).where("asked").select(book, "cur", F.col("last.title").alias("title"), F.col("last.ord").alias("ord"))


def repeated(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows after the first of their key, in order, with their number."""
    from pyspark.sql import Window as W

    return rows.withColumn("nth", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("nth > 1")


def numbered_names(rows: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Names made distinct for one archive: the second `a.epub` becomes `a (2).epub`. New names are not checked against old ones."""
    from pyspark.sql import Window as W

    nth = F.row_number().over(W.partitionBy(name).orderBy(*order))
    stem, ext = F.regexp_replace(name, r"\.[^.]*$", ""), F.regexp_extract(name, r"(\.[^.]*)$", 1)
    return rows.withColumn("nth", nth).withColumn("unique_name", F.when(F.col("nth") == 1, F.col(name)).otherwise(F.concat(stem, F.lit(" ("), F.col("nth").cast("string"), F.lit(")"), ext)))
