"""Books of pages: one canvas for all, orientations, page selection, scan resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.scalars import ceil_div, orientation, whole


def canvas(pages: DataFrame, book: str, max_edge: int) -> DataFrame:
    """pages(book, w, h) -> book, w, h: the canvas that holds every page at the modal shape, capped and even.

    Sizes are counted once; the second step works on distinct sizes, not on pages.
    """
    sizes = pages.groupBy(book, "w", "h").agg(F.count("*").alias("n"))
    over = W.partitionBy(book)
    ranked = sizes.withColumn("mode", F.max_by(F.struct("w", "h"), F.struct("n", F.col("w") * F.col("h"), "w")).over(over))
    needed = F.greatest(F.col("w"), ceil_div(F.col("h") * F.col("mode.w"), F.col("mode.h")))
    grown = ranked.groupBy(book).agg(F.max(needed).alias("cw"), F.first("mode").alias("mode"))
    grown = grown.select(book, "cw", ceil_div(F.col("cw") * F.col("mode.h"), F.col("mode.w")).alias("ch"))
    long = F.greatest("cw", "ch")
    cap = lambda c: F.when((F.lit(max_edge) > 0) & (long > max_edge), whole(c * max_edge, long)).otherwise(c)
    even = lambda c: F.greatest(F.lit(2), c - c % 2)
    return grown.select(book, even(cap(F.col("cw"))).cast("long").alias("canvas_w"), even(cap(F.col("ch"))).cast("long").alias("canvas_h"))


def orientation_tally(pages: DataFrame, book: str) -> DataFrame:
    """Pages of each orientation in each book, and whether the book is mixed."""
    shape = orientation(F.col("w"), F.col("h"))
    counts = {s: F.count_if(shape == s).alias(s) for s in ("landscape", "portrait", "square")}
    return pages.groupBy(book).agg(*counts.values()).withColumn("mixed", ((F.col("landscape") > 0).cast("int") + (F.col("portrait") > 0).cast("int") + (F.col("square") > 0).cast("int")) > 1)


_PART = "^([0-9]*)(-?)([0-9]*)$"


def page_spans(spec: Column, total: Column) -> tuple[Column, Column]:
    """(spans, error) of a page range such as `1-3, 5; 8-`: array of struct(first, last), null where there is an error."""
    parts = F.filter(F.split(spec, "[,; ]"), lambda p: p != "")
    number = lambda p, i: F.when(F.regexp_extract(p, _PART, i) != "", F.regexp_extract(p, _PART, i).cast("long"))
    dashed = lambda p: F.regexp_extract(p, _PART, 2) == "-"
    span = lambda p: F.struct(
        F.coalesce(number(p, 1), F.lit(1).cast("long")).alias("first"),
        F.when(dashed(p), F.coalesce(number(p, 3), total.cast("long"))).otherwise(number(p, 1)).alias("last"),
    )
    wrong = lambda p: (~p.rlike(_PART)) | (p == "-") | (number(p, 1) < 1) | (number(p, 3) < 1) | (number(p, 3) < number(p, 1))
    spans = F.when(F.size(parts) == 0, F.array(F.struct(F.lit(1).cast("long").alias("first"), total.cast("long").alias("last")))).otherwise(F.transform(parts, span))
    late = F.exists(spans, lambda s: (s["first"] > total) | (s["last"] > total))
    error = F.when(F.exists(parts, lambda p: F.coalesce(wrong(p), F.lit(False))), "syntax").when(late & (F.size(parts) > 0), "out of range").otherwise("")
    return spans, error


def select_pages(specs: DataFrame, key: str) -> DataFrame:
    """specs(key, spec, total) -> key, error, pages (0-based, ascending, each once) of every page range."""
    spans, error = page_spans(F.col("spec"), F.col("total"))
    found = specs.select(key, "total", spans.alias("spans"), error.alias("error"))
    pages = F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["first"] - 1, s["last"] - 1)))))
    return found.select(key, "error", F.when((F.col("error") == "") & (F.col("total") > 0), pages).otherwise(F.array().cast("array<bigint>")).alias("pages"))


def slot_of(links: DataFrame, selected: DataFrame, key: str) -> DataFrame:
    """links(key, page) -> slot: the page's place among its book's selected pages(key, pages), -1 for one left out."""
    return links.join(selected.select(key, "pages"), key, "left").select(*links.columns, (F.coalesce(F.array_position("pages", F.col("page")), F.lit(0)) - 1).cast("long").alias("slot"))


def scan_resolution(pages: DataFrame, book: str, order: str, samples: int = 9) -> DataFrame:
    """pages(book, order, ppi, scan) -> book, ppi: the upper median over evenly spaced pages, within 72 to 600; null unless all of those are scans."""
    n = F.count("*").over(W.partitionBy(book))
    at = F.row_number().over(W.partitionBy(book).orderBy(order)) - 1
    ranked = pages.select(book, "ppi", "scan", at.alias("at"), n.alias("n"))
    picks = F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda k: whole(k * (F.col("n") - 1), samples - 1))
    seen = ranked.where((F.col("n") <= samples) | F.array_contains(picks, F.col("at").cast("long")))
    sorted_ = F.array_sort(F.collect_list("ppi"))
    median = F.element_at(sorted_, (whole(F.count("*"), 2) + 1).cast("int"))
    return seen.groupBy(book).agg(F.when(F.bool_and("scan"), F.round(F.least(F.greatest(median, F.lit(72.0)), F.lit(600.0)))).cast("long").alias("ppi"))


def scanned(objects: DataFrame, page: list[str], share: float = 0.9) -> DataFrame:
    """objects(page, kind: image or text, area, page_area) -> page, scan: whether one image and no text fills most of the page."""
    images = F.count_if(F.col("kind") == "image")
    filled = F.sum(F.when(F.col("kind") == "image", F.col("area"))) >= share * F.max("page_area")
    return objects.groupBy(*page).agg(F.coalesce((images == 1) & (F.count_if(F.col("kind") == "text") == 0) & filled, F.lit(False)).alias("scan"))
