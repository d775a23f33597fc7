"""Packages read back for a look at them: pages with their images, sizes and labels, and the contents that lead to pages.

Everything comes from the tables that the validation rules use: spine to item to document to image are joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.paths import resolved
from quire.functions.scalars import normal_space, viewport_size
from quire.plans.package_rules import DOC, OPS, Tables, attr, beneath, filled

XLINK = "http://www.w3.org/1999/xlink"


def _links(t: Tables, kind: str) -> DataFrame:
    """package_id, doc, pre, above, title, target of list entries in navigation lists of a kind, in which each entry's link is its own child."""
    x = t.html.where("pre >= 0").join(t.owners.where(F.array_contains("props", "nav")).select("package_id", F.col("path").alias("doc")), DOC, "left_semi")
    lists = x.where("local = 'nav'").where(attr(f"{{{OPS}}}type") == kind)
    inside = beneath(x.where("local = 'li'").select(*DOC, "pre", "above")).join(lists.select(*DOC, F.col("pre").alias("a_pre")), [*DOC, "a_pre"], "left_semi").drop("a_pre")
    link = x.where("local = 'a'").groupBy(*DOC, F.col("parent").alias("pre")).agg(F.min_by(F.struct(normal_space(F.col("text")).alias("title"), filled("href").alias("href")), "pre").alias("a"))
    return inside.join(link, [*DOC, "pre"], "left").select(*DOC, "pre", "above", "a.title", resolved("doc", F.col("a.href")).alias("target"))


def pages(t: Tables) -> DataFrame:
    """package_id, page (from 0), doc, w, h, image, label of each spine entry that has an item.

    The last viewport of a document counts, and its first image. Of several labels that the page list gives a
    page the last counts; without one it is its number. An image that is missing is null.
    """
    spine = t.spine.where("path is not null").select("package_id", F.col("path").alias("doc"), (F.row_number().over(W.partitionBy("package_id").orderBy("doc", "at")) - 1).alias("page"))
    x = t.html.where("pre >= 0")
    view = x.where((F.col("local") == "meta") & (attr("name") == "viewport")).groupBy(*DOC).agg(F.max_by(filled("content"), "pre").alias("view"))
    shown = x.where("local in ('img', 'image')").select(*DOC, F.struct(F.col("local") != "img", "pre").alias("at"), F.when(F.col("local") == "img", attr("src")).otherwise(F.coalesce(attr(f"{{{XLINK}}}href"), attr("href"))).alias("src"))
    shown = shown.groupBy(*DOC).agg(F.min_by("src", "at").alias("src"))
    labels = _links(t, "page-list").where("target is not null").groupBy("package_id", F.col("target").alias("doc")).agg(F.max_by("title", "pre").alias("label"))
    last = F.max("page").over(W.partitionBy(*DOC)) == F.col("page")  # a document that is several pages lends its label to the last
    rows = spine.withColumn("last", last).join(view, DOC, "left").join(shown, DOC, "left").join(labels, DOC, "left")
    size = viewport_size(F.coalesce("view", F.lit("")))
    return rows.select("package_id", "page", "doc", size["w"].alias("w"), size["h"].alias("h"), resolved("doc", F.col("src")).alias("image"), F.coalesce(F.when(F.col("last"), F.col("label")), (F.col("page") + 1).cast("string")).alias("label"))


def contents(t: Tables) -> DataFrame:
    """package_id, place, depth, title, page of contents entries; one that leads to no page goes with all that it holds."""
    index = t.spine.where("path is not null").select("package_id", F.col("path").alias("target"), (F.row_number().over(W.partitionBy("package_id").orderBy("doc", "at")) - 1).alias("page"))
    index = index.groupBy("package_id", "target").agg(F.max("page").alias("page"))
    rows = _links(t, "toc").join(index, ["package_id", "target"], "left")
    lost = rows.where("page is null").select(*DOC, F.col("pre").alias("a_pre"))
    gone = beneath(rows.where("page is not null")).join(lost, [*DOC, "a_pre"], "left_semi").select(*DOC, "pre").distinct()
    depth = beneath(rows).join(rows.select(*DOC, F.col("pre").alias("a_pre")), [*DOC, "a_pre"], "left_semi").groupBy(*DOC, "pre").agg(F.count("*").alias("depth"))
    kept = rows.where("page is not null").join(gone, [*DOC, "pre"], "left_anti").join(depth, [*DOC, "pre"], "left")
    return kept.select("package_id", F.row_number().over(W.partitionBy("package_id").orderBy("doc", "pre")).alias("place"), F.coalesce("depth", F.lit(0)).alias("depth"), "title", "page")
