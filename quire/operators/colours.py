"""Modal colours, dominant background and flattening."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.scalars import hex_colour, luma, white_point, whole


def modal_colour(pixels: DataFrame, image: str) -> DataFrame:
    """pixels(image, r, g, b) -> the commonest colour of each image, ties to the lighter, then to larger r, g, b."""
    counts = pixels.groupBy(image, "r", "g", "b").agg(F.count("*").alias("n"))
    light = luma(F.col("r"), F.col("g"), F.col("b"))
    best = counts.groupBy(image).agg(F.max_by(F.struct("r", "g", "b", "n"), F.struct("n", light, "r", "g", "b")).alias("c"), F.sum("n").alias("all"))
    return best.select(image, *[F.col(f"c.{x}").alias(x) for x in "rgb"], F.col("c.n").alias("n"), "all")


def background(samples: DataFrame, image: str) -> DataFrame:
    """Modal colour of an image's samples with its grey, coverage in whole percent, white point, and whether it is flattened."""
    found = modal_colour(samples, image)
    grey, cover = luma(F.col("r"), F.col("g"), F.col("b")), whole(F.col("n") * 100, F.col("all"))
    active = (cover >= 25) & grey.between(120, 250)
    return found.select(image, hex_colour(F.col("r"), F.col("g"), F.col("b")).alias("colour"), grey.alias("grey"), cover.alias("cover"), white_point(grey).alias("white_point"), active.alias("active"))


def grid(images: DataFrame, image: str, n: int = 100) -> DataFrame:
    """images(image, w, h) -> image, x, y: the centres of an n by n grid, as pixels."""
    axis = F.sequence(F.lit(0), F.lit(n - 1))
    x = images.select("*", F.explode(axis).alias("i")).select("*", F.explode(axis).alias("j"))
    at = lambda k, side: whole((2 * F.col(k) + 1) * F.col(side), 2 * n)
    return x.select(image, at("i", "w").alias("x"), at("j", "h").alias("y"))
