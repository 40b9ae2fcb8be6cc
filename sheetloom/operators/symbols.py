"""Symbols in images by the distance of their dark points from a template's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Dark is under this grey; points that an image is compared by; what distances are divided by; templates at most.
DARK, MOST_POINTS, SIZE, MOST_TEMPLATES = 128, 64, 32.0, 256


def key_points(grey: Column, width: int) -> Column:
    """Dark pixels of an image by rows; of over MOST_POINTS each one a whole step after the last, up to that number."""
    at = F.filter(F.transform(grey, lambda v, i: F.struct(v.alias("v"), (i % width).cast("double").alias("x"), F.floor(i / width).cast("double").alias("y"))), lambda p: p["v"] < DARK)
    step = F.greatest(F.lit(1), F.floor(F.size(at) / MOST_POINTS).cast("int"))
    return F.transform(F.slice(F.filter(at, lambda p, i: i % step == 0), 1, MOST_POINTS), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))


def hausdorff(a: Column, b: Column) -> Column:
    """The greatest distance from a point of either array to the nearest of the other; both have some."""
    one = lambda p, q: F.array_max(F.transform(p, lambda s: F.array_min(F.transform(q, lambda t: F.sqrt((s["x"] - t["x"]) * (s["x"] - t["x"]) + (s["y"] - t["y"]) * (s["y"] - t["y"]))))))
    return F.greatest(one(a, b), one(b, a))


def detect(images: DataFrame, width: int, templates: dict[str, list[tuple[float, float]]], least: float = 0.6) -> DataFrame:
    """(image, symbol, confidence, x0, y0, x1, y1) of images (image, grey) for each template that fits by least or more.

    Confidence is 1 less the distance of the point sets over SIZE; the box is the whole image. Images without dark pixels and
    templates without points fit nothing. Templates are a counted list, so images are read once and meet no join."""
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"over {MOST_TEMPLATES} templates")
    point = lambda p: F.struct(F.lit(float(p[0])).alias("x"), F.lit(float(p[1])).alias("y"))
    known = F.array(*(F.struct(F.lit(n).alias("symbol"), F.array(*map(point, p)).alias("q")) for n, p in templates.items() if p))
    p = images.select("image", F.size("grey").alias("n"), key_points(F.col("grey"), width).alias("p")).filter("size(p) > 0")
    met = p.select("image", "n", "p", F.inline(known)).select("image", "symbol", (1 - hausdorff(F.col("p"), F.col("q")) / SIZE).alias("confidence"), "n")
    return met.filter(F.col("confidence") >= least).select("image", "symbol", "confidence", F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.lit(width).alias("x1"), F.floor(F.col("n") / width).cast("int").alias("y1"))
