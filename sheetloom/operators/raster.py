"""Raster operators on pixel arrays, a batch of images at a time; ink components also as a graph join."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graphs


def pixels(images: DataFrame, width: int) -> DataFrame:
    """(image, r, c, v) of images (image, grey: array), row by row."""
    p = images.select("image", F.posexplode("grey").alias("k", "v"))
    return p.select("image", F.floor(F.col("k") / width).cast("int").alias("r"), (F.col("k") % width).cast("int").alias("c"), "v")


def drawn(segments: DataFrame, width: int, height: int) -> DataFrame:
    """(image, grey) of segments (image, x0, y0, x1, y1) in pixels, as 255 on 0: points of each a pixel apart at most.

    What lies outside is not drawn. Pixels of an image are told apart before they are gathered."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    n = F.greatest(F.ceil(F.greatest(F.abs(dx), F.abs(dy))), F.lit(1)).cast("int")
    steps = segments.select("image", "x0", "y0", dx.alias("dx"), dy.alias("dy"), n.alias("n"), F.explode(F.sequence(F.lit(0), n)).alias("k"))
    at = steps.select("image", F.round(F.col("x0") + F.col("dx") * F.col("k") / F.col("n")).cast("int").alias("c"), F.round(F.col("y0") + F.col("dy") * F.col("k") / F.col("n")).cast("int").alias("r"))
    inside = at.filter(F.col("c").between(0, width - 1) & F.col("r").between(0, height - 1)).distinct()
    ink = graphs.spread(inside, "image").groupBy("image").agg(F.collect_set(F.col("r") * width + F.col("c")).alias("ink"))
    kind = segments.schema["image"].dataType.simpleString()

    def run(frames):
        for pdf in frames:
            greys = []
            for own in pdf["ink"]:
                grey = np.zeros(width * height, int)
                grey[np.asarray(own, int)] = 255
                greys.append(grey.tolist())
            yield pd.DataFrame({"image": pdf["image"], "grey": greys})

    return ink.mapInPandas(run, f"image {kind}, grey array<int>")


def otsu(images: DataFrame) -> DataFrame:
    """(image, threshold): the grey level of 0..255 that best parts dark from light, from counts of levels."""
    h = images.select("image", F.explode("grey").alias("v")).groupBy("image", "v").agg(F.count("*").alias("n"))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros(256)
        n[pdf["v"].to_numpy(int)] = pdf["n"]
        w, m = np.cumsum(n), np.cumsum(n * np.arange(256))
        with np.errstate(all="ignore"):
            between = (m[-1] * w - m * w[-1]) ** 2 / (w * (w[-1] - w))
        return pd.DataFrame({"image": [pdf["image"].iloc[0]], "threshold": [int(np.nanargmax(np.where(np.isfinite(between), between, -1)))]})

    kind = images.schema["image"].dataType.simpleString()
    return h.groupBy("image").applyInPandas(work, f"image {kind}, threshold int")


def ink_components(images: DataFrame, width: int, threshold: int) -> DataFrame:
    """(image, component, n, r0, c0, r1, c1): 4-connected pixels at or over threshold, with boxes.

    Runs of ink in a row are the nodes, and touching runs of neighbouring rows the edges."""
    ink = pixels(images, width).filter(F.col("v") >= threshold)
    from pyspark.sql import Window as W

    row = W.partitionBy("image", "r").orderBy("c")
    runs = ink.withColumn("g", F.col("c") - F.row_number().over(row)).groupBy("image", "r", "g").agg(F.min("c").alias("c0"), F.max("c").alias("c1"))
    runs = runs.withColumn("id", F.xxhash64("image", "r", "c0"))
    below = runs.select("image", (F.col("r") - 1).alias("r"), F.col("c0").alias("d0"), F.col("c1").alias("d1"), F.col("id").alias("b"))
    edges = runs.join(below, ["image", "r"]).filter("c0 <= d1 and d0 <= c1").select(F.col("id").alias("a"), "b")
    comps = graphs.components(edges)
    named = runs.join(comps, runs["id"] == comps["node"], "left").withColumn("component", F.coalesce("component", "id"))
    return named.groupBy("image", "component").agg(F.sum(F.col("c1") - F.col("c0") + 1).alias("n"), F.min("r").alias("r0"), F.min("c0").alias("c0"), F.max("r").alias("r1"), F.max("c1").alias("c1"))


def sobel(images: DataFrame, width: int, limit: float) -> DataFrame:
    """(image, edges): inner pixels whose Sobel gradient reaches limit."""
    kind = images.schema["image"].dataType.simpleString()

    def work(frames):
        for pdf in frames:
            out = []
            for grey in pdf["grey"]:
                a = np.asarray(grey, float).reshape(-1, width)
                gx = a[:-2, 2:] + 2 * a[1:-1, 2:] + a[2:, 2:] - a[:-2, :-2] - 2 * a[1:-1, :-2] - a[2:, :-2]
                gy = a[2:, :-2] + 2 * a[2:, 1:-1] + a[2:, 2:] - a[:-2, :-2] - 2 * a[:-2, 1:-1] - a[:-2, 2:]
                out.append(int((np.hypot(gx, gy) >= limit).sum()))
            yield pd.DataFrame({"image": pdf["image"], "edges": out})

    return images.mapInPandas(work, f"image {kind}, edges bigint")


def quality(images: DataFrame) -> DataFrame:
    """(image, mean, contrast, dark): simple measures of each image, without Python."""
    return images.select("image", F.explode("grey").alias("v")).groupBy("image").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("contrast"), (F.count_if(F.col("v") < 64) / F.count("*")).alias("dark"))


def per_image(images: DataFrame, width: int, work, name: str = "grey", kind: str = "array<int>") -> DataFrame:
    """images with name set to work(image as a 2D array), flattened where it is an image; a batch of images at a time."""
    ident = images.schema["image"].dataType.simpleString()

    def run(frames):
        for pdf in frames:
            out = [work(np.asarray(g).reshape(-1, width)) for g in pdf["grey"]]
            yield pd.DataFrame({"image": pdf["image"], name: [o.astype(int).reshape(-1).tolist() if isinstance(o, np.ndarray) else o for o in out]})

    return images.select("image", "grey").mapInPandas(run, f"image {ident}, {name} {kind}")


def threshold(images: DataFrame, limit: int, inverse: bool = False) -> DataFrame:
    """images as 255 above limit and 0 else, or the other way round; no Python."""
    ink = (255, 0) if not inverse else (0, 255)
    return images.select("image", F.transform("grey", lambda v: F.when(v > limit, ink[0]).otherwise(ink[1])).alias("grey"))


def _windows(a: np.ndarray, k: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(np.pad(a, k // 2, mode="edge"), (k, k))


def median_filter(images: DataFrame, width: int, size: int = 3) -> DataFrame:
    """Each pixel as the median of the size by size pixels around it, edges repeated."""
    return per_image(images, width, lambda a: np.median(_windows(a, size), axis=(2, 3)))


def gaussian_filter(images: DataFrame, width: int, sigma: float = 1.0) -> DataFrame:
    """Each pixel as the mean of those around it under a bell of width sigma, edges repeated, rounded."""
    r = max(1, int(3 * sigma))
    bell = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    kernel = np.outer(bell, bell) / bell.sum() ** 2
    return per_image(images, width, lambda a: np.rint((_windows(a, 2 * r + 1) * kernel).sum(axis=(2, 3))))


def _ring(a: np.ndarray) -> list[np.ndarray]:
    """The eight neighbours of each pixel, from the one above clockwise; nothing lies beyond the edge."""
    p = np.pad(a, 1)
    return [p[1 + dr : p.shape[0] - 1 + dr, 1 + dc : p.shape[1] - 1 + dc] for dr, dc in ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))]


def thin(ink: np.ndarray, way: str = "zhang_suen", rounds: int = 100) -> np.ndarray:
    """Skeleton of a 0/1 image by one of two parallel thinning rules."""
    a = (ink > 0).astype(np.int64)
    for _ in range(rounds):
        before = a
        for step in (0, 1):
            n, ne, e, se, s, sw, w, nw = _ring(a)
            if way == "zhang_suen":
                around = [n, ne, e, se, s, sw, w, nw]
                turns = sum((x == 0) & (y == 1) for x, y in zip(around, around[1:] + around[:1], strict=True))
                count = sum(around)
                sides = ((n * e * s == 0) & (e * s * w == 0)) if step == 0 else ((n * e * w == 0) & (n * s * w == 0))
                gone = (a == 1) & (count >= 2) & (count <= 6) & (turns == 1) & sides
            else:
                paths = ((1 - n) & (ne | e)) + ((1 - e) & (se | s)) + ((1 - s) & (sw | w)) + ((1 - w) & (nw | n))
                n1, n2 = (nw | n) + (ne | e) + (se | s) + (sw | w), (n | ne) + (e | se) + (s | sw) + (w | nw)
                side = ((n | ne | (1 - se)) & e) if step == 0 else ((s | sw | (1 - nw)) & w)
                gone = (a == 1) & (paths == 1) & (np.minimum(n1, n2) >= 2) & (np.minimum(n1, n2) <= 3) & (side == 0)
            a = np.where(gone, 0, a)
        if (a == before).all():
            break
    return a


def skeleton(images: DataFrame, width: int, limit: int, way: str = "zhang_suen") -> DataFrame:
    """images as 1 on the skeleton of the pixels over limit; an image with more ink than paper is inverted first."""
    return per_image(images, width, lambda a: thin((a > limit) if (a > limit).mean() <= 0.5 else (a <= limit), way))


def junction_kinds(a: np.ndarray) -> list[dict]:
    """Points of a skeleton that are no plain line: by neighbours 1 end, 2 not opposite L, 3 T, 4 X, more multi."""
    ring = _ring((a > 0).astype(int))
    count, out = sum(ring), []
    for r, c in zip(*np.nonzero(a > 0), strict=True):
        k = int(count[r, c])
        own = [i for i, x in enumerate(ring) if x[r, c]]
        kind = {1: "end", 3: "T", 4: "X"}.get(k, "multi" if k > 4 else None)
        if k == 2 and (own[1] - own[0]) % 8 not in (1, 4, 7):
            kind = "L"
        if kind:
            out.append({"r": int(r), "c": int(c), "kind": kind})
    return out


def junctions(skeletons: DataFrame, width: int) -> DataFrame:
    """(image, r, c, kind) of skeleton images (image, grey)."""
    found = per_image(skeletons, width, junction_kinds, "points", "array<struct<r:int,c:int,kind:string>>")
    return found.select("image", F.inline("points"))


def without_spurs(skeletons: DataFrame, width: int, most: int) -> DataFrame:
    """Skeletons without branches of fewer than most pixels that end freely and begin at a junction."""

    def prune(a):
        a = (a > 0).astype(int)
        count = sum(_ring(a))
        gone = []
        for r, c in zip(*np.nonzero((a == 1) & (count == 1)), strict=True):
            path, seen = [(r, c)], {(r, c)}
            while len(path) < most:
                near = [(path[-1][0] + dr, path[-1][1] + dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1)]
                near = [q for q in near if q not in seen and 0 <= q[0] < a.shape[0] and 0 <= q[1] < a.shape[1] and a[q]]
                if len(near) != 1:
                    break
                if count[near[0]] > 2:
                    gone += path
                    break
                path.append(near[0])
                seen.add(near[0])
        for q in gone:
            a[q] = 0
        return a

    return per_image(skeletons, width, prune)


def mask_boxes(images: DataFrame, width: int, limit: int, area: tuple[int, int], side: tuple[int, int], most: int) -> DataFrame:
    """The largest ink components of each image whose pixels and sides lie within limits, most of them at most."""
    from .selection import top_k

    h, w = F.col("r1") - F.col("r0") + 1, F.col("c1") - F.col("c0") + 1
    fit = ink_components(images, width, limit).filter(F.col("n").between(*area) & h.between(*side) & w.between(*side))
    return top_k(fit, ["image"], [F.desc("n"), "r0", "c0"], most).select("image", "n", "r0", "c0", "r1", "c1")


def crop_statistics(images: DataFrame, crops: DataFrame, width: int) -> DataFrame:
    """(image, crop, n, mean, deviation) of crops (image, crop, r0, c0, r1, c1, ends not included), from sums over the image's corners."""
    joined = images.select("image", "grey").join(crops.groupBy("image").agg(F.collect_list(F.struct("crop", "r0", "c0", "r1", "c1")).alias("crops")), "image")
    ident = images.schema["image"].dataType.simpleString()

    def run(frames):
        for pdf in frames:
            rows = []
            for image, grey, own in zip(pdf["image"], pdf["grey"], pdf["crops"], strict=True):
                a = np.asarray(grey, float).reshape(-1, width)
                sums = [np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (a, a * a)]
                for k in own:
                    r0, c0, r1, c1 = (int(k[x]) for x in ("r0", "c0", "r1", "c1"))
                    s, q = (x[r1, c1] - x[r0, c1] - x[r1, c0] + x[r0, c0] for x in sums)
                    n = (r1 - r0) * (c1 - c0)
                    rows.append((image, int(k["crop"]), n, s / n if n else 0.0, max(0.0, q / n - (s / n) ** 2) ** 0.5 if n else 0.0))
            yield pd.DataFrame(rows, columns=["image", "crop", "n", "mean", "deviation"])

    return joined.mapInPandas(run, f"image {ident}, crop bigint, n bigint, mean double, deviation double")


def peak_boxes(images: DataFrame, width: int, limit: int, radius: int, size: float) -> DataFrame:
    """(image, r, c, score, x0, y0, x1, y1): pixels over limit that none within radius exceeds, as boxes of one size."""

    def peaks(a):
        top = _windows(a, 2 * radius + 1).max(axis=(2, 3))
        return [{"r": int(r), "c": int(c), "score": float(a[r, c])} for r, c in zip(*np.nonzero((a == top) & (a > limit)), strict=True)]

    found = per_image(images, width, peaks, "points", "array<struct<r:int,c:int,score:double>>").select("image", F.inline("points"))
    return found.select("image", "r", "c", "score", (F.col("c") - size / 2).alias("x0"), (F.col("r") - size / 2).alias("y0"), (F.col("c") + size / 2).alias("x1"), (F.col("r") + size / 2).alias("y1"))
