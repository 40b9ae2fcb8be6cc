"""Repair of scanned drawings: denoising, local contrast, the paper's corners and its perspective."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import raster, tracing

#: Sides of the search window and of a patch.
SEARCH, PATCH = 5, 3
#: A paper covers this part of the image; its outline is simplified by this part of its shorter side.
LEAST_PAPER, SIMPLIFY = 0.1, 0.02


def denoised(a: np.ndarray, strength: float) -> np.ndarray:
    """Each pixel as the mean of those in the search window, weighed by how alike the patches around both are.

    Windows and patches that would begin before the image begin at its edge; what lies beyond the other edge is left out."""
    rows, cols = a.shape
    v = np.pad(a.astype(np.float32), ((0, SEARCH + PATCH), (0, SEARCH + PATCH)))
    r, c = np.arange(rows), np.arange(cols)
    start = lambda x, side: np.maximum(x - side // 2, 0)
    total = weight = np.zeros((rows, cols), np.float32)
    for dr in range(SEARCH):
        for dc in range(SEARCH):
            nr, nc = start(r, SEARCH) + dr, start(c, SEARCH) + dc
            off = np.zeros((rows, cols), np.float32)
            for pr in range(PATCH):
                for pc in range(PATCH):
                    r1, r2, c1, c2 = start(r, PATCH) + pr, start(nr, PATCH) + pr, start(c, PATCH) + pc, start(nc, PATCH) + pc
                    own = ((r1 < rows) & (r2 < rows))[:, None] & ((c1 < cols) & (c2 < cols))
                    off += np.where(own, (v[np.ix_(r1, c1)] - v[np.ix_(r2, c2)]) ** 2, 0)
            w = np.where((nr < rows)[:, None] & (nc < cols), np.exp(-off / np.float32(strength * strength)), 0).astype(np.float32)
            total, weight = total + w * v[np.ix_(nr, nc)], weight + w
    return np.where(weight > 0, total / np.maximum(weight, 1e-30), a).astype(int)


def non_local_means(images: DataFrame, width: int, strength: float = 10.0) -> DataFrame:
    """images denoised, of any size; memory is a few images' worth."""
    return raster.per_image(images, width, lambda a: denoised(a, strength))


def tile_curves(a: np.ndarray, limit: float, tile: int) -> np.ndarray:
    """[tile row, tile column, grey]: the grey that each becomes by the running counts of its tile, each count cut at limit times
    the mean and the excess shared out."""
    down, right = -(-a.shape[0] // tile), -(-a.shape[1] // tile)
    out = np.zeros((down, right, 256), int)
    for i in range(down):
        for j in range(right):
            part = a[i * tile : (i + 1) * tile, j * tile : (j + 1) * tile]
            n = np.bincount(part.reshape(-1).astype(int), minlength=256)
            most = int(np.float32(limit) * np.float32(part.size) / np.float32(256))
            n = np.minimum(np.minimum(n, most) + np.maximum(n - most, 0).sum() // 256, most)
            run = np.cumsum(n)
            out[i, j] = (run.astype(np.float32) / np.float32(max(int(run[-1]), 1)) * np.float32(255)).astype(int)
    return out


def equalised(a: np.ndarray, limit: float, tile: int, smooth: bool) -> np.ndarray:
    curves = tile_curves(a, limit, tile)
    rows, cols = np.indices(a.shape)
    v = a.astype(int)
    if not smooth:
        return curves[rows // tile, cols // tile, v]
    at = lambda x, n: np.clip((x - (tile - 1) / 2) / tile, 0, n - 1)
    y, x = at(rows, curves.shape[0]), at(cols, curves.shape[1])
    i, j = y.astype(int), x.astype(int)
    i2, j2, fy, fx = np.minimum(i + 1, curves.shape[0] - 1), np.minimum(j + 1, curves.shape[1] - 1), y - i, x - j
    return np.rint((1 - fy) * ((1 - fx) * curves[i, j, v] + fx * curves[i, j2, v]) + fy * ((1 - fx) * curves[i2, j, v] + fx * curves[i2, j2, v])).astype(int)


def local_contrast(images: DataFrame, width: int, limit: float = 2.0, tile: int = 8, smooth: bool = False) -> DataFrame:
    """images with each tile's greys spread out, counts cut at limit; smooth blends the curves of the four nearest tiles."""
    return raster.per_image(images, width, lambda a: equalised(a, limit, tile, smooth))


def _simplified(p: np.ndarray, tol: float) -> np.ndarray:
    """A ring of points without those within tol of the line between the kept ones around them."""

    def kept(i: int, j: int) -> list[int]:
        out, stack = [], [(i, j)]
        while stack:
            a, b = stack.pop()
            if b - a < 2:
                continue
            d, q = ring[b] - ring[a], ring[a + 1 : b] - ring[a]
            n = np.hypot(*d)
            off = np.abs(d[0] * q[:, 1] - d[1] * q[:, 0]) / n if n else np.hypot(*q.T)
            k = int(off.argmax())
            if off[k] > tol:
                out.append(a + 1 + k)
                stack += [(a, a + 1 + k), (a + 1 + k, b)]
        return out

    first = int(np.hypot(*(p - p.mean(axis=0)).T).argmax())
    ring = np.vstack([np.roll(p, -first, axis=0), p[first]])
    far = int(np.hypot(*(ring - ring[0]).T).argmax())
    return ring[sorted({0, far, *kept(0, far), *kept(far, len(ring) - 1)})]


def paper(a: np.ndarray, sigma: float = 1.0) -> dict | None:
    """Corners (top left, top right, bottom right, bottom left) of the largest bright region of a blurred image, as a quad
    where its outline has four corners, else of its box; None for an image of one grey or without a region large enough."""
    r = max(1, int(3 * sigma))
    bell = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    bell /= bell.sum()
    soft = np.apply_along_axis(np.convolve, 1, np.pad(a.astype(float), r, mode="edge"), bell, "valid")
    soft = np.rint(np.apply_along_axis(np.convolve, 0, soft, bell, "valid")).astype(int)
    n = np.bincount(soft.reshape(-1), minlength=256).astype(float)
    w, m = np.cumsum(n), np.cumsum(n * np.arange(256))
    with np.errstate(all="ignore"):
        between = (m[-1] * w - m * w[-1]) ** 2 / (w * (w[-1] - w))
    if not np.isfinite(between).any():
        return None
    bright = soft > int(np.nanargmax(np.where(np.isfinite(between), between, -1)))
    own = tracing.labels(bright)
    names, sizes = np.unique(own[own >= 0], return_counts=True)
    if not len(names) or sizes.max() < LEAST_PAPER * a.size:
        return None
    name = int(names[sizes.argmax()])
    rows, cols = np.nonzero(own == name)
    outline = np.array(tracing.border(own == name, *divmod(name, a.shape[1])))[:, ::-1].astype(float)
    side = min(np.ptp(rows), np.ptp(cols)) + 1
    quad = _simplified(outline, SIMPLIFY * side)
    kind = "quad" if len(quad) == 4 else "box"
    if kind == "box":
        quad = np.array([(x, y) for x in (cols.min(), cols.max()) for y in (rows.min(), rows.max())], float)
    add, less = quad.sum(axis=1), quad[:, 0] - quad[:, 1]
    order = [add.argmin(), less.argmax(), add.argmax(), less.argmin()]
    return {"kind": kind, "share": float(sizes.max() / a.size), "corners": [{"x": float(quad[k, 0]), "y": float(quad[k, 1])} for k in order]}


def papers(images: DataFrame, width: int) -> DataFrame:
    """(image, kind, share, corners) of images that show a paper."""
    found = raster.per_image(images, width, paper, "p", f"struct<kind:string,share:double,corners:{tracing.POINTS}>")
    return found.filter("p is not null").select("image", "p.*")


def homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The 3 x 3 matrix that takes four points to four others."""
    rows, right = [], []
    for (x, y), (u, v) in zip(src, dst, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -x * u, -y * u], [0, 0, 0, x, y, 1, -x * v, -y * v]]
        right += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(right, float)), 1.0).reshape(3, 3)


def flattened(a: np.ndarray, corners: np.ndarray) -> np.ndarray:
    """The quad of a as an upright image of its longer sides, grey by the four nearest pixels; black where the quad lies outside."""
    tl, tr, br, bl = corners
    w, h = (max(1, round(float(max(np.hypot(*(p - q)), np.hypot(*(r - s)))))) for p, q, r, s in ((tr, tl, br, bl), (bl, tl, br, tr)))
    back = homography(np.array([(0, 0), (w - 1, 0), (w - 1, h - 1), (0, h - 1)], float), corners)
    y, x = np.indices((h, w))
    q = back @ np.stack([x.reshape(-1), y.reshape(-1), np.ones(w * h)])
    u, v = (q[:2] / q[2]).round(9)
    j, i = np.floor(u).astype(int), np.floor(v).astype(int)
    fx, fy = u - j, v - i
    inside = (u >= 0) & (v >= 0) & (u <= a.shape[1] - 1) & (v <= a.shape[0] - 1)
    at = lambda r, c: a[np.clip(r, 0, a.shape[0] - 1), np.clip(c, 0, a.shape[1] - 1)]
    grey = (1 - fy) * ((1 - fx) * at(i, j) + fx * at(i, j + 1)) + fy * ((1 - fx) * at(i + 1, j) + fx * at(i + 1, j + 1))
    return np.where(inside, np.rint(grey), 0).astype(int).reshape(h, w)


def corrected(images: DataFrame, corners: DataFrame, width: int) -> DataFrame:
    """(image, width, height, grey): images whose paper (image, corners) is made upright; others stay as they are."""
    ident = images.schema["image"].dataType.simpleString()
    joined = images.select("image", "grey").join(corners.select("image", "corners"), "image", "left")

    def run(frames):
        for pdf in frames:
            rows = []
            for image, grey, quad in zip(pdf["image"], pdf["grey"], pdf["corners"], strict=True):
                a = np.asarray(grey).reshape(-1, width)
                flat = a if quad is None else flattened(a, np.array([(q["x"], q["y"]) for q in quad], float))
                rows.append((image, flat.shape[1], flat.shape[0], flat.astype(int).reshape(-1).tolist()))
            yield pd.DataFrame(rows, columns=["image", "width", "height", "grey"])

    return joined.mapInPandas(run, f"image {ident}, width int, height int, grey array<int>")


def erased(images: DataFrame, boxes: DataFrame, width: int, margin: int = 2, paper: int = 255) -> DataFrame:
    """images with the boxes (image, r0, c0, r1, c1), grown by margin, set to paper; images without a box stay."""
    own = boxes.groupBy("image").agg(F.collect_list(F.struct("r0", "c0", "r1", "c1")).alias("boxes"))
    p = images.join(own, "image", "left").select("image", "grey", F.coalesce("boxes", F.array().cast(own.schema["boxes"].dataType)).alias("boxes"))
    hit = lambda k: F.exists("boxes", lambda b: (F.floor(k / width) >= b["r0"] - margin) & (F.floor(k / width) <= b["r1"] + margin) & (k % width >= b["c0"] - margin) & (k % width <= b["c1"] + margin))
    return p.select("image", F.transform("grey", lambda v, k: F.when(hit(k), paper).otherwise(v)).alias("grey"))
