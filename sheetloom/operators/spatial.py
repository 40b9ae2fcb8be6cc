"""Spatial joins: a grid of cells turns nearness and overlap into equality joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g

#: Grids of doubling cells; a box is listed on the one that fits its size.
LEVELS = 16


def _cell(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("long")


def near_pairs(points: DataFrame, tol: float, id_col: str = "id", strict: bool = True, salts: int = 1, carry: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, d) for pairs of points a < b within tol, and of each column of carry both points' values as c_a and c_b.

    Each point sits in one cell of side tol and looks into its own and four of the eight around it, so the join is on
    cells, each pair of cells meets once and the cost follows the local density. salts deals a crowded cell over that many tasks."""
    base = points.select(F.col(id_col).alias("id"), "x", "y", *carry).filter("x is not null and y is not null")
    home = base.withColumns({"cx": _cell(F.col("x"), tol), "cy": _cell(F.col("y"), tol), "salt": F.pmod(F.xxhash64("id"), F.lit(salts))})
    steps = F.array(*(F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j"), F.lit(k).cast("long").alias("k")) for i, j in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1)) for k in range(salts)))
    second = [F.col(c).alias(f"{c}2") for c in ("id", "x", "y", *carry)]
    look = home.select(*second, "cx", "cy", F.explode(steps).alias("s"))
    look = look.select(*(f"{c}2" for c in ("id", "x", "y", *carry)), ((F.col("s.i") == 0) & (F.col("s.j") == 0)).alias("own"), (F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"), F.col("s.k").alias("salt"))
    d = g.distance(F.col("x"), F.col("y"), F.col("x2"), F.col("y2"))
    near = d < tol if strict else d <= tol
    met = home.join(look, ["cx", "cy", "salt"]).filter(((F.col("id") < F.col("id2")) | (~F.col("own") & (F.col("id") > F.col("id2")))) & near)
    turn = F.col("id") > F.col("id2")
    both = [x for c in carry for x in (F.when(turn, F.col(f"{c}2")).otherwise(F.col(c)).alias(f"{c}_a"), F.when(turn, F.col(c)).otherwise(F.col(f"{c}2")).alias(f"{c}_b"))]
    return met.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"), d.alias("d"), *both)


#: Right rows of a cell that one part of it has, where crowded cells are dealt.
PART_ROWS = 1024


def overlap_pairs(left: DataFrame, right: DataFrame, cell: float = 100.0, pad: float = 0.0, dealt: bool = False) -> DataFrame:
    """Joins two box tables (x0, y0, x1, y1 and more columns, right ones prefixed r_) where the boxes, right
    ones padded, meet. The boxes come as they are: padding and taking it off again would change their last digits.

    A box is listed under the cells it touches on the grid of its own size, four at most. A left box
    looks its cells up on every level that the right side has. A pair is given once, by the cell at the
    lower corner of its common part. With dealt, right rows (with an id) of crowded cells go to several parts, and left ones to
    each of these: for drawings so dense that a few cells have most pairs."""
    r = right.select([F.col(c).alias(f"r_{c}") for c in right.columns])
    lo_x, lo_y, hi_x, hi_y = F.col("r_x0") - pad, F.col("r_y0") - pad, F.col("r_x1") + pad, F.col("r_y1") + pad
    side = F.greatest(hi_x - lo_x, hi_y - lo_y, F.lit(cell))
    r = r.withColumn("level__", F.least(F.lit(LEVELS), F.ceil(F.log2(side / cell))).cast("int"))
    levels = sorted(x[0] for x in r.select("level__").distinct().collect())
    size = lambda level: F.lit(cell) * F.pow(F.lit(2.0), level)
    span = lambda lo, hi, level: F.sequence(F.floor(lo / size(level)), F.floor(hi / size(level)))
    corner = lambda side, x, y: {f"{side}_x__": F.floor(x / size(F.col("level__"))), f"{side}_y__": F.floor(y / size(F.col("level__")))}
    r = r.withColumns(corner("right", lo_x, lo_y)).withColumn("cell_x__", F.explode(span(lo_x, hi_x, F.col("level__")))).withColumn("cell_y__", F.explode(span(lo_y, hi_y, F.col("level__"))))
    l = left.withColumn("level__", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")))
    l = l.withColumns(corner("left", F.col("x0"), F.col("y0"))).withColumn("cell_x__", F.explode(span(F.col("x0"), F.col("x1"), F.col("level__")))).withColumn("cell_y__", F.explode(span(F.col("y0"), F.col("y1"), F.col("level__"))))
    meet = (F.col("x0") <= hi_x) & (lo_x <= F.col("x1")) & (F.col("y0") <= hi_y) & (lo_y <= F.col("y1"))
    once = (F.greatest("left_x__", "right_x__") == F.col("cell_x__")) & (F.greatest("left_y__", "right_y__") == F.col("cell_y__"))
    keys = ["level__", "cell_x__", "cell_y__"]
    if dealt:
        crowded = r.groupBy(*keys).count().filter(F.col("count") > PART_ROWS).select(*keys, F.ceil(F.col("count") / PART_ROWS).alias("parts__"))
        parts = F.coalesce("parts__", F.lit(1).cast("long"))
        r = r.join(F.broadcast(crowded), keys, "left").withColumn("part__", F.pmod(F.xxhash64("r_id"), parts)).drop("parts__")
        l = l.join(F.broadcast(crowded), keys, "left").withColumn("part__", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("parts__")
        keys = [*keys, "part__"]
    return l.join(r, keys).filter(once & meet).drop(*keys, "left_x__", "left_y__", "right_x__", "right_y__")


def with_envelope(segments: DataFrame) -> DataFrame:
    """segments with their ends as sx0.. and their envelope as x0, y0, x1, y1."""
    s = segments.select("*", *(F.col(c).alias(f"s{c}") for c in ("x0", "y0", "x1", "y1")))
    return s.withColumns({"x0": F.least("sx0", "sx1"), "y0": F.least("sy0", "sy1"), "x1": F.greatest("sx0", "sx1"), "y1": F.greatest("sy0", "sy1")})


def crossings(segments: DataFrame, cell: float = 50.0, closed: bool = True, skip_shared: bool = True, each: bool = False) -> DataFrame:
    """(a, b, x, y) of segments a < b that meet. closed: touching counts; skip_shared: not at a common end; each: a row
    (id, x, y) for either segment instead."""
    box = with_envelope(segments).select("id", "sx0", "sy0", "sx1", "sy1", "x0", "y0", "x1", "y1")
    pairs = overlap_pairs(box, box, cell, dealt=True).filter("id < r_id")
    ends = [F.col(c) for c in ("sx0", "sy0", "sx1", "sy1", "r_sx0", "r_sy0", "r_sx1", "r_sy1")]
    if skip_shared:
        for i in (0, 2):
            for j in (4, 6):
                pairs = pairs.filter(~((F.abs(ends[i] - ends[j]) < 1e-10) & (F.abs(ends[i + 1] - ends[j + 1]) < 1e-10)))
    met = pairs.withColumn("p", g.intersection(*ends, closed=closed)).filter("p is not null")
    if each:
        at = F.col("p.x").alias("x"), F.col("p.y").alias("y")
        return met.select(F.inline(F.array(F.struct("id", *at), F.struct(F.col("r_id").alias("id"), *at))))
    return met.select(F.col("id").alias("a"), F.col("r_id").alias("b"), "p.x", "p.y")


def endpoints(segments: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, end, x, y): two rows for each segment, with its columns of carry."""
    ends = F.array(F.struct(F.lit(0).alias("end"), F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.lit(1).alias("end"), F.col("x1").alias("x"), F.col("y1").alias("y")))
    return segments.select("id", F.inline(ends), *carry)


def open_ends(segments: DataFrame, tol: float) -> DataFrame:
    """(id, end, x, y) of segment ends that no other segment's end is within tol of."""
    e = endpoints(segments).withColumn("pid", F.col("id") * 2 + F.col("end"))
    pairs = near_pairs(e.select(F.col("pid").alias("id"), "x", "y"), tol, strict=False)
    met = pairs.filter(F.floor(F.col("a") / 2) != F.floor(F.col("b") / 2)).select(F.explode(F.array("a", "b")).alias("pid")).distinct()
    return e.join(met, "pid", "left_anti").select("id", "end", "x", "y")


#: Regions that are sent to every task at most; more of them meet the segments on the grid.
MOST_REGIONS = 1000


def in_regions(segments: DataFrame, regions: DataFrame, lasso: bool = False, cell: float = 100.0) -> DataFrame:
    """(name, id and the segment's columns) for segments whose midpoint lies in a region.

    regions has name and a rectangle lo_x, lo_y, hi_x, hi_y, or also points (a ring of structs x, y), which
    then decides after the rectangle; with lasso a segment that a side of the ring crosses counts as well. A few
    regions, which are counted, meet the segments by a range join with a broadcast; more meet them on the grid."""
    mid = segments.withColumns({"mx": (F.col("x0") + F.col("x1")) / 2, "my": (F.col("y0") + F.col("y1")) / 2})
    inside = (F.col("mx") >= F.col("lo_x")) & (F.col("mx") <= F.col("hi_x")) & (F.col("my") >= F.col("lo_y")) & (F.col("my") <= F.col("hi_y"))
    touch = (F.greatest("x0", "x1") >= F.col("lo_x")) & (F.least("x0", "x1") <= F.col("hi_x")) & (F.greatest("y0", "y1") >= F.col("lo_y")) & (F.least("y0", "y1") <= F.col("hi_y"))
    if regions.limit(MOST_REGIONS + 1).count() <= MOST_REGIONS:
        out = mid.join(F.broadcast(regions), touch if lasso else inside)
    else:
        box = with_envelope(segments) if lasso else mid.withColumns({"sx0": F.col("x0"), "sy0": F.col("y0"), "sx1": F.col("x1"), "sy1": F.col("y1"), "x0": F.col("mx"), "y0": F.col("my"), "x1": F.col("mx"), "y1": F.col("my")})
        frame = regions.withColumns({"x0": F.col("lo_x"), "y0": F.col("lo_y"), "x1": F.col("hi_x"), "y1": F.col("hi_y")})
        met = overlap_pairs(box, frame, cell)
        met = met.select(*(F.col(f"s{c}" if c in ("x0", "y0", "x1", "y1") else c).alias(c) for c in segments.columns), *(F.col(f"r_{c}").alias(c) for c in regions.columns))
        out = met.withColumns({"mx": (F.col("x0") + F.col("x1")) / 2, "my": (F.col("y0") + F.col("y1")) / 2})
    if "points" not in regions.columns:
        return out
    keep = inside & g.point_in_ring(F.col("mx"), F.col("my"), F.col("points"))
    if lasso:
        n, ends = F.size("points"), [F.col(c) for c in ("x0", "y0", "x1", "y1")]
        after = lambda i: F.element_at("points", (i + 1) % n + 1)
        keep = keep | F.exists(F.transform("points", lambda p, i: g.intersection(*ends, p["x"], p["y"], after(i)["x"], after(i)["y"]).isNotNull()), lambda x: x)
    return out.filter(keep)


def nearest(left: DataFrame, right: DataFrame, reach: float) -> DataFrame:
    """(id, r_id, d): for each point of left the nearest of right within reach, the smaller id on ties."""
    a = left.select(F.col("id"), "x", "y", F.lit(0).alias("side"))
    cells = F.array(*(F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    look = a.select("id", "x", "y", _cell(F.col("x"), reach).alias("cx"), _cell(F.col("y"), reach).alias("cy"), F.explode(cells).alias("s")).select("id", "x", "y", (F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"))
    home = right.select(F.col("id").alias("r_id"), F.col("x").alias("x2"), F.col("y").alias("y2")).withColumns({"cx": _cell(F.col("x2"), reach), "cy": _cell(F.col("y2"), reach)})
    d = g.distance(F.col("x"), F.col("y"), F.col("x2"), F.col("y2"))
    pairs = look.join(home, ["cx", "cy"]).select("id", F.struct(d.alias("d"), "r_id").alias("best")).filter(F.col("best.d") <= reach)
    return pairs.groupBy("id").agg(F.min("best").alias("best")).select("id", "best.r_id", "best.d")


#: Distances between lines that count as none: lines are told apart by their places on a grid of this width and the next one.
LINE_GRID = 1e-6


def collinear_overlaps(segments: DataFrame, tol: float = 1e-6, bucket: float = 32.0) -> DataFrame:
    """(a, b, length) of axis-parallel segments a < b on one line whose spans overlap by more than tol.

    Spans meet in the buckets of the line that they touch, at the bucket where their common part begins, so a
    long line is dealt over its length and not gathered. Lines within tol of each other are one line."""
    dx, dy = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))
    flat = segments.withColumn("kind", F.when(dy <= tol, "h").when(dx <= tol, "v")).filter("kind is not null")
    h = F.col("kind") == "h"
    place = F.when(h, F.col("y0")).otherwise(F.col("x0"))
    line = flat.select("id", "kind", place.alias("at"), F.when(h, F.least("x0", "x1")).otherwise(F.least("y0", "y1")).alias("lo"), F.when(h, F.greatest("x0", "x1")).otherwise(F.greatest("y0", "y1")).alias("hi"))
    cells = lambda df, lo, hi: df.withColumn("cell", F.explode(F.sequence(F.floor(F.col(lo) / bucket), F.floor(F.col(hi) / bucket))))
    left = cells(line.withColumn("line", F.floor(F.col("at") / LINE_GRID)), "lo", "hi")
    near = F.explode(F.array(*(F.floor(F.col("at") / LINE_GRID) + k for k in (-1, 0, 1))))
    right = cells(line.withColumn("line", near).select(F.col("id").alias("b"), "kind", "line", F.col("at").alias("at2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2")), "lo2", "hi2")
    both = F.least("hi", "hi2") - F.greatest("lo", "lo2")
    first = F.floor(F.greatest("lo", "lo2") / bucket) == F.col("cell")
    out = left.join(right, ["kind", "line", "cell"]).filter((F.col("id") < F.col("b")) & (F.abs(F.col("at") - F.col("at2")) <= tol) & (both > tol) & first)
    return out.select(F.col("id").alias("a"), "b", both.alias("length"))


def overlap_exists(segments: DataFrame, probes: DataFrame) -> DataFrame:
    """Those segments that overlap some probe span (id, x0 .. y1) on the same line."""
    both = segments.select(F.struct(F.lit(0).alias("side"), "id").alias("id"), "x0", "y0", "x1", "y1").union(probes.select(F.struct(F.lit(1).alias("side"), "id").alias("id"), "x0", "y0", "x1", "y1"))
    met = collinear_overlaps(both).filter("a.side <> b.side").select(F.when(F.col("a.side") == 0, F.col("a.id")).otherwise(F.col("b.id")).alias("id")).distinct()
    return segments.join(met, "id", "left_semi")
