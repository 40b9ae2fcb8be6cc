"""Following chains of segments end to end, and segments whose ends lie on others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import graphs, spatial


#: Ends in a cell, on average over the drawing.
CELL_ENDS = 4


def band_cells(segments: DataFrame, tol: float, size: float) -> DataFrame:
    """segments (x0, y0, x1, y1 and more) with each cell cx, cy of width size in which on_segment() may find a point on them.

    In a column of cells that is the stretch of y that the line passes there, widened by what tol leaves, within the padded box."""
    dx, slope = F.col("x1") - F.col("x0"), F.try_divide(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0"))
    lo, hi = (lambda a, b: F.least(a, b) - tol), (lambda a, b: F.greatest(a, b) + tol)
    at = lambda v: F.floor(v / size)
    cells = segments.withColumn("cx", F.explode(F.sequence(at(lo("x0", "x1")), at(hi("x0", "x1")))))
    line = lambda x: F.col("y0") + (x - F.col("x0")) * slope
    ya, yb = line(F.greatest(lo("x0", "x1"), F.col("cx") * size)), line(F.least(hi("x0", "x1"), (F.col("cx") + 1) * size))
    slack = tol / F.abs(dx) + 1e-6 * size * (1 + F.abs(slope))
    low = F.when(dx != 0, F.greatest(lo("y0", "y1"), F.least(ya, yb) - slack)).otherwise(lo("y0", "y1"))
    high = F.when(dx != 0, F.least(hi("y0", "y1"), F.greatest(ya, yb) + slack)).otherwise(hi("y0", "y1"))
    spans = cells.withColumns({"low__": at(low), "high__": at(high)}).filter("low__ <= high__")
    return spans.withColumn("cy", F.explode(F.sequence("low__", "high__"))).drop("low__", "high__")


def ends_on_segments(segments: DataFrame, tol: float, cell: float = 50.0) -> DataFrame:
    """(id, end, on): ends (0 or 1) of segments (id, x0, y0, x1, y1) that lie on another segment, its own ends included.

    An end is looked for along each segment, not in its box: in cells that have a few ends on average, of width cell at most."""
    e = spatial.endpoints(segments).filter("x is not null and y is not null")
    b = e.agg(F.count("*").alias("n"), F.min("x").alias("lx"), F.max("x").alias("hx"), F.min("y").alias("ly"), F.max("y").alias("hy")).first()
    w, h = (b.hx - b.lx, b.hy - b.ly) if b.n else (0.0, 0.0)
    size = max(min(cell, max((w * h * CELL_ENDS / max(1, b.n)) ** 0.5, max(w, h) * CELL_ENDS / max(1, b.n))), tol / 8, 1e-9)
    own = e.select("id", "end", "x", "y", F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy"))
    bands = band_cells(segments.select(F.col("id").alias("on"), "x0", "y0", "x1", "y1"), tol, size)
    return own.join(bands, ["cx", "cy"]).filter((F.col("id") != F.col("on")) & g.on_segment(*map(F.col, ("x", "y", "x0", "y0", "x1", "y1")), tol)).select("id", "end", "on")


def _half(segments: DataFrame, tol: float) -> DataFrame:
    """(h, edge, tail, head): both ways of each segment between places of width tol."""
    at = lambda x, y: F.concat_ws(":", *(F.round(F.col(c) / tol).cast("long").cast("string") for c in (x, y)))
    both = segments.select("id", F.inline(F.array(F.struct(F.lit("+").alias("way"), at("x0", "y0").alias("tail"), at("x1", "y1").alias("head")), F.struct(F.lit("-").alias("way"), at("x1", "y1").alias("tail"), at("x0", "y0").alias("head")))))
    return both.select(F.concat(F.col("id").cast("string"), F.col("way")).alias("h"), F.col("id").alias("edge"), "tail", "head")


def _followers(half: DataFrame) -> DataFrame:
    """(h, far, others): the way on from each half-edge, by the least other segment at its head, and how many others there are.

    A place keeps its two least segments, so a place of many segments costs no pairs."""
    own = graphs.written(half.groupBy("tail", "edge").agg(F.min("h").alias("h")))
    first = own.groupBy("tail").agg(F.min(F.struct("edge", "h")).alias("a"), F.count("*").alias("n"))
    second = own.join(first, "tail").filter(F.col("edge") != F.col("a.edge")).groupBy("tail").agg(F.min(F.struct("edge", "h")).alias("b"))
    at = first.join(second, "tail", "left").withColumnRenamed("tail", "head")
    return half.join(at, "head").select("h", F.when(F.col("a.edge") != F.col("edge"), F.col("a.h")).otherwise(F.col("b.h")).alias("far"), (F.col("n") - 1).alias("others"))


def auto_trace(segments: DataFrame, picks: DataFrame, tol: float = 1e-3) -> DataFrame:
    """(pick, k, id, forward, branch, closed): the chain that begins with each picked segment (id), from its second end on.

    At every place the chain goes on with the least segment that it does not have yet. It is closed when it comes back to the
    picked segment's first end, and then ends; else it ends where no new segment is left. branch tells that a step
    ended at a place of several other segments. Ways on are the same for all chains until a chain meets itself, so they
    are doubled and a stretch of n segments takes as many rounds as n has binary digits; only where the next segment
    is one that the chain has does a new stretch begin with another. Segments without a place and unknown picks go."""
    s = segments.filter("x0 is not null and y0 is not null and x1 is not null and y1 is not null")
    half = graphs.written(_half(s, tol))
    step = graphs.written(_followers(half))
    walk = half.select("h", "edge", "head").join(step.select("h", "others"), "h")
    chosen = picks.select(F.col("id").alias("edge")).distinct().join(half.filter(F.endswith("h", F.lit("+"))), "edge")
    starts = graphs.written(chosen.select(F.col("edge").alias("pick"), F.col("tail").alias("home"), F.lit(0).cast("long").alias("k"), "h"))
    homes, done = starts.select("pick", "home"), None
    live = starts.select("pick", "k", "h")
    while not live.isEmpty():
        path, jump, reach = live, step.select("h", "far"), 1
        base = live.select("pick", F.col("k").alias("k0"))
        while True:
            more = path.join(jump.filter("far is not null"), "h").select("pick", (F.col("k") + reach).alias("k"), F.col("far").alias("h"))
            path, reach = graphs.written(path.union(more)), 2 * reach
            ahead = jump.select(F.col("h").alias("far"), F.col("far").alias("far2"))
            jump = graphs.written(jump.join(ahead, "far").select("h", F.col("far2").alias("far")))
            full = path.join(walk, "h").join(homes, "pick").select("pick", "k", "h", "edge", "head", "others", (F.col("head") == F.col("home")).alias("home_again"))
            had = full if done is None else full.select("pick", "k", "edge").union(done.select("pick", "k", "edge"))
            seen = had.groupBy("pick", "edge").agg(F.min("k").alias("first"))
            marked = full.join(seen, ["pick", "edge"]).withColumn("again", F.col("k") > F.col("first"))
            ends = marked.groupBy("pick").agg(F.min(F.when(F.col("again"), F.col("k"))).alias("again_at"), F.min(F.when(F.col("home_again") & ~F.col("again"), F.col("k"))).alias("home_at"), F.count("*").alias("n"))
            ends = graphs.written(ends.join(base, "pick").withColumn("over", F.col("again_at").isNotNull() | F.col("home_at").isNotNull() | (F.col("n") < reach)))
            if ends.filter("not over").isEmpty():
                break
        last = F.least(F.coalesce("home_at", F.lit(1 << 62)), F.coalesce(F.col("again_at") - 1, F.lit(1 << 62)))
        kept = marked.join(ends.select("pick", last.alias("last"), (F.col("home_at").isNotNull() & (F.coalesce("again_at", F.lit(1 << 62)) > F.col("home_at"))).alias("closed"), F.col("again_at").isNotNull().alias("stopped")), "pick").filter(F.col("k") <= F.col("last"))
        kept = graphs.written(kept.select("pick", "k", "h", "edge", "head", "others", "closed", "stopped"))
        done = kept if done is None else graphs.written(done.union(kept))
        # A chain that met itself goes on with the least segment at its place that it does not have.
        tip = kept.filter("stopped and not closed").groupBy("pick").agg(F.max_by(F.struct("k", "head"), "k").alias("t")).select("pick", "t.k", F.col("t.head").alias("tail"))
        onward = tip.join(half.select("tail", "edge", F.col("h")), "tail").join(done.select("pick", "edge"), ["pick", "edge"], "left_anti")
        live = graphs.written(onward.groupBy("pick", "k").agg(F.min(F.struct("edge", "h")).alias("m")).select("pick", (F.col("k") + 1).alias("k"), F.col("m.h").alias("h")))
    if done is None:
        done = starts.join(walk, "h").select("pick", "k", "h", "edge", "head", "others", F.lit(False).alias("closed"), F.lit(False).alias("stopped"))
    whole = done.groupBy("pick").agg(F.max("closed").alias("closed"))
    return done.drop("closed").join(whole, "pick").select("pick", "k", F.col("edge").alias("id"), F.endswith("h", F.lit("+")).alias("forward"), (F.col("others") > 1).alias("branch"), "closed")
