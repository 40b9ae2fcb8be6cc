"""Graphs of polylines as models read them: nodes by place, lines and adjacency, feature rows, index pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import graphs, topology

#: The kinds in the order of their features, and what lengths, degrees and widths are divided by.
NODE_KINDS = ("endpoint", "L", "T", "X", "multi")
EDGE_KINDS = ("line", "arc", "adjacent", "intersecting")
DEGREES, POLYLINES, WIDTHS, LENGTHS, DISTANCES, LEAST_RANGE = 10, 5, 10, 1000, 100, 1e-6


def polyline_graph(points: DataFrame, tol: float = 1e-3) -> tuple[DataFrame, DataFrame]:
    """Nodes (drawing, node, idx, x, y, kind, degree, memberships) and edges (drawing, src, dst, kind, poly, k, length, angle) of
    polylines (drawing, poly, idx, x, y), two points at least.

    Points of one place of width tol are one node, at the first of them by poly and idx; idx numbers a drawing's nodes in that
    order from 0. Each step of a polyline between two nodes is a line, so a step that two polylines share is two lines. Two other
    ends of lines that share a node are adjacent unless a line joins them. degree counts a node's edges of both kinds; a
    node whose first point lies inside its polyline is a midpoint, others take their kind from the degree. Rows with nulls go."""
    w = W.partitionBy("drawing", "poly").orderBy("idx")
    place = lambda c: F.round(F.col(c) / tol).cast("long").cast("string")
    p = points.select("drawing", "poly", "idx", "x", "y").dropna()
    p = p.withColumns({"node": F.concat_ws(":", place("x"), place("y")), "to": F.lead(F.struct(F.concat_ws(":", place("x"), place("y")).alias("node"))).over(w), "before": F.lag("idx").over(w)})
    p = graphs.written(p.filter("to is not null or before is not null").withColumn("mid", F.expr("to is not null and before is not null")))
    n = p.groupBy("drawing", "node").agg(F.min(F.struct("poly", "idx", "x", "y", "mid")).alias("f"), F.count_distinct("poly").alias("memberships"))
    n = n.select("drawing", "node", "f.*", "memberships")
    # Numbers within each polyline, after the numbers of the polylines before: no window holds all nodes of a drawing.
    starts = n.groupBy("drawing", "poly").agg(F.count("*").alias("n")).select("drawing", "poly", (F.sum("n").over(W.partitionBy("drawing").orderBy("poly")) - F.col("n")).alias("start"))
    number = F.row_number().over(W.partitionBy("drawing", "poly").orderBy("idx")) - 1
    n = graphs.written(n.withColumn("within", number).join(starts, ["drawing", "poly"]).select("drawing", "node", (F.col("start") + F.col("within")).alias("idx"), "x", "y", "mid", "memberships"))
    ends = lambda end: n.select("drawing", F.col("node").alias(end), F.col("idx").alias(f"{end}_idx"), F.col("x").alias(f"{end}_x"), F.col("y").alias(f"{end}_y"))
    steps = p.filter("to is not null").select("drawing", "poly", F.col("idx").alias("k"), F.col("node").alias("u"), F.col("to.node").alias("v")).filter("u <> v")
    name = lambda c: F.struct("drawing", F.col(c).alias("node"))
    near = topology.with_adjacent(steps.select(name("u").alias("u"), name("v").alias("v"))).filter("kind = 'adjacent'")
    near = near.select("u.drawing", F.lit(None).cast(p.schema["poly"].dataType).alias("poly"), F.lit(None).cast(p.schema["idx"].dataType).alias("k"), F.col("u.node").alias("u"), F.col("v.node").alias("v"), "kind")
    every = steps.withColumn("kind", F.lit("line")).unionByName(near).join(ends("u"), ["drawing", "u"]).join(ends("v"), ["drawing", "v"])
    turn = (F.col("kind") == "adjacent") & (F.col("u_idx") > F.col("v_idx"))
    side = lambda c, a, b: F.when(turn, F.col(f"{b}_{c}")).otherwise(F.col(f"{a}_{c}"))
    dx, dy = side("x", "v", "u") - side("x", "u", "v"), side("y", "v", "u") - side("y", "u", "v")
    e = graphs.written(every.select("drawing", side("idx", "u", "v").alias("src"), side("idx", "v", "u").alias("dst"), "kind", "poly", "k", F.sqrt(dx * dx + dy * dy).alias("length"), F.atan2(dy, dx).alias("angle")))
    degree = e.select("drawing", F.explode(F.array("src", "dst")).alias("idx")).groupBy("drawing", "idx").agg(F.count("*").alias("degree"))
    n = n.join(degree, ["drawing", "idx"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return n.select("drawing", "node", "idx", "x", "y", F.when(F.col("mid"), "midpoint").otherwise(graphs.degree_type(F.col("degree"))).alias("kind"), "degree", "memberships"), e


def one_hot(kind: Column, kinds: tuple[str, ...]) -> list[Column]:
    return [F.when(kind == k, 1.0).otherwise(0.0) for k in kinds]


def node_vectors(nodes: DataFrame, normalised: bool = True) -> DataFrame:
    """(drawing, idx, features): eleven numbers a node: place within its drawing's bounds (or as it is), five kinds (a midpoint
    is half endpoint, half L), degree, memberships, curvature up to 1, width.

    nodes may have curvature and width; without them they are 0 and 1."""
    has = lambda c, other: F.coalesce(F.col(c), F.lit(other)) if c in nodes.columns else F.lit(other)
    x, y, rows = F.col("x"), F.col("y"), nodes
    if normalised:
        span = lambda c: F.greatest(F.max(c) - F.min(c), F.lit(LEAST_RANGE))
        bounds = nodes.groupBy("drawing").agg(F.min("x").alias("__x"), F.min("y").alias("__y"), span("x").alias("__w"), span("y").alias("__h"))
        rows = nodes.join(bounds, "drawing")
        x, y = (x - F.col("__x")) / F.col("__w"), (y - F.col("__y")) / F.col("__h")
    middle = F.col("kind") == "midpoint"
    kinds = [F.when(middle, 0.5 if k in ("endpoint", "L") else 0.0).otherwise(v) for k, v in zip(NODE_KINDS, one_hot(F.col("kind"), NODE_KINDS), strict=True)]
    return rows.select("drawing", "idx", F.array(x, y, *kinds, F.col("degree") / DEGREES, F.col("memberships") / POLYLINES, F.least(has("curvature", 0.0), F.lit(1.0)), has("width", 1.0) / WIDTHS).alias("features"))


def edge_vectors(edges: DataFrame) -> DataFrame:
    """(drawing, src, dst, features): eleven numbers an edge: four kinds, length, direction as (cos + 1) / 2 and (sin + 1) / 2,
    whether a polyline has it, parallelism, collinearity, mean distance of its neighbours; the last three are 0 where edges lack them."""
    has = lambda c: F.coalesce(F.col(c), F.lit(0.0)) if c in edges.columns else F.lit(0.0)
    a = F.col("angle")
    return edges.select("drawing", "src", "dst", F.array(*one_hot(F.col("kind"), EDGE_KINDS), F.col("length") / LENGTHS, (F.cos(a) + 1) / 2, (F.sin(a) + 1) / 2, F.col("poly").isNotNull().cast("double"), has("parallelism"), has("collinearity"), has("neighbour_distance") / DISTANCES).alias("features"))


def coo(edges: DataFrame, both_ways: bool = False) -> DataFrame:
    """(drawing, src, dst): index pairs of the edges, with both_ways also turned round, each pair once."""
    e = edges.select("drawing", "src", "dst")
    return e.union(e.select("drawing", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct() if both_ways else e
