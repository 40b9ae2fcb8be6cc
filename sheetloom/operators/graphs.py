"""Graphs: components, degrees, nesting, block expansion."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import spatial


def written(df: DataFrame) -> DataFrame:
    """df written once as Parquet to the shared checkpoint folder and read again, so that its lineage is cut.

    Rounds then plan with the sizes of files: sizes guessed from plans are multiplied by every join, so in a loop of
    joins over checkpointed frames their digits double each round. The folder is the one that spark.checkpoint.dir names,
    else one in the warehouse, which is shared too."""
    sc, conf = df.sparkSession.sparkContext, df.sparkSession.conf
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(conf.get("spark.checkpoint.dir", None) or conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    folder = f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys over all shuffle partitions, which adaptive execution does not merge: for few rows that cost much work each."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def _hook(pairs: DataFrame, larger: bool) -> DataFrame:
    """Point the neighbours v of u at the least node seen from u: those above u, or u and those below it."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = pairs.join(least, "u")
    if larger:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges' two columns, component being the least node reachable.

    Large-star and small-star joins alternate until the table stops changing, in about as many rounds as the
    largest component has binary digits. Neighbours are never gathered into one row: the least one is a
    combined minimum that meets its edges by a join, which adaptive execution may split. Nulls and loops are
    dropped; an empty table gives an empty result."""
    a, b = edges.columns[:2]
    pairs = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u is not null and v is not null and u <> v").distinct())
    mark = None
    for _ in range(rounds):
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        pairs = written(_hook(_hook(both, larger=True), larger=False))
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


#: Edges of which a task keeps a forest at a time.
FOREST_ROWS = 1 << 20


def _forest(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Which edges, in their order, are in the least spanning forest: each component takes its first edge out, in rounds."""
    kept, left = np.zeros(len(u), bool), np.arange(len(u))
    n = int(max(u.max(), v.max())) + 1 if len(u) else 0
    part = np.arange(n)
    while True:
        pu, pv = part[u[left]], part[v[left]]
        out = pu != pv
        left, pu, pv = left[out], pu[out], pv[out]
        if not len(left):
            return kept
        first, other = np.full(n, len(u)), np.full(n, len(u))
        first[pu[::-1]], other[pv[::-1]] = left[::-1], left[::-1]  # of equal places the last one stays, which is the first edge
        first = np.minimum(first, other)
        own = np.flatnonzero(first < len(u))
        edge = first[own]
        kept[edge] = True
        to = np.arange(n)
        to[own] = part[u[edge]] + part[v[edge]] - own
        root = own[(to[to[own]] == own) & (own < to[own])]
        to[root] = root
        while not np.array_equal(to, to[to]):
            to = to[to]
        part = to[part]


def least_forests(edges: DataFrame) -> DataFrame:
    """edges (whole numbers a, b and others; equal in no two rows) without those that close a ring with rows before them, in the order of all columns.

    What is left links the same nodes and holds the least spanning forest. Each task looks at its own rows, a portion and
    the forest of those before at a time, so rows of many tasks may still close rings."""
    names = edges.columns

    def kept(t):
        t = t.sort_by([(c, "ascending") for c in names])
        a, b = (t[c].to_numpy() for c in ("a", "b"))
        _, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        return t.filter(pa.array(_forest(at[: len(a)], at[len(a) :])))

    def work(batches):
        held, n = [], 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            n += batch.num_rows
            if n >= FOREST_ROWS:
                forest = kept(pa.concat_tables(held))
                held, n = [forest], forest.num_rows
                if n > FOREST_ROWS // 2:
                    yield from forest.to_batches()
                    held, n = [], 0
        if n:
            yield from kept(pa.concat_tables(held)).to_batches()

    return edges.mapInArrow(work, edges.schema)


def component_sizes(edges: DataFrame) -> DataFrame:
    """(component, nodes, edges, most): size, edge count and greatest degree of each component of edges (a, b)."""
    comps = written(components(edges))
    n = comps.groupBy("component").agg(F.count("*").alias("nodes"))
    e = edges.join(comps, edges["a"] == comps["node"]).groupBy("component").agg(F.count("*").alias("edges"))
    d = degrees(edges).join(comps, "node").groupBy("component").agg(F.max("degree").alias("most"))
    return n.join(e, "component").join(d, "component")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree) over edges (a, b); a loop counts twice."""
    return edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def degree_type(degree):
    return F.when(degree <= 1, "endpoint").when(degree == 2, "L").when(degree == 3, "T").when(degree == 4, "X").otherwise("multi")


def with_box(rings: DataFrame) -> DataFrame:
    """rings (points) with their envelope x0, y0, x1, y1."""
    side = lambda f, c: f(F.transform("points", lambda p: p[c]))
    return rings.withColumns({"x0": side(F.array_min, "x"), "y0": side(F.array_min, "y"), "x1": side(F.array_max, "x"), "y1": side(F.array_max, "y")})


def nesting(rings: DataFrame, drawing: str | None = "drawing", cell: float = 100.0) -> DataFrame:
    """(drawing, ring_id, parent_id, depth) of rings (drawing, ring_id, points): the parent is the smallest strictly
    larger ring of the drawing that holds the first vertex, on ties the one of least id; depth counts such rings.

    With drawing None all rings are of one drawing, and the result has no such column. First vertices meet envelopes on
    a grid that fits the envelopes' sizes, so no two rings are compared that lie apart. A ring's points are one row."""
    if drawing is None:
        return nesting(rings.withColumn("drawing", F.lit(0)), "drawing", cell).drop("drawing")
    r = with_box(rings.select(F.col(drawing).alias("own"), "ring_id", "points", F.abs(g.ring_area(F.col("points"))).alias("area")))
    p = F.element_at("points", 1)
    starts = r.select("own", "ring_id", "area", p["x"].alias("x0"), p["y"].alias("y0"), p["x"].alias("x1"), p["y"].alias("y1"))
    both = spatial.overlap_pairs(starts, r, cell).filter("own = r_own and r_area > area")
    inside = both.filter(g.point_in_ring(F.col("x0"), F.col("y0"), F.col("r_points")))
    found = inside.groupBy("own", "ring_id").agg(F.min(F.struct("r_area", "r_ring_id")).alias("m"), F.count("*").alias("depth"))
    every = rings.select(F.col(drawing).alias("own"), "ring_id").join(found, ["own", "ring_id"], "left")
    return every.select(F.col("own").alias(drawing), "ring_id", F.col("m.r_ring_id").alias("parent_id"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"))


def nesting_paths(parents: DataFrame, rounds: int = 64) -> DataFrame:
    """(ring_id, root_id, depth, path) of rings with parent_id: all parents up to the root, nearest first.

    Paths double each round, so their number is that of the depth's binary digits."""
    row = written(parents.select("ring_id", F.col("parent_id").alias("up"), F.filter(F.array("parent_id"), lambda p: p.isNotNull()).alias("path")))
    for _ in range(rounds):
        ahead = row.select(F.col("ring_id").alias("up"), F.col("up").alias("up2"), F.col("path").alias("more"))
        step = row.join(ahead, "up", "left").select("ring_id", F.col("up2").alias("up"), F.concat("path", F.coalesce("more", F.array().cast(row.schema["path"].dataType))).alias("path"))
        row = written(step)
        if row.filter("up is not null").isEmpty():
            return row.select("ring_id", F.coalesce(F.try_element_at("path", F.lit(-1)), "ring_id").alias("root_id"), F.size("path").alias("depth"), "path")
    raise RuntimeError("parents form a ring")


def expand_blocks(inserts: DataFrame, children: DataFrame, limit: int = 32) -> DataFrame:
    """(root, block, depth, entity) of nested block references; a block already on its path is not entered again.

    inserts has root and block; children has block, entity and child, the block that an entity refers to."""
    level = inserts.select("root", "block", F.array("block").alias("path"))
    out, depth = None, 0
    while depth < limit:
        rows = written(level.join(children, "block").select("root", "block", "path", "entity", "child"))
        plain = rows.filter("child is null").select("root", "block", F.lit(depth).alias("depth"), "entity")
        out = plain if out is None else out.union(plain)
        level = rows.filter(F.col("child").isNotNull() & ~F.array_contains("path", F.col("child"))).select("root", F.col("child").alias("block"), F.concat("path", F.array("child")).alias("path"))
        if level.isEmpty():
            break
        depth += 1
    return out
