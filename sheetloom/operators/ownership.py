"""Instances from overlapping windows: admitted queries, grown and remasked masks, tracks, and one owner for each primitive.

Queries are rows (page, win, query, logits, quality, identity); masks are rows (page, win, query, primitive, logit). No window is
gathered into one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import graphs

QUERY = ["page", "win", "query"]
#: A mask's objectness is the mean of its chances above this.
OBJECT_LEAST = 0.01
#: Weights of identity and shared support in a pair's score.
IDENTITY_WEIGHT, SUPPORT_WEIGHT = 0.65, 0.35


def _argmax(values: Column) -> Column:
    """0-based index of the first greatest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def admitted_queries(queries: DataFrame, masks: DataFrame, ignore: int, least_score: float = 0.2, least_margin: float | None = None, respect_no_object: bool = True) -> DataFrame:
    """Queries with label, class_score, objectness, margin, quality_score, mask_score, score and reason, null where admitted.

    ignore is the label that stands for no object, the last one; without a quality its score is 1."""
    objectness = masks.withColumn("p", g.sigmoid(F.col("logit"), 40.0)).groupBy(*QUERY).agg(F.coalesce(F.avg(F.when(F.col("p") > OBJECT_LEAST, F.col("p"))), F.lit(0.0)).alias("mask_score"))
    probs, own = g.softmax(F.col("logits")), F.slice("logits", 1, ignore)
    label = _argmax(own)
    q = queries.join(objectness, QUERY, "left").withColumns({"label": label, "probs": probs, "mask_score": F.coalesce("mask_score", F.lit(0.0)), "full": _argmax(F.col("logits"))})
    q = q.withColumns({"class_score": F.element_at("probs", F.col("label") + 1), "objectness": 1 - F.element_at("probs", ignore + 1), "margin": F.element_at("logits", F.col("label") + 1) - F.element_at("logits", ignore + 1), "quality_score": F.coalesce(g.sigmoid(F.col("quality"), 40.0), F.lit(1.0))})
    q = q.withColumn("score", F.col("class_score") * F.col("quality_score") * F.col("mask_score"))
    reason = F.when(F.lit(respect_no_object) & (F.col("full") == ignore), "no_object").when(F.lit(least_margin is not None) & (F.col("margin") < F.lit(least_margin or 0.0)), "low_object_margin").when(F.col("score") < least_score, "low_score")
    return q.withColumn("reason", reason).drop("probs", "full", "logits", "quality")


def selected(masks: DataFrame, queries: DataFrame, threshold: float) -> DataFrame:
    """(page, win, query, primitive, p) of the primitives in the masks of admitted queries."""
    own = queries.filter("reason is null").select(*QUERY)
    return masks.join(own, QUERY).withColumn("p", g.sigmoid(F.col("logit"), 40.0)).filter(F.col("p") >= threshold).select(*QUERY, "primitive", "p")


def grown(chosen: DataFrame, masks: DataFrame, places: DataFrame, threshold: float, radius: float, most: float) -> DataFrame:
    """chosen with primitives of the same query whose chance reaches threshold and of whose points one lies within radius of a
    point of a chosen one: the likeliest, then nearest ones, at most the part most of the chosen.

    places has page, primitive and points (ends and middle). Points meet on a grid of cells of side radius, query by query."""
    rest = masks.join(chosen.select(*QUERY).distinct(), QUERY).withColumn("p", g.sigmoid(F.col("logit"), 40.0)).filter(F.col("p") >= threshold).join(chosen, [*QUERY, "primitive"], "left_anti").select(*QUERY, "primitive", "p")
    dots = lambda df: df.join(places, ["page", "primitive"]).select(*QUERY, "primitive", "p", F.inline("points"))
    cell = lambda c: F.floor(F.col(c) / radius)
    seeds = dots(chosen).select(*QUERY, F.col("x").alias("sx"), F.col("y").alias("sy"), cell("x").alias("cx"), cell("y").alias("cy"))
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    look = dots(rest).withColumn("s", F.explode(steps)).withColumns({"cx": cell("x") + F.col("s.i"), "cy": cell("y") + F.col("s.j")})
    d = g.distance(*map(F.col, ("x", "y", "sx", "sy")))
    near = look.join(seeds, [*QUERY, "cx", "cy"]).withColumn("d", d).filter(F.col("d") <= radius).groupBy(*QUERY, "primitive", "p").agg(F.min("d").alias("d"))
    size = chosen.groupBy(*QUERY).agg(F.ceil(F.count("*") * most).alias("room"))
    order = F.row_number().over(W.partitionBy(*QUERY).orderBy(F.desc("p"), "d", F.desc("primitive")))
    added = near.withColumn("place", order).join(size, QUERY).filter("place <= room").select(*QUERY, "primitive", "p")
    return chosen.withColumn("added", F.lit(False)).union(added.withColumn("added", F.lit(True)))


def semantic_labels(rows: DataFrame) -> DataFrame:
    """(page, primitive, semantic) of rows (page, primitive, logits) of all windows: the greatest mean logit, the first of equal ones."""
    means = rows.select("page", "primitive", F.posexplode("logits").alias("k", "v")).groupBy("page", "primitive", "k").agg(F.avg("v").alias("v"))
    return means.groupBy("page", "primitive").agg(F.max_by("k", F.struct("v", -F.col("k"))).alias("semantic"))


def remasked(chosen: DataFrame, queries: DataFrame, semantics: DataFrame) -> DataFrame:
    """chosen without primitives of another semantic label than their query's; a query of which nothing would be left keeps all."""
    j = chosen.join(queries.select(*QUERY, "label"), QUERY).join(semantics, ["page", "primitive"], "left")
    j = j.withColumn("same", F.coalesce(F.col("semantic") == F.col("label"), F.lit(True)))
    some = j.groupBy(*QUERY).agg(F.max("same").alias("some"))
    return j.join(some, QUERY).filter("same or not some").select(*chosen.columns)


def query_tracks(queries: DataFrame, masks: DataFrame, stuff: tuple[int, int], support: float = 0.25, least: float = 0.55) -> DataFrame:
    """(page, win, query, track) of admitted queries: things of neighbouring windows that are each other's best are one track.

    A pair of one label scores by the likeness of identities and by its shared support, the lesser of the chances summed
    over common primitives, against the smaller sum. Labels from stuff[0] to stuff[1] are one track a page each."""
    own = queries.filter("reason is null").select(*QUERY, "label", "identity")
    p = masks.join(own.select(*QUERY), QUERY).withColumn("p", g.sigmoid(F.col("logit"), 60.0)).filter(F.col("p") >= support).select(*QUERY, "primitive", "p")
    p = graphs.written(p)
    total = own.join(p.groupBy(*QUERY).agg(F.sum("p").alias("total")), QUERY, "left").withColumn("total", F.coalesce("total", F.lit(0.0)))
    things = graphs.written(total.filter(F.col("label") < stuff[0]))
    b = things.select("page", (F.col("win") - 1).alias("win"), F.col("query").alias("query2"), "label", F.col("identity").alias("identity2"), F.col("total").alias("total2"))
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda a, c: a * c), F.lit(0.0), lambda a, c: a + c)
    pairs = things.join(b, ["page", "win", "label"])
    shared = p.join(p.select("page", (F.col("win") - 1).alias("win"), F.col("query").alias("query2"), "primitive", F.col("p").alias("p2")), ["page", "win", "primitive"]).groupBy("page", "win", "query", "query2").agg(F.sum(F.least("p", "p2")).alias("shared"))
    cosine = dot("identity", "identity2") / F.greatest(F.sqrt(dot("identity", "identity")) * F.sqrt(dot("identity2", "identity2")), F.lit(1e-8))
    score = IDENTITY_WEIGHT * (cosine + 1) / 2 + SUPPORT_WEIGHT * F.coalesce("shared", F.lit(0.0)) / F.greatest(F.least("total", "total2"), F.lit(1e-8))
    scored = pairs.join(shared, ["page", "win", "query", "query2"], "left").select("page", "win", "query", "query2", score.alias("score"))
    first = lambda key, other: F.row_number().over(W.partitionBy("page", "win", key).orderBy(F.desc("score"), other))
    best = scored.withColumns({"l": first("query", "query2"), "r": first("query2", "query")}).filter((F.col("l") == 1) & (F.col("r") == 1) & (F.col("score") >= least))
    node = lambda w, q: F.struct(F.col("page"), w.alias("win"), F.col(q).alias("query"))
    comps = graphs.components(best.select(node(F.col("win"), "query").alias("a"), node(F.col("win") + 1, "query2").alias("b")))
    named = own.withColumn("node", F.struct(*QUERY)).join(comps, "node", "left").withColumn("root", F.coalesce("component", "node"))
    is_stuff = F.col("label").between(*stuff)
    track = F.when(is_stuff, F.concat(F.lit("stuff "), F.col("label").cast("string"))).otherwise(F.concat_ws(" ", F.lit("thing"), F.col("root.win").cast("string"), F.col("root.query").cast("string")))
    return named.select(*QUERY, track.alias("track"))


def primitive_owners(tracks: DataFrame, masks: DataFrame, owners: DataFrame, nulls: DataFrame, membership: float | None = None) -> DataFrame:
    """(page, primitive, track, evidence) of every primitive of nulls: its owner over all windows, null where none beats having none.

    owners has page, win, query, primitive, logit, nulls page, win, primitive, null_logit. A query's evidence is its logit over
    the window's null logit (the chances' common norm cancels), a track's the greatest of its queries' in any window; only
    evidence over 0 owns. Of equal ones the one met first in the order of windows and queries owns. With membership a
    query counts for the primitives that its mask holds with that chance or more."""
    e = owners.join(tracks, QUERY).join(nulls, ["page", "win", "primitive"])
    if membership is not None:
        held = masks.filter(g.sigmoid(F.col("logit"), 60.0) >= membership).select(*QUERY, "primitive")
        e = e.join(held, [*QUERY, "primitive"], "left_semi")
    by = e.groupBy("page", "primitive", "track").agg(F.max(F.col("logit") - F.col("null_logit")).alias("evidence"), F.min(F.struct("win", "query")).alias("met"))
    top = by.filter("evidence > 0").groupBy("page", "primitive").agg(F.min(F.struct((-F.col("evidence")).alias("down"), "met", "track")).alias("m"))
    every = nulls.select("page", "primitive").distinct()
    return every.join(top, ["page", "primitive"], "left").select("page", "primitive", F.col("m.track").alias("track"), (-F.col("m.down")).alias("evidence"))


def track_instances(queries: DataFrame, tracks: DataFrame, owned: DataFrame) -> DataFrame:
    """(page, track, label, score, class_score, objectness, quality_score, mask_score, fragments, windows, primitives) of tracks that own primitives.

    Label and scores are those of the member of greatest score, the first of equal ones; primitives is their number, owned has them."""
    m = queries.join(tracks, QUERY)
    top = F.max_by(F.struct("label", "score", "class_score", "objectness", "quality_score", "mask_score"), F.struct("score", -F.col("win"), -F.col("query")))
    best = m.groupBy("page", "track").agg(top.alias("t"), F.count("*").alias("fragments"), F.countDistinct("win").alias("windows"))
    n = owned.filter("track is not null").groupBy("page", "track").agg(F.count("*").alias("primitives"))
    return best.join(n, ["page", "track"]).select("page", "track", "t.*", "fragments", "windows", "primitives")
