"""Room acoustics by octave band: absorption areas, reverberation of rooms, seats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.layers import holds
from . import drawing
from .rules import ALPHA_HIGH, ALPHA_LOW, EARLY, LONGEST, OCTAVE_BANDS, SABINE

#: Absorption of a surface whose material is not known, by band; words of seat blocks; spacing classes in mm.
DEFAULT_ALPHA = [0.02, 0.03, 0.04, 0.05, 0.06, 0.07]
SEAT_WORDS = ["SEAT", "CHAIR", "椅", "凳", "AUDITORIUM", "STOOL"]
SEAT_CLASSES = [("auditorium", 550.0), ("single", 800.0), ("double", 1200.0)]
SEATS_LEAST, SEATS_SAMPLED, SPACING = 50, 100, (300.0, 2000.0)
#: Below this mean absorption at 500 Hz the Sabine formula is taken.
SABINE_UNDER = 0.2


def bands(spark) -> DataFrame:
    """(band, default_alpha)."""
    return spark.createDataFrame(list(zip(OCTAVE_BANDS, DEFAULT_ALPHA, strict=True)), "band int, default_alpha double")


def equivalent_absorption(areas: DataFrame, materials: DataFrame, key: str = "room") -> DataFrame:
    """(key, band, absorption): sum of area times alpha over areas (key, material, area); materials (name, band, alpha)
    without coefficients add nothing."""
    j = areas.join(materials.withColumnRenamed("name", "material"), "material")
    return j.groupBy(key, "band").agg(F.sum(F.col("area") * F.col("alpha")).alias("absorption"))


def average_absorption(absorption, total):
    """Absorption over the total area; null without an area."""
    return F.when(total > 0, absorption / total)


def wall_materials(boundaries: DataFrame) -> DataFrame:
    """(drawing, material): the material of a drawing's first boundary that names one."""
    return boundaries.filter("material is not null").groupBy("drawing").agg(F.min_by("material", "ord").alias("material"))


def rooms_of_rings(rings: DataFrame) -> DataFrame:
    """(drawing, room, area, perimeter) in square metres and metres: room 0 is the outer ring, the others the holes in order of id."""
    hole = F.row_number().over(W.partitionBy("drawing", "role").orderBy("ring_id"))
    return rings.select("drawing", F.when(F.col("role") == "outer", 0).otherwise(hole).alias("room"), (F.abs(g.ring_area(F.col("points"))) / 1e6).alias("area"), (g.ring_perimeter(F.col("points")) / 1e3).alias("perimeter"))


def room_absorption(rings: DataFrame, boundaries: DataFrame, materials: DataFrame, height: float, floor: str = "carpet", ceiling: str = "gypsum", wall: str = "concrete") -> DataFrame:
    """(drawing, room, band, volume, surface, absorption): walls, floor and ceiling of each room, each with its material's
    coefficients or the default ones. Materials are a bounded table."""
    rooms = rooms_of_rings(rings).join(wall_materials(boundaries), "drawing", "left")
    parts = F.array(
        F.struct(F.coalesce("material", F.lit(wall)).alias("name"), (F.col("perimeter") * height).alias("area")), F.struct(F.lit(floor).alias("name"), F.col("area").alias("area")), F.struct(F.lit(ceiling).alias("name"), F.col("area").alias("area")),
    )
    faces = rooms.select("drawing", "room", (F.col("area") * height).alias("volume"), (F.col("perimeter") * height + 2 * F.col("area")).alias("surface"), F.inline(parts))
    every = faces.crossJoin(F.broadcast(bands(rings.sparkSession)))
    m = materials.select(F.lower("name").alias("name"), "band", "alpha")
    j = every.withColumn("name", F.lower("name")).join(F.broadcast(m), ["name", "band"], "left")
    return j.groupBy("drawing", "room", "band", "volume", "surface").agg(F.sum(F.col("area") * F.coalesce("alpha", "default_alpha")).alias("absorption"))


def room_reverberation(rings: DataFrame, boundaries: DataFrame, materials: DataFrame, height: float, formula: str = "auto") -> DataFrame:
    """(drawing, room, band, volume, surface, absorption, formula, t60, edt) of each room and band; formula sabine, eyring
    or auto, which goes by the mean absorption at 500 Hz."""
    a = room_absorption(rings, boundaries, materials, height)
    mean = F.max(F.when(F.col("band") == 500, F.try_divide("absorption", "surface"))).over(W.partitionBy("drawing", "room"))
    kind = F.when(mean < SABINE_UNDER, "sabine").otherwise("eyring") if formula == "auto" else F.lit(formula)
    alpha = F.greatest(F.lit(ALPHA_LOW), F.least(F.lit(ALPHA_HIGH), F.try_divide("absorption", "surface")))
    damp = -F.col("surface") * F.log(1 - alpha)
    some = F.col("absorption") > 0.01
    t = F.when(F.col("formula") == "sabine", F.when(some, SABINE * F.col("volume") / F.col("absorption"))).when(some & (F.col("surface") > 0.01) & (damp > 0.01), SABINE * F.col("volume") / damp)
    return a.withColumn("formula", kind).withColumn("t60", F.coalesce(t, F.lit(LONGEST))).withColumn("edt", EARLY * F.col("t60"))


def seat_spacing(seats: DataFrame) -> DataFrame:
    """(block, kind): class of the mean distance, within the limits, between the first SEATS_SAMPLED seats of each block.

    The rule looks at so many seats by definition; they are compared with each other only."""
    few = seats.withColumn("k", F.row_number().over(W.partitionBy("block").orderBy("id"))).filter(F.col("k") <= SEATS_SAMPLED)
    o = few.select("block", F.col("k").alias("k2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    d = g.distance(F.col("x"), F.col("y"), F.col("x2"), F.col("y2"))
    mean = few.join(o, "block").filter(F.col("k") < F.col("k2")).filter(d.between(*SPACING)).groupBy("block").agg(F.avg(d).alias("d"))
    kind = None
    for name, limit in SEAT_CLASSES:
        kind = F.when(F.col("d") < limit, name) if kind is None else kind.when(F.col("d") < limit, name)
    return seats.select("block").distinct().join(mean, "block", "left").select("block", F.when(F.col("d").isNull(), "unknown").otherwise(kind.otherwise("bench")).alias("kind"))


def seat_zones(inserts: DataFrame, least: int = SEATS_LEAST) -> DataFrame:
    """(block, n, kind, area): blocks (block, id, x, y) with a seat word and at least so many places, and their hull's area."""
    own = inserts.filter(holds(F.col("block"), SEAT_WORDS))
    n = own.groupBy("block").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    own = own.join(n.select("block"), "block", "left_semi")
    h = drawing.convex_hulls(own, "block").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("k", "x", "y"))).alias("hull"))
    return n.join(seat_spacing(own), "block").join(h, "block").select("block", "n", "kind", F.abs(g.ring_area(F.col("hull"))).alias("area"))
