"""Domain rules: buckets, tiles, snapping, validation counts, room acoustics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import graphs, spatial

#: Millimetres of a unit, layer words by meaning, absorption limits.
UNIT_MM = {"mm": 1.0, "cm": 10.0, "m": 1000.0, "inch": 25.4, "foot": 304.8, "yard": 914.4, "mile": 1609344.0, "micron": 0.001, "kilometer": 1000000.0, "point": 0.352778, "pica": 4.23333}
WALL_WORDS = ["WALL", "墙", "STRUCT", "结构", "COLUMN", "柱", "BEAM", "梁", "STRUC"]
WALL_PREFIXES = ["A-WALL", "S-WALL", "S-STRC", "A-COLS"]
OCTAVE_BANDS = [125, 250, 500, 1000, 2000, 4000]
SABINE, LONGEST, ALPHA_LOW, ALPHA_HIGH, EARLY = 0.161, 10.0, 0.01, 0.99, 0.85


def to_mm(value: Column, unit: Column) -> Column:
    """value in millimetres; an unknown unit leaves it as it is."""
    factors = F.create_map(*(F.lit(x) for kv in UNIT_MM.items() for x in kv))
    return value * F.coalesce(F.try_element_at(factors, F.lower(unit)), F.lit(1.0))


def is_wall_layer(layer: Column) -> Column:
    up, out = F.upper(layer), F.lit(False)
    for w in WALL_WORDS:
        out = out | F.contains(up, F.lit(w))
    for p in WALL_PREFIXES:
        out = out | F.startswith(up, F.lit(p))
    return out


def octave_band(frequency: Column) -> Column:
    """The nearest band; the lower one when two are as near."""
    near = F.array_min(F.array(*(F.struct(F.abs(frequency - b).alias("d"), F.lit(b).alias("b")) for b in OCTAVE_BANDS)))
    return near["b"]


def area_bucket(area: Column) -> Column:
    return F.when(area <= 64, "tiny").when(area <= 256, "small").when(area <= 1024, "medium").when(area <= 4096, "large").otherwise("xlarge")


def clip_to_tiles(boxes: DataFrame, tile: float, least: float) -> DataFrame:
    """boxes cut at the tiles they touch, in tile coordinates (tx, ty, lx0, ly0, lx1, ly1); parts under least of the box go."""
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / tile), F.floor(F.col(hi) / tile)))
    t = boxes.withColumn("tx", span("x0", "x1")).withColumn("ty", span("y0", "y1"))
    cut = {"lx0": F.greatest("x0", F.col("tx") * tile), "ly0": F.greatest("y0", F.col("ty") * tile), "lx1": F.least("x1", F.col("tx") * tile + tile), "ly1": F.least("y1", F.col("ty") * tile + tile)}
    t = t.withColumns(cut).filter((F.col("lx1") - F.col("lx0")) * (F.col("ly1") - F.col("ly0")) >= least * (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    return t.withColumns({c: F.col(c) - F.col("tx" if "x" in c else "ty") * tile for c in cut})


def snap(points: DataFrame, tol: float) -> DataFrame:
    """points (id, x, y) plus component and sx, sy, the mean of all points joined by steps shorter than tol."""
    comps = graphs.components(spatial.near_pairs(points, tol).select("a", "b"))
    named = points.join(comps, points["id"] == comps["node"], "left").select("id", "x", "y", F.coalesce("component", "id").alias("component"))
    means = named.groupBy("component").agg(F.avg("x").alias("sx"), F.avg("y").alias("sy"))
    return named.join(means, "component")


def issue_counts(rows: DataFrame, checks: list[tuple[str, str, Column]]) -> DataFrame:
    """(code, severity, n) of all checks in one pass."""
    counts = rows.agg(*(F.count_if(c).alias(f"n{i}") for i, (_, _, c) in enumerate(checks)))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity"), F.col(f"n{i}").alias("n")) for i, (code, sev, _) in enumerate(checks)))))


def selection_materials(hits: DataFrame, materials: DataFrame) -> DataFrame:
    """(name, layer, area, share, absorption) by region and layer. Area is length * 3.0 / 1e6, as the unit
    convention of the domain has it for millimetre drawings, although that is not the square metres of a 3 m wall."""
    length = g.distance(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    area = hits.groupBy("name", "layer").agg(F.sum(length * 3.0 / 1e6).alias("area"))
    share = 100 * F.col("area") / F.sum("area").over(W.partitionBy("name"))
    return area.withColumn("share", share).join(materials, "layer", "left").select("name", "layer", "area", "share", (F.col("area") * F.col("alpha")).alias("absorption"))


def reverberation(rooms: DataFrame, height: float) -> DataFrame:
    """rooms (area, perimeter, alpha) plus formula, t60 and edt: Sabine under a mean absorption of 0.2, else Eyring."""
    volume, surface = F.col("area") * height, F.col("perimeter") * height + 2 * F.col("area")
    absorbed = surface * F.col("alpha")
    mean = F.least(F.lit(ALPHA_HIGH), F.greatest(F.lit(ALPHA_LOW), F.try_divide(absorbed, surface)))
    sabine = F.try_divide(SABINE * volume, absorbed)
    eyring = F.try_divide(SABINE * volume, -surface * F.log(1 - mean))
    low = F.col("alpha") < 0.2
    out = rooms.withColumn("formula", F.when(low, "sabine").otherwise("eyring")).withColumn("t60", F.least(F.lit(LONGEST), F.when(low, sabine).otherwise(eyring)))
    return out.withColumn("edt", EARLY * F.col("t60"))


def attribute_filter(rows: DataFrame, layer: Column, words: list[str], color: Column, colors: list[int]) -> DataFrame:
    """Rows whose layer holds one of words and whose colour is in colors; a row without a colour passes."""
    any_word = F.lit(False)
    for w in words:
        any_word = any_word | F.contains(layer, F.lit(w))
    return rows.filter(any_word & (color.isNull() | color.isin(colors)))


def valid_line(x0: str, y0: str, x1: str, y1: str) -> Column:
    """Finite ends and a length between 1e-6 and 1e6, neither included."""
    n, ok = g.distance(*map(F.col, (x0, y0, x1, y1))), F.lit(True)
    for c in (x0, y0, x1, y1):
        ok = ok & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return ok & (n > 1e-6) & (n < 1e6)


def line_in_view(view: list[float]) -> Column:
    """True where an end of x0, y0, x1, y1 is inside the view or the segment strictly crosses one of its sides."""
    a, b, c, e = view
    inside = lambda x, y: F.col(x).between(a, c) & F.col(y).between(b, e)
    out = inside("x0", "y0") | inside("x1", "y1")
    ends = [F.col(k) for k in ("x0", "y0", "x1", "y1")]
    for side in ((a, b, c, b), (c, b, c, e), (c, e, a, e), (a, e, a, b)):
        out = out | g.intersection(*ends, *(F.lit(float(v)) for v in side), closed=False).isNotNull()
    return out


def pixel_scale(calibrated: Column, override_dpi: Column, file_dpi: Column) -> tuple[Column, Column]:
    """Millimetres a pixel and its trust: user calibration, then a given resolution, then the file's."""
    scale = F.coalesce(calibrated, 25.4 / override_dpi, 25.4 / file_dpi)
    trust = F.when(calibrated.isNotNull() | override_dpi.isNotNull(), "high").when(file_dpi.isNotNull(), "medium").otherwise("unknown")
    return scale, trust


def layer_list(rows: DataFrame) -> DataFrame:
    return rows.select("layer").distinct().orderBy("layer")


def without_zero_length(segments: DataFrame, least: float = 1e-4) -> DataFrame:
    """segments of at least the length under which ends count as one point."""
    return without_short(segments, least)


def without_short(segments: DataFrame, least: float) -> DataFrame:
    return segments.filter(g.distance(*map(F.col, ("x0", "y0", "x1", "y1"))) >= least)


def relative_coordinates(segments: DataFrame, drawing: str) -> DataFrame:
    """segments with their drawing's origin ox, oy, the middle of its bounds, and rx0 .. ry1 from it in single precision."""
    low, high = (lambda a, b: F.min(F.least(a, b))), (lambda a, b: F.max(F.greatest(a, b)))
    origin = segments.groupBy(drawing).agg(((low("x0", "x1") + high("x0", "x1")) / 2).alias("ox"), ((low("y0", "y1") + high("y0", "y1")) / 2).alias("oy"))
    return segments.join(origin, drawing).withColumns({f"r{c}": (F.col(c) - F.col(f"o{c[0]}")).cast("float") for c in ("x0", "y0", "x1", "y1")})


def calibration_scale(x0: Column, y0: Column, x1: Column, y1: Column, real: Column) -> Column:
    """Real length over the measured one; null where the points are one."""
    return F.try_divide(real, g.distance(x0, y0, x1, y1))


def scale_boxes(boxes: DataFrame, width: Column, height: Column, to_width: Column, to_height: Column) -> DataFrame:
    """boxes of a page of width and height on a page of to_width and to_height."""
    return boxes.withColumns({c: F.col(c) * (to_width / width if c[0] == "x" else to_height / height) for c in ("x0", "y0", "x1", "y1")})


#: Hint words of the families, in the order in which they are asked.
FAMILY_HINTS = {
    "text": ["text", "ocr", "dimension", "leader", "callout", "note", "label"],
    "sheet": ["title", "table", "schedule", "legend", "stamp", "sheet"],
    "symbol": ["symbol", "fixture", "furniture", "stair", "column", "equipment", "icon"],
    "space": ["room", "space", "area", "region", "polygon", "closed"],
    "boundary": ["wall", "door", "window", "opening", "line", "polyline", "boundary"],
}


def route_family(hint: Column, large: Column, default: Column) -> tuple[Column, Column]:
    """Family by the hint's words, else space for a large region, else default; and whether it abstains."""
    words = F.split(F.regexp_replace(F.lower(F.trim(F.coalesce(hint, F.lit("unknown")))), "[ -]", "_"), "_")
    out = None
    for family, own in FAMILY_HINTS.items():
        met = F.arrays_overlap(words, F.array(*map(F.lit, own)))
        out = F.when(met, family) if out is None else out.when(met, family)
    found = out.when(large, "space")
    return F.coalesce(found, default), found.isNull()


def parse_quality(total: Column, valid: Column, errors: Column, warnings: Column, mismatch: Column, flat: Column) -> Column:
    """1 less weighted penalties for lost entities, errors, warnings, a wrong unit and flattened 3D entities, within 0 and 1."""
    lost = F.when(total > 0, (1 - valid / total) * 0.4).otherwise(0.0)
    score = 1 - lost - F.least(F.lit(0.3), errors * 0.05) - F.least(F.lit(0.15), warnings * 0.01) - F.when(mismatch, 0.1).otherwise(0.0) - F.least(F.lit(0.05), flat * 0.01)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def recovery_rate(recovered: Column, corrupted: Column) -> Column:
    return F.coalesce(F.try_divide(recovered, recovered + corrupted), F.lit(1.0))


def dimension_summary(rows: DataFrame) -> DataFrame:
    """(kind, n, low, high): count of each kind of dimension and the range of its positive measurements."""
    positive = F.when(F.col("measurement") > 0, F.col("measurement"))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.min(positive).alias("low"), F.max(positive).alias("high"))


def is_dashed(length: Column) -> Column:
    """As an aggregate: three pieces or more of nearly one length, which is a spread under three tenths of the mean.

    Squares are compared, from sums: whole lengths decide the same in any order of rows, also where the spread is three
    tenths exactly. A deviation kept row by row ends on either side of that. Pieces of unknown length count as pieces."""
    n, total = F.count(length), F.sum(length)
    least = F.greatest(total, n * 1e-6)
    return (F.count("*") >= 3) & (100 * (n * F.sum(length * length) - total * total) < 9 * least * least)


def gap_class(length: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """collinear, orthogonal or angled by the directions at a gap's ends; small or unknown where one is not given."""
    none = ax.isNull() | ay.isNull() | bx.isNull() | by.isNull()
    cos = F.abs(F.try_divide(ax * bx + ay * by, F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by)))
    return F.when(none, F.when(length < 2.0, "small").otherwise("unknown")).when(cos.isNull(), "unknown").when(cos > 0.9, "collinear").when(cos < 0.2, "orthogonal").otherwise("angled")


def flat_or_solid(low_z: Column, high_z: Column) -> Column:
    """True for an entity whose heights differ."""
    return F.abs(high_z - low_z) > 1e-6


def gate_report(rows: DataFrame) -> DataFrame:
    """(family, decision, reason, n) of gated rows (family, decision, reasons), a row with several reasons counting for each."""
    return rows.select("family", "decision", F.explode_outer("reasons").alias("reason")).groupBy("family", "decision", "reason").agg(F.count("*").alias("n"))


def named_by(rows: DataFrame, table: dict[str, list[str]], label: str, name: str) -> DataFrame:
    """rows with name, the key of table whose list holds the row's label; null for labels that no list has."""
    flat = {v: k for k, own in table.items() for v in own}
    return rows.withColumn(name, F.create_map(*(F.lit(x) for kv in flat.items() for x in kv))[F.col(label)])


def parameter_problems(values: Column, schema: dict[str, tuple]) -> Column:
    """Names of the parameters of a map of texts that break their rule: ("number", least, most) or ("choice", values); a missing
    one breaks its rule too."""
    checks = []
    for name, (kind, *rest) in schema.items():
        v = F.try_element_at(values, F.lit(name))
        ok = v.try_cast("double").between(*rest) if kind == "number" else v.isin(*rest[0])
        checks.append(F.when(~F.coalesce(ok, F.lit(False)), name))
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def constraint_residuals(constraints: DataFrame, points: DataFrame) -> DataFrame:
    """(sketch, n, residual, worst) of constraints (sketch, kind, a, b, value) over points (id, x, y): how far distances, and
    levels of horizontal and vertical pairs, are from what they should be."""
    at = lambda s: points.select(F.col("id").alias(s), F.col("x").alias(f"{s}x"), F.col("y").alias(f"{s}y"))
    j = constraints.join(at("a"), "a").join(at("b"), "b")
    off = F.when(F.col("kind") == "distance", F.abs(g.distance(*map(F.col, ("ax", "ay", "bx", "by"))) - F.col("value"))).when(F.col("kind") == "horizontal", F.abs(F.col("ay") - F.col("by"))).when(F.col("kind") == "vertical", F.abs(F.col("ax") - F.col("bx")))
    return j.groupBy("sketch").agg(F.count("*").alias("n"), F.sum(off * off).alias("residual"), F.max(off).alias("worst"))
