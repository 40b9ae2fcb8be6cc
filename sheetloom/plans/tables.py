"""Geometry tables made from the test tables, in Spark and as SQL that other engines run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Boxes of a page: pages stay small however many rows there are.
PAGE_ROWS = 100


def _e(k: int):
    return F.get("embedding", F.lit(k - 1)).cast("double")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x0, y0, x1, y1, layer: two points of each vector, in millimetres on a 0.01 grid."""
    at = lambda k: F.round(_e(k) * 1000, 2)
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), at(1).alias("x0"), at(2).alias("y0"), at(3).alias("x1"), at(4).alias("y1"), F.concat(F.lit("L"), F.col("label").cast("string")).alias("layer"))


SEGMENTS = "segments AS (SELECT vec_id AS id, round(embedding[1]::DOUBLE * 1000, 2) AS x0, round(embedding[2]::DOUBLE * 1000, 2) AS y0, round(embedding[3]::DOUBLE * 1000, 2) AS x1, round(embedding[4]::DOUBLE * 1000, 2) AS y1, 'L' || label AS layer FROM embeddings)"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, score, x0, y0, x1, y1: a box of each vector, a hundred to a page."""
    x, y = F.round(_e(5) * 1000, 1), F.round(_e(6) * 1000, 1)
    w, h = F.round(F.abs(_e(7)) * 800 + 20, 1), F.round(F.abs(_e(8)) * 800 + 20, 1)
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / PAGE_ROWS).alias("page"), F.col("label"), F.round(F.abs(_e(9)) + F.col("vec_id") * 1e-7, 8).alias("score"), x.alias("x0"), y.alias("y0"), (x + w).alias("x1"), (y + h).alias("y1")
    )


BOXES = "boxes AS (SELECT id, page, label, score, x AS x0, y AS y0, x + w AS x1, y + h AS y1 FROM (SELECT vec_id AS id, vec_id // 100 AS page, label, round(abs(embedding[9]::DOUBLE) + vec_id * 1e-7::DOUBLE, 8) AS score, round(embedding[5]::DOUBLE * 1000, 1) AS x, round(embedding[6]::DOUBLE * 1000, 1) AS y, round(abs(embedding[7]::DOUBLE) * 800 + 20, 1) AS w, round(abs(embedding[8]::DOUBLE) * 800 + 20, 1) AS h FROM embeddings))"


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, source, gold, pred, score: quality labels against a length rule."""
    d, l = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return d.join(l, "doc_id").select(F.col("doc_id").alias("id"), "source", F.col("quality").alias("gold"), (F.col("n_chars") >= 1200).cast("int").alias("pred"), (F.col("n_chars") / (F.col("n_chars") + 1500)).alias("score"))


JUDGED = "judged AS (SELECT d.doc_id AS id, source, quality AS gold, (n_chars >= 1200)::INT AS pred, n_chars / (n_chars + 1500) AS score FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


#: Layer names that meet the drawing rules in every way.
LAYER_NAMES = [
    "A-DOOR-WALL", "WALL-GLAZ", "FOO", "d-01", "w-2", "防火门", "落地窗", "A-WIND", "OPENING_3", "洞口", "A-WALL-FULL", "内墙", "S-COLS", "结构柱", "BEAM", "A-FURN-TABLE", "FF&E", "TOILET", "KITCHEN-CABINET", "A-PLMB-FIXT",
    "HVAC-DUCT", "E-LITE", "L-PLNT", "灯具", "DIM-50", "标高", "A-ANNO-TEXT", "CONC-WALL", "砖墙", "WOOD", "玻璃幕墙", "STEEL", "石膏板", "GYPSUM", "0", "", "SOFA", "A-MECH", "VENTS", "gate",
]


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, layer, color, unit, size: a drawing entity of each vector with a layer name, colour index, declared unit and coordinate size."""
    v = F.col("vec_id")
    units = ["mm", "cm", "m", "inch", "foot", "yard", "mile", "micron", "kilometer", "point", "pica", "parsec"]
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (v % len(names) + 1).cast("int"))
    return read(spark, sf_dir, "embeddings").select(v.alias("id"), pick(LAYER_NAMES).alias("layer"), (v % 9).alias("color"), pick(units).alias("unit"), F.pow(F.lit(10.0), v % 8).alias("size"))


LAYERS = (
    "layers AS (SELECT vec_id AS id, ["
    + ", ".join(f"'{n}'" for n in LAYER_NAMES)
    + f"][vec_id % {len(LAYER_NAMES)} + 1] AS layer, vec_id % 9 AS color, ['mm','cm','m','inch','foot','yard','mile','micron','kilometer','point','pica','parsec'][vec_id % 12 + 1] AS unit, power(10.0::DOUBLE, vec_id % 8) AS size FROM embeddings)"
)
