"""Nested JSON values as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graphs


def walk_values(rows: DataFrame, key: str, text: str, most: int = 256) -> DataFrame:
    """(key, place, path, kind, value): each JSON text itself and every value nested in it; ordered by place they come depth first.

    place holds the numbers of the values on the way, those of an object by the order of its keys; path names them (`$.a[0]`). kind
    is object, array, string, number, boolean or null, and value is compact JSON. Texts that are null or no JSON give no row. A level
    of all texts is one step, written once, so there are as many steps as the deepest text has levels."""
    level = rows.select(F.col(key).alias("k"), F.array().cast("array<int>").alias("place"), F.lit("$").alias("path"), F.to_json(F.try_parse_json(F.col(text))).alias("value")).filter("value is not null")
    out = None
    for _ in range(most):
        level = graphs.written(level)
        out = level if out is None else out.union(level)
        inner = level.filter(F.left("value", F.lit(1)).isin("{", "["))
        if inner.isEmpty():
            first = F.left("value", F.lit(1))
            kind = F.when(first == "{", "object").when(first == "[", "array").when(first == '"', "string").when(first == "n", "null").when(first.isin("t", "f"), "boolean").otherwise("number")
            return out.select(F.col("k").alias(key), "place", "path", kind.alias("kind"), "value")
        held = inner.select("k", "place", "path", F.parse_json("value").alias("v"))
        each = held.lateralJoin(held.sparkSession.tvf.variant_explode(F.col("v").outer()))
        name = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), F.col("key"))).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        # A null of JSON has no text of its own.
        level = each.select("k", F.concat("place", F.array("pos")).alias("place"), F.concat("path", name).alias("path"), F.coalesce(F.to_json("value"), F.lit("null")).alias("value"))
    raise ValueError(f"a text has over {most} levels")
