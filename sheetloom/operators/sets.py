"""Sets, splits, dedup, runs and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import graphs
from .selection import top_k


def first_of_equal(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(order, copies): the first row of each group of equal keys; long keys are told apart by two hashes."""
    k = rows.select(F.sha2(F.coalesce(F.col(key), F.lit("")), 256).alias("k"), F.col(key).isNull().alias("none"), order)
    return k.groupBy("k", "none").agg(F.min(order).alias(order), F.count("*").alias("copies")).select(order, "copies")


def leakage(rows: DataFrame, key: str, split: str) -> DataFrame:
    """(a, b, n): distinct keys that two splits share. Each key becomes its set of splits, which is small."""
    s = rows.groupBy(F.sha2(F.coalesce(F.col(key), F.lit("")), 256).alias("k")).agg(F.array_sort(F.collect_set(split)).alias("s")).filter("size(s) > 1")
    pairs = s.select(F.explode("s").alias("a"), "s").select("a", F.explode("s").alias("b")).filter("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))


def hash_split(key: Column, ratio: float) -> Column:
    """True where the first 8 hex digits of sha1 of the key, as a share of 2^32 - 1, are under ratio."""
    return F.conv(F.substring(F.sha1(key), 1, 8), 16, 10).cast("double") / 4294967295.0 < ratio


def balanced_sample(rows: DataFrame, label: str, key: str, n: int, seed: int) -> DataFrame:
    """At most n rows of each non-null label, picked by a seeded hash of the key."""
    draw = F.xxhash64(F.lit(seed), key)
    return top_k(rows.filter(F.col(label).isNotNull()), [label], [draw, key], n)


def runs(rows: DataFrame, group: str, number: str) -> DataFrame:
    """(group, lo, hi, n) of maximal runs of consecutive integers."""
    u = rows.select(group, number).distinct()
    g = u.withColumn("__g", F.col(number) - F.row_number().over(W.partitionBy(group).orderBy(number)))
    return g.groupBy(group, "__g").agg(F.min(number).alias("lo"), F.max(number).alias("hi"), F.count("*").alias("n")).drop("__g")


def circular_peaks(rows: DataFrame, bins: int, reach: int) -> DataFrame:
    """(bin, n) of bins that no bin within reach, around the circle, exceeds. The histogram has bins rows at most."""
    h = rows.groupBy("bin").agg(F.count("*").alias("n"))
    near = h.select("n", F.explode(F.array(*(F.lit(k) for k in range(-reach, reach + 1) if k))).alias("k"), "bin").select(F.pmod(F.col("bin") + F.col("k"), F.lit(bins)).alias("bin"), F.col("n").alias("m"))
    top = near.groupBy("bin").agg(F.max("m").alias("m"))
    return h.join(top, "bin", "left").filter("m is null or n >= m").select("bin", "n")


def dataset_summary(rows: DataFrame, keys: list[str], size: str) -> DataFrame:
    """(keys, n, least, most)."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(size).alias("least"), F.max(size).alias("most"))


def point_map(points: DataFrame, digits: int = 9) -> DataFrame:
    """points (id, x, y) with first, the least id of the points that are equal to so many digits."""
    key = lambda c: F.round(F.col(c) * 10.0**digits)
    k = points.withColumns({"kx": key("x"), "ky": key("y")})
    first = k.groupBy("kx", "ky").agg(F.min("id").alias("first"))
    return k.join(first, ["kx", "ky"]).drop("kx", "ky")


def merge_on_grid(points: DataFrame, tol: float) -> DataFrame:
    """(id, x, y, n): one point, the one of least id, of those that round to one grid place of width tol."""
    g = points.groupBy(F.round(F.col("x") / tol).alias("gx"), F.round(F.col("y") / tol).alias("gy")).agg(F.min_by(F.struct("id", "x", "y"), "id").alias("p"), F.count("*").alias("n"))
    return g.select("p.id", "p.x", "p.y", "n")


def union_ranked(base: DataFrame, extra: DataFrame, scale: float) -> DataFrame:
    """Both tables with side; base scores are raised by one and extra ones scaled, so that base always ranks first."""
    return base.withColumns({"side": F.lit("base"), "score": F.col("score") + 1}).unionByName(extra.withColumns({"side": F.lit("extra"), "score": F.col("score") * scale}))


def graph_sets(edges: DataFrame) -> DataFrame:
    """(kind, key): the node names and the edges source>target:relation, each once."""
    nodes = edges.select(F.lit("node").alias("kind"), F.explode(F.array(F.col("source").cast("string"), F.col("target").cast("string"))).alias("key"))
    return nodes.union(edges.select(F.lit("edge"), F.concat(F.col("source").cast("string"), F.lit(">"), F.col("target").cast("string"), F.lit(":"), F.col("relation").cast("string")))).distinct()


def leakage_by(rows: DataFrame, group: str, key: str, split: str) -> DataFrame:
    """(group, a, b, n): distinct keys that two splits share within each group."""
    s = rows.groupBy(group, F.sha2(F.coalesce(F.col(key), F.lit("")), 256).alias("k")).agg(F.collect_set(split).alias("s")).filter("size(s) > 1")
    pairs = s.select(group, F.explode("s").alias("a"), "s").select(group, "a", F.explode("s").alias("b")).filter("a < b")
    return pairs.groupBy(group, "a", "b").agg(F.count("*").alias("n"))


def locked_rows(rows: DataFrame, columns: list[str], order: str, most: int = 50) -> DataFrame:
    """The first rows whose named columns hold a word of the splits that training must not see."""
    return rows.filter(F.concat_ws(" ", *columns).rlike("locked|smoke")).orderBy(order).limit(most)


def shuffled_split(rows: DataFrame, key: str, shares: dict[str, float], seed: int) -> DataFrame:
    """(key, split): rows in the order of a seeded hash, then key, cut after the whole numbers of rows that the sums of shares give;
    the last split takes what is left. Stable under reruns; equal keys are rows of their own.

    Two counts by parts of the hash, of 2**14 groups each, find the hash cells of the cuts; only the rows of these cells, a few in
    2**28, are ordered."""
    h = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 40))
    r = graphs.written(rows.select(F.col(key).alias("k"), h.alias("h")).withColumn("cell", F.shiftright("h", 12)))
    high = F.shiftright("cell", 14)

    def counted(part: DataFrame, by: Column) -> list[tuple[int, int]]:
        return sorted((x["p"], x["count"]) for x in part.groupBy(by.alias("p")).count().collect())

    def find(counts: list[tuple[int, int]], cut: int) -> tuple[int, int]:
        """The group that holds the cut-th row, and how many rows of it come before the cut."""
        for p, n in counts:
            if cut <= n:
                return p, cut
            cut -= n
        raise ValueError("shares are over 1")

    first = counted(r, high)
    total, edge, cuts = sum(n for _, n in first), 0.0, []
    for share in list(shares.values())[:-1]:
        edge += share
        cuts.append(int(total * edge + 1e-9))
    tops = [find(first, c) if c else None for c in cuts]
    own = {p: counted(r.filter(high == p), F.col("cell")) for p in {t[0] for t in tops if t}}
    at = [find(own[t[0]], t[1]) if t else (-1, 0) for t in tops]
    met = F.col("cell").isin([c for c, _ in at])
    rank = F.row_number().over(W.partitionBy("cell").orderBy("h", "k"))
    ranked = r.filter(met).withColumn("rank", rank).unionByName(r.filter(~met).withColumn("rank", F.lit(0)))
    split = F.lit(list(shares)[-1])
    for name, (cell, n) in reversed(list(zip(shares, at, strict=False))):
        split = F.when((F.col("cell") < cell) | ((F.col("cell") == cell) & (F.col("rank") <= n)), name).otherwise(split)
    return ranked.select(F.col("k").alias(key), split.alias("split"))


def manifest_hash(files: DataFrame) -> DataFrame:
    """(folder, hash) over path, a zero sign and the file hash of each folder's files (folder, path, sha), by path; folders are small."""
    parts = F.array_sort(F.collect_list(F.struct("path", "sha")))
    return files.groupBy("folder").agg(F.sha2(F.array_join(F.transform(parts, lambda p: F.concat(p["path"], F.lit("\u0000"), p["sha"])), ""), 256).alias("hash"))


def unique_with_cap(rows: DataFrame, group: str, key: str, order: str, cap: int) -> DataFrame:
    """The first row of each key of a group, and of these the first cap rows."""
    return top_k(top_k(rows, [group, key], [order], 1), [group], [order], cap)


def stratified_sample(rows: DataFrame, stratum: str, sizes: dict[str, int], key: str, seed: int) -> DataFrame:
    """So many rows of each stratum, picked by a seeded hash of the key."""
    out = None
    for name, n in sizes.items():
        part = top_k(rows.filter(F.col(stratum) == name), [stratum], [F.xxhash64(F.lit(seed), key), key], n)
        out = part if out is None else out.union(part)
    return out


def weighted_sample(rows: DataFrame, weight: Column, forced: Column, key: str, n: int, seed: int) -> DataFrame:
    """(key, forced): all forced rows, then others up to n by the n greatest of u^(1/weight), u a seeded hash of the key.

    Such draws are a weighted sample without replacement; each task keeps n rows."""
    u = (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 40)) + 0.5) / (1 << 40)
    own = rows.select(key, forced.alias("forced"), F.when(weight > 0, F.log(u) / weight).otherwise(float("-inf")).alias("draw"))
    return own.orderBy(F.desc("forced"), F.desc("draw"), key).limit(n).select(key, "forced")


def by_priority(rows: DataFrame, priority: str, key: str, most: int) -> DataFrame:
    return rows.orderBy(F.desc(priority), key).limit(most)
