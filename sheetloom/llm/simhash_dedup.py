"""SimHash near-duplicates, found through deletion variants of fingerprint segments."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graphs import components
from .common import ddl_type, fresh, map_rows, materialise, split_join, spread

SEED = 42
SHINGLE = 3
HALF = 32
#: Hashes whose bits are counted at a time.
BLOCK = 255 * 256


def _bit_counts(digests: bytes) -> np.ndarray:
    """How many of the 8-byte digests have each bit set, most significant bit first; eight counters share a word."""
    bits = np.unpackbits(np.frombuffer(digests, np.uint8)).reshape(-1, 64)
    whole = len(bits) // 255 * 255
    packed = bits[:whole].view(np.uint64).reshape(-1, 255, 8).sum(axis=1)
    return packed.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of a text as a signed integer: a bit is set if over half of its shingles' hashes set it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest, join = xxhash.xxh64_digest, b" ".join
    if len(words) < SHINGLE:
        counts, n = _bit_counts(digest(join(words), SEED)), 1
    else:
        counts, n = np.zeros(64, np.int64), len(words) - SHINGLE + 1
        for at in range(0, n, BLOCK):
            w = words[at : at + BLOCK + SHINGLE - 1]
            counts += _bit_counts(b"".join([digest(join(t), SEED) for t in zip(w, w[1:], w[2:], strict=False)]))
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def row_key(id_col: str, text_col: str):
    """A 64-bit name of a row among those of its id; rows that repeat both id and text share it."""
    return F.xxhash64(id_col, text_col)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, fp) for each row; a null or wordless text has fp 0. Other columns are not read."""

    def work(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([fingerprint(x) for x in b.column(2).to_pylist()], pa.int64())], names=["id", "row", "fp"])

    picked = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    return map_rows(picked, work, f"id {ddl_type(docs, id_col)}, row bigint, fp bigint")


def _halves():
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", HALF)
    return [(0, low), (1, high)]


def _variants(fps: DataFrame) -> DataFrame:
    """Index rows (key, side, fp) of each distinct fingerprint.

    Two fingerprints that differ in at most two bits differ in at most one bit of one 32-bit half. That
    half is either equal, found under the half's own value (side 0), or differs in one bit, found under
    the half with that bit deleted, one fingerprint having the bit (side 1) and the other not (side 0).
    The key packs the half, the deleted position plus one (zero: none) and the remaining value."""
    rows = []
    for half, value in _halves():
        rows.append(F.struct((value + F.lit(half << 40)).alias("key"), F.lit(-1).alias("side")))
        for p in range(HALF):
            bit = F.shiftrightunsigned(value, p).bitwiseAND(F.lit(1))
            rows.append(F.struct((value - bit * F.lit(1 << p) + F.lit((half << 40) + ((p + 1) << 33))).alias("key"), bit.cast("int").alias("side")))
    return fps.select("fp", F.explode(F.array(*rows)).alias("x")).select("x.key", "x.side", "fp")


def _close(a: str, b: str, bits: int):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= bits


def near_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (column fp) at two differing bits or fewer.

    The index is grouped by key. A key that only two fingerprints can meet under gives its pair at once,
    which is then verified. The members of fuller keys are kept aside, each once, and linked exactly
    without pairing them all: every fingerprint is listed under itself and its 64 one-bit neighbours,
    two are within two bits just if they share such an entry, an entry holds at most 65 of them and all
    of these are within two bits of each other, so linking an entry's members to its least loses nothing."""
    index = _variants(fps)
    lone = lambda s: F.min(F.when(F.col("side") == s, F.col("fp")))
    keys = index.groupBy("key").agg(
        *(F.count(F.when(F.col("side") == s, 1)).alias(f"n{i}") for i, s in enumerate((-1, 0, 1))),
        F.min("fp").alias("lo"), F.max("fp").alias("hi"), lone(0).alias("z"), lone(1).alias("o"),
    )
    keys = materialise(keys.filter("n0 > 1 or (n1 > 0 and n2 > 0)"))
    twos = keys.filter("n0 = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b")).union(keys.filter("n1 = 1 and n2 = 1").select("z", "o")).filter(_close("a", "b", 2))
    full = keys.filter("n0 > 2 or (n1 > 0 and n2 > 0 and n1 + n2 > 2)").select("key")
    crowd = index.join(full, "key", "left_semi").select("fp").distinct()
    around = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(1 << p if p < 63 else -(1 << 63))) for p in range(64)))
    meets = crowd.select("fp", F.explode(around).alias("spot")).groupBy("spot").agg(F.collect_set("fp").alias("all")).filter("size(all) > 1")
    stars = meets.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).filter("a <> b").filter(_close("a", "b", 2))
    return twos.union(stars).distinct()


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row, fp, component_id) for each row."""
    fps = materialise(fingerprints(docs, id_col, text_col))
    distinct = materialise(fps.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("rows")))
    comps = components(near_links(spread(distinct.select("fp"), "fp"))).select(F.col("node").alias("fp"), "component")
    named = distinct.join(comps, "fp")
    names = named.join(named.groupBy("component").agg(F.min("first").alias("name")), "component").select("fp", "name")
    labels = materialise(distinct.join(names, "fp", "left").select("fp", F.coalesce("name", "first").alias("component_id"), "rows"))
    return split_join(fps, labels, ["fp"], "rows")


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id_col, fingerprint, component_id).

    Documents whose fingerprints differ in two bits or fewer are linked; component_id is the smallest
    id reachable, the row's own included. Rows with a null id take part and get the smallest id of
    their group, null if there is none; repeated rows each come back. Null, empty and wordless texts are
    copies of each other; very long texts are read whole; other columns are not read. Empty tables give
    empty results. Exact copies share a fingerprint, which enters the index once. Only fingerprints are shuffled."""
    out = _grouped(docs, id_col, text_col)
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each near-duplicate group: the one with the smallest id.

    Among rows with that id, or in a group of null ids only, the row with the least hash of id and text
    stays, once. All columns are returned as they are, whatever their names; an empty table stays empty."""
    rows = materialise(_grouped(docs, id_col, text_col).select("id", "row", "fp", "component_id"))
    group = F.when(F.col("component_id").isNull(), F.col("fp")).otherwise(0)
    best = rows.groupBy("component_id", group.alias("g")).agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("b"))
    name, rid, key = fresh(docs, "row_key", "best_id", "best_key")
    marked = docs.withColumn(name, row_key(id_col, text_col))
    same = (F.col(name) == F.col(key)) & F.col(id_col).eqNullSafe(F.col(rid))
    kept = marked.join(best.select(F.col("b.id").alias(rid), F.col("b.row").alias(key)), same, "left_semi")
    twice = rows.groupBy("id", "row").count().filter("count > 1").select(F.col("id").alias(rid), F.col("row").alias(key))
    repeated = kept.join(twice, same, "left_semi").dropDuplicates([id_col, name])
    return kept.join(twice, same, "left_anti").unionByName(repeated).select(*docs.columns)
