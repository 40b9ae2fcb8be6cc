"""Small helpers that the operators of this folder share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one piece of an Arrow batch handled at a time, and the bytes of text it may hold.
SLICE_ROWS = 2048
SLICE_BYTES = 8 << 20


def use_checkpoints(spark: SparkSession) -> None:
    """Set the checkpoint folder from spark.checkpoint.dir; where that is unset, a folder in the warehouse, which is shared too."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.sparkContext.setCheckpointDir(folder)


def materialise(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and cut its lineage."""
    use_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def slices(batches: Iterator[pa.RecordBatch], text_col: str | int = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into pieces of bounded rows and, but for single rows, of most bytes of text."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            n = min(SLICE_ROWS, batch.num_rows - at)
            while n > 1 and batch.column(text_col).slice(at, n).nbytes > most:
                n = max(1, n // 2)
            yield batch.slice(at, n)
            at += n


def map_rows(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Run work over df's partitions, in Arrow batches of bounded size."""
    return df.mapInArrow(lambda batches: work(slices(batches)), schema)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """names, each with underscores added until no column of df has it, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys over all shuffle partitions, which adaptive execution does not merge: for rows that will grow."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism), *keys)


def ddl_type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def bucket_of(doc_id, k: int):
    """crc32 of the id as text, modulo k; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % k


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: A key of a join's table is hot if it meets more rows than HOT_ROWS and than one in HOT_SHARE of all; so there are under HOT_SHARE hot keys.
HOT_ROWS, HOT_SHARE = 256, 4096


def split_join(rows: DataFrame, table: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """rows joined with table, which has each combination of keys once and in weight the number of rows it meets.

    The few hot keys, under HOT_SHARE of them, go to every task, where their rows stay; all others are
    joined by key. Both sides must be materialised, as they are read more than once. weight is dropped."""
    total = table.agg(F.sum(weight)).first()[0] or 0
    often = max(HOT_ROWS, total // HOT_SHARE)
    hot = table.filter(F.col(weight) > often).drop(weight)
    cold = table.filter(F.col(weight) <= often).drop(weight)
    first = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return first.unionByName(rest)


#: Tasks that the rows of one key are dealt over where a small table joins a large one.
SALTS = 16


def salted_join(rows: DataFrame, table: DataFrame, keys: list[str], by: str) -> DataFrame:
    """rows joined with table, which has each combination of keys once, is far smaller and comes SALTS times, once for each
    part of the rows of a key; by tells the rows of a key apart."""
    salt = fresh(rows, "salt")[0]
    many = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn(salt, F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(many, [*keys, salt]).drop(salt)
