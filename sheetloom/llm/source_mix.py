"""Mixing sources to target weights by hash-threshold histograms, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, split_join, use_checkpoints

#: Weights of the sources in their order, repeating, and the most times that a source is taken.
WEIGHTS, MOST_TIMES = (5, 2, 1), 3
#: A document's place is a number of LEVELS digits of DIGIT_BITS bits, from a hash of its id and text.
LEVELS, DIGIT_BITS = 4, 15
#: Sources that one task ranks; more are cut into ranges first.
RANGE_ROWS = 1 << 16

_KEYS = ["source", "none"]
_SPACE = " \t\n\v\f\r"


def n_words(text: Column) -> Column:
    """Number of runs of other characters than space and the controls 9 to 13; null has none."""
    return F.coalesce(F.length(F.regexp_replace(F.rtrim(text, F.lit(_SPACE)), r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++", "w")), F.lit(0)).cast("long")


def place(doc_id: Column, text: Column) -> Column:
    """A whole number of LEVELS * DIGIT_BITS bits that depends on id and text alone; rows equal in both share it."""
    whole = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, LEVELS * DIGIT_BITS // 4), 16, 10).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """sources with rank, from 0 by code point, null last. Many sources are ranked in ranges, whose sizes are carried over."""
    by = [F.col("none"), F.col("source")]
    dealt = materialise(sources.repartitionByRange(max(1, -(-sources.count() // RANGE_ROWS)), *by).withColumn("part", F.spark_partition_id()))
    ahead = F.coalesce(F.sum("rows").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    carry = dealt.groupBy("part").agg(F.count("*").alias("rows")).select("part", ahead.alias("ahead"))
    own = F.row_number().over(W.partitionBy("part").orderBy(*by)) - 1
    return dealt.withColumn("own", own).join(F.broadcast(carry), "part").withColumn("rank", F.col("own") + F.col("ahead")).drop("part", "own", "ahead")


def targets(sources: DataFrame, share: float = 1.0) -> DataFrame:
    """sources (source, none, source_size) with target: its part by weight of share of all sizes.

    A target stops at MOST_TIMES its source's size, and what is over is split among the others by weight until none is
    above. The words for a unit of weight only grow from round to round; a round is one aggregate over the sources, and
    no source passes through the driver."""
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    rows = materialise(ranked(sources).withColumn("weight", weight).withColumn("most", F.col("source_size") * MOST_TIMES))
    total = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("s"), F.coalesce(F.sum("weight"), F.lit(0)).alias("w")).first()
    words, weights = share * total["s"], total["w"]
    while True:
        target = F.lit(float(words)) * F.col("weight") / F.lit(float(max(weights, 1)))
        over = rows.filter(target > F.col("most")).agg(F.coalesce(F.sum("most"), F.lit(0)).alias("s"), F.coalesce(F.sum("weight"), F.lit(0)).alias("w")).first()
        if total["w"] - over["w"] in (weights, 0):
            break
        words, weights = share * total["s"] - over["s"], total["w"] - over["w"]
    return rows.withColumn("target", F.least(target, F.col("most").cast("double"))).drop("rank", "weight", "most")


def thresholds(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """sources (with source_size, n_rows, target) with times and threshold: a document is taken times times, and once more
    if its place is at or under threshold.

    Sizes are summed by source and the place's first digit; the running sum over a source's at most 2^DIGIT_BITS digits
    finds the one in which its budget ends. Only that digit's rows are refined by the next digit; they are written first, so
    that later levels read a small part of the rows. The last boundary's documents are taken if that comes nearer
    to the budget. The threshold of a smaller target is never above that of a larger one."""
    times = F.least(F.lit(MOST_TIMES), F.floor(F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)))).cast("long")
    cut = sources.withColumn("times", times).withColumns({"rest": F.greatest(F.col("target") - times * F.col("source_size"), F.lit(0.0)), "threshold": F.lit(0).cast("long")})
    cut, inside = materialise(cut), rows
    for level in range(LEVELS):
        shift = DIGIT_BITS * (LEVELS - 1 - level)
        digit = F.shiftright("place", shift).bitwiseAND((1 << DIGIT_BITS) - 1)
        sums = inside.groupBy(*_KEYS, digit.alias("digit")).agg(F.sum("size").alias("s"))
        run = sums.withColumn("upto", F.sum("s").over(W.partitionBy(*_KEYS).orderBy("digit"))).withColumn("before", F.col("upto") - F.col("s"))
        ends = run.join(cut.select(*_KEYS, "rest"), _KEYS).filter(F.col("upto") > F.col("rest")).groupBy(*_KEYS).agg(F.min(F.struct("digit", "before", "s")).alias("at"))
        # A budget that no digit passes takes all of them.
        head = F.shiftleft("threshold", DIGIT_BITS) + F.coalesce("at.digit", F.lit((1 << DIGIT_BITS) - 1))
        left = F.col("rest") - F.coalesce("at.before", F.lit(0))
        if level == LEVELS - 1:
            further = F.col("at").isNotNull() & (F.col("at.s") - left >= left)
            head = head - further.cast("long")
        cut = materialise(cut.join(ends, _KEYS, "left").withColumns({"threshold": head, "rest": left}).drop("at"))
        if level < LEVELS - 1:
            heads = cut.select(*_KEYS, "n_rows", F.col("threshold").alias("head"))
            inside = materialise(split_join(inside, heads, _KEYS, "n_rows").filter(F.shiftright("place", shift) == F.col("head")).drop("head"))
    return cut.drop("rest")


def mix(docs: DataFrame, share: float = 1.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, size, source_size, target, taken) of every document: how many of its words a mix of share of all words takes.

    taken is a whole number of times the document's size, MOST_TIMES at most. A hash of id and text is compared with
    the source's threshold, so nothing is sorted, reruns agree, and a smaller share takes part of what a larger one takes. A
    source's words miss its target by half the size of its boundary document at most, counting all rows equal to it. A null
    text has size 0, null sources are one source and last; repeated rows count each and stand or fall together; an empty
    table gives no rows; other columns are ignored. Sources of many rows go to every task, so that their rows stay."""
    use_checkpoints(docs.sparkSession)
    source = F.col(source_col).cast("string")
    rows = materialise(docs.select(F.col(id_col).alias("id"), F.coalesce(source, F.lit("")).alias("source"), source.isNull().alias("none"), n_words(F.col(text_col)).alias("size"), place(F.col(id_col), F.col(text_col)).alias("place")))
    sources = materialise(rows.groupBy(*_KEYS).agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows")))
    cut = thresholds(rows, targets(sources, share))
    more = (F.col("place") <= F.col("threshold")).cast("long")
    return split_join(rows, cut, _KEYS, "n_rows").select("id", "size", "source_size", "target", (F.col("size") * (F.col("times") + more)).alias("taken"))


#: The same by running sums over sorted places.
SQL = r"""
WITH rows_ AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
        CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS place
    FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM rows_ GROUP BY source),
total AS (SELECT sum(source_size) AS words, sum(weight) AS weights FROM sources),
-- In the order in which sources stop: what is left if all before a source have stopped.
stops AS (
    SELECT *, words - coalesce(sum(3 * source_size) OVER w, 0) AS words_left, weights - coalesce(sum(weight) OVER w, 0) AS weights_left
    FROM sources, total WINDOW w AS (ORDER BY 3 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
    SELECT CAST(arg_max(words_left, weights_left) AS DOUBLE) AS words_left, CAST(max(weights_left) AS DOUBLE) AS weights_left
    FROM stops WHERE CAST(words_left AS DOUBLE) * weight / CAST(weights_left AS DOUBLE) <= 3 * source_size),
goals AS (SELECT source, source_size, least(l.words_left * weight / l.weights_left, CAST(3 * source_size AS DOUBLE)) AS target FROM sources, level l),
budgets AS (SELECT *, CAST(coalesce(least(3, floor(target / nullif(source_size, 0))), 0) AS BIGINT) AS times FROM goals),
run AS (
    SELECT r.*, source_size, target, times, greatest(target - times * source_size, 0) AS rest, sum(size) OVER (PARTITION BY r.source ORDER BY place) AS upto, sum(size) OVER (PARTITION BY r.source, place) AS own
    FROM rows_ r JOIN budgets b ON r.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, CAST(size * (times + CASE WHEN upto <= rest OR upto - rest < rest - (upto - own) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM run
"""
