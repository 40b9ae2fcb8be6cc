"""Quality rules: counts within a document, and lines that too many documents of a host share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ddl_type, fresh, map_rows, materialise, split_join

#: Fixed values of the base rules.
SPACES = b" \t\n\r\x0b\f"
SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30

#: A line is boilerplate if more documents of its host hold it than either limit.
LINE_DOCS = 12
LINE_SHARE = 0.005
#: A document is depleted if less than this share of its words stays once boilerplate lines are gone.
LEAST_LEFT = 0.5


def _repeated(words: list[bytes]) -> int:
    """Words in some 8-word window that occurs twice or more: windows are ranked by doubling, without collisions."""
    n = len(words) - REPEAT_WINDOW + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    rank = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) == len(words):
        return 0
    width = 1
    while width < REPEAT_WINDOW:
        m = len(rank) - width
        pair = rank[:m] * (int(rank.max()) + 1) + rank[width:]
        _, rank = np.unique(pair, return_inverse=True)
        width *= 2
    twice = np.bincount(rank)[rank] > 1
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + REPEAT_WINDOW, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def measures(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text; a null text has none of any."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    seen, dup = set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += bool(line.strip(SPACES))
        else:
            seen.add(line)
    return len(words), len(text) - sum(raw.count(bytes([c])) for c in SPACES), sum(map(text.count, SYMBOLS)), dup, _repeated(words)


def document_measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) for each row."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def work(batches):
        for b in batches:
            found = np.array([measures(x) for x in b.column(2).to_pylist()], np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(found[:, k]) for k in range(5))], names=["id", "row", *names])

    picked = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    return map_rows(picked, work, f"id {ddl_type(docs, id_col)}, row bigint, " + ", ".join(f"{n} bigint" for n in names))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(line):
    """A line in lower case (A-Z) with each run of white space as one space and none at its ends."""
    return F.trim(F.regexp_replace(F.translate(line, UPPER, LOWER), r"[\x20\x09-\x0D]+", " "))


def document_lines(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """(id, row, host, doc, pos, key, n) for every line with a word; key names host and normalised line."""
    host = F.coalesce(F.col(host_col).cast("string"), F.lit(""))
    picked = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("row"), host.alias("host"), F.xxhash64(text_col).alias("doc"), F.posexplode(F.split(text_col, "\n")).alias("pos", "raw"))
    lines = picked.withColumn("line", normalised(F.col("raw"))).filter("line <> ''")
    return lines.select("id", "row", F.xxhash64("host").alias("host"), "doc", "pos", F.xxhash64("host", "line").alias("key"), F.size(F.split("line", " ")).alias("n"))


def frequent_lines(lines: DataFrame, docs: DataFrame, text_col: str = "text", host_col: str = "source", line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE) -> DataFrame:
    """(key, docs, times) of lines in more distinct documents of their host than line_docs and line_share of them.

    Documents are told apart by their texts, so exact copies count once and do not make their lines
    boilerplate. Counts are combined before the shuffle; a host's documents never meet in one task."""
    counts = lines.groupBy("host", "key").agg(F.count_distinct("doc").alias("docs"), F.count("*").alias("times")).filter(F.col("docs") > line_docs)
    host = F.xxhash64(F.coalesce(F.col(host_col).cast("string"), F.lit("")))
    hosts = docs.select(host.alias("host"), F.xxhash64(text_col).alias("doc")).groupBy("host").agg(F.count_distinct("doc").alias("all"))
    return counts.join(hosts, "host").filter(F.col("docs") > line_share * F.col("all")).select("key", "docs", "times")


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, least_left: float = LEAST_LEFT) -> DataFrame:
    """One row per document: measures, base_failed, n_removed_words, removed_keys and kept.

    base_failed: fewer than 20 words, or over 30 % of them in repeated 8-word windows. Lines that are too
    frequent in the document's host are removed; a document with less than least_left of its words left
    is depleted. kept: neither. Null and empty texts have no words and fail; a null host is the empty host;
    null ids and repeated rows each come back, and a repeated row's lines count once; very long texts are
    read whole; other columns are not read; an empty table gives an empty result. Lines are written once,
    as hashes, for counting and for removal; the commonest never meet in one task."""
    lines = materialise(document_lines(docs, id_col, text_col, host_col))
    bad = materialise(frequent_lines(lines, docs, text_col, host_col, line_docs, line_share))
    found = split_join(lines, bad.select("key", "times"), ["key"], "times")
    removed = found.groupBy("id", "row", "pos").agg(F.max("n").alias("n"), F.max("key").alias("key")).groupBy(F.col("id").alias("rid"), F.col("row").alias("rrow")).agg(F.sum("n").alias("removed"), F.collect_set("key").alias("removed_keys"))
    out = document_measures(docs, id_col, text_col).join(removed, (F.col("row") == F.col("rrow")) & F.col("id").eqNullSafe(F.col("rid")), "left")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    gone = F.coalesce("removed", F.lit(0)).cast("bigint")
    return out.select(
        F.col("id").alias(id_col), "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), gone.alias("n_removed_words"), "removed_keys", (~failed & (F.col("n_words") - gone >= least_left * F.col("n_words"))).alias("kept"),
    )


def clean_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """The kept documents with their boilerplate lines removed, columns unchanged, whatever their names."""
    row, keys, vid, vrow = fresh(docs, "row_key", "removed_keys", "verdict_id", "verdict_row")
    verdicts = judge_quality(docs, id_col, text_col, host_col, **limits).filter("kept").select(F.col(id_col).alias(vid), F.col("row").alias(vrow), F.col("removed_keys").alias(keys)).dropDuplicates([vid, vrow])
    joined = docs.withColumn(row, F.xxhash64(id_col, text_col)).join(verdicts, (F.col(row) == F.col(vrow)) & F.col(id_col).eqNullSafe(F.col(vid)))
    host = F.coalesce(F.col(host_col).cast("string"), F.lit(""))
    stays = F.filter(F.split(text_col, "\n"), lambda x: ~F.array_contains(keys, F.xxhash64(host, normalised(x))))
    return joined.withColumn(text_col, F.when(F.col(keys).isNull(), F.col(text_col)).otherwise(F.array_join(stays, "\n"))).select(*docs.columns)


#: DuckDB SQL of the query over `documents`.
SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host FROM documents),
words AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS w FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs)),
wins AS (SELECT doc_id, i, string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS win, count(*) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS c FROM words),
twice AS (SELECT doc_id, unnest(list(i)) AS i FROM wins WHERE c = 8 GROUP BY doc_id, win HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(8)) AS k) GROUP BY doc_id),
lines AS (SELECT doc_id, host, text, generate_subscripts(l, 1) AS pos, unnest(l) AS line FROM (SELECT *, string_split(text, chr(10)) AS l FROM docs)),
full_lines AS (SELECT *, trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dups AS (SELECT doc_id, sum(c - 1) AS n FROM (SELECT doc_id, line, count(*) AS c FROM full_lines GROUP BY ALL) GROUP BY doc_id),
hosts AS (SELECT host, count(DISTINCT text) AS n FROM docs GROUP BY host),
bad AS (SELECT host, norm FROM full_lines JOIN hosts USING (host) GROUP BY host, norm, hosts.n HAVING count(DISTINCT text) > 12 AND count(DISTINCT text) > 0.005 * hosts.n),
gone AS (SELECT doc_id, sum(len(string_split(norm, ' '))) AS n FROM full_lines JOIN bad USING (host, norm) GROUP BY doc_id),
base AS (
  SELECT doc_id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS gone
  FROM docs LEFT JOIN dups USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN gone USING (doc_id)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_words - gone >= 0.5 * n_words AS kept FROM judged
"""
