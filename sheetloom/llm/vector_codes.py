"""Vector code compression: product codes whose nearest entries are found by vector approximation (VA-file) bounds."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ddl_type, fresh, materialise, slices, split_join

#: Parts of a vector, entries of a part's codebook, rounds of refinement.
PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Components are floor(SCALE * x), and no further from zero than LARGEST, so that squared distances of up to 1024 components fit a long.
SCALE, LARGEST = 4096, 1 << 25
#: Bits of a coordinate's cell in the approximation of an entry.
CELL_BITS = 4


@dataclass
class Codebooks:
    """books[p][k] is entry k of part p; all are integers. Its size is fixed: ENTRIES whole vectors."""

    books: np.ndarray
    width: int

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.books.reshape(-1).tolist())).encode()).hexdigest()


class Approximation:
    """One part's entries quantised to cells of CELL_BITS bits a coordinate.

    A query looks up, for each coordinate and cell, the least and greatest squared difference to any value of the cell;
    their sums bound an entry's distance from both sides."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.low = entries.min(axis=0)
        self.step = (entries.max(axis=0) - self.low >> CELL_BITS) + 1
        self.cells = (entries - self.low) // self.step

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each query's nearest entry, the lower index on ties.

        Only entries whose lower bound does not exceed the least upper bound are measured."""
        first = self.low + np.arange(1 << CELL_BITS)[:, None] * self.step  # cell, coordinate
        below, above = first - queries[:, None], queries[:, None] - (first + self.step - 1)  # query, cell, coordinate
        least = np.maximum(np.maximum(below, above), 0) ** 2
        most = np.maximum(np.abs(below), np.abs(above)) ** 2
        place = np.arange(queries.shape[1])
        under = sum((least[:, self.cells[:, j], j] for j in place), np.zeros((len(queries), len(self.entries)), np.int64))
        over = sum((most[:, self.cells[:, j], j] for j in place), np.zeros_like(under))
        row, entry = np.nonzero(under <= over.min(axis=1, keepdims=True))  # every query has its best one at least
        far = ((queries[row] - self.entries[entry]) ** 2).sum(axis=1)
        start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        best = np.minimum.reduceat(far, start)
        hit = np.flatnonzero(far == np.repeat(best, np.diff(np.r_[start, len(row)])))
        hit = hit[np.r_[True, row[hit][1:] != row[hit][:-1]]]
        return entry[hit], best


def _kept(vectors: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector is there and has finite components only."""
    return vectors.filter(F.col(vector_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))


def _integers(batch: pa.RecordBatch, at: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of batch with vectors of width components, and these as integers cut into parts, padded to whole parts with zeros."""
    column = batch.column(at)
    rows = np.flatnonzero(np.asarray(column.value_lengths()) == width)
    flat = np.asarray(column.take(pa.array(rows)).flatten()).astype(np.float64).reshape(len(rows), width)
    whole = np.clip(np.floor(flat * SCALE), -LARGEST, LARGEST).astype(np.int64)
    return rows, np.pad(whole, ((0, 0), (0, -width % PARTS))).reshape(len(rows), PARTS, -(-width // PARTS))


def _sums(vectors: DataFrame, model: Codebooks) -> DataFrame:
    """(part, entry, place, n, s): number and componentwise sums of the parts that each entry is nearest to.

    A task sends at most one row for each component of the codebooks, whatever its number of vectors."""

    def work(batches):
        near = [Approximation(b) for b in model.books]
        n = np.zeros(model.books.shape[:2], np.int64)
        s = np.zeros_like(model.books)
        for batch in slices(batches, 0):
            _, parts = _integers(batch, 0, model.width)
            for p, a in enumerate(near):
                if len(parts):
                    entry, _ = a.nearest(parts[:, p])
                    np.add.at(n[p], entry, 1)
                    np.add.at(s[p], entry, parts[:, p])
        p, e, j = (x.reshape(-1) for x in np.indices(s.shape))
        used = n[p, e] > 0
        yield pa.RecordBatch.from_arrays([pa.array(x[used]) for x in (p, e, j, n[p, e], s.reshape(-1))], ["part", "entry", "place", "n", "s"])

    found = vectors.mapInArrow(work, "part long, entry long, place long, n long, s long")
    return found.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def train(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> Codebooks | None:
    """Codebooks of all vectors: the parts of the ENTRIES rows of smallest id, refined ROUNDS times over all rows.

    Each round assigns every part to its nearest entry and replaces an entry by the floored mean of its parts; entries
    without parts stay. The vectors are read again each round and never shuffled; the driver sees ENTRIES vectors and
    then one row for each component of the codebooks. Rows of equal id are ordered by their vectors, null ids come last.
    The first row's vector fixes the number of components; rows with another number are left out. None without rows."""
    rows = _kept(vectors, vector_col).select(F.col(vector_col).alias("v"), F.col(id_col).alias("i"))
    first = rows.orderBy(F.col("i").asc_nulls_last(), "v").limit(1).select(F.size("v")).first()
    if first is None:
        return None
    width = first[0]
    seed = rows.filter(F.size("v") == width).orderBy(F.col("i").asc_nulls_last(), "v").limit(ENTRIES).select("v").collect()
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in seed], pa.list_(pa.float64()))], ["v"])
    model = Codebooks(np.ascontiguousarray(_integers(batch, 0, width)[1].transpose(1, 0, 2)), width)
    for _ in range(ROUNDS):
        books = model.books.copy()
        for r in _sums(rows.select("v"), model).collect():
            books[r["part"], r["entry"], r["place"]] = r["s"] // r["n"]
        model = Codebooks(books, width)
    return model


def encode(vectors: DataFrame, model: Codebooks | None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, code, error) of every vector that has the model's number of finite components.

    code has two hex digits for each part's entry, error the squared distances summed over parts. Repeated rows are
    coded each; an empty table (model None) gives no rows; ids and labels may be null; other columns are ignored."""
    out = f"id {ddl_type(vectors, id_col)}, label {ddl_type(vectors, label_col)}, code string, error long"
    if model is None:
        return vectors.sparkSession.createDataFrame([], out)

    def work(batches):
        near = [Approximation(b) for b in model.books]
        for batch in slices(batches, 2):
            rows, parts = _integers(batch, 2, model.width)
            found = [a.nearest(parts[:, p]) for p, a in enumerate(near)] if len(rows) else []
            codes = np.stack([e for e, _ in found], axis=1).astype(np.uint8) if found else np.zeros((0, PARTS), np.uint8)
            error = sum((d for _, d in found), np.zeros(len(rows), np.int64))
            own = [batch.column(k).take(pa.array(rows)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*own, pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)], ["id", "label", "code", "error"])

    rows = _kept(vectors, vector_col).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    return rows.mapInArrow(work, out)


def decode(codes: list[str], model: Codebooks) -> np.ndarray:
    """The vectors that codes stand for, one a row."""
    entry = np.array([list(bytes.fromhex(c)) for c in codes], int).reshape(-1, PARTS)
    parts = model.books[np.arange(PARTS), entry]
    return parts.reshape(len(codes), -1)[:, : model.width] / SCALE


def with_label_error(codes: DataFrame) -> DataFrame:
    """codes with label_error, the error summed over rows of equal label, null labels together.

    Sums are combined in each task; labels of many rows go to every task and their rows stay where they are."""
    key, none, weight = fresh(codes, "label_key", "label_null", "label_rows")
    rows = materialise(codes.withColumns({key: F.coalesce(F.col("label").cast("string"), F.lit("")), none: F.col("label").isNull()}))
    sums = materialise(rows.groupBy(key, none).agg(F.sum("error").alias("label_error"), F.count("*").alias(weight)))
    return split_join(rows, sums, [key, none], weight).drop(key, none)


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of every vector, coded by codebooks trained on all of them."""
    model = train(vectors, id_col, vector_col)
    coded = with_label_error(encode(vectors, model, id_col, vector_col, label_col))
    return coded.select("id", "code", "error", "label_error", F.lit(model.digest() if model else None).cast("string").alias("codebooks_sha256"))


def _sql() -> str:
    """The same as SQL: one pair of named steps a round, distances to all entries."""
    steps = [
        "kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "coords AS MATERIALIZED (SELECT vec_id, (i - 1) // d AS p, (i - 1) % d AS j, v[i] AS x FROM (SELECT vec_id, v, len(v) // 8 AS d, unnest(range(1, len(v) + 1)) AS i FROM kept))",
        "b0 AS MATERIALIZED (SELECT p, e, j, x AS y FROM coords JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 16) USING (vec_id))",
    ]
    for r in range(ROUNDS + 1):
        steps.append(f"d{r} AS MATERIALIZED (SELECT vec_id, c.p, e, CAST(sum((x - y) * (x - y)) AS BIGINT) AS far FROM coords c JOIN b{r} b ON c.p = b.p AND c.j = b.j GROUP BY ALL)")
        steps.append(f"a{r} AS MATERIALIZED (SELECT * FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY far, e) = 1)")
        if r < ROUNDS:
            mean = f"m{r} AS MATERIALIZED (SELECT p, e, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{r} JOIN coords USING (vec_id, p) GROUP BY p, e, j)"
            steps += [mean, f"b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, b.j, CASE WHEN n IS NULL THEN y ELSE (s - ((s % n) + n) % n) // n END AS y FROM b{r} b LEFT JOIN m{r} m ON b.p = m.p AND b.e = m.e AND b.j = m.j)"]
    last = f"codes AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(far) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id)"
    digest = f"(SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY p, e, j)) FROM b{ROUNDS})"
    return f"WITH {', '.join(steps)}, {last} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, {digest} AS codebooks_sha256 FROM codes JOIN kept USING (vec_id)"


SQL = _sql()
