"""Benchmark decontamination by suffix arrays over shards of the training text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ddl_type, fresh, slices

WINDOW = 13
#: A block of the benchmark that is sent to all tasks holds this many bytes of text at most, but for a single item.
BLOCK_BYTES = 16 << 20
#: Bytes that stay in words: digits, letters in lower case, and all bytes of characters beyond ASCII.
_TABLE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Probe:
    """The suffixes of a block of test items, ready to be searched in a shard's suffix array."""

    def __init__(self, items: list[tuple[str, str | None]]) -> None:
        self.names, texts = [], []
        for name, text in items:
            if w := words_of(text):
                self.names.append(name)
                texts.append(w)
        self.vocab: dict[bytes, int] = {}
        ids = [[self.vocab.setdefault(w, len(self.vocab) + 1) for w in t] for t in texts]
        #: Every suffix that begins a window: its item, its first words up to a window, and their number.
        starts = [(i, s, min(WINDOW, len(t))) for i, t in enumerate(ids) for s in range(len(t) - min(WINDOW, len(t)) + 1)]
        self.item = np.array([x[0] for x in starts], np.int64)
        self.place = np.array([x[1] for x in starts], np.int64)
        self.width = np.array([x[2] for x in starts], np.int64)
        self.rows = np.zeros((len(starts), WINDOW), np.int32)
        for k, (i, s, n) in enumerate(starts):
            self.rows[k, :n] = ids[i][s : s + n]
        self.least = int(self.width.min()) if starts else 0


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """Positions of tokens in the order of their suffixes, told apart by their first 16 tokens (rank doubling)."""
    rank, n, step = tokens.astype(np.int64), len(tokens), 1
    while step <= 8:
        nxt = np.zeros(n, np.int64)
        nxt[: max(0, n - step)] = rank[step:] + 1
        pair = rank * (int(nxt.max(initial=0)) + 1) + nxt
        order = np.argsort(pair, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.r_[0, pair[order][1:] != pair[order][:-1]]) if n else 0
        rank, step = new, 2 * step
    return np.argsort(rank, kind="stable")


def _below(tokens: np.ndarray, at: np.ndarray, rows: np.ndarray, width: np.ndarray, ties: bool) -> np.ndarray:
    """For each probe, whether the suffix at its position sorts before it (or, with ties, begins with it)."""
    padded = np.r_[tokens, np.zeros(WINDOW, tokens.dtype)]
    less, open_ = np.zeros(len(at), bool), np.ones(len(at), bool)
    for k in range(WINDOW):
        here = open_ & (k < width)
        x, y = padded[at + k], rows[:, k]
        less |= here & (x < y)
        open_ &= ~here | (x == y)
    return less | (open_ if ties else False)


def search(tokens: np.ndarray, suffixes: np.ndarray, rows: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Binary search of all probes at once: the range of suffixes that begin with each."""
    out = []
    for ties in (False, True):
        lo, hi = np.zeros(len(rows), np.int64), np.full(len(rows), len(suffixes), np.int64)
        while (todo := lo < hi).any():
            mid = (lo + hi) // 2
            below = _below(tokens, suffixes[np.minimum(mid, len(suffixes) - 1)], rows, width, ties)
            lo, hi = np.where(todo & below, mid + 1, lo), np.where(todo & ~below, mid, hi)
        out.append(lo)
    return out[0], out[1]


def match_shard(texts: list[str | None], probe: Probe) -> tuple[list[int], dict[int, list[tuple[int, int, int, int]]]]:
    """Words of each text, and by text the verbatim matches (start word, end word, item, its word) of benchmark windows.

    Only runs of benchmark vocabulary as long as the shortest window can hold a match, so the shard's
    suffix array is made of these runs, with zeros between them."""
    sizes, tokens, owner, place = [], [], [], []
    look = probe.vocab.get
    for k, text in enumerate(texts):
        words = words_of(text)
        sizes.append(len(words))
        if not probe.least or not words:
            continue
        ids = np.fromiter(map(look, words, (0 for _ in words)), np.int32, len(words))
        edge = np.flatnonzero(np.diff(np.r_[0, (ids > 0).view(np.int8), 0]))
        for s, e in zip(edge[::2], edge[1::2], strict=True):
            if e - s >= probe.least:
                tokens += [ids[s:e], np.zeros(1, np.int32)]
                owner.append(np.full(e - s + 1, k))
                place.append(np.arange(s, e + 1))
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    if tokens:
        all_, owner, place = np.concatenate(tokens), np.concatenate(owner), np.concatenate(place)
        order = suffix_array(all_)
        order = order[all_[order] > 0]
        lo, hi = search(all_, order, probe.rows, probe.width)
        for p in np.flatnonzero(hi > lo):
            for at in order[lo[p] : hi[p]]:
                s = int(place[at])
                found.setdefault(int(owner[at]), []).append((s, s + int(probe.width[p]), int(probe.item[p]), int(probe.place[p])))
    return sizes, found


def _merged(matches: list[tuple[int, int, str, int]]) -> list[tuple[int, int, str, int]]:
    """The longest matches: windows that overlap or touch in the text and lie as far apart in the item are one."""
    out: list[list] = []
    for s, e, item, place in sorted(matches, key=lambda m: (m[2], m[0] - m[3], m[0])):
        if out and out[-1][2] == item and out[-1][0] - out[-1][3] == s - place and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e, item, place])
    return sorted(map(tuple, out))


MATCHES = "array<struct<start:bigint,end:bigint,item:string,item_start:bigint>>"
_ARROW_MATCHES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("item", pa.string()), ("item_start", pa.int64())]))


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int):
    """The benchmark's items in blocks of bounded bytes, one block at a time on the driver."""
    block, size = [], 0
    for row in benchmark.select(F.col(item_col).cast("string"), text_col).toLocalIterator():
        n = len((row[1] or "").encode("utf-8", "surrogatepass"))
        if block and size + n > block_bytes:
            yield block
            block, size = [], 0
        block.append((row[0] or "", row[1]))
        size += n
    yield block


def find_matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES, words_name: str = "n_words", matches_name: str = "matches") -> DataFrame:
    """docs with two more columns: the number of words, and the verbatim benchmark matches by their starts.

    A match is a longest stretch of document words, [start, end), that equals the item's words from item_start
    on and holds windows of 13 words of the item, or the whole item if it is shorter. Each task builds suffix
    arrays of its shard of documents and binary searches every benchmark suffix in them. The benchmark goes
    out in blocks of bounded size; each block is one pass without a shuffle. Null texts have no words; an
    empty benchmark matches nothing; repeated items and rows all count; a null item id is the empty name."""
    at, out = docs.columns.index(text_col), docs
    for k, block in enumerate(_blocks(benchmark, item_col, item_text_col, block_bytes)):
        out = _pass(out, docs.sparkSession.sparkContext.broadcast(block), at, k > 0, words_name, matches_name)
    return out


def _pass(docs: DataFrame, block, at: int, more: bool, words_name: str, matches_name: str) -> DataFrame:
    schema = docs.schema if more else docs.select("*", F.lit(0).cast("bigint").alias(words_name), F.lit(None).cast(MATCHES).alias(matches_name)).schema

    def work(batches):
        probe = Probe(block.value)
        for b in slices(batches, at):
            sizes, found = match_shard(b.column(at).to_pylist(), probe)
            rows = [[(s, e, probe.names[i], p) for s, e, i, p in found.get(k, ())] for k in range(b.num_rows)]
            if more:
                rows = [r + [(m["start"], m["end"], m["item"], m["item_start"]) for m in old or ()] for r, old in zip(rows, b.column(b.num_columns - 1).to_pylist(), strict=True)]
            matches = pa.array([[{"start": s, "end": e, "item": i, "item_start": p} for s, e, i, p in _merged(r)] for r in rows], _ARROW_MATCHES)
            kept = b.columns[:-2] if more else b.columns
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sizes, pa.int64()), matches], names=[f.name for f in schema.fields])

    return docs.mapInArrow(work, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_hit, items, matches, contaminated) for each row of docs.

    n_hit counts document words inside any match; items are the sorted ids of matched items; a document
    is contaminated if hit words are a twentieth of its words or more. Null ids and repeated rows come back
    as they are; null and empty texts have no words; very long texts are read whole; other columns are not
    read; an empty table gives an empty result."""
    found = find_matches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), benchmark, "text", item_col, item_text_col)
    hit = _hit_words("matches")
    return found.select(F.col("id").alias(id_col), "n_words", hit.alias("n_hit"), F.array_sort(F.array_distinct("matches.item")).alias("items"), "matches", _bad(hit, "n_words").alias("contaminated"))


def _hit_words(matches: str):
    """Words inside any of the matches, which are in the order of their starts."""
    step = lambda acc, m: F.struct(
        (acc["n"] + F.greatest(F.lit(0), m["end"] - F.greatest(acc["end"], m["start"]))).cast("bigint").alias("n"), F.greatest(acc["end"], m["end"]).alias("end")
    )
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end"))
    return F.aggregate(matches, zero, step, lambda acc: acc["n"])


def _bad(hit, words: str):
    return (hit > 0) & (20 * hit >= F.col(words))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs without the contaminated ones, columns unchanged, whatever their names."""
    words, matches = fresh(docs, "n_words", "matches")
    found = find_matches(docs, benchmark, text_col, item_col, item_text_col, words_name=words, matches_name=matches)
    return found.filter(~_bad(_hit_words(matches), words)).select(*docs.columns)
