"""Language-model scoring by logistic mixing of hashed-context bit predictors."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ddl_type, map_rows, materialise

#: Bytes of context of each predictor, and the bits of its table of hashed (context, bit node) slots.
ORDERS = (1, 2, 3, 4, 5)
TABLE_BITS = (18, 18, 20, 21, 21)
OFFSETS = tuple(int(x) for x in np.cumsum([0, *(1 << b for b in TABLE_BITS)]))
SLOTS = OFFSETS[-1]
#: Slots whose counts travel in one row.
PAGE = 1 << 12
LONGEST = max(ORDERS)
#: Fixed values of the byte code: 16 bytes of 5 bits, 32 of 7 bits, all others of 10 bits.
SHORT = b" etaoinsrhldcumg"
MIDDLE = b"pbfyvwkxjqz.,-'0123456789\n\xc3\xa9\xa8\xa4\xbc\xb6"
LONGEST_CODE = 10
GATES = (len(ORDERS) + 1) * LONGEST_CODE
PRIOR = 0.05
#: A context counts as seen, for the gate, from this many bits.
SEEN = 2
#: Adaptive refinement: last byte by buckets of the mixed log odds.
BUCKETS = 32
REACH = 12.0
#: Text of one group of a training task grows eightfold from the first to the last of these bytes; text hashed at a time.
FIRST_GROUP, LAST_GROUP, CHUNK = 1 << 19, 1 << 25, 1 << 21
RATE = 0.15
#: Words whose counts every task holds; the counts of all other words are joined.
HOT_WORDS = 1 << 16
#: Entries of scored contexts that a task remembers.
REMEMBERED = 1 << 20
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Distinct contexts handled at a time, which stay in cache.
BLOCK = 1 << 14


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def contexts(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Each scored byte under its five bytes of context, as one integer, and the bytes of each document.

    A document is its words, a space between each two, and a final line end; what lies before it is line ends."""
    lead = b"\n" * LONGEST
    data = np.frombuffer(b"".join([lead + b" ".join(w) + b"\n" for w in docs]), np.uint8)
    size = np.fromiter((sum(map(len, w)) + max(0, len(w) - 1) + 1 for w in docs), np.int64, len(docs))
    keep = np.ones(len(data), bool)
    starts = np.cumsum(size + LONGEST) - size - LONGEST
    for k in range(LONGEST):
        keep[starts + k] = False
    wide = data.astype(np.int64)
    packed = wide.copy()
    for k in range(1, LONGEST + 1):
        packed[k:] |= wide[:-k] << (8 * k)
    return packed[keep], size


def slot_indices(packed: np.ndarray, node: np.ndarray) -> list[np.ndarray]:
    """For each predictor, the slot of (context, bit node); node is 1 and the bits of the byte so far."""
    out = []
    step = node.astype(np.uint64) * _STEP
    for order, bits, at in zip(ORDERS, TABLE_BITS, OFFSETS, strict=False):
        context = (packed >> 8) & ((1 << (8 * order)) - 1)
        if order == 1:
            out.append((context << LONGEST_CODE | node) + at)
        else:
            h = (context.view(np.uint64) + step) * _MIX
            h ^= h >> np.uint64(29)
            out.append(((h * _MIX) >> np.uint64(64 - bits)).view(np.int64) + at)
    return out


def _code() -> tuple[np.ndarray, np.ndarray]:
    """A prefix code over bytes, as bits and lengths: common bytes take fewer binary predictions."""
    bits, size = np.arange(256) | 3 << 8, np.full(256, LONGEST_CODE)
    for lead, prefix, width in ((MIDDLE, 2, 5), (SHORT, 0, 4)):
        for i, c in enumerate(lead):
            bits[c], size[c] = prefix << width | i, width + (2 if prefix else 1)
    return bits, size


CODE, CODE_SIZE = _code()


def _bits(packed: np.ndarray):
    """(place, own, bit, slots) for each bit of the packed bytes' codes; own selects those whose code goes on."""
    byte = packed & 255
    code, size = CODE[byte], CODE_SIZE[byte]
    node, own = np.ones(len(packed), np.int64), np.arange(len(packed))
    for j in range(LONGEST_CODE):
        if j >= 5:
            going = size > j
            if not going.all():
                packed, code, size, node, own = packed[going], code[going], size[going], node[going], own[going]
        if not len(own):
            return
        bit = (code >> (size - 1 - j)) & 1
        yield j, own, bit, slot_indices(packed, node)
        node = node << 1 | bit


def _stretch(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.log((n1 + np.float32(PRIOR)) / (n0 + np.float32(PRIOR)))


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -REACH, REACH)))


def _start_weights() -> np.ndarray:
    """Weights by gate (orders seen, bit place): nearly all on the longest order seen."""
    w = np.zeros((len(ORDERS) + 1, LONGEST_CODE, len(ORDERS)))
    for g in range(len(ORDERS) + 1):
        for k in range(g):
            w[g, :, k] = 0.45 if k == g - 1 else 0.25 if k == g - 2 else 0.08
    return w.reshape(GATES, len(ORDERS))


def _bucket(last: np.ndarray, x: np.ndarray) -> np.ndarray:
    return last * BUCKETS + ((np.clip(x, -REACH, REACH - 1e-3) + REACH) * (BUCKETS / (2 * REACH))).astype(np.int64)


class Trainer:
    """One task's predictors, gated weights and refinement, learnt online over groups of text.

    Each group is predicted with what earlier groups left, then weights and refinement follow the errors,
    then the group's bits enter the predictors' counts. Equal bytes in equal contexts of a group are
    handled once, with their number."""

    def __init__(self) -> None:
        self.n = np.zeros(2 * SLOTS, np.float32)
        self.w, self.moved = _start_weights(), np.zeros(GATES)
        self.apm = np.zeros((2, 256 * BUCKETS))
        self.started = False

    def learn(self, packed: np.ndarray, count: np.ndarray) -> None:
        mixed = np.random.default_rng(len(packed)).permutation(len(packed))
        blocks = [mixed[at : at + BLOCK] for at in range(0, len(packed), BLOCK)]
        for step in (self._predict, self._count) if self.started else (self._count,):
            for own in blocks:
                step(packed[own], count[own].astype(np.float32))
        self.started = True

    def _predict(self, packed, count) -> None:
        last = (packed >> 8) & 255
        for j, own, bit, slots in _bits(packed):
            pairs = [self.n.reshape(-1, 2)[s] for s in slots]
            seen = sum((x.sum(axis=1) >= SEEN).astype(np.int64) for x in pairs)
            self._mix([_stretch(x[:, 0], x[:, 1]) for x in pairs], seen * LONGEST_CODE + j, bit, count[own], last[own])

    def _count(self, packed, count) -> None:
        for _, own, bit, slots in _bits(packed):
            for s in slots:
                np.add.at(self.n, 2 * s + bit, count[own])

    def _mix(self, st, gate, bit, count, last) -> None:
        """One online step: of each gate's weights along the errors, and of the refinement's counts."""
        x = np.zeros(len(gate), np.float32)
        for k, s in enumerate(st):
            x += self.w[gate, k].astype(np.float32) * s
        p = _squash(x)
        error, curve = count * (bit - p), count * p * (1 - p)
        total = np.bincount(gate, count, GATES)
        for k, s in enumerate(st):
            self.w[:, k] += RATE * np.bincount(gate, error * s, GATES) / (np.bincount(gate, curve * s * s, GATES) + 0.02 * total + 50.0)
        self.moved += total
        spot = _bucket(last, x)
        self.apm[1] += np.bincount(spot, bit * count, 256 * BUCKETS)
        self.apm[0] += np.bincount(spot, (1 - bit) * count, 256 * BUCKETS)


@dataclass
class Model:
    """Predictors as fixed-point log odds with how often each was seen, gated weights and refinement."""

    table: np.ndarray
    weights: np.ndarray
    refine: np.ndarray

    def log2_probs(self, packed: np.ndarray) -> np.ndarray:
        """log2 of the probability of each packed byte in its context."""
        return np.concatenate([np.zeros(0), *(self._block(packed[at : at + BLOCK]) for at in range(0, len(packed), BLOCK))])

    def _block(self, packed) -> np.ndarray:
        last, out = (packed >> 8) & 255, np.zeros(len(packed))
        for j, own, bit, slots in _bits(packed):
            raw = [self.table[s] for s in slots]
            gate = sum((r & 1).astype(np.int64) for r in raw) * LONGEST_CODE + j
            x = np.zeros(len(own), np.float32)
            for k, r in enumerate(raw):
                x += self.weights[gate, k] * ((r >> 1) * np.float32(1 / 512))
            p = 0.5 * (_squash(x) + self.refine[_bucket(last[own], x)])
            out[own] += np.log2(np.where(bit == 1, p, 1 - p))
        return out


def _summed(packed, count=None):
    codes, seen = pd.factorize(packed)
    return seen, np.bincount(codes, count, len(seen))


def _groups(docs, size: int):
    """Distinct contexts and counts over groups of about size bytes, then eight times that, and so on."""
    held, n, wait, waiting = [], 0, [], 0
    for words in docs:
        wait.append(words)
        waiting += sum(map(len, words)) + len(words)
        if waiting >= min(CHUNK, size):
            held.append(_summed(contexts(wait)[0]))
            n, wait, waiting = n + waiting, [], 0
            if n >= size:
                yield _joined(held)
                held, n, size = [], 0, min(8 * size, LAST_GROUP)
    if wait:
        held.append(_summed(contexts(wait)[0]))
    if held:
        yield _joined(held)


def _joined(held):
    return held[0] if len(held) == 1 else _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Learn from all rows of docs.

    Each task learns online over its own rows and gives its predictors' counts; counts of a slot are
    summed over all tasks, weights averaged by the bits they followed. The number of slots is fixed, so
    the model that reaches driver and tasks is bounded however large the corpus is."""

    def work(batches):
        trainer = Trainer()
        texts = (words_of(x) for b in batches for x in b.column(0).to_pylist())
        for group in _groups(texts, FIRST_GROUP):
            trainer.learn(*group)
        yield from pages(np.r_[trainer.n, trainer.apm.T.reshape(-1)])
        yield row(-1, np.r_[trainer.moved, (trainer.w * trainer.moved[:, None]).T.reshape(-1)])

    def row(page, values):
        return pa.RecordBatch.from_arrays([pa.array([page], pa.int32()), pa.array([zstandard.compress(values.astype(np.float64 if page < 0 else np.uint32).tobytes(), 1)], pa.binary())], names=["page", "counts"])

    def pages(values):
        for k in range(0, len(values), 2 * PAGE):
            own = values[k : k + 2 * PAGE]
            if own.any():
                yield row(k // (2 * PAGE), own)

    def add(batches):
        page, total = None, None
        for b in batches:
            for k, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = np.frombuffer(zstandard.decompress(blob), np.float64 if k < 0 else np.uint32)
                if k != page:
                    if page is not None:
                        yield done(page, total)
                    page, total = k, np.zeros(len(own))
                total += own
        if page is not None:
            yield done(page, total)

    def done(page, total):
        return pa.RecordBatch.from_arrays([pa.array([page], pa.int32()), pa.array([zstandard.compress(total.astype(np.float64 if page < 0 else np.float32).tobytes(), 1)], pa.binary())], names=["page", "counts"])

    schema = "page int, counts binary"
    sums = map_rows(docs.select(F.col(text_col).alias("text")), work, schema).repartition("page").sortWithinPartitions("page").mapInArrow(add, schema).toArrow()
    flat, moved, mixed = np.zeros(2 * (SLOTS + 256 * BUCKETS), np.float32), np.zeros(GATES), _start_weights().T.reshape(-1)
    for page, blob in zip(sums.column(0).to_pylist(), sums.column(1).to_pylist(), strict=True):
        own = np.frombuffer(zstandard.decompress(blob), np.float64 if page < 0 else np.float32)
        if page < 0:
            moved, mixed = own[:GATES], own[GATES:]
        else:
            flat[2 * PAGE * page : 2 * PAGE * page + len(own)] = own
    n = flat[: 2 * SLOTS].reshape(-1, 2).T
    table = (np.clip(_stretch(n[0], n[1]), -31, 31) * 512).astype(np.int16) << 1 | (n.sum(axis=0) >= SEEN)
    counts = flat[2 * SLOTS :].reshape(-1, 2).T
    middle = _squash((np.arange(BUCKETS) + 0.5) * (2 * REACH / BUCKETS) - REACH)
    prior = np.tile(middle, 256)
    refine = (counts[1] + 20 * prior) / (counts.sum(axis=0) + 20)
    start = _start_weights()
    weights = np.where(moved[:, None] > 0, mixed.reshape(len(ORDERS), GATES).T / np.maximum(moved, 1e-9)[:, None], start)
    return Model(table.astype(np.int16), weights.astype(np.float32), np.clip(refine, 1e-6, 1 - 1e-6))


class Scorer:
    """Scores documents with a finished model; remembers contexts met at the first, second, fourth, eighth call and so on."""

    def __init__(self, model: Model) -> None:
        self.model, self.known, self.values, self.turn = model, None, None, 0

    def __call__(self, docs: list[list[bytes]]) -> np.ndarray:
        """log10 of the probability of each document."""
        packed, size = contexts(docs)
        codes, names = pd.factorize(packed)
        value = np.empty(len(names))
        at = self.known.get_indexer(names) if self.known is not None else np.full(len(names), -1)
        old = at >= 0
        value[old] = self.values[at[old]] if old.any() else 0.0
        value[~old] = self.model.log2_probs(names[~old])
        self.turn += 1
        room = REMEMBERED - (0 if self.known is None else len(self.known))
        if room > 0 and self.turn & (self.turn - 1) == 0:
            more, worth = names[~old][:room], value[~old][:room]
            self.known, self.values = (pd.Index(more), worth) if self.known is None else (self.known.append(pd.Index(more)), np.r_[self.values, worth])
        return np.add.reduceat(value[codes], np.cumsum(size) - size) * np.log10(2.0)


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, c): the 64-bit hash of each word of docs and its count; END stands for the end of a text."""

    def work(batches):
        held: Counter = Counter()
        for b in batches:
            for x in b.column(0).to_pylist():
                held.update(words_of(x))
            if len(held) > 300_000:
                yield out(held)
                held = Counter()
        yield out(held)

    def out(held):
        return pa.RecordBatch.from_arrays([pa.array([_name(w) for w in held], pa.int64()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])

    return map_rows(docs.select(F.col(text_col).alias("text")), work, "word bigint, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def _name(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def score(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_words: int = HOT_WORDS) -> DataFrame:
    """One row per document: (id_col, n_tokens, n_known, train_tokens, base_score, score, bytes, bits_per_byte).

    score is the mixing model's log10 probability of the whole text as words and an end; base_score that
    of add-one word counts. Both learn from all of training. A null text is an end alone; null ids and
    repeated rows each come back; very long texts are scored whole; other columns are not read; empty tables
    give empty results, and without training every bit has even odds. Tasks learn the mixing weights over their own
    rows, so scores depend a little on how the training table is dealt. The counts of the hot_words commonest words go to every task; those of
    all other words meet their documents in a join, so no word gathers a large group."""
    spark = docs.sparkSession
    counts = materialise(word_counts(training, text_col))
    ends = training.count()
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_all, v_all = total["n"] + ends, total["v"] + (ends > 0)
    under = n_all + v_all + 1
    hot = counts.orderBy(F.desc("c"), "word").limit(hot_words).toArrow()
    shared = spark.sparkContext.broadcast((train(training, text_col), dict(zip(hot.column(0).to_pylist(), hot.column(1).to_pylist(), strict=True))))

    def work(batches):
        model, known = shared.value
        scorer, names = Scorer(model), {}
        logs = {w: (np.log10((c + 1) / under), c > 0) for w, c in known.items()}
        end_log = np.log10((ends + 1) / under)
        for b in batches:
            rid, ids, wait, waiting = [], [], [], 0
            for r, i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = words_of(x)
                rid.append(r)
                ids.append(i)
                wait.append(words)
                waiting += sum(map(len, words)) + len(words)
                if waiting >= CHUNK:
                    yield out(b, scorer, names, logs, end_log, rid, ids, wait)
                    rid, ids, wait, waiting = [], [], [], 0
            if wait:
                yield out(b, scorer, names, logs, end_log, rid, ids, wait)

    def out(b, scorer, names, logs, end_log, rid, ids, docs_):
        known, sums, rare = [], [], []
        for words in docs_:
            n, s, own = int(ends > 0), end_log, []
            for w, tf in Counter(words).items():
                name = names.get(w)
                if name is None:
                    name = _name(w)
                    if name in logs:
                        names[w] = name
                hit = logs.get(name)
                if hit is None:
                    own += [name] * tf
                else:
                    s += tf * hit[0]
                    n += tf
            known.append(n)
            sums.append(s)
            rare.append(own)
        long = pa.int64()
        size = [sum(map(len, w)) + max(0, len(w) - 1) + 1 for w in docs_]
        return pa.RecordBatch.from_arrays(
            [pa.array(rid, long), pa.array(ids, b.column(1).type), pa.array([len(w) + 1 for w in docs_], long), pa.array(known, long), pa.array(sums, pa.float64()), pa.array(scorer(docs_)), pa.array(size, long), pa.array(rare, pa.list_(long))],
            names=["rid", "id", "n_tokens", "known", "hot_sum", "score", "bytes", "rare"],
        )

    picked = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scored = materialise(map_rows(picked, work, f"rid bigint, id {ddl_type(docs, id_col)}, n_tokens bigint, known bigint, hot_sum double, score double, bytes bigint, rare array<bigint>"))
    rare = scored.select("rid", F.explode("rare").alias("word")).join(counts, "word", "left")
    c = F.coalesce("c", F.lit(0))
    sums = rare.groupBy("rid").agg(F.sum(F.log10((c + 1) / F.lit(float(under)))).alias("rare_sum"), F.sum((c > 0).cast("bigint")).alias("rare_known"))
    out_ = scored.drop("rare").join(sums, "rid", "left")
    return out_.select(
        F.col("id").alias(id_col), "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(n_all).cast("bigint").alias("train_tokens"),
        (F.col("hot_sum") + F.coalesce("rare_sum", F.lit(0.0))).alias("base_score"), "score", "bytes", (-F.col("score") / (F.lit(float(np.log10(2.0))) * F.col("bytes"))).alias("bits_per_byte"),
    )
