"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, ddl_type, map_rows, materialise, slices

ORDER = 5
BITS = 12
DISCOUNT = 0.75
#: Grams that the model keeps, shared evenly by the languages, and the least share of a language.
MODEL_GRAMS, LEAST_GRAMS = 1 << 20, 20_000
TEMPERATURES = (1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0)
#: A document is rejected if its cross-entropy is over its language's mean by both of these: nats, and deviations at its length.
REJECT_NATS, REJECT_DEVIATIONS = 1.0, 6.0
UNKNOWN = "und"
#: Bytes of text, characters and symbols handled at a time, and counted grams that a task holds: they bound a worker's memory.
SLICE_BYTES, PART, BLOCK, HELD_GRAMS = 1 << 20, 1 << 18, 1 << 17, 1 << 19
#: Grams whose chances a task remembers.
REMEMBERED = 1 << 18


def _symbol_table() -> np.ndarray:
    """A 12-bit symbol for every code point: 0 for all but letters; letters beyond U+07FF share the upper half."""
    cp = np.arange(0x110000)
    table = np.where(cp < 0x800, cp, 0x800 + cp % 2039)
    letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return np.where(letters, table, 0).astype(np.uint16)


_tables: list[np.ndarray] = []


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts one after the other, and the number of symbols of each.

    Texts are lower-cased; a run of characters that are no letters is one space, and a last one ends each
    text. A text without a letter has no symbols. Long texts are taken in parts."""
    if not _tables:
        _tables.append(_symbol_table())
    table, low = _tables[0], [(x or "").lower() + "\n" for x in texts]
    whole, out, kept, last = "".join(low), [np.zeros(0, np.uint16)], [], 0
    for at in range(0, len(whole), PART):
        s = table[np.frombuffer(whole[at : at + PART].encode("utf-32-le", "surrogatepass"), np.uint32)]
        keep = (s > 0) | (np.r_[np.uint16(last), s[:-1]] > 0)
        last = int(s[-1])
        out.append(s[keep])
        kept.append(keep)
    starts = np.cumsum([0, *map(len, low)])[:-1]
    size = np.add.reduceat(np.concatenate(kept), starts, dtype=np.int64) if low else np.zeros(0, np.int64)
    return np.concatenate(out), size


def grams(s: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first symbol, packed 5-gram that ends at each symbol) of blocks of symbols.

    A gram reaches back to its text's start at most; what would lie before is spaces."""
    first = np.cumsum(size) - size
    for at in range(0, len(s), BLOCK):
        lead = min(at, ORDER - 1)
        own = s[at - lead : at + BLOCK].astype(np.int64)
        packed, n = own[lead:].copy(), len(own) - lead
        place = np.arange(at, at + n)
        place -= first[np.searchsorted(first, place, "right") - 1]
        for k in range(1, ORDER):
            back = np.zeros(n, np.int64)
            skip = min(n, max(0, k - lead))
            back[skip:] = own[lead - k + skip : lead - k + n]
            packed |= np.where(place >= k, back, 0) << (BITS * k)
        yield at, packed


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def _gram_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, gram, n) over all rows; each task combines its own counts first, over all languages up to HELD_GRAMS."""

    def work(batches):
        held: dict[str, list] = {}
        new = total = 0
        for batch in batches:
            for b in slices(iter([batch]), 0, SLICE_BYTES):
                own: dict[str, list] = {}
                for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    own.setdefault(lang, []).append(text)
                for lang, texts in own.items():
                    for _, packed in grams(*symbols(texts)):
                        part = [x.to_numpy() for x in pa.array(packed).value_counts().flatten()]
                        held.setdefault(lang, []).append(part)
                        new += len(part[0])
                if new > HELD_GRAMS:
                    held = {lang: [_added(parts)] for lang, parts in held.items()}
                    total, new = sum(len(x[0][0]) for x in held.values()), 0
                    if total > HELD_GRAMS:
                        yield from out(held)
                        held = {}
        yield from out({lang: [_added(parts)] for lang, parts in held.items()})

    def out(held):
        for lang, [(keys, n)] in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(keys), np.int32))), pa.array(keys), pa.array(n)], names=["lang", "gram", "n"])

    picked = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text is not null and lang is not null")
    return map_rows(picked, work, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Per language and order: sorted grams with discounted probabilities, sorted contexts with back-off weights."""

    langs: list[str]
    orders: dict[str, list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]
    symbols: dict[str, int]
    temperature: float = 20.0
    limits: dict[str, tuple[float, float]] | None = None

    def log_probs(self, lang: str, packed: np.ndarray) -> np.ndarray:
        p = np.full(len(packed), 1.0 / self.symbols[lang])
        for k, (keys, probs, contexts, weights) in enumerate(self.orders[lang], 1):
            gram = packed & ((1 << (BITS * k)) - 1)
            p = _look(contexts, weights, gram >> BITS, 1.0) * p + _look(keys, probs, gram, 0.0)
        return np.log(p)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_known"}

    def all_log_probs(self, seen: np.ndarray) -> np.ndarray:
        """log_probs of distinct grams, one column a language; the first REMEMBERED grams met are worked out once."""
        if not hasattr(self, "_known"):
            self._known = np.zeros(0, np.int64), np.zeros((0, len(self.langs)), np.float32)
        keys, values = self._known
        out, at = np.empty((len(seen), len(self.langs)), np.float32), np.searchsorted(keys, seen)
        old = keys[np.minimum(at, len(keys) - 1)] == seen if len(keys) else np.zeros(len(seen), bool)
        out[old] = values[at[old]]
        new = seen[~old]
        worth = np.stack([self.log_probs(lang, new) for lang in self.langs], axis=1).astype(np.float32)
        out[~old] = worth
        room = max(0, REMEMBERED - len(keys))
        if room and len(new):
            keys, values = np.r_[keys, new[:room]], np.r_[values, worth[:room]]
            order = np.argsort(keys)
            self._known = keys[order], values[order]
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Mean nats a symbol under each language, one row per text, and the texts' symbols."""
        s, size = symbols(texts)
        ends, out = np.cumsum(size), np.zeros((len(texts), len(self.langs)))
        for at, packed in grams(s, size):
            coded = pa.array(packed).dictionary_encode()
            seen, codes = coded.dictionary.to_numpy(), coded.indices.to_numpy()
            owner = np.searchsorted(ends, np.arange(at, at + len(packed)), "right")
            worth = self.all_log_probs(seen)
            for j in range(len(self.langs)):
                out[:, j] -= np.bincount(owner, worth[:, j][codes], len(texts))
        return out / np.maximum(size, 1)[:, None], size


def _look(keys: np.ndarray, values: np.ndarray, want: np.ndarray, other: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(want), other)
    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    return np.where(keys[at] == want, values[at], other)


def _levels(counts: DataFrame) -> DataFrame:
    """(lang, k, gram, n, raw) of all orders: Kneser-Ney count n, and how often the gram occurs.

    The highest order counts occurrences; lower orders count the distinct symbols that a gram follows."""
    level, out = counts.select("lang", "gram", "n", F.col("n").alias("raw")), None
    for k in range(ORDER, 0, -1):
        part = level.select("lang", F.lit(k).alias("k"), "gram", "n", "raw")
        out = part if out is None else out.union(part)
        shorter = F.col("gram").bitwiseAND(F.lit((1 << (BITS * (k - 1))) - 1))
        level = level.groupBy("lang", shorter.alias("gram")).agg(F.count("*").alias("n"), F.sum("raw").alias("raw"))
    return out


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", model_grams: int = MODEL_GRAMS, least_grams: int = LEAST_GRAMS) -> Model:
    """Fit models on all rows of docs whose text and language are not null.

    All counts come from every whole text. A finished language keeps the grams that occur most often, of
    all orders together, within its even share of model_grams or least_grams, whichever is more; single
    symbols always stay. A gram occurs no oftener than the shorter grams in it, so with a gram all that it
    backs off to is kept. Back-off weights take the mass of what was pruned, so chances still sum to one.
    A language's share does not depend on the other languages' texts, so rare ones lose nothing. Temperature
    and limits are set on all the rows. Nothing learned gives a model without languages."""
    every = materialise(_levels(materialise(_gram_counts(docs, text_col, lang_col))))
    step = F.floor(F.log2("raw") * 8).cast("int")
    ranks: dict[str, list] = {}
    for lang, at, n in every.filter("k > 1").groupBy("lang", step.alias("at")).count().orderBy("lang", F.desc("at")).collect():
        ranks.setdefault(lang, []).append((at, n))
    langs = sorted(r["lang"] for r in every.filter("k = 1").select("lang").distinct().collect())
    share, bounds = max(least_grams, model_grams // max(1, len(langs))), []
    for lang in langs:
        total, least = 0, 1 << 20
        for at, n in ranks.get(lang, ()):
            total += n
            if total > share:
                break
            least = at
        bounds.append((lang, least))
    model = Model(langs, {}, {})
    if not langs:
        return model
    spark = docs.sparkSession
    bound = F.create_map(*(F.lit(x) for pair in bounds for x in pair))
    stays = (F.col("k") == 1) | (step >= bound[F.col("lang")])
    worth = F.greatest(F.col("n") - F.lit(DISCOUNT), F.lit(0.0))
    context = F.shiftright("gram", BITS).alias("context")
    marked = every.select("lang", "k", "gram", context, stays.alias("stays"), "n", worth.alias("worth"))
    totals = materialise(marked.groupBy("lang", "k", "context").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("stays"), F.col("worth"))).alias("kept")).filter("kept is not null"))
    number = F.create_map(*(F.lit(x) for i, lang in enumerate(langs) for x in (lang, i)))[F.col("lang")].cast("short").alias("lang")
    probs = marked.filter("stays").join(totals, ["lang", "k", "context"]).select(number, F.col("k").cast("short"), "gram", (F.col("worth") / F.col("total")).cast("float").alias("p"))
    weights = totals.select(number, F.col("k").cast("short"), F.col("context").alias("gram"), (1 - F.col("kept") / F.col("total")).cast("float").alias("p"))
    tables = [[c.to_numpy() for c in x.toArrow().combine_chunks().itercolumns()] for x in (probs, weights)]
    for j, lang in enumerate(langs):
        own = [[_sorted(t, j, k) for t in tables] for k in range(1, ORDER + 1)]
        model.orders[lang] = [(*a, *b) for a, b in own]
        model.symbols[lang] = len(own[0][0][0]) + 1
    _calibrate(model, docs, text_col, lang_col, spark)
    return model


def _sorted(table: list[np.ndarray], lang: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    own = (table[0] == lang) & (table[1] == k)
    gram, p = table[2][own], table[3][own]
    order = np.argsort(gram)
    return gram[order], p[order]


def _calibrate(model: Model, docs: DataFrame, text_col: str, lang_col: str, spark) -> None:
    """Set temperature and limits on all rows: losses, symbols, means and squares of each task and language are added up."""
    langs, shared = model.langs, spark.sparkContext.broadcast(model)
    picked = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text is not null and lang is not null")

    def work(batches):
        held = {}
        for batch in batches:
            for b in slices(iter([batch]), 0, SLICE_BYTES):
                ce, size = shared.value.entropies(b.column(0).to_pylist())
                own = np.fromiter(map(langs.index, b.column(1).to_pylist()), np.int64, len(size))
                ce, own, size = ce[size > 0], own[size > 0], size[size > 0]
                loss = np.stack([-np.log(np.maximum(_chances(ce, t)[np.arange(len(own)), own], 1e-9)) for t in TEMPERATURES], axis=1)
                for j in np.unique(own):
                    mine = own == j
                    held[j] = _merged(held.get(j), _moments(ce[mine, j], size[mine], loss[mine]))
        cols = list(zip(*[(langs[j], *m[:4], m[4].tolist()) for j, m in held.items()], strict=True)) or [[]] * 6
        types = (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["lang", "n", "weight", "mean", "square", "loss"])

    parts = map_rows(picked, work, "lang string, n bigint, weight bigint, mean double, square double, loss array<double>")
    weight, mean, total = F.col("weight"), F.col("mean"), F.sum("weight")
    between = F.greatest(F.lit(0.0), F.sum(weight * mean * mean) - F.sum(weight * mean) * F.sum(weight * mean) / total)
    losses = [F.sum(F.col("loss")[k]).alias(f"loss{k}") for k in range(len(TEMPERATURES))]
    seen = parts.groupBy("lang").agg(F.sum("n").alias("n"), (F.sum(weight * mean) / total).alias("mean"), (F.sum("square") + between).alias("square"), *losses).collect()
    model.limits = {r["lang"]: (r["mean"], float(np.sqrt(r["square"] / r["n"]))) for r in seen if r["n"] > 1}
    if seen:
        model.temperature = TEMPERATURES[min(range(len(TEMPERATURES)), key=lambda k: sum(r[f"loss{k}"] for r in seen))]


def _moments(x: np.ndarray, weight: np.ndarray, loss: np.ndarray) -> tuple:
    """Number, weight, weighted mean, weighted squares about it, and sums of losses."""
    mean = float(np.average(x, weights=weight))
    return len(x), int(weight.sum()), mean, float(((x - mean) ** 2 * weight).sum()), loss.sum(axis=0)


def _merged(x: tuple | None, y: tuple) -> tuple:
    if x is None:
        return y
    weight = x[1] + y[1]
    step = y[2] - x[2]
    return x[0] + y[0], weight, x[2] + step * y[1] / weight, x[3] + y[3] + step * step * x[1] * y[1] / weight, x[4] + y[4]


def _chances(ce: np.ndarray, temperature: float) -> np.ndarray:
    e = np.exp(-temperature * (ce - ce.min(axis=1, keepdims=True)))
    return e / e.sum(axis=1, keepdims=True)


def judge(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Language, score, cross-entropy and rejection of each text; a text without a letter is "und" and rejected.

    Of languages with the same cross-entropy the first by name is taken. A model without languages calls every
    text "und" and rejects only those without a letter."""
    if not model.langs:
        none = np.array([not any(map(str.isalpha, x or "")) for x in texts], bool)
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), none
    ce, size = model.entropies(texts)
    best = ce.argmin(axis=1)
    least = ce[np.arange(len(ce)), best]
    score = np.where(size > 0, _chances(ce, model.temperature)[np.arange(len(ce)), best], 0.0)
    mean, dev = (np.array([(model.limits or {}).get(x, (np.inf, 0.0))[i] for x in model.langs])[best] for i in (0, 1))
    odd = (least > mean + REJECT_NATS) & ((least - mean) * np.sqrt(size) > REJECT_DEVIATIONS * dev)
    return [model.langs[j] if n else UNKNOWN for j, n in zip(best, size, strict=True)], score, least, odd | (size == 0)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score, cross_entropy, rejected) for each row, by the lowest cross-entropy a symbol.

    score is the calibrated chance of the language. Null texts and texts without a letter are "und" with
    score 0; very long texts are read whole, in parts; null ids and repeated rows come back as they are;
    other columns are not read; an empty table gives an empty result. Nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        for batch in batches:
            for b in slices(iter([batch]), 1, SLICE_BYTES):
                lang, score, ce, odd = judge(shared.value, b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(ce), pa.array(odd)], names=[id_col, "lang_pred", "score", "cross_entropy", "rejected"])

    picked = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    return map_rows(picked, work, f"`{id_col}` {ddl_type(docs, id_col)}, lang_pred string, score double, cross_entropy double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without the rejected documents; columns unchanged, whatever their names.

    Null texts and texts without a letter are rejected; repeated rows stay or go alike."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def work(batches):
        for b in slices(batches, at, SLICE_BYTES):
            _, _, _, odd = judge(shared.value, b.column(at).to_pylist())
            yield b.filter(pa.array(~odd))

    return docs.mapInArrow(work, docs.schema)


def training_rows(docs: DataFrame, id_col: str = "doc_id", folds: int = 5, held_out: int = 0) -> DataFrame:
    """The rows that may be learned from."""
    return docs.filter(bucket_of(F.col(id_col), folds) != held_out)
