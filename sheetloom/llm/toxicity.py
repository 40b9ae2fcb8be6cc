"""Toxicity by compression distance: zstandard dictionaries trained on toxic and on ordinary text.

Texts are compressed as words, not letters: each word is written as the eight bytes of its hash, so a
dictionary shortens a window by the whole words it knows and never by parts of them, in any language."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ddl_type, map_rows

#: The sample that the classifier is fitted on: labelled rows of each class at most, and the longest text it takes.
TOXIC_ROWS, ORDINARY_ROWS, SAMPLE_CHARS = 2500, 5000, 32_768
#: The curve is calibrated on the windows of each part of the sample under dictionaries of the other parts.
FOLDS = 3
WINDOW_WORDS = 16
CODE = 8
LEVEL = 12
#: Bytes of the ordinary dictionary, and windows of each ordinary text that it is trained on.
ORDINARY_BYTES, TEXT_WINDOWS = 32_768, 12
#: The toxic dictionary is trained on the words of toxic texts whose log odds over ordinary ones reach this and that this many texts have.
LOG_ODDS, LEAST_TEXTS = 3.0, 3
#: Codes that the trainer sees at least, and bytes of the smallest dictionary it makes.
TRAINED_CODES, LEAST_BYTES = 3000, 512
PREDICT_AT = 0.3
GAINS = (2, 3, 4, 5, 6, 8)
#: Bytes that stay in words: digits, letters in lower case, and all bytes of characters beyond ASCII.
_TABLE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def coded(words: list[bytes]) -> bytes:
    return b"".join(map(xxhash.xxh64_digest, words))


def windows(words: list[bytes]) -> list[bytes]:
    """The codes of each WINDOW_WORDS words."""
    whole, step = coded(words), CODE * WINDOW_WORDS
    return [whole[k : k + step] for k in range(0, len(whole), step)]


def _trained(size: int, samples: list[bytes]) -> bytes:
    """A trained dictionary; where there is too little text to train on, the text itself."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def telling_words(toxic: Counter, n_toxic: int, ordinary: Counter, n_ordinary: int) -> set[bytes]:
    """Words of toxic texts, given how many texts of each kind have each word, that ordinary texts hardly have."""
    odds = lambda w, n: np.log((n + 0.5) / (n_toxic + 1)) - np.log((ordinary[w] + 0.5) / (n_ordinary + 1))
    return {w for w, n in toxic.items() if n >= LEAST_TEXTS and odds(w, n) > LOG_ODDS}


def dictionaries(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> tuple[bytes, bytes]:
    """The toxic and the ordinary dictionary of two lists of texts' words."""
    count = lambda texts: Counter(w for t in texts for w in set(t))
    telling = telling_words(count(toxic), len(toxic), count(ordinary), len(ordinary))
    found = [xxhash.xxh64_digest(w) for t in toxic for w in t if w in telling]
    spread = lambda own: [own[i * len(own) // TEXT_WINDOWS] for i in range(TEXT_WINDOWS)] if len(own) > TEXT_WINDOWS else own
    own = _trained(max(LEAST_BYTES, 2 * CODE * len(telling)), found * (1 + TRAINED_CODES // len(found))) if found else b""
    return own, _trained(ORDINARY_BYTES, [w for t in ordinary for w in spread(windows(t))])


@dataclass
class Model:
    """Contents of the two dictionaries, and a logistic curve over a text's window gains."""

    toxic: bytes
    ordinary: bytes
    weights: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        return _compressors(self.toxic, self.ordinary)


def _compressors(toxic: bytes, ordinary: bytes) -> list[zstandard.ZstdCompressor]:
    """An ordinary compressor, and one that knows the toxic dictionary as well; so lengths differ by toxic words alone."""
    out = []
    for content in (ordinary or bytes(CODE), toxic + (ordinary or bytes(CODE))):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def window_gains(words: list[bytes], compressors) -> np.ndarray:
    """Bytes that the toxic dictionary saves over the ordinary one in each window of a whole text; no words are one empty window."""
    plain, tox = (c.compress for c in compressors)
    return np.array([len(plain(w)) - len(tox(w)) for w in windows(words) or [b""]], np.int64)


def features(gains: np.ndarray) -> np.ndarray:
    n = len(gains)
    return np.array([1.0, min(gains.max(), 16), np.log(n), gains.clip(0).mean(), gains.mean(), *(np.log1p((gains >= g).sum()) for g in GAINS), *((gains >= g).mean() for g in GAINS)])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = weight * p * (1 - p) + 1e-6
        step = np.linalg.solve((x * h[:, None]).T @ x + np.diag(penalty), x.T @ (weight * (y - p)) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(toxic: list[str], ordinary: list[str], toxic_share: float) -> Model:
    """Fit on sampled texts; toxic_share is the share of toxic rows among all labelled ones."""
    bad, good = [words_of(x) for x in toxic], [words_of(x) for x in ordinary]
    x, y = [], []
    for f in range(FOLDS):
        rest = lambda texts: [t for i, t in enumerate(texts) if i % FOLDS != f]  # noqa: B023, E731
        pair = _compressors(*dictionaries(rest(bad), rest(good)))
        for texts, label in ((bad[f::FOLDS], 1.0), (good[f::FOLDS], 0.0)):
            x += [features(window_gains(t, pair)) for t in texts]
            y += [label] * len(texts)
    x, y = np.array(x).reshape(-1, 5 + 2 * len(GAINS)), np.array(y)
    model = Model(*dictionaries(bad, good), np.r_[-4.0, np.zeros(x.shape[1] - 1)], np.zeros(x.shape[1]), np.ones(x.shape[1]))
    if len(set(y)) == 2:
        model.centre, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        model.centre[0], model.scale[0] = 0.0, 1.0
        weight = np.where(y > 0, toxic_share / len(bad), (1 - toxic_share) / len(good)) * len(y)
        model.weights = _logistic((x - model.centre) / model.scale, y, weight)
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS) -> Model:
    """Fit dictionaries and thresholds on a bounded sample of labelled rows.

    The sample is toxic_rows and ordinary_rows at most of whole texts of up to SAMPLE_CHARS characters, those
    whose hash of id and text is least, so the rows that reach the driver are bounded in number and size and
    a second run picks the same. Labels that disagree about an id count as toxic; null ids, texts and labels
    are left out; rows that repeat an id all count. Without both classes every score is low."""
    own = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    sizes = {r["label"]: r["n"] for r in own.groupBy("label").agg(F.count("*").alias("n")).collect()}
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS))

    def sample(label: int, most: int) -> list[str]:
        # twice as many ids as rows are wanted, by their hash, go to every task; so no text is shuffled
        few = own.filter(F.col("label") == label).select("id").orderBy(F.xxhash64("id"), "id").limit(2 * most)
        rows = picked.join(F.broadcast(few), "id").select(F.xxhash64("id", "text").alias("place"), "text").orderBy("place", "text").limit(most)
        return rows.toArrow().column("text").to_pylist()

    toxic, ordinary = sample(1, toxic_rows), sample(0, ordinary_rows)
    return fit(toxic, ordinary, sizes.get(1, 0) / max(1, sum(sizes.values())))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score, predicted, windows, best_gain) for each row, from its whole text, however long.

    score is the calibrated chance of being toxic, predicted 1 from PREDICT_AT. Null and empty texts are
    one empty window; null ids and repeated rows come back as they are, so ties stay ties; other columns are
    not read; an empty table gives an empty result. Nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        m = shared.value
        pair = m.compressors()
        for b in batches:
            gains = [window_gains(words_of(x), pair) for x in b.column(1).to_pylist()]
            x = (np.array([features(g) for g in gains]).reshape(-1, len(m.weights)) - m.centre) / m.scale
            p = 1 / (1 + np.exp(-np.clip(x @ m.weights, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= PREDICT_AT).astype(np.int32)), pa.array([len(g) for g in gains], pa.int64()), pa.array([int(g.max()) for g in gains], pa.int64())], names=[id_col, "score", "predicted", "windows", "best_gain"])

    picked = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    return map_rows(picked, work, f"`{id_col}` {ddl_type(docs, id_col)}, score double, predicted int, windows bigint, best_gain bigint")
