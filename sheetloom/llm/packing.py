"""Best-fit-decreasing packing of tokenised documents into fixed windows."""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ddl_type, map_rows

WINDOW = 1024
END_ID = 0
#: Encoded chunks that a worker remembers.
CACHE_CHUNKS = 500_000

_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Closing marks; none begins a contraction or an added token.
_CLOSING = ".,;:!?)*%&$#"
_TWO_SPACES = re.compile(r"\s\s")
_workers: dict[str, "ChunkEncoder"] = {}


class ChunkEncoder:
    """A byte-level BPE tokeniser that remembers the ids of space-led chunks.

    Its pre-tokeniser never joins text over a single space between two other characters, so a text's ids
    are those of its chunks ("word", " word", ...) in order; runs of white space stay inside a chunk."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out, known = [], self.known
        for text in texts:
            chunks = text.split(" ") if _TWO_SPACES.search(text) is None and text[:1] != " " and text[-1:] != " " else _SAFE_CUT.split(text)
            first = self._encoded(chunks[0]) if text else b""
            del chunks[0]
            try:
                out.append(first + b"".join(map(known.__getitem__, chunks)))
            except KeyError:
                if len(known) > CACHE_CHUNKS:
                    known.clear()
                    self.parts.clear()
                for c in set(chunks):
                    if c not in known:
                        known[c] = self._encoded(f" {c}")
                out.append(first + b"".join(map(known.__getitem__, chunks)))
        return out

    def _encoded(self, chunk: str) -> bytes:
        """Ids of a chunk; the pre-tokeniser always cuts between letters, following punctuation and a line's end."""
        led, found, part = chunk[0] == " ", [], self._part
        for line in (chunk[1:] if led else chunk).split("\n"):
            word = line.rstrip(_CLOSING)
            if not word.isalpha():
                return self._any(chunk)
            found.append(part(f" {word}" if led and not found else word))
            if len(word) < len(line):
                found.append(part(line[len(word) :]))
            found.append(part("\n"))
        return b"".join(found[:-1])

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            model = f"\u0120{part[1:]}" if part[0] == " " and part.isascii() else part if part.isalpha() and part.isascii() else self.tokenizer.pre_tokenizer.pre_tokenize_str(part)[0][0]
            found = self.parts[part] = array("I", [t.id for t in self.tokenizer.model.tokenize(model)]).tobytes()
        return found

    def _any(self, chunk: str) -> bytes:
        return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()


def encoder(path: str) -> ChunkEncoder:
    if path not in _workers:
        _workers[path] = ChunkEncoder(path)
    return _workers[path]


def cut_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Tokenise whole texts, append end_id and cut at each full window: (id, start, length, ids, doc_tokens).

    ids is the piece as little-endian unsigned 32-bit integers. Every id lies in one piece. Null and empty
    texts are the end id alone; very long texts are read whole and become many pieces; repeated rows are cut each
    on its own; null ids are kept; other columns are not read; an empty table gives an empty result."""

    def work(batches):
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            ids, start, length, piece, total = [], [], [], [], []
            for key, blob in zip(b.column(0).to_pylist(), encoder(tokenizer_path).ids([x or "" for x in b.column(1).to_pylist()]), strict=True):
                blob += end
                n = len(blob) // 4
                for s in range(0, n, window):
                    ids.append(key)
                    start.append(s)
                    length.append(min(window, n - s))
                    piece.append(blob[4 * s : 4 * (s + window)])
                    total.append(n)
                    if len(ids) >= 16384:
                        yield batch(b, ids, start, length, piece, total)
                        ids, start, length, piece, total = [], [], [], [], []
            yield batch(b, ids, start, length, piece, total)

    def batch(b, ids, start, length, piece, total):
        long = pa.int64()
        return pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), pa.array(start, long), pa.array(length, long), pa.array(piece, pa.binary()), pa.array(total, long)], names=["id", "start", "length", "ids", "doc_tokens"])

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_rows(picked, work, f"id {ddl_type(docs, id_col)}, start bigint, length bigint, ids binary, doc_tokens bigint")


class OpenWindows:
    """Open windows under a segment tree over remaining capacity; finds the tightest one that fits."""

    def __init__(self, window: int) -> None:
        self.size = 1 << window.bit_length()
        self.filled = [0] * (2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, by: int) -> None:
        i = capacity + self.size
        while i:
            self.filled[i] += by
            i >>= 1

    def push(self, capacity: int, window_no: int) -> None:
        if capacity:
            self.at[capacity].append(window_no)
            self._add(capacity, 1)

    def pop(self, need: int) -> tuple[int, int] | None:
        """(capacity, window) of the open window with the least capacity of at least need."""
        i, filled = need + self.size, self.filled
        if not filled[i]:
            while i > 1 and (i & 1 or not filled[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if filled[2 * i] else 2 * i + 1
        capacity = i - self.size
        self._add(capacity, -1)
        return capacity, self.at[capacity].pop()


def pack_pieces(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """pieces (with id, start, length and any more columns) plus sequence_id and offset.

    Pieces are dealt by a hash of id and start to tasks, sorted there from long to short, and each goes
    into the tightest open window that holds it, else into a new one. Full windows meet no open window.
    The dealing spreads one long document over all tasks. A task holds its open windows only. The sort
    names id and start last, so a task that runs again gives the same sequences; pieces that agree in all three
    are rows repeated, and any of them may come first. Null ids are dealt like others; an empty table gives an
    empty result."""

    def work(batches):
        from pyspark import TaskContext

        base, number, open_ = TaskContext.get().partitionId() << 40, 0, OpenWindows(window)
        for b in batches:
            seq, off = [], []
            for need in b.column("length").to_pylist():
                found = open_.pop(need) if need < window else None
                if found is None:
                    found, number = (window, number), number + 1
                capacity, no = found
                seq.append(base + no)
                off.append(window - capacity)
                open_.push(capacity - need, no)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(seq, pa.int64()), pa.array(off, pa.int64())], names=[*b.schema.names, "sequence_id", "offset"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields), "sequence_id bigint", "offset bigint"])
    dealt = pieces.repartition(F.xxhash64("id", "start")).sortWithinPartitions(F.desc("length"), "id", "start")
    return dealt.mapInArrow(work, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Whole packing with the pieces' token ids: (id, start, length, ids, doc_tokens, sequence_id, offset)."""
    return pack_pieces(cut_documents(docs, tokenizer_path, id_col, text_col, window, end_id), window)
