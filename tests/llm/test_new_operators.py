"""Brute-force checks of vector codes, spelling variants and source mixes."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetloom.llm import queries, source_mix, spelling_variants, vector_codes
from sheetloom.llm.common import read

VECTORS = "vec_id long, embedding array<float>, label int, id int, error string, code string, label_error int, label_key string, v int"
DOCS = "doc_id long, text string, source string, size string, id int, n string, place string, word int, none int, n_rows int"


def plain_codes(rows):
    """(vec_id, code, error) of each row (vec_id, vector), and the final entries, by the definition."""
    ints = [(i, [int(np.floor(4096 * float(x))) for x in v]) for i, v in rows]
    d = len(ints[0][1]) // 8
    cut = lambda v, p: v[p * d : p * d + d]
    books = [[cut(v, p) for _, v in sorted(ints)[:16]] for p in range(8)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda v, p: min((far(cut(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(6):
        own = [[[] for _ in b] for b in books]
        for _, v in ints:
            for p in range(8):
                own[p][best(v, p)[1]].append(cut(v, p))
        books = [[[sum(c) // len(m) for c in zip(*m, strict=True)] if m else e for e, m in zip(b, o, strict=True)] for b, o in zip(books, own, strict=True)]
    out = [(i, "".join(f"{best(v, p)[1]:02x}" for p in range(8)), sum(best(v, p)[0] for p in range(8))) for i, v in ints]
    return out, books


def test_vector_codes_match_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.2, 16).astype(np.float32)]) for i in rng.permutation(90)]
    rows += [(200 + k, rows[0][1]) for k in range(30)] + [(200, rows[0][1])]
    df = spark.createDataFrame([(i, v, i % 3 or None, 1, "e", "c", 2, "k", 3) for i, v in rows], VECTORS).repartition(5)
    want, books = plain_codes(rows)
    got = vector_codes.compress(df).collect()
    assert sorted((r["id"], r["code"], r["error"]) for r in got) == sorted(want)
    sums = Counter()
    for i, _, e in want:
        sums[i % 3 or None] += e
    assert all(r["label_error"] == sums[r["id"] % 3 or None] for r in got)
    text = ",".join(str(x) for b in books for e in b for x in e)
    assert {r["codebooks_sha256"] for r in got} == {hashlib.sha256(text.encode()).hexdigest()}


def test_vector_codes_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    v = [0.5, -0.25, 3e38, -3e38, 0.0, 1e-30, -1e-30, 1.0]
    bad = [None, [nan] + v[1:], [inf] + v[1:], v[:7] + [-inf], v[:7] + [None], v[:5]]
    rows = [(7, v, None), (None, v, 1), (7, v, None), (8, [x / 2 for x in v], 1), *((9, b, 1) for b in bad)]
    df = spark.createDataFrame([(*r, 1, "e", "c", 2, "k", 3) for r in rows], VECTORS)
    got = vector_codes.compress(df)
    assert got.columns == ["id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((r["id"] or 0) for r in got.collect()) == [0, 7, 7, 8]
    assert vector_codes.compress(df.filter("false")).count() == 0
    assert vector_codes.compress(df.select("vec_id", F.array().cast("array<double>").alias("embedding"), "label")).first()["code"] == "00" * 8


def test_cell_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    entries, queries_ = rng.integers(-3000, 3000, (16, 6)), rng.integers(-9000, 9000, (500, 6))
    entries[9] = entries[3]
    queries_[:16] = entries
    index, best = vector_codes.Approximation(entries).nearest(queries_)
    far = ((queries_[:, None] - entries) ** 2).sum(axis=2)
    assert (index == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all() and index[9] == 3


def test_codes_decode_near_their_vectors(spark, sf):
    df = read(spark, sf, "embeddings")
    model = vector_codes.train(df)
    rows = vector_codes.encode(df, model).join(df.select(F.col("vec_id").alias("id"), "embedding"), "id").collect()
    back = vector_codes.decode([r["code"] for r in rows], model)
    off = np.floor(np.array([r["embedding"] for r in rows], float) * 4096) - np.rint(back * 4096)
    assert ((off**2).sum(axis=1).astype(int) == [r["error"] for r in rows]).all()


def apart(u, v):
    """Whether u and v differ by one inserted, deleted or replaced letter."""
    if len(u) > len(v):
        u, v = v, u
    k = next((k for k, (a, b) in enumerate(zip(u, v, strict=False)) if a != b), len(u))
    return u != v and (u[k + 1 :] == v[k + 1 :] and len(u) == len(v) or u[k:] == v[k + 1 :])


def plain_variants(docs):
    count = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and apart(v, w)] for w in words}
    form = {}
    for w, vs in near.items():
        top = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = top if top and words[top] >= 5 * words[w] else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def test_variants_match_brute_force(spark, sf):
    docs = read(spark, sf, "documents")
    got = {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in queries.op12_spelling_variants(spark, sf).collect()}
    assert got == plain_variants([(r.doc_id, r.text) for r in docs.collect()]) and any(r[1] for r in got) or not got


@pytest.mark.parametrize("trie_words", [4096, 7])
def test_near_words_of_crowded_tries(spark, trie_words):
    rng = random.Random(4)
    words = {"".join(rng.choices("abcé", k=rng.choice([6, 6, 7, 8]))) for _ in range(300)} | {"prefix" + "".join(rng.choices("ab", k=4)) for _ in range(20)}
    words |= {w[1:] + "suffix" for w in list(words)[:40]} | {"x" * 3000, "x" * 3001, "x" * 2999 + "y", "aaaaaa", "aaaaaaa", "aaaaaaaa"}
    counts = {w: rng.randrange(5, 40) for w in words}
    got = {r["word"]: (r["n_near"], r["near_n"], r["near"]) for r in spelling_variants.near_words(spark.createDataFrame(list(counts.items()), "word string, n long"), trie_words=trie_words).collect()}
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and apart(v, w)] for w in words}
    want = {w: (len(vs), *min((-counts[v], v) for v in vs)) for w, vs in near.items() if vs}
    assert got == {w: (k, -n, v) for w, (k, n, v) in want.items()} and len(got) > 100


def test_variants_follow_chains_and_odd_rows(spark):
    words = {"abcdefgh": 7, "abcdefghi": 45, "abcdefghij": 300, "abcdefghijk": 1900, "zzzzzz": 4, "short": 90}
    rows = [(k, None if k == 3 else w.upper() if k % 2 else w) for k, w in enumerate(x for x, n in words.items() for _ in range(n))]
    rows += [(None, "Éclairs éclairs × ÷÷÷÷÷÷"), (None, ""), (5, "9 word9word")] * 6
    df = spark.createDataFrame([(i, t, "s", "1", 1, "n", "p", 2, 3, 4) for i, t in rows], DOCS).repartition(3)
    got = {tuple(r) for r in spelling_variants.variants(df).collect()}
    assert got == plain_variants(rows) and max(r[2] for r in got if r[0] == "abcdefghi") == "abcdefghijk"
    assert spelling_variants.variants(df.filter("false")).count() == 0


def plain_targets(sizes, share):
    """{source: target} by resharing what is over, with exact fractions; sources in code-point order, null last."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, stopped, spare = dict.fromkeys(order, Fraction(0)), set(), Fraction(share) * sum(sizes.values())
    while spare and len(stopped) < len(order):
        free = sum(weight[s] for s in order if s not in stopped)
        for s in order:
            if s not in stopped:
                target[s] += spare * weight[s] / free
        spare = Fraction(0)
        for s in order:
            if s not in stopped and target[s] > 3 * sizes[s]:
                spare += target[s] - 3 * sizes[s]
                target[s] = Fraction(3 * sizes[s])
                stopped.add(s)
    return target


def plain_mix(docs, share=1):
    """[(id, size, source_size, target, taken)] by sorting each source's documents."""
    rows = [(i, len(re.findall(r"[^\x20\x09-\x0d]+", t or "")), s, int(hashlib.md5(f"{'' if i is None else i}:{t or ''}".encode()).hexdigest()[:15], 16)) for i, t, s in docs]
    sizes = Counter({s: 0 for _, _, s, _ in rows})
    for _, n, s, _ in rows:
        sizes[s] += n
    out, target = [], plain_targets(sizes, share)
    for s in sizes:
        times = min(3, target[s] // sizes[s]) if sizes[s] else 0
        rest, done, more = target[s] - times * sizes[s], 0, set()
        by = Counter()
        for _, n, o, p in rows:
            if o == s:
                by[p] += n
        for p in sorted(by):
            if done + by[p] <= rest or done + by[p] - rest < rest - done:
                more.add(p)
            done += by[p]
            if done > rest:
                break
        out += [(i, n, sizes[s], float(target[s]), n * (times + (p in more))) for i, n, o, p in rows if o == s]
    return out


def like(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    return len(got) == len(want) and all(a[:3] == b[:3] and a[4] == b[4] and abs(a[3] - b[3]) < 1e-6 for a, b in zip(got, want, strict=True))


def test_mix_matches_brute_force(spark, sf):
    docs = [(r.doc_id, r.text, r.source) for r in read(spark, sf, "documents").collect()]
    assert like(queries.op13_source_mix(spark, sf).collect(), plain_mix(docs))


def test_mix_hot_source_small_sources_and_odd_rows(spark):
    rng = random.Random(3)
    text = lambda n: " \t".join(["w"] * n)
    rows = [(k, text(rng.randrange(1, 60)), "hot") for k in range(900)] + [(k, text(rng.randrange(40)), f"s{k % 7}") for k in range(900, 960)]
    rows += [(None, None, None), (None, "a b", None), (1, None, "empty"), (2, " \n", "empty"), (3, "\x0b one\x0c ", ""), (4, text(20_000), "é"), *[(5, "same row here", "twice")] * 8, *[(None, f"no id {k}", "z") for k in range(20)]]
    df = spark.createDataFrame([(i, t, s, "1", 1, "n", "p", 2, 3, 4) for i, t, s in rows], DOCS).repartition(4)
    got = source_mix.mix(df)
    assert like(got.collect(), plain_mix(rows))
    less = {(r["id"], r["size"]): r["taken"] for r in source_mix.mix(df, 0.5).collect()}
    assert all(less[r["id"], r["size"]] <= r["taken"] <= 3 * r["size"] for r in got.collect())
    assert source_mix.mix(df.filter("false")).count() == 0


def test_mix_ranks_sources_in_ranges(spark, monkeypatch):
    rows = [(k, "a b c", None if k == 50 else f"s{k:03}") for k in range(60)]
    monkeypatch.setattr(source_mix, "RANGE_ROWS", 9)
    assert like(source_mix.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect(), plain_mix(rows))
