"""Brute-force checks of language ID, SimHash, decontamination, secret scans, packing and the pipeline."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from sheetloom.llm import decontaminate, language_id, packing, queries, secret_scan, simhash_dedup
from sheetloom.llm.common import read

ODD = "doc_id long, text string, lang string, source string, n_chars long, fp string, id string, row_key long, best_id long, n_words string, matches string, __row long, __words int"


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r.doc_id: r for r in read(spark, sf, "documents").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and long texts, repeated rows and clashing column names."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    rows = [(1, None, None, None, None, "a", "b", 1), (2, "", "en", "s", 0, None, None, None), (None, "one two", "en", "s", 1, "a", "b", 1), (3, long, "en", "s", 9, "a", "b", 1), (4, "one  Two three", "fr", None, 9, "a", "b", 1), (4, "one  Two three", "fr", None, 9, "a", "b", 1), (5, "password = abcdef123", "en", "s", 1, "x", "y", 2), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame([(*r, 7, "w", None, k, 5) for k, r in enumerate(rows)], ODD)


def simhash(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(fps):
    ids, comp = list(fps), {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if comp[a] < comp[b] and bin(fps[a] ^ fps[b]).count("1") <= 2:
                    comp[b], changed = comp[a], True
    return comp


def test_simhash_matches_brute_force(spark, sf, docs):
    fps = {i: simhash(r.text) for i, r in docs.items()}
    comp = reach(fps)
    got = queries.op2_simhash_dedup(spark, sf).collect()
    assert len(got) == len(docs)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fps[i]:016x}", comp[i]) for i in docs}


def test_simhash_links_crowded_keys(spark):
    rng = np.random.default_rng(3)
    base = int(rng.integers(1 << 62))
    fps = {base ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(150)} | {int(x) for x in rng.integers(1 << 62, size=50)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    fps = sorted({signed(f) for f in fps})
    links = simhash_dedup.near_links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()
    near = lambda a, b: bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 2
    assert all(near(r.a, r.b) for r in links)
    comp = {f: f for f in fps}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for r in links:
        a, b = root(r.a), root(r.b)
        comp[max(a, b)] = min(a, b)
    want = reach({f: f & ((1 << 64) - 1) for f in fps})
    assert {f: root(f) for f in fps} == want


def test_simhash_odd_rows(spark, odd):
    got = simhash_dedup.near_duplicate_groups(odd).collect()
    assert len(got) == 8
    assert {r.component_id for r in got if r.fingerprint == "0" * 16} == {1}
    kept = simhash_dedup.keep_first(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 3, 4, 5]
    assert simhash_dedup.near_duplicate_groups(odd.limit(0)).count() == 0
    assert simhash_dedup.keep_first(odd.limit(0)).count() == 0


def test_packing_round_trip(spark, sf, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = queries.op3_packing(spark, sf).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(docs)
    for i, pieces in by_doc.items():
        ids = np.array([*tok.encode(docs[i].text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    total = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        total += at
    assert total >= 0.98 * 1024 * (len(by_seq) - 1)


def test_packing_finds_tightest():
    rng, tree, plain = np.random.default_rng(5), packing.OpenWindows(64), []
    for k in range(500):
        if rng.random() < 0.5:
            c = int(rng.integers(1, 65))
            tree.push(c, k)
            plain.append(c)
        else:
            need = int(rng.integers(1, 64))
            want = min((c for c in plain if c >= need), default=None)
            got = tree.pop(need)
            assert (got and got[0]) == want
            if want:
                plain.remove(want)


def test_chunked_tokens_equal_whole():
    e = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", " ", "a", " lead", "trail ", "two  spaces", "line.\nNext one\n\nafter", "x<|endoftext|> y", "a <|endoftext|>\n b", "it's we'll 'tis\tTab", "été ça, où?!", "a b 　c", "no.5 v2, $9.99 (x)", "😀 a😀 b", "..., ! ?a\n.b"]
    want = [np.array(e.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert e.ids(texts) == want


def test_packing_odd_rows(spark, odd):
    got = queries.packed(odd, queries.tokenizer_path()).collect()
    assert sum(r.start == 0 for r in got) == 8
    assert sorted(r.doc_tokens for r in got if r.doc_id in (1, 2)) == [1, 1]
    assert queries.packed(odd.limit(0), queries.tokenizer_path()).count() == 0


def brute_hits(docs, items):
    table = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = defaultdict(set)
    for name, text in items:
        w = table(text)
        n = min(13, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[s : s + n])].add(name)
    sizes, out = {len(w) for w in windows}, {}
    for i, text in docs:
        w, hit, names = table(text), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s : s + n])) in windows:
                    hit |= set(range(s, s + n))
                    names |= windows[k]
        out[i] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_decontamination_matches_brute_force(spark, sf, docs):
    items = [(str(r.item_id), r.text) for r in read(spark, sf, "benchmark").collect()]
    got = {r.doc_id: tuple(r[1:]) for r in queries.op7_decontaminate(spark, sf).collect()}
    want = brute_hits([(i, r.text) for i, r in docs.items()], items)
    assert got == want and sum(x[4] for x in want.values()) > 0


def test_decontamination_small_blocks_and_short_items(spark):
    a = " ".join(f"q{i}" for i in range(30))
    docs = [(1, a), (2, "x A b! c y"), (3, None), (4, ""), (5, " ".join(["a b c"] * 4 + ["z"] * 300)), (6, "q0 q1 q2 " + " ".join(f"q{i}" for i in range(5, 18))), (None, "a b c"), (5, "a b c")]
    items = [(1, "A, b c"), (10, a), (2, " ".join(f"q{i}" for i in range(5, 20))), (3, None), (4, "zz")]
    d = spark.createDataFrame([(i, t) for i, t in docs], "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 20, 1):
        got = [r for r in decontaminate.find_matches(d, b, block_bytes=size).collect()]
        flat = sorted((r.text or "", sorted({m.item for m in r.matches})) for r in got)
        words = {r.text: decontaminate.words_of(r.text) for r in got}
        named = {str(i): decontaminate.words_of(t) for i, t in items}
        for r in got:
            for m in r.matches:
                own, other = words[r.text], named[m.item]
                n = m.end - m.start
                assert own[m.start : m.end] == other[m.item_start : m.item_start + n]
                assert m.start == 0 or m.item_start == 0 or own[m.start - 1] != other[m.item_start - 1]
                assert m.end == len(own) or m.item_start + n == len(other) or own[m.end] != other[m.item_start + n]
        want = brute_hits(list(enumerate(t for _, t in docs)), [(str(i), t) for i, t in items])
        assert [len(x[1]) for x in flat] == [want[k][2] for k, _ in sorted(enumerate(docs), key=lambda x: (x[1][1] or "", want[x[0]][2]))]
    judged = decontaminate.contamination(d, b).collect()
    assert sorted((r.n_words, r.n_hit, r.contaminated) for r in judged) == sorted((w[0], w[1], w[4]) for w in want.values())
    assert decontaminate.contamination(d.limit(0), b).count() == 0
    assert decontaminate.contamination(d, b.limit(0)).filter("contaminated").count() == 0
    named = d.select("*", F.lit("k").alias("matches"), F.lit(3).alias("N_words"), F.lit(1).alias("__hit"))
    kept = decontaminate.drop_contaminated(named, b)
    assert kept.columns == named.columns and all((r.matches, r.N_words) == ("k", 3) for r in kept.collect())


def brute_base(text):
    text, out = text or "", []
    for m in re.finditer(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for k, (kind, p, n) in enumerate((("access", r"AKIA[A-Z0-9]+", 20), ("hex", r"[0-9a-f]+", 24)), 1):
        out += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(p, text) if len(m[0]) >= n]
    return [x[2] for x in sorted(out)]


def test_secret_base_matches_brute_force(spark, sf, docs):
    got = {r.doc_id: r for r in queries.op9_secret_scan(spark, sf).collect()}
    assert set(got) == set(docs)
    for i, r in docs.items():
        base = brute_base(r.text)
        assert got[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(x.startswith(k) for x in base) for k in ("assign", "access", "hex"))
        assert set(base) <= set(got[i].spans.split(",")) | {""}


def test_entropy_windows():
    secret = "Zx8Kq2Lm0Vb7Tn4Rw9Yc3Df6"
    assert secret_scan.entropy_spans(secret) == [(0, len(secret))]
    assert secret_scan.find_spans(f"key {secret} end") == [(4, 4 + len(secret), "entropy")]
    assert secret_scan.find_spans("a thoroughlyordinarylowercaseword and/some/path-of-words-here") == []
    assert secret_scan.find_spans("123e4567-e89b-12d3-a456-426614174000") == []
    assert [k for _, _, k in secret_scan.find_spans("ſecret = abcdef token=abcdef api_KEY: 'zzzzzz")] == ["assign", "assign"]


def test_entropy_allows_no_more_than_it_says():
    key = "kJ8f2Qz9LmN4pR7tVx3WbY6c"
    assert secret_scan.redact("qWzRtYpLkJhGfDsAzXcVbNm") == "[SECRET]"
    assert key not in secret_scan.redact(f"path/example/{key}") and secret_scan.find_spans("see AKXAIOSFODNN7EXAMPLE") == []
    assert secret_scan.find_spans("n 73910482657301948256 m") == [(2, 22, "entropy")]
    long = f"{key}0123456789abcdef01234567{key[::-1]}"
    left = secret_scan.redact(f"a {long} b")
    assert key[2:] not in left and key[::-1][:-2] not in left and left.replace("[SECRET]", "") == "a  b"


def test_entropy_spans_match_brute_force():
    """Windows counted anew at every place, over random runs of every class."""
    rng = np.random.default_rng(8)
    entropy = lambda w: -sum(w.count(c) / len(w) * np.log2(w.count(c) / len(w)) for c in set(w))
    alphabets = ("0123456789", "0123456789abcdefABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", "aab01")
    found = 0
    for _ in range(300):
        run = "".join("".join(rng.choice(list(alphabets[rng.integers(4)]), rng.integers(5, 40))) for _ in range(rng.integers(1, 4)))
        cover = set()
        for s in range(len(run) - 19):
            w = run[s : s + 20]
            if any(set(w) <= members and entropy(w) >= limit - 1e-9 for _, members, limit in secret_scan.CLASSES) and not secret_scan.SAMPLE.search(w):
                cover |= set(range(s, s + 20))
        got = secret_scan.entropy_spans(run)
        assert {k for s, e in got for k in range(s, e)} == cover
        found += bool(got)
    assert found > 100


def test_secret_odd_rows(spark, odd):
    assert secret_scan.secret_spans(odd).count() == 8
    out = secret_scan.redact_secrets(odd)
    assert out.columns == odd.columns and out.filter("doc_id = 5").first().text == "[SECRET]"
    assert secret_scan.redact_secrets(odd.limit(0)).count() == 0


def test_language_held_out(spark):
    big = "/root/testdata/sf0.01"
    got = queries.op10_language_id(spark, big)
    truth = read(spark, big, "documents").select("doc_id", "lang")
    rows = got.filter("held_out").join(truth, "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(spark, odd):
    model = language_id.train(odd)
    got = language_id.identify(odd, model).collect()
    assert len(got) == 8
    assert {r.lang_pred for r in got if r.doc_id in (1, 2)} == {"und"}
    assert language_id.train(odd.limit(0)).langs == []
    assert language_id.keep_identified(odd, model).columns == odd.columns
    none = language_id.train(odd.limit(0))
    assert {r.lang_pred for r in language_id.identify(odd, none).collect()} == {"und"}
    assert sorted(str(r.doc_id) for r in language_id.keep_identified(odd, none).collect()) == ["3", "4", "4", "5", "None"]
    assert language_id.keep_identified(odd.limit(0), model).count() == 0


def plain_symbols(text):
    """The table's symbols of a text: letters by code point, each run of other characters one space, none ahead."""
    out = []
    for c in (text or "").lower() + "\n":
        if c.isalpha():
            out.append(ord(c) if ord(c) < 0x800 else 0x800 + ord(c) % 2039)
        elif out and out[-1]:
            out.append(0)
    return out


def brute_kneser_ney(texts):
    """The chance of a symbol after four others, straight from the definition, as a function."""
    runs = [[0, 0, 0, 0, *plain_symbols(t)] for t in texts]
    whole = [tuple(s[i - 4 : i + 1]) for s in runs for i in range(4, len(s))]
    tables, kinds = {}, set(whole)
    tables[5] = {g: whole.count(g) for g in kinds}
    for k in range(4, 0, -1):
        tables[k] = {g: len({x for x in tables[k + 1] if x[1:] == g}) for g in {x[1:] for x in tables[k + 1]}}

    def chance(g, k=5):
        if k == 0:
            return 1 / (len(tables[1]) + 1)
        g = g[-k:]
        own = {x: n for x, n in tables[k].items() if x[:-1] == g[:-1]}
        if not own:
            return chance(g, k - 1)
        total = sum(own.values())
        return max(own.get(g, 0) - 0.75, 0) / total + sum(min(n, 0.75) for n in own.values()) / total * chance(g, k - 1)

    return chance


def test_kneser_ney_equals_its_definition(spark, monkeypatch):
    texts = ["Abac, abba! caba", "cab  bac", "", "ééa 漢字 ab"]
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(9, "other words", "y")], "doc_id long, text string, lang string")
    model, chance = language_id.train(d), brute_kneser_ney(texts)
    asked = [*texts, "zab abacus", "...", None, "b"]
    for block in (language_id.BLOCK, 3):
        monkeypatch.setattr(language_id, "BLOCK", block)
        monkeypatch.setattr(language_id, "PART", block)
        ce, size = model.entropies(asked)
        for i, t in enumerate(asked):
            s = [0, 0, 0, 0, *plain_symbols(t)]
            assert size[i] == len(s) - 4
            want = -sum(np.log(chance(tuple(s[k - 4 : k + 1]))) for k in range(4, len(s)))
            assert ce[i, 0] * max(1, size[i]) == pytest.approx(want, rel=1e-5)


def test_kneser_ney_sums_to_one(spark):
    d = spark.createDataFrame([(1, "abac abba caba", "x"), (2, "cab bac", "x")], "doc_id long, text string, lang string")
    for most in (1, 6, 1 << 20):
        model = language_id.train(d, model_grams=most, least_grams=most)
        s, size = language_id.symbols(["abac abba caba cab bac"])
        for _, packed in language_id.grams(s, size):
            for g in set(packed.tolist()):
                seen = np.array([(g >> 12 << 12) | c for c in (0, 97, 98, 99, 7)])
                assert np.exp(model.log_probs("x", seen)).sum() == pytest.approx(1, rel=1e-5)


def test_language_budgets(spark):
    """Small budgets lose little; a rare language beside common ones stays; no budget empties a model."""
    big = "/root/testdata/sf0.01"
    docs = read(spark, big, "documents").filter("lang <> 'es' or doc_id % 10 = 0").cache()
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    seen = {}
    for most in (500, 20_000, 1 << 21):
        model = language_id.train(docs, model_grams=most, least_grams=most)
        assert model.langs == ["de", "en", "es", "fr"]
        assert all(len(own[0][0]) > 20 for own in model.orders.values())
        got = {r.doc_id: r.lang_pred for r in language_id.identify(docs, model).collect()}
        seen[most] = sum(got[i] == truth[i] for i in truth) / len(truth)
        if most >= 20_000:
            rare = [i for i in truth if truth[i] == "es" and got[i] != "und"]
            assert sum(got[i] == "es" for i in rare) >= 0.9 * len(rare)
    docs.unpersist()
    assert seen[500] > 0.85 and abs(seen[20_000] - seen[1 << 21]) <= 0.01


def test_language_limits_come_from_all_rows(spark):
    """Temperature and limits are those of every labelled row, of a table larger than any sample that once stood for it."""
    rng = np.random.default_rng(3)
    rows = [(k, " ".join("".join(rng.choice(list("abcdefgh" if k % 2 else "efghijkl"), 4)) for _ in range(int(rng.integers(1, 5)))), "xy"[k % 2]) for k in range(9000)]
    rows += [(9000, "", "x"), (9001, None, "y"), (9002, "abc", None)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5))
    ce, size = model.entropies([r[1] for r in rows[:9000]])
    own = np.arange(9000) % 2
    loss = [-np.log(np.maximum(language_id._chances(ce, t)[np.arange(9000), own], 1e-9)).sum() for t in language_id.TEMPERATURES]
    assert model.temperature == language_id.TEMPERATURES[int(np.argmin(loss))]
    for j, lang in enumerate("xy"):
        x, n = ce[own == j, j], size[own == j]
        mean = np.average(x, weights=n)
        assert model.limits[lang] == pytest.approx((mean, np.sqrt(np.mean((x - mean) ** 2 * n))), rel=1e-9)


def test_pipeline_matches_stages(spark, sf, docs):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "secret_scan", "packing"]
    pieces = corpus_pipeline.run(spark, sf).collect()
    got = {r.doc_id for r in pieces}
    model = language_id.train(language_id.training_rows(read(spark, sf, "documents")))
    stay = {r.doc_id for r in language_id.identify(read(spark, sf, "documents"), model).filter("not rejected").collect()}
    comp = reach({i: simhash(docs[i].text) for i in stay})
    stay = {i for i in stay if comp[i] == i}
    bad = brute_hits([(i, docs[i].text) for i in stay], [(str(r.item_id), r.text) for r in read(spark, sf, "benchmark").collect()])
    assert got == {i for i in stay if not bad[i][4]}
    assert len(stay) >= 0.7 * len(docs)


def test_language_stage_learns_limits_from_all_rows(spark, sf, monkeypatch):
    """The pipeline's model has the limits of every training row."""
    import corpus_pipeline

    rng = np.random.default_rng(8)
    rows = [(k, " ".join("".join(rng.choice(list("abcdefgh"), 4)) for _ in range(int(rng.integers(1, 4)))), "x") for k in range(10_600)]
    seen, keep = [], language_id.keep_identified
    monkeypatch.setattr(language_id, "keep_identified", lambda docs, model: seen.append(model) or keep(docs, model))
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    assert corpus_pipeline.language(spark, table, sf).count() > 10_000
    ce, size = seen[0].entropies([r.text for r in language_id.training_rows(table).collect()])
    mean = np.average(ce[:, 0], weights=size)
    assert len(size) > 8000
    assert seen[0].limits["x"] == pytest.approx((mean, np.sqrt(np.mean((ce[:, 0] - mean) ** 2 * size))), rel=1e-9)


def test_stages_take_odd_rows(spark, odd, sf):
    """Every stage over nulls, empty and long texts, repeated rows, clashing names and an empty table."""
    import corpus_pipeline

    for rows in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, sf)
            assert out.columns == rows.columns
            texts = [r.text for r in out.collect()]
            assert len(texts) <= 8 and (rows is odd or not texts)
        assert corpus_pipeline.packing(spark, rows, sf).filter("start = 0").count() == rows.count()
