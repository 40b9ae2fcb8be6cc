"""Brute-force checks of URL filters, quality rules, toxicity, context mixing and repeated passages."""

import re
import sys
import zlib
from collections import Counter, defaultdict
from math import log10

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sheetloom.llm import context_mixing, quality_rules, queries, substring_dedup, toxicity, url_filter
from sheetloom.llm.common import read

ODD = "doc_id long, text string, lang string, source string, n_chars long, row long, n int, row_key int, removed_keys string, __keys int, id string, key string"


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r.doc_id: r for r in read(spark, sf, "documents").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    rows = [(1, None, None, None, None, 1, 2), (2, "", "en", "s", 0, None, None), (None, "one two", "en", "s", 1, 1, 1), (3, long, "en", "s", 9, 1, 1), (4, "one  Two three", "fr", None, 9, 1, 1), (4, "one  Two three", "fr", None, 9, 1, 1), (None, None, None, None, None, None, None)]
    return spark.createDataFrame([(*r, 1, "a", 2, None, "k") for r in rows], ODD)


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path):
    best = None
    for action, h, p in queries.URL_RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = action, h + p
    return best or (None, None)


def plain_tree(urls):
    """Template and purity of each (host, path), by plain recursion; urls holds (n, bad, good) of each."""
    template = {}

    def grow(host, own, prefix, depth):
        groups = defaultdict(list)
        for path in own:
            segs = [x for x in path.split("/") if x]
            groups[segs[depth] if depth < len(segs) else ""].append(path)
        total = lambda paths, k: sum(urls[host, p][k] for p in paths)
        n, bad, good = (total(own, k) for k in range(3))
        below = defaultdict(list)
        for seg, paths in groups.items():
            if not seg:
                template.update({(host, p): prefix for p in paths})
                continue
            b, g = total(paths, 1), total(paths, 2)
            seen, rest = b + g, bad + good - b - g
            alike = False
            if seen and rest:
                rate = (bad + 1) / (bad + good + 2)
                alike = abs(b / seen - (bad - b) / rest) <= url_filter.Z * (rate * (1 - rate) * (1 / seen + 1 / rest)) ** 0.5
            varies = re.search(r"[0-9]", seg) or (len(groups) >= url_filter.FAN and total(paths, 0) < url_filter.SHARE * n)
            below[f"{prefix}/*" if varies or alike else f"{prefix}/{seg}"] += paths
        for name, paths in below.items():
            grow(host, paths, name, depth + 1)

    for host in {h for h, _ in urls}:
        grow(host, [p for h, p in urls if h == host], "", 0)
    groups = defaultdict(lambda: [0, 0])
    for (host, path), name in template.items():
        domain = ".".join(host.split(".")[-2:])
        for key in (host, domain, name), (domain, name), (name,), ():
            groups[key][0] += urls[host, path][1]
            groups[key][1] += sum(urls[host, path][1:])
    out = {}
    for (host, path), name in template.items():
        domain = ".".join(host.split(".")[-2:])
        purity = (groups[()][0] + 1) / (groups[()][1] + 2)
        for key in (name,), (domain, name), (host, domain, name):
            purity = (groups[key][0] + 2 * purity) / (groups[key][1] + 2)
        out[host, path] = name, purity
    return out


@pytest.mark.parametrize("hot", (256, 0))
def test_url_filter_matches_brute_force(spark, monkeypatch, hot):
    """Every rule, template, purity and verdict of a whole table; templates decide some urls without a rule."""
    from sheetloom.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", hot)
    sf = "/root/testdata/sf0.01"
    urls = {r.page_id: r.url for r in read(spark, sf, "pages").collect()}
    counts = defaultdict(lambda: [0, 0, 0])
    for url in urls.values():
        place = plain_url(url)
        verdict, _ = plain_rule(*place)
        counts[place] = [x + y for x, y in zip(counts[place], (1, verdict == "block", verdict == "allow"), strict=True)]
    want = plain_tree(counts)
    got = queries.op1_url_filter(spark, sf).collect()
    assert len(got) == len(urls)
    decided = 0
    for r in got:
        place = plain_url(urls[r.page_id])
        verdict, name = plain_rule(*place)
        template, purity = want[place]
        assert (r.host, r.path, r.rule, r.template) == (*place, name, template)
        assert r.purity == pytest.approx(purity)
        assert r.verdict == (verdict or ("block" if purity >= url_filter.PURITY else "allow"))
        decided += verdict is None and r.verdict == "block"
    assert decided > 0


def test_url_templates_agree_with_rules_they_have_not_seen(spark):
    """Without the labels of a fifth of the hosts, templates block what rules block there, and hardly anything that they allow."""
    sf = "/root/testdata/sf0.1"
    pages = read(spark, sf, "pages").withColumn("host", url_filter.host_of(F.col("url")))
    _, verdict = url_filter.matching_rule(F.col("host"), url_filter.path_of(F.col("url")), queries.URL_RULES)
    away = F.pmod(F.xxhash64("host"), F.lit(5)) == 0
    labels = pages.filter(~away).select("page_id", (verdict == "block").cast("int").alias("label")).filter("label is not null")
    got = url_filter.judge_urls(pages, [], labels).join(pages.filter(away).select("page_id", verdict.alias("truth")).filter("truth is not null"), "page_id").toPandas()
    blocked = got[got.verdict == "block"]
    assert len(got) > 100 and (blocked.truth == "block").mean() > 0.95
    assert (got.verdict[got.truth == "block"] == "block").mean() > 0.9


def test_url_templates_and_odd_rows(spark):
    rows = [(k, f"http://h.org/shop/{k}/buy", 1) for k in range(40)] + [(100 + k, f"http://h.org/news/{k}/read", 0) for k in range(40)]
    deep, deeper = "/".join(f"d{'abcdefghijklmnop'[k % 16]}" for k in range(300)), "/".join("abcdefghijkl")
    rows += [(200, "http://h.org/shop/999/buy", None), (201, "http://h.org/news/999/read", None), (202, None, None), (203, "no host", None), (None, "HTTP://H.org?x", None), (204, "a://b://c/d", None), (205, f"http://h.org/{deeper}", None), (206, f"http://h.org/{deep}/x", 1), (207, f"http://h.org/{deep}/y", 0), (206, f"http://h.org/{deep}/x", 0)]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u, _ in rows], "page_id long, url string, host string, template string")
    labels = spark.createDataFrame([(i, v) for i, _, v in rows if v is not None], "page_id long, label int")
    found = url_filter.judge_urls(pages, queries.URL_RULES, labels).collect()
    assert len(found) == len(rows)
    got = {r.page_id: r for r in found}
    assert got[200].verdict == "block" and got[200].template == "/shop/*/buy"
    assert got[201].verdict == "allow" and got[201].template == "/news/*/read"
    assert (got[202].host, got[202].path, got[203].host) == ("", "", "")
    assert (got[None].host, got[None].path) == ("H.org".lower(), "")
    assert (got[204].host, got[204].path) == ("b:", "//c/d") == plain_url("a://b://c/d")
    assert got[205].template == f"/{deeper}" and "/db/dc/" in got[206].template and got[206].template.count("/") == 301
    assert url_filter.judge_urls(pages.limit(0), queries.URL_RULES).count() == 0


def test_quality_matches_sql(spark, sf):
    got = queries.op4_quality_rules(spark, sf).toPandas()
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.execute(quality_rules.SQL).df()[list(got.columns)]
    order = lambda x: x.sort_values("doc_id").reset_index(drop=True).astype(str)
    assert order(got).equals(order(want))


def test_quality_lines(spark):
    line = "subscribe to our newsletter for more stories like this one"
    own = lambda k: " ".join(f"word{k}x{i}" for i in range(30))
    rows = [(k, f"{line}\n{own(k)}", "a", "b") for k in range(30)] + [(100 + k, "\n".join([line] + [f"{line} {k}"] * (k % 2) + [" ".join(f"u{k}"[: 2 + (k > 9)] for _ in range(3))]) + " tail words here to pass twenty of them all in this doc", "a", "b") for k in range(0)]
    rows += [(200, f"{line.upper()}\n{line}x a b c d e f g h i j k l m n o p\n" + own(200), "other", "b"), (201, f"{line}\n{own('s')[:20]}\nthe of and a b c d e f g h", "a", "b")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, key string")
    got = {r.doc_id: r for r in quality_rules.judge_quality(d).collect()}
    assert got[3].n_removed_words == 10 and got[3].kept
    assert got[200].n_removed_words == 0
    assert not got[201].kept or got[201].n_removed_words == 10
    clean = {r.doc_id: r.text for r in quality_rules.clean_documents(d).collect()}
    assert clean[3] == own(3)


def test_quality_odd_rows(spark, odd):
    assert len(quality_rules.judge_quality(odd).collect()) == 7
    assert quality_rules.judge_quality(odd.limit(0)).count() == 0
    assert quality_rules.clean_documents(odd).columns == odd.columns


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    lang = read(spark, sf, "documents").select("doc_id", "lang")
    got = queries.op5_toxicity(spark, sf).filter("held_out").join(read(spark, sf, "labels"), "doc_id").join(lang, "doc_id").select("score", "predicted", "toxic", "lang").toPandas()
    rank = got.score.rank()
    bad = got.toxic == 1
    auc = (rank[bad].sum() - bad.sum() * (bad.sum() + 1) / 2) / (bad.sum() * (~bad).sum())
    assert auc > 0.97
    assert (got.predicted[bad] == 1).mean() > 0.85 and (got.predicted[~bad] == 1).mean() < 0.04
    for x in ("de", "en", "es", "fr"):
        own = got[got.lang == x]
        assert (own.predicted[own.toxic == 1] == 1).mean() >= 0.85 and (own.predicted[own.toxic == 0] == 1).mean() < 0.04


def test_toxicity_equals_its_definition(spark, sf):
    """Score from windows, lengths and the curve, step by step; and the words that the toxic dictionary is made of."""
    import xxhash
    import zstandard

    d, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    model = toxicity.train(d, labels)
    lengths = lambda raw: [len(zstandard.ZstdCompressor(level=12, dict_data=zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False).compress(raw)) for c in (model.ordinary, model.toxic + model.ordinary)]
    rows = {r.doc_id: r for r in toxicity.score(d, model).collect()}
    for r in d.orderBy("doc_id").limit(15).collect():
        words = re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (r.text or "").encode()))
        gains = []
        for k in range(0, len(words), 16) or [0]:
            plain, tox = lengths(b"".join(xxhash.xxh64(w).digest() for w in words[k : k + 16]))
            gains.append(plain - tox)
        assert (rows[r.doc_id].windows, rows[r.doc_id].best_gain) == (len(gains), max(gains))
        x = (toxicity.features(np.array(gains)) - model.centre) / model.scale
        assert rows[r.doc_id].score == pytest.approx(1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30))))
        assert rows[r.doc_id].predicted == (rows[r.doc_id].score >= 0.3)
    toxic = [[b"vile", b"word", b"%d" % i] for i in range(40)]
    ordinary = [[b"good", b"word", b"%d" % i] for i in range(40)]
    own, other = toxicity.dictionaries(toxic, ordinary)
    assert xxhash.xxh64_digest(b"vile") in own and xxhash.xxh64_digest(b"word") not in own and xxhash.xxh64_digest(b"word") in other


def test_toxicity_odd_rows(spark, odd):
    labels = spark.createDataFrame([(2, 0, 1), (3, 1, 0), (None, 1, 1), (4, None, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.train(odd, labels)
    got = toxicity.score(odd, model).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(odd.limit(0), toxicity.train(odd.limit(0), labels.limit(0))).count() == 0


def low_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


@pytest.mark.parametrize("hot", [1 << 16, 50])
def test_mixing_base_matches_brute_force(spark, sf, docs, hot):
    train = [r for i, r in docs.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for r in train for w in low_words(r.text))
    n, v = sum(c.values()) + len(train), len(c) + 1
    d = read(spark, sf, "documents")
    own = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    got = context_mixing.score(d, d.filter(own), hot_words=hot).collect()
    assert len(got) == len(docs)
    for r in got:
        w = low_words(docs[r.doc_id].text)
        want = sum(log10((c[x] + 1) / (n + v + 1)) for x in w) + log10((len(train) + 1) / (n + v + 1))
        assert abs(r.base_score - want) < 1e-6 * max(1, abs(want))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w) + 1, sum(x in c for x in w) + 1, n)
        assert r.score < 0 and 0 < r.bits_per_byte < 12


def test_mixing_is_a_distribution():
    trainer = context_mixing.Trainer()
    for g in context_mixing._groups(iter([b"the cat sat on the mat".split()] * 400), 1 << 12):
        trainer.learn(*g)
    n = trainer.n.reshape(-1, 2).T
    table = ((np.clip(context_mixing._stretch(n[0], n[1]), -31, 31) * 512).astype(np.int16) << 1 | (n.sum(axis=0) >= context_mixing.SEEN)).astype(np.int16)
    middle = context_mixing._squash((np.arange(32) + 0.5) * 0.75 - 12)
    model = context_mixing.Model(table, trainer.w.astype(np.float32), np.tile(middle, 256))
    packed = context_mixing.contexts([b"the cat".split()])[0]
    for p in packed:
        all_ = (int(p) >> 8 << 8) | np.arange(256)
        assert 0.9 < np.exp2(model.log2_probs(all_)).sum() < 1 + 1e-6
    assert context_mixing.Scorer(model)([b"the cat sat on the mat".split()])[0] > context_mixing.Scorer(model)([b"zqj vvx kkw qqz zzzz".split()])[0]


def test_mixing_odd_rows(spark, odd):
    assert len(context_mixing.score(odd, odd).collect()) == 7
    assert context_mixing.score(odd, odd.limit(0)).filter("n_known = 0").count() == 7
    assert context_mixing.score(odd.limit(0), odd).count() == 0


def test_passages_catch_repeats(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: substring_dedup.words_of(r.text) for r in read(spark, sf, "documents").collect()}
    where = defaultdict(set)
    for i, w in texts.items():
        for s in range(len(w) - 49):
            where[tuple(w[s : s + 50])].add(i)
    want = set().union(*(x for x in where.values() if len(x) > 1))
    got = queries.op8_substring_dedup(spark, sf).collect()
    found = {r.doc_id for r in got} | {r.other_doc_id for r in got}
    assert want and want <= found
    for r in got:
        b, a = texts[r.doc_id], texts[r.other_doc_id]
        assert 0 <= r.start < r.end <= len(b) and 0 <= r.other_start < r.other_end <= len(a)
        assert min(r.end - r.start, r.other_end - r.other_start) >= substring_dedup.LEAST_WORDS
        assert r.equal_words <= min(r.end - r.start, r.other_end - r.other_start)
        grams = {tuple(a[s : s + 8]) for s in range(r.other_start, r.other_end - 7)}
        assert any(tuple(b[s : s + 8]) in grams for s in range(r.start, r.end - 7))


def test_passages_fuzzy_hot_and_odd(spark, odd, monkeypatch):
    rng = np.random.default_rng(9)
    word = lambda: f"w{rng.integers(1 << 30):x}"
    shared = [word() for _ in range(120)]
    rows = []
    for k in range(60):
        own = shared.copy()
        for at in rng.choice(120, 3, replace=False):
            own[at] = word()
        rows.append((k, " ".join([word() for _ in range(30)] + own + [word() for _ in range(30)])))
    rows += [(100 + k, " ".join(word() for _ in range(150))) for k in range(20)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (substring_dedup.HOT_ROWS, 0):
        monkeypatch.setattr(substring_dedup, "HOT_ROWS", hot)
        got = substring_dedup.repeated_passages(d).collect()
        assert {r.doc_id for r in got} | {r.other_id for r in got} == set(range(60))
        assert max(r.end - r.start for r in got) >= 90
    assert substring_dedup.repeated_passages(odd).count() == 0
    assert substring_dedup.repeated_passages(odd.limit(0)).count() == 0


def test_chains_prefer_one_diagonal():
    line = [(10 * k, 10 * k + 5) for k in range(6)]
    found = substring_dedup.chains(line + [(15, 400), (20, 3)])
    assert found[0] == line


@pytest.mark.parametrize("first", (60, 300))
@pytest.mark.parametrize("apart", (70, 200, 400, 600, 3000))
def test_chains_keep_a_later_passage(first, apart):
    """Two passages of one pair both chain, whatever lies between; the later one is found by the near predecessor."""
    second = first + apart
    matches = [(i, 5 + i) for i in range(0, first, 6)] + [(second + i, 9 + second + i) for i in range(0, 60, 6)]
    long = [c for c in substring_dedup.chains(matches) if len(c) > 1]
    assert sorted((c[0][0], c[-1][0]) for c in long) == [(0, (first - 1) // 6 * 6), (second, second + 54)]


def test_chains_score_as_brute_force():
    """The best chain reaches the score of the quadratic recurrence that asks every predecessor within the gap."""
    k, cost, reach = substring_dedup.K, substring_dedup.GAP_COST, substring_dedup.WIDEST_GAP + substring_dedup.K
    rng = np.random.default_rng(5)
    for _ in range(200):
        matches = sorted({(int(b), int(a)) for b, a in rng.integers(0, rng.integers(20, 900), (60, 2))})
        score = []
        for i, (b, a) in enumerate(matches):
            near = [score[j] - cost * (b - y + a - x) for j, (y, x) in enumerate(matches[:i]) if 0 < b - y <= reach and 0 < a - x <= reach]
            score.append(k + max([0.0, *near]))
        best = substring_dedup.chains(matches)[0]
        got = k * len(best) - cost * (best[-1][0] - best[0][0] + best[-1][1] - best[0][1])
        assert got == pytest.approx(max(score))


def run_places(texts, n):
    """(text, place) of each run of n words that two different texts have."""
    where = defaultdict(set)
    for i, t in enumerate(texts):
        for s in range(len(t) - n + 1):
            where[tuple(t[s : s + n])].add((i, s))
    return {x for own in where.values() if len({tuple(texts[i]) for i, _ in own}) > 1 for x in own}


def run_covered(found, n):
    """(text, place) of each run of n words that lies in one reported passage."""
    sides = lambda r: ((r.doc_id, r.start, r.end), (r.other_id, r.other_start, r.other_end))
    return {(i, k) for r in found for i, s, e in sides(r) for k in range(s, e - n + 1)}


@pytest.mark.parametrize("hot", (64, 0))
def test_passages_cover_every_repeated_run(spark, monkeypatch, hot):
    """Each run of 50 words that two different texts have is in a reported passage of both, though its parts are
    common; of runs of 40 words, which need not hold a seed with 40 words after or before it, few are missed."""
    monkeypatch.setattr(substring_dedup, "HOT_ROWS", hot)
    rng = np.random.default_rng(21)
    word = lambda: f"w{rng.integers(1 << 30):x}"
    some = lambda n: [word() for _ in range(n)]
    sentences = [some(int(rng.integers(18, 34))) for _ in range(14)]
    texts = []
    for _ in range(160):
        x, y = rng.choice(14, 2, replace=False)
        texts.append(some(20) + sentences[x] + sentences[y] + some(20))
    texts += [some(20) + s + some(20) for s in sentences for _ in range(8)]
    texts += [t[:25] + t[25:60] + some(100) + t[5:50] for t in texts[:10]]
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    found = substring_dedup.repeated_passages(d).collect()
    assert all(r.equal_words >= substring_dedup.LEAST_EQUAL * max(r.end - r.start, r.other_end - r.other_start) for r in found)
    want, shorter = run_places(texts, 50), run_places(texts, 40)
    assert len(want) > 300 and not want - run_covered(found, 50)
    assert len(shorter - run_covered(found, 40)) < 0.03 * len(shorter)


def test_passages_cover_runs_of_a_table(spark):
    d = read(spark, "/root/testdata/sf0.01", "documents").orderBy("doc_id")
    rows = d.collect()
    texts, names = [substring_dedup.words_of(r.text) for r in rows], {r.doc_id: k for k, r in enumerate(rows)}
    found = substring_dedup.repeated_passages(spark.createDataFrame([(names[r.doc_id], r.text) for r in rows], "doc_id long, text string")).collect()
    want = run_places(texts, 50)
    words = lambda places: {(i, k) for i, s in places for k in range(s, s + 50)}
    assert len(want) > 5_000
    assert not words(want) - words(run_covered(found, 50))


def test_passages_find_fuzzy_pairs(spark):
    """Of pairs that share 100 words of which one in 16 is changed, nine in ten are found, and with most of their words."""
    rng = np.random.default_rng(4)
    some = lambda n: [f"w{rng.integers(1 << 30):x}" for _ in range(n)]
    rows = []
    for k in range(200):
        shared = some(100)
        changed = [x if rng.random() > 1 / 16 else f"c{k}" for x in shared]
        rows += [(2 * k, " ".join(some(40) + shared + some(40))), (2 * k + 1, " ".join(some(int(rng.integers(90))) + changed + some(20)))]
    found = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    pairs = {min(r.doc_id, r.other_id): 0 for r in found}
    for r in found:
        assert {r.doc_id // 2} == {r.other_id // 2}
        pairs[min(r.doc_id, r.other_id)] += r.end - r.start
    assert len(pairs) >= 180 and np.mean(list(pairs.values())) > 80


@pytest.mark.parametrize("hot", (64, 0))
def test_passages_link_every_pair(spark, monkeypatch, hot):
    """Pairs whose only seeds lie in a line of very many texts, and that share no run of LEAST_WORDS words, are all found."""
    monkeypatch.setattr(substring_dedup, "HOT_ROWS", hot)
    rng = np.random.default_rng(31)
    some = lambda n: [f"w{rng.integers(1 << 30):x}" for _ in range(n)]
    line, texts = some(30), []
    for _ in range(40):
        beside = [some(6) for _ in range(4)]
        for _ in range(2):
            texts.append(some(15) + line + [x for part in beside for x in [*some(1), *part]] + some(15))
    texts += [some(20) + line + some(20) for _ in range(120)]
    order = rng.permutation(len(texts))
    d = spark.createDataFrame([(int(i), " ".join(texts[i])) for i in order], "doc_id long, text string")
    found = substring_dedup.repeated_passages(d).collect()
    assert {tuple(sorted((r.doc_id, r.other_id))) for r in found} == {(k, k + 1) for k in range(0, 80, 2)}


@pytest.mark.parametrize("hot", (8, 0))
def test_passages_link_classes_without_all_pairs(spark, monkeypatch, hot):
    """Texts that one template gave, and texts with stretches of one word, are linked by far fewer matches than they have pairs."""
    monkeypatch.setattr(substring_dedup, "HOT_ROWS", hot)
    rng = np.random.default_rng(17)
    some = lambda n: [f"w{rng.integers(1 << 30):x}" for _ in range(n)]
    template, line, n = some(140), some(25), 150
    kinds = [lambda: some(20) + [x if rng.random() > 1 / 30 else some(1)[0] for x in template], lambda: some(20) + ["the"] * int(rng.integers(60, 90)) + some(20), lambda: some(30) + line + some(30)]
    d = spark.createDataFrame([(k * n + i, " ".join(kind())) for k, kind in enumerate(kinds) for i in range(n)], "doc_id long, text string")
    assert substring_dedup.seed_matches(d).count() < 3 * n * 60
    edges = {(r.doc_id, r.other_id) for r in substring_dedup.repeated_passages(d).collect()}
    group = list(range(3 * n))
    for b, a in edges:
        group = [group[a] if x == group[b] else x for x in group]
    assert len(set(group[:n])) == 1 and len(set(group[n : 2 * n])) == 1 and len(set(group)) == 2 + n


def test_seeds_of_many_texts_at_once(spark, monkeypatch):
    """Seeds come from the words of many texts together, in far fewer steps than texts, and are those of each text alone."""
    texts = ["", " ", "a b c d e f g h", "the " * 90, "x y z " * 30 + "end", "\x1c\x0b a B \u00a0 \u0130" * 12, "a b c d e f g h"]
    rng = np.random.default_rng(8)
    texts += [" ".join(rng.choice(["a", "b", "c"], int(rng.integers(70)))) for _ in range(300)]
    texts += [" ".join(f"w{x}" for x in rng.integers(1 << 30, size=int(rng.integers(60)))) for _ in range(1000)]
    works = []
    monkeypatch.setattr(substring_dedup, "map_rows", lambda df, work, schema: works.append(work))
    substring_dedup.seed_rows(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    batch = lambda own: pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([texts[i] for i in own])], names=["text_id", "text"])
    found = lambda batches: [tuple(r.values()) for b in works[0](iter(batches)) for r in b.to_pylist()]
    alone = [r for i in range(len(texts)) for r in found([batch([i])])]
    steps = Counter()
    sys.setprofile(lambda frame, event, arg: steps.update([event]))
    together = list(works[0](iter([batch(range(len(texts) - 1000, len(texts)))])))
    sys.setprofile(None)
    assert sum(b.num_rows for b in together) > 1000 and steps["call"] + steps["c_call"] < 10 * 1000
    assert len(alone) > 2000 and sorted(found([batch(range(len(texts)))])) == sorted(alone)
    for i in range(0, len(texts), 7):
        words = substring_dedup.words_of(texts[i])
        mine = [(r[0], words[r[2] >> 32 :][:8]) for r in alone if r[1] == i]
        assert all(len(w) == 8 for _, w in mine) and len({s for s, _ in mine}) == len({tuple(w) for _, w in mine})
        assert bool(mine) == (len(words) >= 8)


def test_gaps_align_as_the_usual_table():
    rng = np.random.default_rng(3)
    for _ in range(300):
        x, y = ([b"%d" % k for k in rng.integers(6, size=int(rng.integers(60)))] for _ in range(2))
        table = np.zeros((len(x) + 1, len(y) + 1), int)
        for i, p in enumerate(x):
            for k, q in enumerate(y):
                table[i + 1, k + 1] = table[i, k] + 1 if p == q else max(table[i, k + 1], table[i + 1, k])
        want = table[-1, -1] if len(x) != len(y) else sum(p == q for p, q in zip(x, y, strict=True))
        assert substring_dedup._common(x, y) == want


def test_copies_are_not_read_for_their_words_again(spark):
    d = spark.createDataFrame([(1, "a b " * 30), (2, "a b " * 30), (3, "c")], "doc_id long, text string")
    found = substring_dedup.repeated_passages(d)
    assert "regexp" not in found._jdf.queryExecution().toString()
    assert [tuple(r) for r in found.collect()] == [(2, 1, 0, 60, 0, 60, 60)]
