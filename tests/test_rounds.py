"""Operators that go in rounds give what their sequential rules give, however small the rounds are."""

import random

import pytest
from pyspark.sql import functions as F

from sheetloom.operators import drawing, selection, sets, symbols


@pytest.mark.parametrize("shape", ["walk", "flat", "grid"])
def test_simplify_in_rounds(spark, shape):
    rng = random.Random(4)
    rows = []
    for key, n in ((1, 250), (2, 40), (3, 2), (4, 1)):
        x = y = 0.0
        for i in range(n):
            x, y = (x + rng.uniform(0, 2), y + rng.uniform(-3, 3)) if shape == "walk" else (float(i), 0.0) if shape == "flat" else (float(rng.randint(0, 3)), float(rng.randint(0, 3)))
            rows.append((key, 3 * i, x, y, f"p{i}"))
    rows += [(None, 0, 1.0, 1.0, "a"), (2, None, 1.0, 1.0, "b"), (2, 1, None, 1.0, "c")]
    d = spark.createDataFrame(rows, "key int, idx int, x double, y double, name string")
    whole, cut = ({tuple(r) for r in drawing.simplify(d, "key", 1.5, most).collect()} for most in (4096, 15))
    assert whole == cut
    size = {k: sum(r[0] == k for r in whole) for k in (1, 2, 3, 4)}
    assert size[3] == 2 and size[4] == 1 and (size[1] == 2 if shape == "flat" else 20 < size[1] <= 250)
    assert drawing.simplify(d.limit(0), "key", 1.0).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_caps_of_three_counters(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([0, 0, 0, 1]), i, rng.randint(0, 5) / 2, rng.choice(["a", "b", None]), rng.randrange(5), "all") for i in range(400)]
    caps = {"label": 31, "side": 14, "every": 55}
    want, seen = set(), {}
    for page, i, _, *values in sorted(rows, key=lambda r: (-r[2], r[1])):
        keys = [(page, c, v) for c, v in zip(caps, values, strict=True)]
        if all(seen.get(k, 0) < caps[k[1]] for k in keys):
            want.add(i)
            for k in keys:
                seen[k] = seen.get(k, 0) + 1
    d = spark.createDataFrame(rows, "page int, id int, score double, label string, side int, every string")
    assert {r.id for r in drawing.multi_cap(d, caps).collect()} == want
    assert drawing.multi_cap(d, caps | {"side": 0}).count() == 0 and drawing.multi_cap(d.limit(0), caps).columns == d.columns


@pytest.mark.parametrize("total", [0, 1, 7, 40, 10_000])
def test_budget_in_portions(spark, total):
    rng = random.Random(total)
    rows = [(g, 100 * g + i, rng.randint(1, 3) / 2, i % 3) for g in range(60) for i in range(rng.choice([1, 2, 5, 6, 9]))]
    by = {}
    for g, i, s, label in sorted(rows, key=lambda r: (-r[2], r[1])):
        own = by.setdefault(g, [])
        if sum(o[1] == label for o in own) < 2:
            own.append((i, label, s))
    by = {g: own[:5] for g, own in by.items()}
    left, want = total, set()
    for own in (by[g] for g in sorted(by, key=lambda g: (-sum(o[2] for o in by[g]), g))):
        if len(own) <= left:
            want |= {o[0] for o in own}
            left -= len(own)
    d = spark.createDataFrame(rows, "page int, id int, score double, label int")
    assert {r.id for r in selection.budget(d, "page", 5, 2, total).collect()} == want


def test_holes_of_rings_of_few_points(spark):
    """Rings of any number of points, none included, are read by the check of holes."""
    from sheetloom.operators import validation

    p = lambda *xy: [{"x": float(x), "y": float(y)} for x, y in xy]
    rows = [(0, 1, "outer", p((0, 0), (10, 0), (10, 10), (0, 10))), (0, 2, "hole", p((20, 20), (21, 20), (21, 21))), (0, 3, "hole", p((1, 1))), (0, 4, "hole", []), (0, 5, "hole", p((2, 2), (4, 2), (3, 4))), (0, 6, "hole", p((3, 3), (6, 3), (6, 6)))]
    got = validation.check_holes(spark.createDataFrame(rows, "drawing int, ring_id int, role string, points array<struct<x:double,y:double>>")).select("ring_id", "code").orderBy("ring_id", "code")
    assert [tuple(r) for r in got.collect()] == [(2, "E004"), (4, "E004"), (6, "E006")]


@pytest.mark.parametrize("n", [0, 1, 9, 5003])
def test_split_is_exact(spark, n):
    d = spark.range(n).select((F.col("id") % 4000).alias("k"))
    shares = {"dev": 0.1, "none": 0.0, "locked": 0.25, "train": 0.65}
    once, again = (sorted((r.k, r.split) for r in sets.shuffled_split(d.repartition(parts), "k", shares, 7).collect()) for parts in (1, 6))
    size = {s: sum(r[1] == s for r in once) for s in shares}
    assert once == again and size == {"dev": n // 10, "none": 0, "locked": int(n * 0.35) - n // 10, "train": n - int(n * 0.35)}
    if n > 5000:
        assert [r[0] for r in once] == sorted(i % 4000 for i in range(n)) and once != sorted((r.k, r.split) for r in sets.shuffled_split(d, "k", shares, 8).collect())


def test_symbols_by_distance(spark):
    """Against the definition, point by point; over 64 dark pixels are thinned by steps."""
    rng = random.Random(3)
    width, images = 12, []
    for i, dark in enumerate((0.0, 0.05, 0.3, 1.0, 0.7)):
        images.append((i, [rng.randrange(128) if rng.random() < dark else rng.randrange(128, 256) for _ in range(width * 12)]))
    templates = {"cross": [(k, 6) for k in range(12)] + [(6, k) for k in range(12)], "dot": [(5, 5)], "none": []}
    want = {}
    for i, grey in images:
        p = [(k % width, k // width) for k, v in enumerate(grey) if v < 128]
        p = p[:: len(p) // 64][:64] if len(p) > 64 else p
        for name, q in templates.items():
            if p and q:
                d = lambda a, b: ((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5
                far = max(max(min(d(a, b) for b in q) for a in p), max(min(d(a, b) for a in p) for b in q))
                want[i, name] = round(1 - far / 32, 9)
    d = spark.createDataFrame([*images, (9, None)], "image int, grey array<int>")
    got = {(r.image, r.symbol): round(r.confidence, 9) for r in symbols.detect(d, width, templates, 0.0).collect()}
    assert got == want and len(want) == 8
    assert {(r.image, r.symbol) for r in symbols.detect(d, width, templates, 0.8).collect()} == {k for k, v in want.items() if v >= 0.8}
