"""Chains of segments against walking them one by one."""

import random

from pyspark.sql import functions as F

from sheetloom.operators import chains, selection


def plain(segments, pick):
    """[(id, forward)], closed: at every place the least segment not in the chain, until back home or at an end."""
    at = {}
    for i, (a, b) in segments.items():
        at.setdefault(a, set()).add(i)
        at.setdefault(b, set()).add(i)
    home, here = segments[pick]
    path = [(pick, True)]
    while here != home:
        left = sorted(at[here] - {p for p, _ in path})
        if not left:
            return path, False
        forward = segments[left[0]][0] == here
        path.append((left[0], forward))
        here = segments[left[0]][1 if forward else 0]
    return path, True


def table(spark, segments):
    return spark.createDataFrame([(i, float(a), 0.0, float(b), 0.0) for i, (a, b) in segments.items()], "id long, x0 double, y0 double, x1 double, y1 double")


def test_traces_equal_walks_on_random_graphs(spark):
    rng = random.Random(9)
    ids = list(range(60))
    rng.shuffle(ids)
    segments = {i: tuple(rng.sample(range(34), 2)) for i in ids}
    picks = spark.createDataFrame([(i,) for i in (*ids[:14], 999)], "id long")
    got, closed = {}, {}
    for r in chains.auto_trace(table(spark, segments), picks).collect():
        got.setdefault(r.pick, {})[r.k] = (r.id, r.forward)
        closed[r.pick] = r.closed
    assert set(got) == set(ids[:14]) and len(set(closed.values())) == 2
    for pick, path in got.items():
        want, ring = plain(segments, pick)
        assert [path[k] for k in sorted(path)] == want and sorted(path) == list(range(len(want))) and closed[pick] == ring


def test_long_chain_takes_few_rounds(spark):
    n = 100_000
    d = spark.range(n).select(F.pmod(F.col("id") * 7919, F.lit(n)).alias("id"), F.col("id").cast("double").alias("x0"), F.lit(0.0).alias("y0"), F.pmod(F.col("id") + 1, F.lit(n)).cast("double").alias("x1"), F.lit(0.0).alias("y1"))
    out = chains.auto_trace(d, spark.createDataFrame([(0,)], "id long"))
    r = out.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.max("k").alias("k"), F.min("closed").alias("closed"), F.max("branch").alias("branch"), F.sum((F.col("id") != F.pmod(F.col("k") * 7919, F.lit(n))).cast("int")).alias("off")).first()
    assert (r.n, r.ids, r.k, r.closed, r.branch, r.off) == (n, n, n - 1, True, False, 0)


def test_ends_on_segments(spark):
    rows = [(1, 0.0, 0.0, 10.0, 0.0), (2, 4.0, 0.0, 4.0, 9.0), (3, 10.0, 0.0, 20.0, 0.0), (4, 5.0, 0.5, 6.0, 3.0)]
    got = {tuple(r) for r in chains.ends_on_segments(spark.createDataFrame(rows, "id long, x0 double, y0 double, x1 double, y1 double"), 1e-6).collect()}
    assert got == {(2, 0, 1), (1, 1, 3), (3, 0, 1)}


def test_assignments_equal_the_sequential_rule(spark):
    rng = random.Random(4)
    rows = [(k, k % 6, rng.randrange(5), rng.randrange(8) / 8, rng.randrange(3) / 3) for k in range(240)]
    df = spark.createDataFrame(rows, "id long, item int, owner int, score double, second double")
    got = {r.id: r.reason for r in selection.assignments(df, ["item"], "owner", 0.25, 3, 2, 3).collect()}
    want = {}
    for item in range(6):
        own = sorted((r for r in rows if r[1] == item and r[3] >= 0.25), key=lambda r: (-r[3], -r[4], r[0]))
        by = {}
        for r in own:
            by.setdefault(r[2], []).append(r)
        for owner in sorted(by, key=lambda o: (-by[o][0][3], -by[o][0][4], o))[:3]:
            want |= {r[0]: "assigned" for r in by[owner][:2]}
        want |= {r[0]: "overflow" for r in [r for r in own if r[0] not in want][:3]}
    assert got == want and set(want.values()) == {"assigned", "overflow"}
    assert "overflow" not in {r.reason for r in selection.assignments(df, ["item"], "owner", 0.25, 3, 2).collect()}


def test_ends_are_looked_for_along_segments(spark):
    """Random, flat, upright and empty segments against all pairs; a long segment has few cells beside those that it passes."""
    import random

    from pyspark.sql import functions as F

    rnd = random.Random(3)
    c = lambda: round(rnd.uniform(-40, 40), 1)
    rows = [(i, x, y, *rnd.choice([(c(), c()), (c(), y), (x, c()), (x, y), (x + 0.1, c())])) for i, (x, y) in enumerate((c(), c()) for _ in range(250))]
    s = spark.createDataFrame(rows, "id long, x0 double, y0 double, x1 double, y1 double")
    for tol in (5.0, 0.5, 1e-6):
        want = set()
        for i, *p in rows:
            for end, (x, y) in enumerate((p[:2], p[2:])):
                for k, x0, y0, x1, y1 in rows:
                    if i != k and min(x0, x1) - tol <= x <= max(x0, x1) + tol and min(y0, y1) - tol <= y <= max(y0, y1) + tol and abs((x - x0) * (y1 - y0) - (y - y0) * (x1 - x0)) <= tol:
                        want.add((i, end, k))
        got = [tuple(r) for r in chains.ends_on_segments(s, tol).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert chains.ends_on_segments(s.limit(0), 1.0).count() == 0
    slant = spark.createDataFrame([(0, 0.0, 0.0, 100.0, 100.0)], "id long, x0 double, y0 double, x1 double, y1 double")
    assert chains.band_cells(slant, 1.0, 1.0).agg(F.count("*")).first()[0] < 500
