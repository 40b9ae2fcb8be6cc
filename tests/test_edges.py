"""Ties, touching places and last digits: where rounding or a tolerance once decided otherwise than the SQL."""

import itertools
import random

import duckdb
import pandas as pd
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sheetloom.functions import geometry as g
from sheetloom.operators import rules, scene, spatial


def against_sql(spark, folder, name, vectors):
    """The query's rows and its SQL's over embeddings of such vectors, as numbers, sorted."""
    rows = [(i, [float(x) for x in v] + [0.0] * (64 - len(v)), i % 10) for i, v in enumerate(vectors)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet/*.parquet'")
    got = entry.queries()[name](spark, str(folder)).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()[list(got.columns)]
    return [sorted(tuple(-1.0 if pd.isna(v) else float(v) for v in r) for r in df.itertuples(index=False)) for df in (got, want)]


def test_every_crossing_ends_a_piece(spark, tmp_path):
    """Three lines through one place, and two cuts of a line that lie closer than the tolerance."""
    lines = [(-0.1, 0, 0.1, 0), (0, -0.1, 0, 0.1), (-0.1, -0.1, 0.1, 0.1), (0.05, -0.1, 0.05, 0.1), (0.3, 0.3, 0.31, 0.3)]
    got, want = against_sql(spark, tmp_path, "gr_05_split", lines)
    assert got == want
    assert {r[0]: r[1] for r in got} == {0: 4, 1: 3, 2: 4, 3: 3, 4: 1}


def test_padded_boxes_come_back_unchanged(spark):
    rnd = random.Random(5)
    rows = [(i, *(round(rnd.uniform(0, 300), 1) for _ in range(2)), round(rnd.uniform(20, 90), 1), round(rnd.uniform(20, 90), 1)) for i in range(200)]
    b = spark.createDataFrame(rows, "id long, x0 double, y0 double, w double, h double").selectExpr("id", "x0", "y0", "x0 + w as x1", "y0 + h as y1")
    own = {r.id: tuple(r)[1:] for r in b.collect()}
    p = spatial.overlap_pairs(b, b, 50.0, pad=10.0).collect()
    assert len(p) > 1000
    assert all((r.r_x0, r.r_y0, r.r_x1, r.r_y1) == own[r.r_id] for r in p)


def test_label_that_sticks_out_is_not_whole(spark):
    box = "page long, id long, x0 double, y0 double, x1 double, y1 double"
    rooms = spark.createDataFrame([(0, 1, 1e-12, 0.0, 50.0, 50.0), (1, 2, 0.0, 0.0, 50.0, 50.0)], box).withColumn("points", F.lit(None).cast("array<struct<x:double,y:double>>"))
    labels = spark.createDataFrame([(0, 8, 0.0, 1.0, 10.0, 2.0), (1, 9, 0.0, 1.0, 10.0, 2.0)], box)
    got = {r.label: r.method for r in scene.room_of_label(rooms, labels, 25.0).collect()}
    assert got == {8: "box_centre", 9: "box_whole"}


def test_points_on_a_ring_are_not_inside(spark, tmp_path):
    sides = [(sx * k, sy * (0.12 - k)) for k in (0.0, 0.03, 0.05032, 0.06, 0.0123, 0.12) for sx in (1, -1) for sy in (1, -1)]
    got, want = against_sql(spark, tmp_path, "sc_05_point_in_ring", sides + [(0, 0), (-0.05, 0.06), (0.07, 0.06), (-0.05999, 0.06), (-0.06001, 0.06)])
    assert got == want
    assert [r[0] for r in got] == [24, 25, 27]


def test_dashes_in_any_order(spark):
    """The spread of 9, 15, 7, 9 is three tenths of its mean, so it is not under it; a piece of unknown length is a piece."""
    ways = sorted(set(itertools.permutations((9.0, 15.0, 7.0, 9.0))))
    rows = [(i, k, x) for i, way in enumerate(ways) for k, x in enumerate(way)]
    rows += [(100 + i, k, x) for i, way in enumerate([(9.0, 14.0, 7.0, 9.0), (5.0, 5.0, None), (5.0, 5.0), (0.0, 0.0, 0.0), (5.1, 5.1, 5.1)]) for k, x in enumerate(way)]
    t = spark.createDataFrame(rows, "id long, k int, length double").coalesce(1).sortWithinPartitions("id", "k")
    got = {r.id: r.dashed for r in t.groupBy("id").agg(rules.is_dashed(F.col("length")).alias("dashed")).collect()}
    assert got == {i: False for i in range(len(ways))} | {100: True, 101: True, 102: False, 103: True, 104: True}


def test_boxes_of_one_size_have_one_area(spark):
    """A box has the product of its sides as area, wherever it lies: of two boxes of one size neither is the larger."""
    rnd = random.Random(9)
    rows = [tuple(round(rnd.uniform(-300, 300), 1) for _ in range(2)) + (round(rnd.uniform(20, 90), 1), round(rnd.uniform(20, 90), 1)) for _ in range(500)]
    b = spark.createDataFrame(rows, "x0 double, y0 double, w double, h double").selectExpr("x0", "y0", "x0 + w as x1", "y0 + h as y1")
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    a = b.select(g.ring_area(F.array(p("x0", "y0"), p("x1", "y0"), p("x1", "y1"), p("x0", "y1"))).alias("a"), F.expr("(x1 - x0) * (y1 - y0)").alias("b")).toPandas()
    pd.testing.assert_series_equal(a["a"], a["b"], check_names=False, check_exact=True)
    assert b.limit(1).select(g.ring_area(F.array().cast("array<struct<x:double,y:double>>")).alias("a")).first().a == 0


def test_nesting_of_boxes_of_one_size(spark, tmp_path):
    """Boxes of a few sizes on a fine grid, many of one area: parents and depths as the SQL has them."""
    rnd = random.Random(4)
    at = lambda: round(rnd.randint(-40, 40) * 0.0013, 4)
    vectors = [(0, 0, 0, 0, at(), at(), rnd.choice((0.01, 0.0137, 0.02)), rnd.choice((0.01, 0.0137, 0.02))) for _ in range(300)]
    got, want = against_sql(spark, tmp_path, "gr_09_nesting", vectors)
    assert got == want


def test_forests_keep_what_spans(spark, monkeypatch):
    """Rows that close a ring with rows before them go, a portion at a time; what is left holds the least spanning forest."""
    from sheetloom.operators import graphs

    rnd = random.Random(2)
    rows = sorted({(rnd.randint(0, 30), *sorted(rnd.sample(range(60), 2))) for _ in range(900)})
    parent = {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    least = set()
    for r in rows:
        if root(r[1]) != root(r[2]):
            least.add(r)
            parent[root(r[1])] = root(r[2])
    for portion, parts in ((1 << 20, 1), (100, 1), (100, 3)):
        monkeypatch.setattr(graphs, "FOREST_ROWS", portion)
        df = spark.createDataFrame(rnd.sample(rows, len(rows)), "d long, a long, b long").repartition(parts)
        got = {tuple(r) for r in graphs.least_forests(df).collect()}
        assert least <= got and len(got) < len(rows) / 2
        assert parts > 1 or portion < len(rows) or got == least
    assert graphs.least_forests(df.limit(0)).count() == 0


def test_pairs_of_ends_are_not_moved_again(spark, sf):
    """Directions come with the ends: one join finds the pairs, and pairs that do not run on go at once."""
    from sheetloom.operators import drawing
    from sheetloom.plans.tables import segments

    plan = drawing.gap_candidates(segments(spark, sf), 20.0, 0.95)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1


def test_contours_write_forests_only(spark, monkeypatch):
    """Of a bundle in which every piece runs on into every other, a contour takes fewer pairs than it has pieces."""
    from sheetloom.operators import graphs, topology

    rows = [(i, 0.0, i / 100, 100.0, i / 100) for i in range(60)] + [(100, 0.0, 500.0, 100.0, 500.0)]
    s = spark.createDataFrame(rows, "id long, x0 double, y0 double, x1 double, y1 double").coalesce(1)
    seen = []
    monkeypatch.setattr(graphs, "components", lambda pairs, f=graphs.components: seen.append(pairs.count()) or f(pairs))
    got = {r.contour: (r.n, r.dashed) for r in topology.line_types(s, 3.0).collect()}
    assert got == {0: (60, True), 100: (1, False)}
    assert seen[0] < 60 * 59 / 2
