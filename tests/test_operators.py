"""Hand-computed cases of geometry, joins, graphs, selection, metrics and service operators."""

import math
import math
import random

import pytest
from pyspark.sql import functions as F

from sheetloom.functions import geometry as g
from sheetloom.functions import text as tx
from sheetloom.operators import graphs, metrics, rules, selection, sets, spatial
from sheetloom.streaming import service


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def lits(*xs):
    return [F.lit(float(x)) for x in xs]


def test_boxes(spark):
    a, b, c = lits(0, 0, 10, 10), lits(1, 0, 11, 10), lits(5, 0, 15, 10)
    assert one(spark, g.iou(a, b)) == pytest.approx(0.818182, abs=1e-6)
    assert one(spark, g.iou(a, c)) == pytest.approx(1 / 3, abs=1e-6)
    assert one(spark, g.box_gap(a, lits(13, 14, 20, 20))) == 5.0
    assert one(spark, g.containment(lits(2, 2, 4, 4), a)) == 1.0
    m = g.compose_affine([1, 0, 5, 0, 1, 7], [2, 0, 0, 0, 2, 0])
    assert [one(spark, c) for c in g.apply_affine(m, *lits(3, 4))] == [11.0, 15.0]


def test_segments(spark):
    hit = one(spark, g.intersection(*lits(0, 0, 10, 10, 0, 10, 10, 0)))
    assert (hit.x, hit.y) == (5, 5)
    touch = lits(0, 0, 10, 0, 5, 0, 5, 5)
    assert one(spark, g.intersection(*touch)).x == 5
    assert one(spark, g.intersection(*touch, closed=False)) is None
    assert one(spark, g.intersection(*lits(0, 0, 1, 0, 0, 1, 1, 1))) is None


def ring(*points):
    return F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points))


def test_room_area_and_perimeter(spark):
    room = ring((0, 0), (10000, 0), (10000, 8000), (0, 8000))
    assert one(spark, g.ring_area(room)) / 1e6 == 80
    assert one(spark, g.ring_perimeter(room)) / 1000 == 36
    assert one(spark, g.point_in_ring(F.lit(1.0), F.lit(1.0), room)) is True
    assert one(spark, g.point_in_ring(F.lit(-1.0), F.lit(1.0), room)) is False


def test_reverberation(spark):
    rooms = spark.createDataFrame([(80.0, 36.0, 0.04)], "area double, perimeter double, alpha double")
    r = rules.reverberation(rooms, 3.0).first()
    assert r.formula == "sabine" and r.t60 == pytest.approx(3.604478, abs=1e-6) and r.edt == pytest.approx(3.063806, abs=1e-6)


def test_nesting(spark):
    sq = lambda a, b: [(float(a), float(a)), (float(b), float(a)), (float(b), float(b)), (float(a), float(b))]
    rows = [(1, sq(0, 30)), (2, sq(10, 20)), (3, sq(14, 16))]
    rings = spark.createDataFrame(rows, "ring_id long, points array<struct<x:double,y:double>>")
    got = {r.ring_id: (r.parent_id, r.depth) for r in graphs.nesting(rings, None).collect()}
    assert got == {1: (None, 0), 2: (1, 1), 3: (2, 2)}


def test_suppression(spark):
    rows = [(1, 0, 0.9, 0.0, 0.0, 10.0, 10.0), (2, 0, 0.8, 1.0, 0.0, 11.0, 10.0), (3, 0, 0.7, 5.0, 0.0, 15.0, 10.0)]
    b = spark.createDataFrame(rows, "id long, page int, score double, x0 double, y0 double, x1 double, y1 double")
    assert {r.id for r in selection.suppress(b, ["page"], 0.5).collect()} == {1, 3}
    assert {r.id for r in selection.suppress(b, ["page"], 0.5, cap=1).collect()} == {1}


def test_snap_chain(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.8, 0.0), (3, 1.6, 0.0), (4, 9.0, 0.0)], "id long, x double, y double")
    got = {r.id: (r.component, round(r.sx, 6)) for r in rules.snap(p, 1.0).collect()}
    assert got == {1: (1, 0.8), 2: (1, 0.8), 3: (1, 0.8), 4: (4, 9.0)}


def test_open_square(spark):
    s = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 0.0), (2, 10.0, 0.0, 10.0, 10.0), (3, 10.0, 10.0, 0.0, 10.0)], "id long, x0 double, y0 double, x1 double, y1 double")
    assert {(r.id, r.end) for r in spatial.open_ends(s, 0.5).collect()} == {(1, 0), (3, 1)}


@pytest.mark.parametrize("seed", range(3))
def test_overlaps_of_mixed_sizes(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for k in range(120):
        x, y, s = rnd.uniform(-500, 500), rnd.uniform(-500, 500), rnd.choice([0.0, 3, 40, 600])
        rows.append((k, x, y, x + s, y + s * rnd.random()))
    b = spark.createDataFrame(rows, "id long, x0 double, y0 double, x1 double, y1 double")
    got = sorted((r.id, r.r_id) for r in spatial.overlap_pairs(b, b, 20.0, pad=1.0).filter("id < r_id").collect())
    meet = lambda p, q: p[1] <= q[3] + 1 and q[1] - 1 <= p[3] and p[2] <= q[4] + 1 and q[2] - 1 <= p[4]
    assert got == sorted((p[0], q[0]) for p in rows for q in rows if p[0] < q[0] and meet(p, q))


def test_components_of_chain_and_empty(spark):
    n = 300
    e = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.component for r in graphs.components(e).collect()}
    assert set(got.values()) == {0, 1000} and len(got) == n + 3
    assert graphs.components(e.limit(0)).count() == 0


def test_block_cycle(spark):
    inserts = spark.createDataFrame([("r", "A")], "root string, block string")
    children = spark.createDataFrame([("A", "e1", None), ("A", "e2", "B"), ("B", "e3", None), ("B", "e4", "A")], "block string, entity string, child string")
    assert sorted((r.entity, r.depth) for r in graphs.expand_blocks(inserts, children).collect()) == [("e1", 0), ("e3", 1)]


def test_intervals_and_runs(spark):
    rows = spark.createDataFrame([("g", 0.0, 2.0), ("g", 3.0, 5.0), ("g", 7.0, 8.0)], "k string, lo double, hi double")
    assert sorted((r.lo, r.hi) for r in selection.merge_intervals(rows, ["k"], 1).collect()) == [(0, 5), (7, 8)]
    n = spark.createDataFrame([("g", k) for k in (1, 2, 3, 7, 8, 10)], "k string, n long")
    assert sorted((r.lo, r.hi) for r in sets.runs(n, "k", "n").collect()) == [(1, 3), (7, 8), (10, 10)]


def test_metric_cases(spark):
    low, high = metrics.wilson(F.lit(0.8), F.lit(50.0))
    assert one(spark, low) == pytest.approx(0.669626, abs=1e-6) and one(spark, high) == pytest.approx(0.887564, abs=1e-6)
    s = lambda *v: spark.createDataFrame([(x,) for x in v], "k long")
    r = metrics.relation_metrics(s(1, 2, 3), s(2, 3, 4), ["k"]).first()
    assert (r.tp, r.fp, r.fn) == (2, 1, 1) and r.f1 == pytest.approx(2 / 3)
    assert metrics.relation_metrics(s().limit(0) if False else s(1).limit(0), s(1).limit(0), ["k"]).first().f1 == 1.0
    assert one(spark, F.levenshtein(F.lit("kitten"), F.lit("sitting"))) == 3


def test_leakage(spark):
    rows = spark.createDataFrame([("a", "train"), ("b", "train"), ("b", "dev"), ("c", "dev"), ("d", "locked")], "k string, s string")
    assert [(r.a, r.b, r.n) for r in sets.leakage(rows, "k", "s").collect()] == [("dev", "train", 1)]


def test_degree_types(spark):
    d = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 5)], "degree long")
    assert [r.t for r in d.select(graphs.degree_type(F.col("degree")).alias("t")).collect()] == ["endpoint", "L", "T", "X", "multi"]


def test_text_rules(spark):
    assert one(spark, tx.label_tokens(F.lit("WallType-Door_02"))) == ["wall", "type", "door", "02"]
    assert one(spark, tx.style_map(F.lit("fill: red;stroke:a:b"))) == {"fill": "red", "stroke": "a:b"}
    assert one(spark, tx.error_rate(F.lit(""), F.lit(""))) == 0.0
    assert one(spark, tx.confidence(F.lit("1.7"))) == 1.0 and one(spark, tx.confidence(F.lit("x"), 0.25)) == 0.25
    assert one(spark, rules.is_wall_layer(F.lit("a-wall-ext"))) and not one(spark, rules.is_wall_layer(F.lit("DOOR")))


def test_breaker():
    b = service.Breaker(2, 10.0)
    assert [b.see(t, f) for t, f in ((0, True), (1, True), (5, False), (12, False), (13, True))] == ["closed", "open", "open", "closed", "closed"]
    h = service.Breaker(1, 10.0)
    assert [h.see(t, f) for t, f in ((0, True), (11, True), (12, False))] == ["open", "open", "open"]


def test_streams(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    src = str(tmp_path / "in")
    spark.read.parquet(f"{sf}/events.parquet").limit(500).write.parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    failed = stream.withColumn("failed", F.col("event_type") == "error")
    for name, df in (("w", service.windowed_metrics(stream, "ts", "value", "event_type")), ("b", service.breaker_stream(failed, "user_id", "ts", 2, 3600.0))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        q.stop()
    rows = spark.table("b")
    assert rows.count() == 500 and {r.state for r in rows.select("state").distinct().collect()} <= {"closed", "open", "half_open"}
    assert "p99" in spark.table("w").columns


def test_orientation_of_near_collinear(spark):
    assert one(spark, g.orientation(*lits(0, 0, 1, 1, 2, 2), 1e-9)) == 0
    assert one(spark, g.orientation(*lits(0, 0, 1, 0, 0, 1))) == 1
    assert math.isclose(one(spark, g.aic(F.lit(1.0), F.lit(10.0), 2)), 4 + 10 * math.log(2 * math.pi * (1 + 1e-10)) + 10)


def test_crowded_cells_are_dealt(spark, monkeypatch):
    """Right rows of crowded cells in several parts give the same pairs, each once."""
    import random

    rnd = random.Random(8)
    rows = [(i, x, y, x + rnd.choice((1.0, 9.0, 70.0)), y + rnd.choice((1.0, 9.0, 70.0))) for i, (x, y) in enumerate((rnd.uniform(0, 90), rnd.uniform(0, 90)) for _ in range(120))]
    b = spark.createDataFrame(rows, "id long, x0 double, y0 double, x1 double, y1 double")
    monkeypatch.setattr(spatial, "PART_ROWS", 3)
    got = sorted((r.id, r.r_id) for r in spatial.overlap_pairs(b, b, 20.0, dealt=True).collect())
    assert got == sorted((p[0], q[0]) for p in rows for q in rows if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4])
