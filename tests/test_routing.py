"""Routed records and expert rules by worked cases, update queues against a plain restatement."""

import random

import pytest
from pyspark.sql import functions as F

from sheetloom.operators import routing
from sheetloom.streaming import updates


def test_records_from_json_lines(spark, tmp_path):
    from sheetloom.sources import files

    (tmp_path / "r.jsonl").write_text(
        '{"record_id": "a", "text_candidates": [{"text_type": "room label", "confidence": 1.7}, {"type": "", "bbox": [0, 0, 0.4, 0.2], "confidence": "bad"}, null], "request_hints": {"text_candidates": [{"id": "unused"}], "symbol_candidates": [{"target_id": "s", "symbol_type": "blob", "bbox": [0, 0, 0.5, 0.5]}, {"symbol_type": "blob", "bbox": [0, 0, 0.5]}],'
        ' "primitive_graph": {"nodes": [{"id": "n", "semantic_type": "Door-Leaf", "confidence": 0.2}, {"bbox": [0, 0, 9, 9]}]}}}\n\n{"record_id": "b"}\n'
    )
    got = {(r.source, r.place): r for r in routing.route_records(files.read_jsonl(spark, str(tmp_path / "r.jsonl"), routing.RECORD)).collect()}
    pick = lambda *k: (got[k].candidate_id, got[k].expert, got[k].candidate_type, got[k].confidence, got[k].matched_hint, got[k].abstain)
    assert len(got) == 6
    assert pick("primitives", 0) == ("n", "wall_opening", "door-leaf", 1.0, "door", False)
    assert pick("primitives", 1) == ("primitive_1", "wall_opening", "primitive", 0.3, None, True)
    assert pick("text_candidates", 0) == ("text_0", "text_dimension", "room_label", 1.0, "label", False)
    assert pick("text_candidates", 1) == ("text_1", "text_dimension", "text", 1.0, "text", False)
    assert pick("symbol_candidates", 0) == ("s", "room_space", "blob", 1.0, "large_region_bbox", False)
    assert pick("symbol_candidates", 1) == ("symbol_1", "symbol_fixture", "blob", 0.3, None, True) and got["symbol_candidates", 1].bbox is None


def test_text_scores(spark):
    rows = [("Kitchen", 0, 0), ("WC", 0, 0), ("12x4", 0, 0), ("R 12", 0, 0), ("12.5", 0, 0), ("", 12, 20), (None, 12, 20), ("--", 8, 20), ("Fünf", 0, 0), ("a" * 26, 0, 0)]
    d = spark.createDataFrame(rows, "t string, w int, h int").select(*routing.text_scores(F.col("t"), F.col("w"), F.col("h")))
    got = [(r.dimension_text, r.leader_line, r.note_text, r.room_label) for r in d.collect()]
    assert got == [(0, 0, 0.4, 0.9), (0, 0, 0.3, 0.9), (0.95, 0, 0, 0), (0, 0, 0.8, 0), (0, 0, 0, 0), (0, 0.6, 0, 0), (0, 0.6, 0, 0), (0, 0, 0, 0), (0, 0, 0.3, 0.9), (0, 0, 0.4, 0)]


def test_sheet_parts(spark):
    rows = [("Project title", 800, 700, 990, 790), ("DOOR list", 100, 100, 400, 300), ("Key plan", 850, 400, 950, 500), ("revision", 700, 10, 720, 25), ("Contractor shall", 50, 100, 90, 700), ("Contractor shall", 500, 100, 600, 700), (None, 0, 0, 0, 0)]
    d = spark.createDataFrame(rows, "t string, x0 int, y0 int, x1 int, y1 int")
    got = [tuple(r) for r in d.select(*routing.sheet_part(F.col("t"), *(F.col(c) for c in ("x0", "y0", "x1", "y1")), F.lit(1000), F.lit(800))).collect()]
    assert got == [("title_block", 0.92), ("schedule", 0.88), ("legend", 0.85), ("stamp", 0.82), ("notes", 0.8), ("notes", 0.5), ("notes", 0.5)]


def _events(n, users, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        op = rng.choices(["mark", "next", "view", "clear", "other"], [12, 4, 3, 1, 1])[0]
        x, y = rng.randint(0, 60), rng.randint(0, 60)
        wide = 25 if op == "view" else rng.randint(1, 9)
        rows.append((rng.randrange(users), i, op, float(i // 3), i, rng.choice([0, 1, 2, 3, None] if rng.random() < 0.1 else [0, 1, 2, 3]), rng.choice([None, 4.0, 20.0]), float(x) if rng.random() > 0.05 else None, float(y), float(x + wide), float(y + wide)))
    return rows


SCHEMA = "user int, seq long, op string, at double, entity long, priority int, lasts double, x0 double, y0 double, x1 double, y1 double"


def _restated(rows, most_tasks, most_boxes):
    """The queue as a list searched whole, boxes joined by repeated passes over all pairs."""
    waiting, dirty, out = {}, {}, []
    for user, seq, op, at, entity, priority, lasts, *box in sorted(rows, key=lambda r: (r[3], r[1])):
        tasks, boxes = waiting.setdefault(user, []), dirty.setdefault(user, [])
        whole = None not in box
        if op == "mark" and priority is not None:
            if whole:
                boxes.append(box)
                if len(boxes) > most_boxes:
                    boxes[:] = [[min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)]]
            if len(tasks) == most_tasks:
                tasks.sort(key=lambda t: (t[0], t[1]))
                tasks.pop()
            tasks.append((priority, seq, at, entity, lasts))
        elif op == "next":
            skipped, found = 0, (None, None, None)
            for t in sorted(tasks, key=lambda t: (t[0], t[1])):
                tasks.remove(t)
                if t[4] is None or at - t[2] <= t[4]:
                    found = (t[3], t[0], at - t[2])
                    break
                skipped += 1
            out.append((user, seq, op, *found, skipped, len(tasks), None))
        elif op == "view" and whole:
            groups = [list(b) for b in boxes if b[0] <= box[2] and box[0] <= b[2] and b[1] <= box[3] and box[1] <= b[3]]
            again = True
            while again:
                again = False
                for i, a in enumerate(groups):
                    for j in range(i + 1, len(groups)):
                        b = groups[j]
                        if a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]:
                            groups = [g for k, g in enumerate(groups) if k not in (i, j)] + [[min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])]]
                            again = True
                            break
                    if again:
                        break
            out.append((user, seq, op, None, None, None, 0, len(tasks), sorted(groups)))
        elif op == "clear":
            boxes.clear()
    return sorted(out, key=lambda r: r[:2])


@pytest.mark.parametrize("users", [1, 5])
def test_update_results(spark, users):
    rows = _events(900, users, users)
    d = spark.createDataFrame(rows, SCHEMA)
    got = sorted((tuple(r) for r in updates.update_results(d, "user", 6, 7).collect()), key=lambda r: r[:2])
    want = _restated(rows, 6, 7)
    assert got == want and any(r[6] for r in want) and any(len(r[8] or []) > 1 for r in want)
    assert updates.update_results(d.limit(0), "user").count() == 0


def test_update_stream(spark, tmp_path):
    rows = _events(300, 4, 9)
    for part in range(3):
        spark.createDataFrame(rows[part * 100 : part * 100 + 100], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = updates.update_stream(stream, "user", 6, 7).writeStream.format("memory").queryName("updates").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = sorted((tuple(r) for r in spark.table("updates").collect()), key=lambda r: r[:2])
    assert len(q.recentProgress) >= 3 and got == _restated(rows, 6, 7)


def test_query_of_updates(spark, sf):
    """The registered query against the restatement over its whole table."""
    from sheetloom.plans import feature_queries as fq

    e = [(r.user_id, r.event_id, r.ts, r.value or 0.0) for r in spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).collect()]
    rows = []
    for user, i, at, v in e:
        op = "clear" if i % 29 == 28 else "next" if i % 4 == 3 else "view" if i % 9 == 8 else "mark"
        wide = 150.0 if op == "view" else 6.0
        rows.append((user, i, op, at, i, i % 5 % 4, 21600.0 if i % 3 == 0 else None, v, v * 7 % 200, v + wide, v * 7 % 200 + wide))
    got = sorted((tuple(r) for r in fq.stm_06_updates(spark, sf).collect()), key=lambda r: r[:2])
    want = _restated(rows, 16, 8)
    assert len(want) > 100 and any(r[6] for r in want) and any(len(r[8] or []) > 1 for r in want)
    assert got == want
