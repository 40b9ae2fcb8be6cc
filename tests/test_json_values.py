"""Nested JSON values against a recursion in Python."""

import json
import random

from sheetloom.operators import json_values


def _walk(value, place=(), path="$"):
    yield place, path, json.dumps(value, separators=(",", ":"), sort_keys=True)
    if isinstance(value, dict):
        for i, k in enumerate(sorted(value)):
            yield from _walk(value[k], (*place, i), f"{path}.{k}")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from _walk(v, (*place, i), f"{path}[{i}]")


def _any(rng, depth):
    pick = rng.random()
    if depth and pick < 0.35:
        return {rng.choice("abcdef"): _any(rng, depth - 1) for _ in range(rng.randrange(4))}
    if depth and pick < 0.7:
        return [_any(rng, depth - 1) for _ in range(rng.randrange(4))]
    return rng.choice([None, True, False, 0, -17, 12.5, "", "text", 'with "quotes" and {braces}', "null"])


def test_walk(spark):
    rng = random.Random(6)
    values = [_any(rng, 5) for _ in range(60)]
    rows = [(i, json.dumps(v)) for i, v in enumerate(values)] + [(100, None), (101, "{broken"), (102, "")]
    got = json_values.walk_values(spark.createDataFrame(rows, "id int, t string"), "id", "t").collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.id, r.place)):
        by.setdefault(r.id, []).append((tuple(r.place), r.path, r.value))
    assert by == {i: list(_walk(v)) for i, v in enumerate(values)}
    kinds = {dict: "object", list: "array", str: "string", bool: "boolean", int: "number", float: "number", type(None): "null"}
    assert all(r.kind == kinds[type(json.loads(r.value))] for r in got) and {r.kind for r in got} == set(kinds.values())
