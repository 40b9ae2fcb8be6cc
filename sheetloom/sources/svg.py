"""Annotated SVG files: nested elements with their transforms, labels by alias, exact boxes, and one record a drawing."""

from __future__ import annotations

import io
import math
import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import _texts

#: Chords of a curve of a path.
CHORDS = 16
NAMES = ("class", "id", "data-name", "name")
_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
ELEMENTS = "path string, ord int, ancestors array<int>, tag string, tokens array<string>, hidden boolean, font_size double, matrix array<double>, centre array<double>, closed boolean, points array<struct<x:double,y:double>>, text string"


def numbers(text: str | None) -> list[float]:
    return [float(x) for x in re.findall(_NUMBER, text or "")]


def product(m: tuple, n: tuple) -> tuple:
    """First n, then m; each is a, b, c, d, e, f for x' = a x + c y + e and y' = b x + d y + f."""
    return (m[0] * n[0] + m[2] * n[1], m[1] * n[0] + m[3] * n[1], m[0] * n[2] + m[2] * n[3], m[1] * n[2] + m[3] * n[3], m[0] * n[4] + m[2] * n[5] + m[4], m[1] * n[4] + m[3] * n[5] + m[5])


def transform_of(text: str | None) -> tuple:
    """The matrix of a transform attribute, its steps applied from the last to the first."""
    out = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    for name, args in re.findall(r"(\w+)\s*\(([^)]*)\)", text or ""):
        v = numbers(args)
        if name == "matrix" and len(v) == 6:
            step = tuple(v)
        elif name == "translate" and v:
            step = (1, 0, 0, 1, v[0], v[1] if len(v) > 1 else 0)
        elif name == "scale" and v:
            step = (v[0], 0, 0, v[1] if len(v) > 1 else v[0], 0, 0)
        elif name == "rotate" and v:
            c, s = math.cos(math.radians(v[0])), math.sin(math.radians(v[0]))
            step = (c, s, -s, c, 0, 0)
            if len(v) == 3:
                step = product(product((1, 0, 0, 1, v[1], v[2]), step), (1, 0, 0, 1, -v[1], -v[2]))
        elif name == "skewX" and v:
            step = (1, 0, math.tan(math.radians(v[0])), 1, 0, 0)
        elif name == "skewY" and v:
            step = (1, math.tan(math.radians(v[0])), 0, 1, 0, 0)
        else:
            continue
        out = product(out, step)
    return tuple(map(float, out))


def _arc(p: complex, rx: float, ry: float, turn: float, large: bool, sweep: bool, q: complex) -> list[complex]:
    """Points of an elliptic arc from p to q, by its end points as SVG defines it."""
    if p == q or not rx or not ry:
        return [q]
    rx, ry, spin = abs(rx), abs(ry), complex(math.cos(math.radians(turn)), math.sin(math.radians(turn)))
    h = (p - q) / 2 / spin
    over = (h.real / rx) ** 2 + (h.imag / ry) ** 2
    if over > 1:
        rx, ry = rx * math.sqrt(over), ry * math.sqrt(over)
    part = rx * rx * h.imag**2 + ry * ry * h.real**2
    k = math.sqrt(max(0.0, (rx * rx * ry * ry - part) / part)) * (1 if large != sweep else -1)
    c = complex(k * rx * h.imag / ry, -k * ry * h.real / rx)
    a0, a1 = (math.atan2((u - c).imag / ry, (u - c).real / rx) for u in (h, -h))
    if sweep and a1 < a0:
        a1 += 2 * math.pi
    if not sweep and a1 > a0:
        a1 -= 2 * math.pi
    n = max(1, math.ceil(abs(a1 - a0) / (math.pi / CHORDS)))
    angles = [a0 + (a1 - a0) * i / n for i in range(1, n)]
    return [(complex(rx * math.cos(a), ry * math.sin(a)) + c) * spin + (p + q) / 2 for a in angles] + [q]


def path_points(data: str | None) -> tuple[list[complex], bool]:
    """Points of path data, curves as chords, and whether its last part is closed; reading stops at what is no command."""
    tokens = re.findall(rf"[A-Za-z]|{_NUMBER}", data or "")
    out, at, start, last, command, i, closed = [], 0j, 0j, None, None, 0, False

    def take(n):
        nonlocal i
        v = [float(t) for t in tokens[i : i + n]]
        if len(v) < n:
            raise ValueError("numbers are missing")
        i += n
        return v

    try:
        while i < len(tokens):
            if tokens[i].isalpha():
                command, i = tokens[i], i + 1
            elif command in (None, "Z", "z"):
                break
            kind, base = command.upper(), at if command.islower() else 0j
            if kind == "Z":
                at, closed, last = start, True, None
                out.append(at)
                continue
            closed = False
            if kind in "MLT":
                x, y = take(2)
                to = base + complex(x, y)
                if kind == "T":
                    control = 2 * at - last[1] if last and last[0] == "Q" else at
                    out += [_bezier([at, control, to], t / CHORDS) for t in range(1, CHORDS + 1)]
                    at, last = to, ("Q", control)
                    continue
                out.append(to)
                if kind == "M":
                    start, command = to, "l" if command == "m" else "L"
                at, last = to, None
            elif kind in "HV":
                (v,) = take(1)
                at = complex(v + base.real, at.imag) if kind == "H" else complex(at.real, v + base.imag)
                out.append(at)
                last = None
            elif kind in "CSQ":
                v = take({"C": 6, "S": 4, "Q": 4}[kind])
                p = [base + complex(v[k], v[k + 1]) for k in range(0, len(v), 2)]
                if kind == "S":
                    p.insert(0, 2 * at - last[1] if last and last[0] == "C" else at)
                out += [_bezier([at, *p], t / CHORDS) for t in range(1, CHORDS + 1)]
                last, at = ("Q" if kind == "Q" else "C", p[-2]), p[-1]
            elif kind == "A":
                rx, ry, turn, large, sweep, x, y = take(7)
                to = base + complex(x, y)
                out += _arc(at, rx, ry, turn, bool(large), bool(sweep), to)
                at, last = to, None
            else:
                break
    except ValueError:
        pass
    return out, closed


def _bezier(p: list[complex], t: float) -> complex:
    while len(p) > 1:
        p = [a + (b - a) * t for a, b in zip(p, p[1:], strict=False)]
    return p[0]


def _shape(tag: str, e: ET.Element, font: float | None) -> tuple[list[float] | None, bool, list[complex]]:
    """Centre and radii of a round shape, whether the outline is closed, and its points."""
    at = lambda name, other=0.0: (numbers(e.get(name)) or [other])[0]
    if tag in ("circle", "ellipse"):
        rx, ry = (at("r"), at("r")) if tag == "circle" else (at("rx"), at("ry"))
        return [at("cx"), at("cy"), rx, ry], True, []
    if tag == "line":
        return None, False, [complex(at("x1"), at("y1")), complex(at("x2"), at("y2"))]
    if tag in ("polygon", "polyline"):
        v = numbers(e.get("points"))
        return None, tag == "polygon", [complex(a, b) for a, b in zip(v[::2], v[1::2], strict=False)]
    if tag == "path":
        points, closed = path_points(e.get("d"))
        return None, closed, points
    if tag == "rect" or (tag == "image" and e.get("width")):
        x, y, w, h = at("x"), at("y"), at("width"), at("height")
        return None, True, [complex(x, y), complex(x + w, y), complex(x + w, y + h), complex(x, y + h)]
    if tag == "text":
        x, y, size, n = at("x"), at("y"), font or 12.0, len("".join(e.itertext()).strip())
        w = 0.6 * size * n
        return None, True, [complex(x, y - size), complex(x + w, y - size), complex(x + w, y), complex(x, y)] if n else []
    return None, False, []


def elements_of(text: str) -> list[tuple]:
    """Elements of one document in its order, with what they have from those around them; files that do not parse and those
    that declare entities have none. A stack stands for the nesting, so depth is no limit."""
    if "<!ENTITY" in text:
        return []
    out, stack = [], [((), (1.0, 0.0, 0.0, 1.0, 0.0, 0.0), False, None)]
    try:
        for event, e in ET.iterparse(io.BytesIO(text.encode()), ("start", "end")):
            if event == "start":
                above, matrix, hidden, font = stack[-1]
                style = e.get("style") or ""
                hidden = hidden or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*(hidden|collapse)", style)) or e.get("display") == "none" or e.get("visibility") in ("hidden", "collapse")
                font = (numbers(e.get("font-size")) or numbers((re.search(r"font-size\s*:\s*([^;]+)", style) or [None, None])[1]) or [font])[0]
                stack.append(((*above, len(out)), product(matrix, transform_of(e.get("transform"))), hidden, font))
                out.append(None)
            else:
                own, matrix, hidden, font = stack.pop()
                tag = e.tag.rsplit("}", 1)[-1]
                tokens = [t for name in NAMES for t in re.split(r"[\s,;]+", e.get(name) or "") if t]
                centre, closed, points = _shape(tag, e, font)
                words = " ".join("".join(e.itertext()).split()) if tag == "text" else None
                out[own[-1]] = (own[-1], list(own[-2::-1]), tag, tokens, hidden, font, list(matrix), centre, closed, [{"x": p.real, "y": p.imag} for p in points], words)
    except ET.ParseError:
        return []
    return out


def read_svg_elements(spark: SparkSession, path: str) -> DataFrame:
    """(path, ord, ancestors, tag, tokens, hidden, font_size, matrix, centre, closed, points, text): every element of SVG files.

    ancestors go from the nearest outwards, as ord; tokens are the words of class, id, data-name and name; matrix takes the
    element's own coordinates to the drawing's. Round shapes have centre (cx, cy, rx, ry), others points. A file is one row before."""

    def run(frames):
        for pdf in frames:
            for name, text in zip(pdf["path"], pdf["text"], strict=True):
                rows = [(name, *e) for e in elements_of(text)]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in ELEMENTS.split(", ")])

    return _texts(spark, path).mapInPandas(run, ELEMENTS)


def with_boxes(elements: DataFrame, least_area: float = 0.0) -> DataFrame:
    """Visible elements that have a shape, with x0, y0, x1, y1 in the drawing and points there; round shapes' boxes are exact.

    Shapes whose own box is smaller than least_area go."""
    m = [F.col("matrix")[k] for k in range(6)]
    moved = F.transform("points", lambda p: F.struct((m[0] * p["x"] + m[2] * p["y"] + m[4]).alias("x"), (m[1] * p["x"] + m[3] * p["y"] + m[5]).alias("y")))
    c = [F.col("centre")[k] for k in range(4)]
    cx, cy = m[0] * c[0] + m[2] * c[1] + m[4], m[1] * c[0] + m[3] * c[1] + m[5]
    w, h = F.sqrt((m[0] * c[2]) ** 2 + (m[2] * c[3]) ** 2), F.sqrt((m[1] * c[2]) ** 2 + (m[3] * c[3]) ** 2)
    side = lambda f, col, axis: f(F.transform(col, lambda p: p[axis]))
    span = lambda axis: side(F.array_max, "points", axis) - side(F.array_min, "points", axis)
    area = F.when(F.col("centre").isNotNull(), 4 * c[2] * c[3]).otherwise(span("x") * span("y"))
    shown = elements.filter(~F.col("hidden") & (F.col("centre").isNotNull() | (F.size("points") > 0))).filter(area >= least_area)
    out = shown.withColumn("points", moved)
    box = {"x0": (cx - w, F.array_min, "x"), "y0": (cy - h, F.array_min, "y"), "x1": (cx + w, F.array_max, "x"), "y1": (cy + h, F.array_max, "y")}
    return out.withColumns({k: F.when(F.col("centre").isNotNull(), own).otherwise(side(f, "points", axis)) for k, (own, f, axis) in box.items()})


#: Rows of an alias table that is sent to every task, at most.
MOST_ALIASES = 10_000


def with_labels(elements: DataFrame, aliases: DataFrame) -> DataFrame:
    """elements with label, family, raw_label: by the alias (token, label, family, priority) of greatest priority among the element's
    tokens, the first token on ties, else those of the nearest ancestor that has one, else null.

    Tokens match without case and signs. elements must still hold the groups that labels come from."""
    if aliases.limit(MOST_ALIASES + 1).count() > MOST_ALIASES:
        raise ValueError("the alias table is too large to be sent to every task")
    plain = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
    known = aliases.select(plain(F.col("token")).alias("t"), "label", "family", "priority")
    tokens = elements.select("path", "ord", F.posexplode("tokens").alias("k", "raw_label")).withColumn("t", plain(F.col("raw_label")))
    best = F.max_by(F.struct("label", "family", "raw_label"), F.struct("priority", -F.col("k"), "family"))
    own = tokens.join(F.broadcast(known), "t").groupBy("path", "ord").agg(best.alias("own"))
    line = elements.select("path", "ord", F.posexplode(F.concat(F.array("ord"), "ancestors")).alias("up", "of"))
    named = line.join(own.withColumnRenamed("ord", "of"), ["path", "of"]).groupBy("path", "ord").agg(F.min_by("own", "up").alias("own"))
    return elements.join(named, ["path", "ord"], "left").select(*(F.col(c) for c in elements.columns), "own.label", "own.family", "own.raw_label")


def drawing_records(labelled: DataFrame) -> DataFrame:
    """(path, boundaries, rooms, symbols, texts, dimensions, label_counts) of labelled shapes with boxes: one nested record a drawing, bounded by it."""
    item = F.struct("ord", "label", "raw_label", "tag", F.array("x0", "y0", "x1", "y1").alias("box"), "text", "font_size")
    part = lambda ok: F.array_sort(F.collect_list(F.when(ok, item)))
    family = F.col("family")
    rows = labelled.filter("family is not null").groupBy("path").agg(
        part(family == "boundary").alias("boundaries"), part(family == "space").alias("rooms"), part(family == "symbol").alias("symbols"), part(family == "text").alias("texts"),
        part((family == "text") & F.startswith("label", F.lit("dimension_"))).alias("dimensions"), F.collect_list("label").alias("all"),
    )
    counts = F.map_from_entries(F.transform(F.array_sort(F.array_distinct("all")), lambda name: F.struct(name, F.size(F.filter("all", lambda x: x == name)))))
    return rows.withColumn("label_counts", counts).drop("all")
