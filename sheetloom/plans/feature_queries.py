"""Queries of placed drawings, graph features, routed candidates and update queues over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import graph_features, json_values, routing, symbols
from ..sources import entities
from ..streaming import updates
from .tables import BOXES, SEGMENTS, boxes, read, segments

QUERIES, ORACLES = {}, {}


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _parts(spark: SparkSession, d: str) -> DataFrame:
    """A drawing of every hundred segments: lines at the top and in three blocks, references at the top and in two blocks that
    hold each other; one block that references name is missing."""
    r, none = F.col("id") % 20, F.lit(None)
    s = segments(spark, d).select("*", r.alias("r"))
    block = F.when(F.col("r") < 10, F.concat(F.lit("B"), (F.col("id") % 3).cast("string"))).when(F.col("r").isin(10, 11), "B0").when(F.col("r") == 18, "B1")
    kind = F.when((F.col("r") < 10) | (F.col("r") >= 16) & (F.col("r") != 18), "LINE").otherwise("INSERT")
    name = F.when(F.col("r").isin(10, 11), "B1").when(F.col("r") == 18, "B0").when(kind == "INSERT", F.concat(F.lit("B"), (F.col("id") % 4).cast("string")))
    numbers = F.when(kind == "INSERT", F.create_map(F.lit(41), F.lit(0.5), F.lit(42), F.lit(-2.0), F.lit(50), F.col("x1")))
    return s.select(
        F.floor(F.col("id") / 100).cast("string").alias("path"), F.col("id").alias("ord"), block.alias("block"), kind.alias("entity_type"), "layer", F.lit(False).alias("closed"), F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y"))).alias("points"),
        F.array(F.lit(0.0)).alias("bulges"), F.col("x1").alias("x2"), F.col("y1").alias("y2"), name.alias("name"), numbers.alias("numbers"), none.cast("array<double>").alias("knots"), none.cast("array<double>").alias("weights"), none.cast("int").alias("degree"),
    )


@register("src_07_placed_edges", f"""WITH {SEGMENTS}, s AS (SELECT *, id // 100 AS path, id % 20 AS r, 0.5 * cos(radians(x1)) AS a, 2 * sin(radians(x1)) AS b, 0.5 * sin(radians(x1)) AS c, -2 * cos(radians(x1)) AS e FROM segments),
l AS (SELECT path, id, 'B' || id % 3 AS block, layer, x0, y0, x1, y1 FROM s WHERE r < 10), t AS (SELECT *, 'B' || id % 4 AS name FROM s WHERE r BETWEEN 12 AND 15), n AS (SELECT *, CASE WHEN r = 18 THEN 'B1' ELSE 'B0' END AS block, CASE WHEN r = 18 THEN 'B0' ELSE 'B1' END AS name FROM s WHERE r IN (10, 11, 18)),
m AS (SELECT path, id AS ord, name, 1 AS depth, a, b, x0 AS tx, c, e, y0 AS ty FROM t UNION ALL
    SELECT t.path, t.id, n.name, 2, t.a*n.a + t.b*n.c, t.a*n.b + t.b*n.e, t.a*n.x0 + t.b*n.y0 + t.x0, t.c*n.a + t.e*n.c, t.c*n.b + t.e*n.e, t.c*n.x0 + t.e*n.y0 + t.y0 FROM t JOIN n ON n.path = t.path AND n.block = t.name)
SELECT path::VARCHAR AS path, id AS ord, NULL::BIGINT AS ref, 0 AS depth, layer, 0 AS k, round(x0, 4) AS x0, round(y0, 4) AS y0, round(x1, 4) AS x1, round(y1, 4) AS y1 FROM s WHERE r IN (16, 17, 19) UNION ALL
SELECT m.path::VARCHAR, ord, l.id, depth, layer, 0, round(a*x0 + b*y0 + tx, 4), round(c*x0 + e*y0 + ty, 4), round(a*x1 + b*y1 + tx, 4), round(c*x1 + e*y1 + ty, 4) FROM m JOIN l ON l.path = m.path AND l.block = m.name""")
def src_07_placed_edges(spark, d):
    e = entities.drawn_edges(_parts(spark, d))
    return e.select("path", "ord", "ref", "depth", "layer", "k", *(F.round(c, 4).alias(c) for c in ("x0", "y0", "x1", "y1")))


def _polylines(spark: SparkSession, d: str) -> DataFrame:
    """Three points of each vector on a grid of ten, a hundred polylines to a drawing, so that many points coincide."""
    at = lambda k: F.round(F.get("embedding", F.lit(k - 1)).cast("double") * 20) * 10
    p = F.array(*(F.struct(at(2 * i + 1).alias("x"), at(2 * i + 2).alias("y")) for i in range(3)))
    return read(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 100).alias("drawing"), F.col("vec_id").alias("poly"), F.posexplode(p).alias("idx", "p")).select("drawing", "poly", "idx", "p.x", "p.y")


GRAPH = """q AS (SELECT vec_id // 100 AS drawing, vec_id AS poly, unnest([0, 1, 2]) AS i, unnest([embedding[1], embedding[3], embedding[5]]) AS ex, unnest([embedding[2], embedding[4], embedding[6]]) AS ey FROM embeddings),
p AS (SELECT drawing, poly, i, round(ex::DOUBLE * 20) * 10 + 0.0 AS x, round(ey::DOUBLE * 20) * 10 + 0.0 AS y FROM q),
n0 AS (SELECT drawing, x, y, min(poly * 3 + i) AS f, count(DISTINCT poly) AS memberships FROM p GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY drawing ORDER BY f) - 1 AS idx, f % 3 = 1 AS mid FROM n0),
s AS (SELECT drawing, poly, i, x, y, lead(x) OVER w AS tx, lead(y) OVER w AS ty FROM p WINDOW w AS (PARTITION BY poly ORDER BY i)),
l AS (SELECT s.drawing, s.poly, s.i AS k, a.idx AS src, b.idx AS dst, sqrt((tx-s.x)*(tx-s.x)+(ty-s.y)*(ty-s.y)) AS length, atan2(ty-s.y, tx-s.x) AS angle FROM s JOIN n a ON a.drawing = s.drawing AND a.x = s.x AND a.y = s.y JOIN n b ON b.drawing = s.drawing AND b.x = tx AND b.y = ty WHERE a.idx <> b.idx),
w AS (SELECT drawing, src AS u, dst AS v FROM l UNION SELECT drawing, dst, src FROM l), j AS (SELECT DISTINCT a.drawing, a.v AS src, b.v AS dst FROM w a JOIN w b ON a.drawing = b.drawing AND a.u = b.u AND a.v < b.v),
e AS (SELECT *, 'line' AS kind FROM l UNION ALL SELECT j.drawing, NULL, NULL, j.src, j.dst, sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)), atan2(b.y-a.y, b.x-a.x), 'adjacent' FROM j ANTI JOIN w ON w.drawing = j.drawing AND w.u = j.src AND w.v = j.dst JOIN n a ON a.drawing = j.drawing AND a.idx = j.src JOIN n b ON b.drawing = j.drawing AND b.idx = j.dst)"""


def _vector(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(*keys, F.posexplode("features").alias("f", "value")).select(*keys, "f", F.round("value", 6).alias("value"))


@register("prj_33_node_vectors", f"""WITH {GRAPH}, d AS (SELECT drawing, idx, count(*) AS degree FROM (SELECT drawing, src AS idx FROM e UNION ALL SELECT drawing, dst FROM e) GROUP BY ALL),
b AS (SELECT drawing, min(x) AS lx, min(y) AS ly, greatest(max(x) - min(x), 1e-6) AS w, greatest(max(y) - min(y), 1e-6) AS h FROM n GROUP BY drawing), t AS (SELECT n.*, coalesce(degree, 0) AS degree, (x - lx) / w AS fx, (y - ly) / h AS fy FROM n JOIN b USING (drawing) LEFT JOIN d USING (drawing, idx)),
v AS (SELECT drawing, idx, [fx, fy, CASE WHEN mid THEN 0.5 ELSE (degree <= 1)::INT END, CASE WHEN mid THEN 0.5 ELSE (degree = 2)::INT END, (NOT mid AND degree = 3)::INT, (NOT mid AND degree = 4)::INT, (NOT mid AND degree > 4)::INT, degree / 10, memberships / 5, 0, 0.1] AS a FROM t)
SELECT drawing, idx, unnest(range(11))::INT AS f, round(unnest(a), 6) AS value FROM v""")
def prj_33_node_vectors(spark, d):
    return _vector(graph_features.node_vectors(graph_features.polyline_graph(_polylines(spark, d), 0.5)[0]), ["drawing", "idx"])


@register("prj_34_edge_vectors", f"""WITH {GRAPH}, v AS (SELECT drawing, src, dst, [(kind = 'line')::INT, 0, (kind = 'adjacent')::INT, 0, length / 1000, (cos(angle) + 1) / 2, (sin(angle) + 1) / 2, (poly IS NOT NULL)::INT, 0, 0, 0] AS a FROM e)
SELECT drawing, src, dst, unnest(range(11))::INT AS f, round(unnest(a), 6) AS value FROM v""")
def prj_34_edge_vectors(spark, d):
    return _vector(graph_features.edge_vectors(graph_features.polyline_graph(_polylines(spark, d), 0.5)[1]), ["drawing", "src", "dst"])


@register("prj_35_coo", f"WITH {GRAPH} SELECT drawing, src, dst FROM e UNION SELECT drawing, dst, src FROM e")
def prj_35_coo(spark, d):
    return graph_features.coo(graph_features.polyline_graph(_polylines(spark, d), 0.5)[1], both_ways=True)


def _pick(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


#: Kinds of candidates and texts on sheets that meet the rules in every way.
KINDS = ["wall-line", "text note", "Sheet", "stair icon", "room_polygon", "blob", "title_text", ""]
SHEET_TEXTS = ["Room 12", "KITCHEN", "bath", "3.20 x 4.10", "900×2100", "Door schedule", "a", "LEGEND of symbols", "Revision B, checked", "", "General note: verify on site", "PROJECT title, scale 1:50", "12.5", "wc_1", "Finish & area", "living room and dining room", " - "]


@register("prj_37_routed", f"""WITH i AS (SELECT l_orderkey, l_linenumber, ['primitives','text_candidates','symbol_candidates','semantic_regions','layout_regions'][l_partkey % 5 + 1] AS source, ['boundary','text','symbol','space','sheet'][l_partkey % 5 + 1] AS default_,
    CASE WHEN l_suppkey % 3 > 0 THEN 'c' || l_linenumber END AS id, nullif({KINDS}[l_partkey % 8 + 1], '') AS kind, l_discount * 10 * l_tax * 10 AS area, greatest(0, least(1, l_quantity / 40)) AS given, l_partkey, l_suppkey, l_extendedprice, l_quantity FROM lineitem),
p AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, source ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS place, replace(lower(coalesce(kind, CASE WHEN source = 'primitives' THEN 'primitive' ELSE default_ END)), ' ', '_') AS candidate_type FROM i),
t AS (SELECT *, string_split(replace(candidate_type, '-', '_'), '_') AS t, source <> 'primitives' AND area >= 0.08 AS large FROM p),
m AS (SELECT *, list_min(list_intersect(t, ['text','ocr','dimension','leader','callout','note','label'])) AS h1, list_min(list_intersect(t, ['title','table','schedule','legend','stamp','sheet'])) AS h2, list_min(list_intersect(t, ['symbol','fixture','furniture','stair','column','equipment','icon'])) AS h3,
    list_min(list_intersect(t, ['room','space','area','region','polygon','closed'])) AS h4, list_min(list_intersect(t, ['wall','door','window','opening','line','polyline','boundary'])) AS h5 FROM t),
f AS (SELECT *, CASE WHEN h1 IS NOT NULL THEN 'text' WHEN h2 IS NOT NULL THEN 'sheet' WHEN h3 IS NOT NULL THEN 'symbol' WHEN h4 IS NOT NULL THEN 'space' WHEN h5 IS NOT NULL THEN 'boundary' WHEN large THEN 'space' ELSE default_ END AS family, coalesce(h1, h2, h3, h4, h5, CASE WHEN large THEN 'large_region_bbox' END) AS matched_hint FROM m)
SELECT l_orderkey AS record_id, source, place::INT AS place, coalesce(id, CASE WHEN source = 'primitives' THEN 'primitive' ELSE family END || '_' || place) AS candidate_id, CASE family WHEN 'boundary' THEN 'wall_opening' WHEN 'space' THEN 'room_space' WHEN 'symbol' THEN 'symbol_fixture' WHEN 'text' THEN 'text_dimension' ELSE 'sheet_layout' END AS expert,
    family, candidate_type, round(CASE WHEN matched_hint IS NULL THEN 0.3 WHEN source = 'primitives' THEN 1 ELSE given END, 6) AS confidence, matched_hint, matched_hint IS NULL AS abstain FROM f""")
def prj_37_routed(spark, d):
    part, none = F.col("l_partkey"), F.lit(None).cast("string")
    box = F.array(F.lit(0.0), F.lit(0.0), (F.col("l_discount") * 10).cast("double"), (F.col("l_tax") * 10).cast("double"))
    kind = _pick(KINDS, part)
    odd = F.col("l_linenumber") % 2 == 1
    c = F.struct(
        F.when(F.col("l_suppkey") % 3 > 0, F.concat(F.lit("c"), F.col("l_linenumber").cast("string"))).alias("id"), none.alias("target_id"), F.when(odd, kind).alias("type"), F.when(~odd, kind).alias("semantic_type"), none.alias("symbol_type"),
        none.alias("layout_type"), none.alias("text_type"), none.alias("label"), box.alias("bbox"), (F.col("l_quantity") / 40).cast("string").alias("confidence"),
    )
    mine = lambda k: F.transform(F.array_sort(F.collect_list(F.when(part % 5 == k, F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", c.alias("c"))))), lambda r: r["c"])
    lists = list(routing.LISTS)
    # Every other record has its lists in its hints.
    r = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("record_id")).agg(mine(0).alias("nodes"), *(mine(k + 1).alias(n) for k, n in enumerate(lists)))
    own = F.col("record_id") % 2 == 0
    hints = F.struct(F.struct("nodes").alias("primitive_graph"), *(F.when(~own, F.col(n)).alias(n) for n in lists))
    return routing.route_records(r.select("record_id", *(F.when(own, F.col(n)).alias(n) for n in lists), hints.alias("request_hints"))).drop("bbox").withColumn("confidence", F.round("confidence", 6))


@register("prj_38_text_scores", f"""WITH t AS (SELECT p_partkey AS id, {SHEET_TEXTS}[p_partkey % {len(SHEET_TEXTS)} + 1] || CASE WHEN p_size % 5 = 0 THEN ' ' || p_name ELSE '' END AS s, p_size % 30 AS w, p_size % 20 + 8 AS h FROM part),
n AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(lower(s), '[\\s_\\-]+', ' ', 'g'), '[^a-z0-9\\s.]', '', 'g'), '\\s+', ' ', 'g')) AS n FROM t), l AS (SELECT *, replace(replace(n, ' ', ''), '.', '') AS l, contains(n, 'x') OR contains(s, '×') AS cross_ FROM n), k AS (SELECT *, regexp_matches(l, '^[a-z]+$') AS alpha, length(l) AS k, n <> '' AND NOT cross_ AS other FROM l)
SELECT id, 0.0::DOUBLE AS dimension_line, CASE WHEN n <> '' AND cross_ THEN 0.95 ELSE 0 END AS dimension_text, CASE WHEN n = '' AND w BETWEEN 9 AND 15 AND h BETWEEN 14 AND 25 THEN 0.6 ELSE 0 END AS leader_line,
    CASE WHEN other AND regexp_matches(s, '[0-9]') AND regexp_matches(s, '[a-zA-Z]') THEN 0.8 WHEN other AND alpha AND k > 5 THEN 0.4 WHEN other AND alpha AND k BETWEEN 2 AND 4 THEN 0.3 ELSE 0 END AS note_text, CASE WHEN other AND alpha AND k <= 25 THEN 0.9 ELSE 0 END AS room_label FROM k""")
def prj_38_text_scores(spark, d):
    text = F.concat(_pick(SHEET_TEXTS, F.col("p_partkey")), F.when(F.col("p_size") % 5 == 0, F.concat(F.lit(" "), F.col("p_name"))).otherwise(""))
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), *routing.text_scores(text, F.col("p_size") % 30, F.col("p_size") % 20 + 8))


@register("prj_39_sheet_parts", f"""WITH {BOXES}, t AS (SELECT id, lower({SHEET_TEXTS}[id % {len(SHEET_TEXTS)} + 1]) AS s, x0 + 400 AS x0, y0 + 400 AS y0, x1 + 400 AS x1, y1 + 400 AS y1 FROM boxes),
g AS (SELECT *, (800 - y1) / 800 AS below, (1000 - x1) / 1000 AS rite, x0 / 1000 AS lft, y0 / 800 AS above, (x1-x0)*(y1-y0)/800000 AS share, greatest((x1-x0)/(y1-y0), (y1-y0)/(x1-x0)) AS long_ FROM t),
k AS (SELECT id, CASE WHEN below < 0.15 AND rite < 0.35 AND share > 0.01 AND regexp_matches(s, 'title|project|drawing|scale|date|sheet') THEN 1 WHEN regexp_matches(s, 'schedule|room|door|area|finish|qty|type') AND share > 0.02 AND long_ < 3 THEN 2 WHEN rite < 0.2 AND (y0+y1)/2 > 240 AND regexp_matches(s, 'legend|symbol|key|note') THEN 3
    WHEN share < 0.02 AND long_ < 2 AND regexp_matches(s, 'revision|approval|stamp|date|checked') THEN 4 WHEN lft < 0.1 AND above > 0.05 AND regexp_matches(s, 'general note|specification|contractor|verify') THEN 5 ELSE 6 END AS k FROM g)
SELECT id, ['title_block','schedule','legend','stamp','notes','notes'][k] AS label, [0.92, 0.88, 0.85, 0.82, 0.8, 0.5][k]::DOUBLE AS confidence FROM k""")
def prj_39_sheet_parts(spark, d):
    at = [F.col(c) + 400 for c in ("x0", "y0", "x1", "y1")]
    return boxes(spark, d).select("id", *routing.sheet_part(_pick(SHEET_TEXTS, F.col("id")), *at, F.lit(1000.0), F.lit(800.0)))


@register("stm_06_updates")
def stm_06_updates(spark, d):
    """Every user's events as marks, with a next, a view and now and then a clear between them; every third task lasts six hours at most."""
    i, v = F.col("event_id"), F.coalesce("value", F.lit(0.0))
    op = F.when(i % 29 == 28, "clear").when(i % 4 == 3, "next").when(i % 9 == 8, "view").otherwise("mark")
    wide = F.when(op == "view", 150.0).otherwise(6.0)
    e = read(spark, d, "events").select("user_id", i.alias("seq"), op.alias("op"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), i.alias("entity"), (i % 5 % 4).cast("int").alias("priority"), F.when(i % 3 == 0, 21600.0).alias("lasts"), v.alias("x0"), (v * 7 % 200).alias("y0"), (v + wide).alias("x1"), (v * 7 % 200 + wide).alias("y1"))
    return updates.update_results(e, "user_id", 16, 8)


#: Shapes of eight by eight pixels.
TEMPLATES = {"ring": [(i % 8, i // 8) for i in range(64) if {i % 8, i // 8} & {0, 7}], "slash": [(i, 7 - i) for i in range(8)], "corner": [(0, 0), (1, 0), (0, 1)]}
_SHAPES = ", ".join(f"('{n}', {x}, {y})" for n, p in TEMPLATES.items() for x, y in p)


@register("ra_26_symbols", f"""WITH g AS (SELECT vec_id AS image, unnest(range(len(embedding))) AS k, least(255, greatest(0, floor(unnest(embedding)::DOUBLE * 400 + 128))) AS v FROM embeddings), p AS (SELECT image, k % 8 AS x, k // 8 AS y FROM g WHERE v < 128), t(symbol, x, y) AS (VALUES {_SHAPES}),
d AS (SELECT image, symbol, p.x AS px, p.y AS py, t.x AS tx, t.y AS ty, sqrt((p.x-t.x)*(p.x-t.x)+(p.y-t.y)*(p.y-t.y)) AS d FROM p, t), a AS (SELECT image, symbol, min(d) AS d FROM d GROUP BY image, symbol, px, py UNION ALL SELECT image, symbol, min(d) FROM d GROUP BY image, symbol, tx, ty)
SELECT image, symbol, round(1 - max(d) / 32, 6) AS confidence FROM a GROUP BY image, symbol HAVING 1 - max(d) / 32 >= 0.85""")
def ra_26_symbols(spark, d):
    grey = F.transform("embedding", lambda e: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(e.cast("double") * 400 + 128))).cast("int"))
    images = read(spark, d, "embeddings").select(F.col("vec_id").alias("image"), grey.alias("grey"))
    return symbols.detect(images, 8, TEMPLATES, 0.85).select("image", "symbol", F.round("confidence", 6).alias("confidence"))


@register("flt_20_clipped_lines", f"""WITH {SEGMENTS}, d AS (SELECT *, x1 - x0 AS dx, y1 - y0 AS dy FROM segments),
t AS (SELECT *, CASE WHEN dx > 0 THEN (-60 - x0) / dx WHEN dx < 0 THEN (40 - x0) / dx WHEN x0 BETWEEN -60 AND 40 THEN 0 ELSE 2 END AS a, CASE WHEN dx > 0 THEN (40 - x0) / dx WHEN dx < 0 THEN (-60 - x0) / dx ELSE 1 END AS b,
    CASE WHEN dy > 0 THEN (-30 - y0) / dy WHEN dy < 0 THEN (70 - y0) / dy WHEN y0 BETWEEN -30 AND 70 THEN 0 ELSE 2 END AS c, CASE WHEN dy > 0 THEN (70 - y0) / dy WHEN dy < 0 THEN (-30 - y0) / dy ELSE 1 END AS e FROM d),
m AS (SELECT *, greatest(0, a, c) AS t0, least(1, b, e) AS t1 FROM t)
SELECT id, round(x0 + dx * t0, 6) AS x0, round(y0 + dy * t0, 6) AS y0, round(CASE WHEN t1 = 1 THEN x1 ELSE x0 + dx * t1 END, 6) AS x1, round(CASE WHEN t1 = 1 THEN y1 ELSE y0 + dy * t1 END, 6) AS y1 FROM m WHERE t0 <= t1""")
def flt_20_clipped_lines(spark, d):
    part = g.clip_segment(*(F.col(c) for c in ("x0", "y0", "x1", "y1")), [-60.0, -30.0, 40.0, 70.0])
    s = segments(spark, d).select("id", part.alias("p")).filter("p is not null")
    return s.select("id", *(F.round(f"p.{c}", 6).alias(c) for c in ("x0", "y0", "x1", "y1")))


@register("sf_16_json_values", """WITH e AS (SELECT event_id AS id, '"' || event_type || '"' AS t, replace(props, ' ', '') AS p FROM events WHERE props IS NOT NULL AND event_type IS NOT NULL),
d AS (SELECT *, '[' || t || ',' || id || ',{"c":null}]' AS b FROM e), v AS (SELECT id, unnest([('', '$', 'object', '{"a":' || p || ',"b":' || b || ',"d":[],"f":' || (id % 2 = 0)::VARCHAR || '}'), ('0', '$.a', 'object', p), ('0,0', '$.a.k', 'number', p[6:-2]), ('1', '$.b', 'array', b), ('1,0', '$.b[0]', 'string', t), ('1,1', '$.b[1]', 'number', id::VARCHAR),
    ('1,2', '$.b[2]', 'object', '{"c":null}'), ('1,2,0', '$.b[2].c', 'null', 'null'), ('2', '$.d', 'array', '[]'), ('3', '$.f', 'boolean', (id % 2 = 0)::VARCHAR)]) AS r FROM d) SELECT id, r[1] AS place, r[2] AS path, r[3] AS kind, r[4] AS value FROM v""")
def sf_16_json_values(spark, d):
    i = F.col("event_id").cast("string")
    text = F.concat(F.lit('{"f": '), (F.col("event_id") % 2 == 0).cast("string"), F.lit(', "b": ["'), "event_type", F.lit('", '), i, F.lit(', {"c": null}], "a": '), "props", F.lit(', "d": [ ]}'))
    w = json_values.walk_values(read(spark, d, "events").select(F.col("event_id").alias("id"), text.alias("t")), "id", "t")
    return w.withColumn("place", F.concat_ws(",", F.transform("place", lambda p: p.cast("string"))))
