"""Layer, unit, text and record rule queries over the test tables, each with the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import layers as ly
from ..functions import text as tx
from ..operators import evaluation, rules
from .tables import BOXES, LAYERS, SEGMENTS, boxes, layers, read, segments

QUERIES, ORACLES = {}, {}


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


r6 = lambda c, n: F.round(c, 6).alias(n)


def _fits(words: list[str], starts: list[str] = ()) -> str:
    esc = lambda w: w.replace("&", "&")
    return "regexp_matches(upper(layer), '" + "|".join([*map(esc, words), *(f"^{esc(p)}" for p in starts)]) + "')"


DOOR, WINDOW, OPENING = _fits(["DOOR", "门"], ["D-"]), _fits(["WINDOW", "窗", "GLAZ", "GLASS"], ["A-WIND", "W-"]), _fits(["OPEN", "开口", "HOLE", "洞", "GATE", "通道"])
WALL = _fits(["WALL", "墙", "STRUCT", "结构", "COLUMN", "柱", "BEAM", "梁", "STRUC"], ["A-WALL", "S-WALL", "S-STRC", "A-COLS"])
FURNITURE = _fits(ly.FURNITURE_WORDS)
FIXTURE = _fits(ly.BATHROOM_WORDS + ly.KITCHEN_WORDS + ly.HVAC_WORDS + ly.ELECTRIC_WORDS + ly.FIXTURE_WORDS, ["A-FURN", "FF&E"])


@register("flt_05_layer_kinds", f"WITH {LAYERS} SELECT id, {DOOR} AS door, {WINDOW} AS win, {OPENING} AS opening, {DOOR} OR {WINDOW} OR {OPENING} AS any_opening, {FURNITURE} AS furniture, {_fits(ly.DIMENSION_WORDS)} AS dimension, {FIXTURE} AS fixture FROM layers")
def flt_05_layer_kinds(spark, d):
    n = F.col("layer")
    return layers(spark, d).select("id", ly.is_door(n).alias("door"), ly.is_window(n).alias("win"), ly.is_opening(n).alias("opening"), ly.is_door_or_window(n).alias("any_opening"), ly.is_furniture(n).alias("furniture"), ly.is_dimension(n).alias("dimension"), ly.is_fixture(n).alias("fixture"))


@register("flt_01_layer_modes", f"WITH {LAYERS} SELECT 'walls' AS mode, id FROM layers WHERE {WALL} UNION ALL SELECT 'openings', id FROM layers WHERE {DOOR} OR {WINDOW} OR {OPENING} UNION ALL SELECT 'architectural', id FROM layers WHERE {WALL} OR {DOOR} OR {WINDOW} OR {OPENING} UNION ALL SELECT 'furniture', id FROM layers WHERE {FURNITURE} UNION ALL SELECT 'all', id FROM layers UNION ALL SELECT 'list', id FROM layers WHERE contains(layer, 'A-') UNION ALL SELECT 'custom', id FROM layers WHERE {_fits(['SOFA', 'GATE'])}")
def flt_01_layer_modes(spark, d):
    rows, out = layers(spark, d), None
    for name, mode, listed, custom in (("walls", "walls", [], []), ("openings", "openings", [], []), ("architectural", "architectural", [], []), ("furniture", "furniture", [], []), ("all", "all", [], []), ("list", "walls", ["A-"], []), ("custom", "custom", [], ["SOFA", "GATE"])):
        part = rows.filter(ly.layer_passes(F.col("layer"), mode, listed, custom)).select(F.lit(name).alias("mode"), "id")
        out = part if out is None else out.union(part)
    return out


@register("flt_09_layer_list", f"WITH {LAYERS} SELECT DISTINCT layer FROM layers")
def flt_09_layer_list(spark, d):
    return rules.layer_list(layers(spark, d))


@register("flt_11_edge_lengths", f"WITH {SEGMENTS}, s AS (SELECT *, sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)) AS n FROM segments) SELECT 'zero' AS rule, id FROM s WHERE n >= 0.0001 UNION ALL SELECT 'short', id FROM s WHERE n >= 100")
def flt_11_edge_lengths(spark, d):
    s = segments(spark, d)
    return rules.without_zero_length(s).select(F.lit("zero").alias("rule"), "id").union(rules.without_short(s, 100.0).select(F.lit("short"), "id"))


@register("prj_22_semantic_rules", f"WITH {LAYERS} SELECT id, CASE WHEN {DOOR} THEN 'door' WHEN {WINDOW} THEN 'window' WHEN {OPENING} THEN 'opening' ELSE 'hard_wall' END AS semantic, CASE WHEN {WALL} THEN 'hard_wall' WHEN {DOOR} THEN 'door' WHEN {WINDOW} THEN 'window' WHEN {OPENING} THEN 'opening' WHEN NOT {FIXTURE} THEN NULL WHEN {_fits(ly.BATHROOM_WORDS)} THEN 'bathroom_fixture' WHEN {_fits(ly.KITCHEN_WORDS)} THEN 'kitchen_fixture' WHEN {_fits(ly.HVAC_WORDS)} THEN 'hvac' WHEN {_fits(ly.ELECTRIC_WORDS)} THEN 'electrical' ELSE 'furniture' END AS kind FROM layers")
def prj_22_semantic_rules(spark, d):
    return layers(spark, d).select("id", ly.semantic(F.col("layer")).alias("semantic"), ly.semantic_or_null(F.col("layer")).alias("kind"))


@register("prj_24_materials", f"WITH {LAYERS} SELECT id, ['concrete','brick','wood','gypsum','glass','metal','default_wall'][color] AS by_color, CASE WHEN {_fits(['CONC', '混凝土'])} THEN 'concrete' WHEN {_fits(['BRICK', '砖'])} THEN 'brick' WHEN {_fits(['WOOD', '木'])} THEN 'wood' WHEN {_fits(['GLASS', 'GLAZ', '玻璃'])} THEN 'glass' WHEN {_fits(['METAL', 'STEEL', '钢', '金属'])} THEN 'metal' WHEN {_fits(['GYPSUM', '石膏'])} THEN 'gypsum' END AS by_layer FROM layers")
def prj_24_materials(spark, d):
    return layers(spark, d).select("id", ly.material_of_color(F.col("color")).alias("by_color"), ly.material_of_layer(F.col("layer")).alias("by_layer"))


@register("prj_01_units", f"WITH {LAYERS} SELECT id, CASE WHEN (unit IN ('m','inch','cm') AND size > 10000) OR (unit = 'foot' AND size > 1000) OR (unit IN ('yard','point','pica') AND size > 5000) OR (unit = 'micron' AND size > 1000000) THEN 'mm' WHEN unit = 'mm' AND size < 10 AND size * 1.5 < 100 THEN 'm' WHEN unit = 'mile' AND size > 100 THEN 'kilometer' WHEN unit = 'kilometer' AND size < 1 THEN 'm' ELSE unit END AS real_unit, unit IN ('inch') AND size > 10000 AS mismatch, round(coalesce(MAP {{'mm':0.5,'cm':0.05,'m':0.0005,'inch':0.02,'foot':0.0016,'yard':0.00055,'mile':0.00000031,'micron':500.0,'kilometer':0.0000005,'point':1.42,'pica':0.118}}[unit], 0.5)::DOUBLE * CASE WHEN size > 10000 THEN 10 WHEN size < 100 THEN 0.1 ELSE 1 END * CASE color % 3 WHEN 0 THEN 10 WHEN 1 THEN 1 ELSE 0.1 END, 9) AS tolerance FROM layers")
def prj_01_units(spark, d):
    u, size = F.col("unit"), F.col("size")
    precision = F.when(F.col("color") % 3 == 0, "rough").when(F.col("color") % 3 == 1, "normal").otherwise("fine")
    return layers(spark, d).select("id", ly.true_unit(u, size, size * 1.5).alias("real_unit"), ly.unit_mismatch(u, size).alias("mismatch"), F.round(ly.adaptive_tolerance(u, size, precision), 9).alias("tolerance"))


@register("prj_26_opening_width", f"WITH {SEGMENTS}, n AS (SELECT id, sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)) * 10 AS n FROM segments) SELECT id, CASE WHEN n / 1000 >= 0.5 AND n / 1000 <= 5 THEN round(n / 1000, 6) END AS width FROM n")
def prj_26_opening_width(spark, d):
    from ..functions import geometry as g

    n = g.distance(*map(F.col, ("x0", "y0", "x1", "y1"))) * 10
    return segments(spark, d).select("id", r6(ly.opening_width(n), "width"))


@register("prj_27_line_widths", f"WITH {BOXES}, w AS (SELECT unnest([0.0,0.05,0.09,0.13,0.15,0.18,0.2,0.25,0.3,0.35,0.4,0.5,0.53,0.6,0.7,0.8,0.9,1.0,1.06,1.2,1.4,1.58,2.0,2.11])::DOUBLE AS w, unnest(range(24)) AS i) SELECT id, (SELECT i FROM w ORDER BY abs(score * 5 - w), i LIMIT 1)::INT AS place FROM boxes")
def prj_27_line_widths(spark, d):
    return boxes(spark, d).select("id", ly.snap_line_width(F.col("score") * 5).cast("int").alias("place"))


@register("prj_28_line_styles", "WITH s AS (SELECT p_partkey, ['CONTINUOUS','dashed','ACAD_ISO03W100','DashDot','DIVIDE','CENTER','ZIGZAG'][p_partkey % 7 + 1] AS name FROM part) SELECT p_partkey, CASE upper(name) WHEN 'CONTINUOUS' THEN 'solid' WHEN 'DASHED' THEN 'dashed' WHEN 'ACAD_ISO03W100' THEN 'dotted' WHEN 'DASHDOT' THEN 'dash_dot' WHEN 'DIVIDE' THEN 'dash_dot_dot' WHEN 'CENTER' THEN 'long_dash_dot' END AS style FROM s")
def prj_28_line_styles(spark, d):
    names = F.array(*map(F.lit, ["CONTINUOUS", "dashed", "ACAD_ISO03W100", "DashDot", "DIVIDE", "CENTER", "ZIGZAG"]))
    return read(spark, d, "part").select("p_partkey", ly.line_style(F.element_at(names, (F.col("p_partkey") % 7 + 1).cast("int"))).alias("style"))


@register("prj_17_relative", f"WITH {SEGMENTS}, o AS (SELECT layer, (min(least(x0,x1)) + max(greatest(x0,x1)))/2 AS ox, (min(least(y0,y1)) + max(greatest(y0,y1)))/2 AS oy FROM segments GROUP BY layer) SELECT id, round(ox, 6) AS ox, round(oy, 6) AS oy, round((x0-ox)::FLOAT::DOUBLE, 3) AS rx, round((y0-oy)::FLOAT::DOUBLE, 3) AS ry FROM segments JOIN o USING (layer)")
def prj_17_relative(spark, d):
    out = rules.relative_coordinates(segments(spark, d), "layer")
    return out.select("id", r6("ox", "ox"), r6("oy", "oy"), F.round(F.col("rx0").cast("double"), 3).alias("rx"), F.round(F.col("ry0").cast("double"), 3).alias("ry"))


@register("prj_21_calibration", f"WITH {SEGMENTS} SELECT id, round(100.0 / nullif(sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)), 0), 6) AS scale FROM segments")
def prj_21_calibration(spark, d):
    return segments(spark, d).select("id", r6(rules.calibration_scale(*map(F.col, ("x0", "y0", "x1", "y1")), F.lit(100.0)), "scale"))


@register("prj_20_page_scaling", f"WITH {BOXES} SELECT id, round(x0 * 640 / 1000, 6) AS x0, round(y0 * 480 / 2000, 6) AS y0, round(x1 * 640 / 1000, 6) AS x1, round(y1 * 480 / 2000, 6) AS y1 FROM boxes")
def prj_20_page_scaling(spark, d):
    out = rules.scale_boxes(boxes(spark, d), F.lit(1000), F.lit(2000), F.lit(640), F.lit(480))
    return out.select("id", *(r6(c, c) for c in ("x0", "y0", "x1", "y1")))


@register("prj_36_router", "WITH t AS (SELECT p_partkey AS id, ['wall-line','text_note','sheet','stair icon','room_polygon','blob','title_text','column-wall'][p_partkey % 8 + 1] AS hint, p_size * 40 AS w FROM part), k AS (SELECT *, string_split(regexp_replace(hint, '[ -]', '_', 'g'), '_') AS t FROM t), f AS ( SELECT id, CASE WHEN list_has_any(t, ['text','ocr','dimension','leader','callout','note','label']) THEN 'text' WHEN list_has_any(t, ['title','table','schedule','legend','stamp','sheet']) THEN 'sheet' WHEN list_has_any(t, ['symbol','fixture','furniture','stair','column','equipment','icon']) THEN 'symbol' WHEN list_has_any(t, ['room','space','area','region','polygon','closed']) THEN 'space' WHEN list_has_any(t, ['wall','door','window','opening','line','polyline','boundary']) THEN 'boundary' WHEN w * w >= 1000000 THEN 'space' ELSE 'unknown' END AS family FROM k) SELECT id, family, family = 'unknown' AS abstain FROM f")
def prj_36_router(spark, d):
    hints = F.array(*map(F.lit, ["wall-line", "text_note", "sheet", "stair icon", "room_polygon", "blob", "title_text", "column-wall"]))
    t = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.element_at(hints, (F.col("p_partkey") % 8 + 1).cast("int")).alias("hint"), (F.col("p_size") * 40).alias("w"))
    family, abstain = rules.route_family(F.col("hint"), F.col("w") * F.col("w") >= 1_000_000, F.lit("unknown"))
    return t.select("id", family.alias("family"), abstain.alias("abstain"))


@register("ag_15_parse_quality", "WITH s AS (SELECT l_orderkey AS id, count(*) AS n, count_if(l_quantity > 10) AS ok, count_if(l_discount > 0.05) AS errors, count_if(l_tax > 0.04) AS warnings, max(l_linenumber) > 5 AS mismatch, count_if(l_linenumber % 2 = 0) AS flat FROM lineitem GROUP BY l_orderkey) SELECT id, round(greatest(0, least(1, 1 - (1 - ok / n) * 0.4 - least(0.3, errors * 0.05) - least(0.15, warnings * 0.01) - CASE WHEN mismatch THEN 0.1 ELSE 0 END - least(0.05, flat * 0.01))), 6) AS score, round(CASE WHEN ok + errors = 0 THEN 1 ELSE ok / (ok + errors) END, 6) AS recovery FROM s")
def ag_15_parse_quality(spark, d):
    s = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n"), F.count_if(F.col("l_quantity") > 10).alias("ok"), F.count_if(F.col("l_discount") > 0.05).alias("errors"), F.count_if(F.col("l_tax") > 0.04).alias("warnings"), (F.max("l_linenumber") > 5).alias("mismatch"), F.count_if(F.col("l_linenumber") % 2 == 0).alias("flat"))
    return s.select("id", r6(rules.parse_quality(*map(F.col, ("n", "ok", "errors", "warnings", "mismatch", "flat"))), "score"), r6(rules.recovery_rate(F.col("ok"), F.col("errors")), "recovery"))


@register("ag_01_dimensions", "SELECT event_type AS kind, count(*) AS n, round(min(CASE WHEN value > 0 THEN value END), 6) AS low, round(max(CASE WHEN value > 0 THEN value END), 6) AS high FROM events GROUP BY event_type")
def ag_01_dimensions(spark, d):
    out = rules.dimension_summary(read(spark, d, "events").select(F.col("event_type").alias("kind"), F.col("value").alias("measurement")))
    return out.select("kind", "n", r6("low", "low"), r6("high", "high"))


@register("ag_53_topology_score", "WITH c AS (SELECT l_orderkey AS id, count(*) AS n, sum(l_linenumber) AS e, count(DISTINCT l_suppkey) AS f FROM lineitem GROUP BY 1), r AS (SELECT id, greatest(0, CASE WHEN n > 0 THEN 1 - abs(4 - n) / n ELSE 1 END) AS v, greatest(0, CASE WHEN e > 0 THEN 1 - abs(9 - e) / e ELSE 1 END) AS w, greatest(0, CASE WHEN f > 0 THEN 1 - abs(3 - f) / f ELSE 1 END) AS x FROM c) SELECT id, round(100 * (0.3 * v + 0.4 * w + 0.3 * x), 6) AS score FROM r")
def ag_53_topology_score(spark, d):
    c = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("e"), F.count_distinct("l_suppkey").alias("f"))
    return c.select("id", r6(evaluation.topology_score([(F.col("n"), F.lit(4)), (F.col("e"), F.lit(9)), (F.col("f"), F.lit(3))]), "score"))


@register("wn_16_dashes", "SELECT l_orderkey AS id, count(*) >= 3 AND stddev_pop(l_quantity) / greatest(avg(l_quantity), 1e-6) < 0.3 AS dashed FROM lineitem GROUP BY 1")
def wn_16_dashes(spark, d):
    return read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(rules.is_dashed(F.col("l_quantity").cast("double")).alias("dashed"))


@register("sc_27_gap_class", f"WITH {SEGMENTS}, p AS (SELECT id, x0, y0, x1, y1, abs(x0*x1 + y0*y1) / nullif(sqrt(x0*x0+y0*y0) * sqrt(x1*x1+y1*y1), 0) AS c FROM segments) SELECT id, CASE WHEN c > 0.9 THEN 'collinear' WHEN c < 0.2 THEN 'orthogonal' WHEN c IS NULL THEN 'unknown' ELSE 'angled' END AS kind FROM p")
def sc_27_gap_class(spark, d):
    return segments(spark, d).select("id", rules.gap_class(F.lit(5.0), *map(F.col, ("x0", "y0", "x1", "y1"))).alias("kind"))


@register("sf_01_normal_text", "SELECT doc_id, translate(lower(text), 'öäå./-', 'oaa   ') AS t FROM documents")
def sf_01_normal_text(spark, d):
    return read(spark, d, "documents").select("doc_id", tx.fold_text(F.col("text")).alias("t"))


@register("sf_07_dimension_text", "WITH t AS (SELECT p_partkey, ['12.5','3,40 m','12 x 30','R 4.5','abc','2500mm','','Ø 20','1:50'][p_partkey % 9 + 1] AS t FROM part) SELECT p_partkey, regexp_full_match(replace(lower(trim(t)), ',', '.'), '\\d+(\\.\\d+)?\\s*(m|mm|cm|m2|m²)?|\\d+\\s*[x×]\\s*\\d+') AS is_dimension FROM t")
def sf_07_dimension_text(spark, d):
    texts = F.array(*map(F.lit, ["12.5", "3,40 m", "12 x 30", "R 4.5", "abc", "2500mm", "", "Ø 20", "1:50"]))
    return read(spark, d, "part").select("p_partkey", tx.looks_like_dimension(F.element_at(texts, (F.col("p_partkey") % 9 + 1).cast("int"))).alias("is_dimension"))


@register("sf_19_vectors", "SELECT l_orderkey * 10 + l_linenumber AS id, round(l_quantity::DOUBLE, 6) AS a, 0.0::DOUBLE AS b, round(l_tax::DOUBLE, 6) AS c FROM lineitem")
def sf_19_vectors(spark, d):
    m = F.create_map(F.lit("q"), F.col("l_quantity").cast("double"), F.lit("t"), F.col("l_tax").cast("double"))
    v = read(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), tx.feature_vector(m, ["q", "missing", "t"]).alias("v"))
    return v.select("id", r6(F.col("v")[0], "a"), r6(F.col("v")[1], "b"), r6(F.col("v")[2], "c"))


@register("sf_21_path_group", "WITH p AS (SELECT p_partkey, 'plans/' || p_partkey || ['_rot90.png','_rot180.png','.png','-r270.png'][p_partkey % 4 + 1] AS path FROM part) SELECT p_partkey, regexp_replace(path, '[-_](rot|r)(90|180|270)(\\.[a-z]+)$', '\\3') AS base FROM p")
def sf_21_path_group(spark, d):
    tails = F.array(*map(F.lit, ["_rot90.png", "_rot180.png", ".png", "-r270.png"]))
    path = F.concat(F.lit("plans/"), F.col("p_partkey"), F.element_at(tails, (F.col("p_partkey") % 4 + 1).cast("int")))
    return read(spark, d, "part").select("p_partkey", tx.without_rotation(path).alias("base"))


@register("prj_43_plain_mtext", "WITH t AS (SELECT p_partkey, 1 AS t FROM part) SELECT p_partkey, '\\H2.5;' || p_name || chr(10) || chr(10) || ';x' AS plain FROM t JOIN part USING (p_partkey)")
def prj_43_plain_mtext(spark, d):
    t = F.concat(F.lit("{\\H2.5;"), F.col("p_name"), F.lit("}\\P\\C1;x "))
    return read(spark, d, "part").select("p_partkey", tx.plain_mtext(t).alias("plain"))


@register("sf_12_pdf_string", "SELECT p_partkey, 'a(' || p_partkey || ')' || chr(10) || 'A\\' AS s FROM part")
def sf_12_pdf_string(spark, d):
    raw = F.concat(F.lit("a\\("), F.col("p_partkey").cast("string"), F.lit("\\)\\n\\101\\\\"))
    return read(spark, d, "part").select("p_partkey", tx.unescape_pdf(raw).alias("s"))


@register("sf_28_set_overlap", "WITH s AS (SELECT l_orderkey AS id, list(DISTINCT l_suppkey % 7) AS a, list(DISTINCT l_partkey % 7) AS b FROM lineitem GROUP BY 1) SELECT id, round(len(list_intersect(a, b)) / len(list_distinct(a || b)), 6) AS iou, round(len(list_intersect(a, b)) / least(len(a), len(b)), 6) AS overlap FROM s")
def sf_28_set_overlap(spark, d):
    s = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set(F.col("l_suppkey") % 7).alias("a"), F.collect_set(F.col("l_partkey") % 7).alias("b"))
    iou, overlap = tx.set_overlap(F.col("a"), F.col("b"))
    return s.select("id", r6(iou, "iou"), r6(overlap, "overlap"))


@register("sc_29_softmax", f"WITH {BOXES}, s AS (SELECT id, score, exp(score) AS a, exp(-score) AS b, exp(0.5) AS c FROM boxes) SELECT id, round(a/(a+b+c), 6) AS p, round(1/(1+exp(-score)), 6) AS q FROM s")
def sc_29_softmax(spark, d):
    from ..functions import geometry as g

    p = g.softmax(F.array(F.col("score"), -F.col("score"), F.lit(0.5)))
    return boxes(spark, d).select("id", r6(p[0], "p"), r6(g.sigmoid(F.col("score")), "q"))


@register("sc_07_incircle", f"WITH {SEGMENTS}, p AS (SELECT id, 0-x0 AS a, 0-y0 AS b, 100-x0 AS c, 0-y0 AS d, 0-x0 AS e, 100-y0 AS f FROM segments) SELECT id, sign((a*a+b*b)*(c*f-e*d) - (c*c+d*d)*(a*f-e*b) + (e*e+f*f)*(a*d-c*b))::INT AS side FROM p")
def sc_07_incircle(spark, d):
    from ..functions import geometry as g

    z, h = F.lit(0.0), F.lit(100.0)
    return segments(spark, d).select("id", g.incircle((z, z), (h, z), (z, h), (F.col("x0"), F.col("y0"))).alias("side"))


@register("sc_20_boxes", f"WITH {BOXES} SELECT id, round(greatest(0, least(50, x0)), 6) AS ux, round(greatest(x0 - 3, -100), 6) AS cx, round(4*pi()*abs((x1-x0)*(y1-y0))/power(2*(x1-x0+y1-y0), 2), 6) AS compact, round(0.5*x0 - 2*y0 + 7, 6) AS ax, round(10 + 2*4 + 3*(ln(2*pi()*(score*score+1e-10))+1) - 10 - 2*4, 6) AS aic FROM boxes")
def sc_20_boxes(spark, d):
    from ..functions import geometry as g

    b = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    page = [F.lit(v) for v in (-100.0, -100.0, 900.0, 900.0)]
    w, h = b[2] - b[0], b[3] - b[1]
    m = g.compose_affine([0.5, 0, 5, 0, 1, 0], [1, -4, 4, 0, 1, 1])
    return boxes(spark, d).select("id", r6(F.greatest(F.lit(0.0), g.union_box(b, [F.lit(50.0)] * 4)[0]), "ux"), r6(g.clip_box(g.expand_box(b, F.lit(3.0)), page)[0], "cx"), r6(g.compactness(w * h, 2 * (w + h)), "compact"), r6(g.apply_affine(m, b[0], b[1])[0], "ax"), r6(g.aic(F.col("score"), F.lit(3), 0), "aic"))


@register("ml_17_mask_scores", f"WITH {BOXES}, m AS (SELECT id, score, [score - 0.05, score, 2 * score]::DOUBLE[] AS p FROM boxes), q AS (SELECT id, score, p, list_filter(p, lambda x: x > 0.01) AS k, [1.0, 2.0, 3.0]::DOUBLE[] AS w, [p[1] > 0.05, p[2] > 0.05, p[3] > 0.05] AS a, [true, false, true] AS b FROM m) SELECT id, round(CASE WHEN len(k) = 0 THEN 0 ELSE list_avg(k) END, 6) AS objectness, round((a[1]::INT*1.0 + a[3]::INT*3.0) / greatest(1e-9, 1.0 + 3.0 + a[2]::INT*2.0), 6) AS weighted_iou, round(score * CASE WHEN len(k) = 0 THEN 0 ELSE list_avg(k) END * 0.5, 6) AS deployed FROM q")
def ml_17_mask_scores(spark, d):
    p = F.array(F.col("score") - 0.05, F.col("score"), 2 * F.col("score"))
    o = evaluation.mask_objectness(p)
    w = evaluation.weighted_mask_iou(F.transform(p, lambda x: x > 0.05), F.array(F.lit(True), F.lit(False), F.lit(True)), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)))
    return boxes(spark, d).select("id", r6(o, "objectness"), r6(w, "weighted_iou"), r6(F.col("score") * o * 0.5, "deployed"))


@register("flt_21_gate_report", f"WITH {BOXES}, g AS (SELECT label AS family, CASE WHEN score > 0.1 THEN 'pass' ELSE 'hold' END AS decision, list_filter([CASE WHEN score <= 0.1 THEN 'low' END, CASE WHEN x1-x0 > 60 THEN 'wide' END], lambda x: x IS NOT NULL) AS r FROM boxes), e AS (SELECT family, decision, unnest(r) AS reason FROM g UNION ALL SELECT family, decision, NULL FROM g WHERE len(r) = 0) SELECT family, decision, reason, count(*) AS n FROM e GROUP BY ALL")
def flt_21_gate_report(spark, d):
    reasons = F.filter(F.array(F.when(F.col("score") <= 0.1, "low"), F.when(F.col("x1") - F.col("x0") > 60, "wide")), lambda x: x.isNotNull())
    return rules.gate_report(boxes(spark, d).select(F.col("label").alias("family"), F.when(F.col("score") > 0.1, "pass").otherwise("hold").alias("decision"), reasons.alias("reasons")))


@register("sf_18_ontology", "SELECT p_partkey, CASE WHEN p_size % 5 IN (0, 1) THEN 'boundary' WHEN p_size % 5 = 2 THEN 'space' WHEN p_size % 5 = 3 THEN 'symbol' END AS family FROM part")
def sf_18_ontology(spark, d):
    names = F.element_at(F.array(*map(F.lit, ["wall", "door", "room", "sink", "blob"])), (F.col("p_size") % 5 + 1).cast("int"))
    return rules.named_by(read(spark, d, "part").select("p_partkey", names.alias("label")), {"boundary": ["wall", "door"], "space": ["room"], "symbol": ["sink"]}, "label", "family").select("p_partkey", "family")


@register("sf_17_parameters", "SELECT p_partkey, concat_ws(',', CASE WHEN p_size NOT BETWEEN 5 AND 40 THEN 'size' END, CASE WHEN p_partkey % 3 = 0 THEN 'kind' END, 'gone') AS broken FROM part")
def sf_17_parameters(spark, d):
    values = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("kind"), F.element_at(F.array(F.lit("x"), F.lit("arc"), F.lit("line")), (F.col("p_partkey") % 3 + 1).cast("int")))
    broken = rules.parameter_problems(values, {"size": ("number", 5, 40), "kind": ("choice", ["arc", "line"]), "gone": ("number", 0, 1)})
    return read(spark, d, "part").select("p_partkey", F.array_join(broken, ",").alias("broken"))


@register("gr_34_residuals", f"WITH {SEGMENTS}, c AS (SELECT id % 20 AS sketch, ['distance','horizontal','vertical'][id % 3 + 1] AS kind, id AS a, id + 1 AS b FROM segments), j AS (SELECT sketch, CASE kind WHEN 'distance' THEN abs(sqrt((p.x0-q.x0)*(p.x0-q.x0)+(p.y0-q.y0)*(p.y0-q.y0)) - 100) WHEN 'horizontal' THEN abs(p.y0-q.y0) ELSE abs(p.x0-q.x0) END AS off FROM c JOIN segments p ON p.id = a JOIN segments q ON q.id = b) SELECT sketch, count(*) AS n, round(sum(off*off), 3) AS residual, round(max(off), 6) AS worst FROM j GROUP BY sketch")
def gr_34_residuals(spark, d):
    s = segments(spark, d)
    kind = F.element_at(F.array(F.lit("distance"), F.lit("horizontal"), F.lit("vertical")), (F.col("id") % 3 + 1).cast("int"))
    c = s.select((F.col("id") % 20).alias("sketch"), kind.alias("kind"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit(100.0).alias("value"))
    return rules.constraint_residuals(c, s.select("id", F.col("x0").alias("x"), F.col("y0").alias("y"))).select("sketch", "n", F.round("residual", 3).alias("residual"), r6("worst", "worst"))


@register("wn_04_curvature_variance", f"WITH {BOXES}, k AS (SELECT id, unnest([1,2,3,4]) AS i, 2/sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)) AS c FROM boxes) SELECT id AS ring, 0.0::DOUBLE AS spread, round(avg(c), 6) AS mean FROM k GROUP BY id")
def wn_04_curvature_variance(spark, d):
    from ..operators import drawing

    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    c = boxes(spark, d).select(F.col("id").alias("ring"), F.posexplode(F.array(p("x0", "y0"), p("x1", "y0"), p("x1", "y1"), p("x0", "y1"))).alias("idx", "p")).select("ring", "idx", "p.x", "p.y")
    return drawing.vertex_turns(c).groupBy("ring").agg(F.round(F.var_pop("curvature"), 6).alias("spread"), F.round(F.avg("curvature"), 6).alias("mean"))


@register("flt_12_collinear", f"WITH {BOXES} SELECT id AS ring, unnest([0, 2, 3, 4]) AS idx FROM boxes")
def flt_12_collinear(spark, d):
    from ..operators import drawing

    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    c = boxes(spark, d).select(F.col("id").alias("ring"), F.posexplode(F.array(p(x0, y0), p((x0 + x1) / 2, y0), p(x1, y0), p(x1, y1), p(x0, y1))).alias("idx", "p")).select("ring", "idx", "p.x", "p.y")
    return drawing.vertex_turns(c).filter(F.abs("turn") >= 1.0).select("ring", "idx")
