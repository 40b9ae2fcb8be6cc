"""Layer, colour, unit and line rules of drawings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.rules import UNIT_MM, is_wall_layer

#: Words that a layer name, in capitals, holds, and what it begins with.
DOOR_WORDS, DOOR_PREFIXES = ["DOOR", "门"], ["D-"]
WINDOW_WORDS, WINDOW_PREFIXES = ["WINDOW", "窗", "GLAZ", "GLASS"], ["A-WIND", "W-"]
OPENING_WORDS = ["OPEN", "开口", "HOLE", "洞", "GATE", "通道"]
FURNITURE_WORDS = [
    "FURN", "家具", "FF&E", "EQUIP", "设备", "洁具", "橱柜", "BED", "床", "SOFA", "沙发", "CHAIR", "椅子", "TABLE", "桌", "DESK", "TV", "电视", "TOILET", "卫生", "BATH", "淋浴",
    "KITCHEN", "厨房", "灶", "STOVE", "SINK", "面盆", "马桶", "WARDROBE", "衣柜", "CLOSET", "CABINET", "SHELF", "书架", "HVAC", "暖通", "空调", "LIGHT", "照明", "LAMP", "灯", "ELEC", "电气",
    "SWITCH", "开关", "OUTLET", "插座", "WC", "浴缸", "URINAL", "小便", "洗手", "REFRIG", "冰箱", "微波炉", "洗碗", "COOK", "A-PLMB", "A-PLUM", "A-CASE", "A-MILL", "A-MECH", "MECH-", "MEP-", "E-", "L-",
]
DIMENSION_WORDS = ["DIM", "标注", "ANNOT", "注释", "标高", "轴号", "MEASURE", "测量", "A-ANNO", "ANNO-"]
BATHROOM_WORDS = ["TOILET", "卫生", "BATH", "SHOWER", "淋浴", "WASH", "洗手", "WC", "马桶", "SINK", "面盆", "浴缸", "A-PLMB", "A-PLUM", "给排水"]
KITCHEN_WORDS = ["KITCHEN", "厨房", "COOK", "灶", "STOVE", "REFRIG", "冰箱", "CABINET", "橱柜", "A-CASE", "A-MILL"]
HVAC_WORDS = ["HVAC", "暖通", "空调", "DUCT", "风管", "VENT", "A-MECH", "MECH-", "MEP-"]
ELECTRIC_WORDS = ["ELEC", "电气", "LIGHT", "照明", "LAMP", "灯", "SWITCH", "开关", "OUTLET", "插座", "E-", "L-"]
#: Further words of indoor fixtures, which belong to no kind above.
FIXTURE_WORDS = [
    "URINAL", "小便", "RANGE", "MICROWAVE", "微波炉", "OVEN", "洗碗", "COUNTERTOP", "台面", "BED", "床", "MATTRESS", "WARDROBE", "衣柜", "CLOSET", "衣帽", "DRESSER", "NIGHTSTAND",
    "SOFA", "沙发", "CHAIR", "椅子", "TABLE", "桌", "DESK", "TV", "电视", "COFFEE", "茶几", "SHELF", "书架", "STOOL", "凳", "BENCH", "储物", "AC-", "AIR-COND", "风口",
    "DIFFUSER", "散流器", "FAN-COIL", "风机盘管", "RADIATOR", "暖气", "POWER", "电源", "FIRE-ALARM", "烟感", "SPRINKLER", "喷淋",
]
FIXTURE_PREFIXES = ["A-FURN", "FF&E"]
MATERIAL_WORDS = {"concrete": ["CONC", "混凝土"], "brick": ["BRICK", "砖"], "wood": ["WOOD", "木"], "glass": ["GLASS", "GLAZ", "玻璃"], "metal": ["METAL", "STEEL", "钢", "金属"], "gypsum": ["GYPSUM", "石膏"]}
COLOR_MATERIALS = {1: "concrete", 2: "brick", 3: "wood", 4: "gypsum", 5: "glass", 6: "metal", 7: "default_wall"}
LINE_WIDTHS = [0.0, 0.05, 0.09, 0.13, 0.15, 0.18, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5, 0.53, 0.6, 0.7, 0.8, 0.9, 1.0, 1.06, 1.2, 1.4, 1.58, 2.0, 2.11]
LINE_STYLES = {
    "CONTINUOUS": "solid", "SOLID": "solid", "DASHED": "dashed", "ACAD_ISO02W100": "dashed", "DOT": "dotted", "ACAD_ISO03W100": "dotted", "DASHDOT": "dash_dot", "ACAD_ISO04W100": "dash_dot",
    "DIVIDE": "dash_dot_dot", "ACAD_ISO05W100": "dash_dot_dot", "CENTER": "long_dash_dot", "ACAD_ISO06W100": "long_dash_dot",
}
#: A declared unit that coordinates above or below a limit (and a diagonal below one) show to be another.
TOO_LARGE = [("m", 10_000.0, "mm"), ("inch", 10_000.0, "mm"), ("foot", 1000.0, "mm"), ("cm", 10_000.0, "mm"), ("yard", 5000.0, "mm"), ("mile", 100.0, "kilometer"), ("micron", 1e6, "mm"), ("point", 5000.0, "mm"), ("pica", 5000.0, "mm")]
TOO_SMALL = [("mm", 10.0, 100.0, "m"), ("kilometer", 1.0, float("inf"), "m")]
#: Half a millimetre in each unit.
BASE_TOLERANCE = {"mm": 0.5, "cm": 0.05, "m": 0.0005, "inch": 0.02, "foot": 0.0016, "yard": 0.00055, "mile": 0.00000031, "micron": 500.0, "kilometer": 0.0000005, "point": 1.42, "pica": 0.118}


def holds(name: Column, words: list[str], prefixes: list[str] = ()) -> Column:
    """True if name, in capitals, holds any of words or begins with any of prefixes; null counts as neither."""
    up, out = F.upper(F.coalesce(name, F.lit(""))), F.lit(False)
    for w in words:
        out = out | F.contains(up, F.lit(w))
    for p in prefixes:
        out = out | F.startswith(up, F.lit(p))
    return out


def is_door(layer: Column) -> Column:
    return holds(layer, DOOR_WORDS, DOOR_PREFIXES)


def is_window(layer: Column) -> Column:
    return holds(layer, WINDOW_WORDS, WINDOW_PREFIXES)


def is_opening(layer: Column) -> Column:
    return holds(layer, OPENING_WORDS)


def is_door_or_window(layer: Column) -> Column:
    return is_door(layer) | is_window(layer) | is_opening(layer)


def is_furniture(layer: Column) -> Column:
    return holds(layer, FURNITURE_WORDS)


def is_dimension(layer: Column) -> Column:
    return holds(layer, DIMENSION_WORDS)


def is_fixture(layer: Column) -> Column:
    return holds(layer, BATHROOM_WORDS + KITCHEN_WORDS + HVAC_WORDS + ELECTRIC_WORDS + FIXTURE_WORDS, FIXTURE_PREFIXES)


def layer_passes(layer: Column, mode: str, whitelist: list[str] = (), custom: list[str] = ()) -> Column:
    """A white list of substrings decides alone; else the mode: all, walls, openings, architectural, furniture or custom."""
    if whitelist:
        out = F.lit(False)
        for w in whitelist:
            out = out | F.contains(layer, F.lit(w))
        return out
    walls, openings = F.coalesce(is_wall_layer(layer), F.lit(False)), is_door_or_window(layer)
    return {"all": F.lit(True), "walls": walls, "openings": openings, "architectural": walls | openings, "furniture": is_furniture(layer), "custom": holds(layer, list(custom))}[mode]


def semantic(layer: Column) -> Column:
    """door, window, opening or hard_wall, the first that the name fits; hard_wall for all others."""
    return F.when(is_door(layer), "door").when(is_window(layer), "window").when(is_opening(layer), "opening").otherwise("hard_wall")


def semantic_or_null(layer: Column) -> Column:
    """Walls first, then openings, then kinds of fixtures; null where no rule fits."""
    kind = F.when(holds(layer, BATHROOM_WORDS), "bathroom_fixture").when(holds(layer, KITCHEN_WORDS), "kitchen_fixture").when(holds(layer, HVAC_WORDS), "hvac").when(holds(layer, ELECTRIC_WORDS), "electrical").otherwise("furniture")
    return F.when(is_wall_layer(layer), "hard_wall").when(is_door(layer), "door").when(is_window(layer), "window").when(is_opening(layer), "opening").when(is_fixture(layer), kind)


def material_of_color(color: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in COLOR_MATERIALS.items() for x in kv))[color.cast("int")]


def material_of_layer(layer: Column) -> Column:
    out = None
    for name, words in MATERIAL_WORDS.items():
        out = F.when(holds(layer, words), name) if out is None else out.when(holds(layer, words), name)
    return out


def opening_width(length_mm: Column) -> Column:
    """Width in metres of an opening between 0.5 and 5 m, else null."""
    return F.when((length_mm / 1000.0).between(0.5, 5.0), length_mm / 1000.0)


def snap_line_width(mm: Column) -> Column:
    """Place of the nearest standard width, the thinner one when two are as near."""
    return F.array_min(F.array(*(F.struct(F.abs(mm - F.lit(w)).alias("d"), F.lit(i).alias("i")) for i, w in enumerate(LINE_WIDTHS))))["i"]


def line_style(name: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in LINE_STYLES.items() for x in kv))[F.upper(name)]


def true_unit(declared: Column, largest: Column, diagonal: Column) -> Column:
    """The unit that coordinates of this size are in, given the declared one."""
    out = F.when(F.lit(False), declared)
    for unit, limit, real in TOO_LARGE:
        out = out.when((declared == unit) & (largest > limit), real)
    for unit, limit, across, real in TOO_SMALL:
        out = out.when((declared == unit) & (largest < limit) & (diagonal < across), real)
    return out.otherwise(declared)


def unit_mismatch(declared: Column, largest: Column) -> Column:
    """Metres or inches with coordinates above 10,000."""
    low = F.lower(F.coalesce(declared, F.lit("")))
    named = F.lit(False)
    for w in ("米", "meter", "英寸", "inch"):
        named = named | F.contains(low, F.lit(w))
    return named & (largest > 10_000.0)


def base_tolerance(unit: Column) -> Column:
    """Half a millimetre in unit; an unknown unit counts as millimetres."""
    return F.coalesce(F.create_map(*(F.lit(x) for kv in BASE_TOLERANCE.items() for x in kv))[F.lower(unit)], F.lit(0.5))


def adaptive_tolerance(unit: Column, extent: Column, precision: Column) -> Column:
    """The base tolerance, ten times in drawings over 10,000 across and a tenth under 100, times 10, 1, 0.1 or 0.01 for rough to ultra work."""
    scale = F.when(extent > 10_000.0, 10.0).when(extent < 100.0, 0.1).otherwise(1.0)
    return base_tolerance(unit) * scale * F.when(precision == "rough", 10.0).when(precision == "fine", 0.1).when(precision == "ultra", 0.01).otherwise(1.0)
