"""Candidates of drawing records routed to experts, and the rules that text and sheet experts start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import FAMILY_HINTS

CANDIDATE = "array<struct<id:string,target_id:string,type:string,semantic_type:string,symbol_type:string,layout_type:string,text_type:string,label:string,bbox:array<double>,confidence:string>>"
#: A record's lists with their default families, the families' experts, the trust in a candidate without a hint, a large region's area.
LISTS = {"text_candidates": "text", "symbol_candidates": "symbol", "semantic_regions": "space", "layout_regions": "sheet"}
EXPERTS = {"boundary": "wall_opening", "space": "room_space", "symbol": "symbol_fixture", "text": "text_dimension", "sheet": "sheet_layout"}
UNSURE, LARGE = 0.3, 0.08
#: Schema of records, for readers of JSON lines; lists may stand in the record or in its hints.
RECORD = f"record_id string, {', '.join(f'{c} {CANDIDATE}' for c in LISTS)}, request_hints struct<primitive_graph:struct<nodes:{CANDIDATE}>,{','.join(f'{c}:{CANDIDATE}' for c in LISTS)}>"


def _first(row: Column, *names: str) -> Column:
    """The first of a candidate's fields that is neither null nor empty."""
    return F.coalesce(*(F.nullif(row[n], F.lit("")) for n in names))


def hinted_family(kind: Column, large: Column, default: Column) -> list[Column]:
    """family, matched_hint and abstain of a candidate's kind: the first family with one of its words, else space if it is large."""
    words = F.split(F.replace(kind, F.lit("-"), F.lit("_")), "_")
    met = {family: F.array_min(F.array_intersect(words, F.array(*map(F.lit, own)))) for family, own in FAMILY_HINTS.items()}
    hint = F.coalesce(*met.values())
    family = F.coalesce(*(F.when(h.isNotNull(), f) for f, h in met.items()), F.when(large, "space"), default)
    return [family.alias("family"), F.coalesce(hint, F.when(large, "large_region_bbox")).alias("matched_hint"), (hint.isNull() & ~large).alias("abstain")]


def route_records(records: DataFrame, key: str = "record_id") -> DataFrame:
    """(key, source, place, candidate_id, expert, family, candidate_type, confidence, bbox, matched_hint, abstain) of records as RECORD
    describes them: a row for each primitive and each candidate of the four lists.

    A list that the record lacks is taken from its hints. Hints of a candidate are the first kind it names; candidates of
    no family keep their list's and are trusted with UNSURE only, others with their confidence within 0 and 1. Boxes that
    have not four numbers are null. Candidates without an id are named by family and place in their list."""
    nodes = records.select(key, F.lit("primitives").alias("source"), F.lit("boundary").alias("default"), F.posexplode("request_hints.primitive_graph.nodes").alias("place", "c"))
    rows = nodes
    for name, family in LISTS.items():
        rows = rows.union(records.select(key, F.lit(name), F.lit(family), F.posexplode(F.coalesce(F.col(name), F.col(f"request_hints.{name}")))))
    c, primitive = F.col("c"), F.col("source") == "primitives"
    said = F.when(primitive, F.coalesce(_first(c, "type", "semantic_type", "label"), F.lit("primitive"))).otherwise(F.coalesce(_first(c, "type", "semantic_type", "symbol_type", "layout_type", "text_type"), F.col("default")))
    box = F.when((F.size(c["bbox"]) == 4) & ~F.exists(c["bbox"], lambda v: v.isNull()), c["bbox"])
    width, height = (F.greatest(F.lit(0.0), F.try_element_at("bbox", F.lit(i + 2)) - F.try_element_at("bbox", F.lit(i))) for i in (1, 2))
    rows = rows.filter(c.isNotNull()).select("*", F.replace(F.lower(F.trim(said)), F.lit(" "), F.lit("_")).alias("candidate_type"), box.alias("bbox"))
    large = F.coalesce(~primitive & (width * height >= LARGE), F.lit(False))
    routed = rows.select("*", *hinted_family(F.col("candidate_type"), large, F.col("default")))
    given = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c["confidence"].try_cast("double"), F.lit(1.0))))
    experts = F.create_map(*(F.lit(v) for pair in EXPERTS.items() for v in pair))
    name = F.coalesce(_first(c, "id", "target_id"), F.concat_ws("_", F.when(primitive, "primitive").otherwise(F.col("family")), F.col("place").cast("string")))
    return routed.select(
        key, "source", "place", name.alias("candidate_id"), F.coalesce(experts[F.col("family")], F.concat("family", F.lit("_expert"))).alias("expert"), "family", "candidate_type",
        F.when(F.col("abstain"), UNSURE).when(primitive, 1.0).otherwise(given).alias("confidence"), "bbox", "matched_hint", "abstain",
    )


def plain_words(text: Column, keep: str = "") -> Column:
    """Lower case with spaces for runs of spaces, dashes and underlines; letters a to z, digits and the signs in keep only."""
    spaced = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\s_\-]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(spaced, rf"[^a-z0-9\s{keep}]", ""), r"\s+", " "))


def text_scores(text: Column, width: Column, height: Column) -> list[Column]:
    """Five scores, by the kinds of text that a candidate may be: dimension_line, dimension_text, leader_line, note_text, room_label.

    A text with an x or a cross is a dimension and nothing else; letters alone are room labels up to 25 and notes from six or
    from two to four of them, letters with digits notes. Empty texts in a narrow upright box are leaders."""
    words = plain_words(text, ".")
    letters = F.regexp_replace(words, r"[ .]", "")
    empty, cross = words == "", F.contains(words, F.lit("x")) | F.contains(text, F.lit("×"))
    n = F.when(letters.rlike("^[a-z]+$"), F.length(letters)).otherwise(0)
    mixed = text.rlike("[0-9]") & text.rlike("[A-Za-z]")
    leader = width.between(9, 15) & height.between(14, 25)
    other = ~empty & ~cross
    return [
        F.lit(0.0).alias("dimension_line"), F.when(~empty & cross, 0.95).otherwise(0.0).alias("dimension_text"), F.when(empty & leader, 0.6).otherwise(0.0).alias("leader_line"),
        F.when(other & mixed, 0.8).when(other & (n > 5), 0.4).when(other & n.between(2, 4), 0.3).otherwise(0.0).alias("note_text"), F.when(other & n.between(1, 25), 0.9).otherwise(0.0).alias("room_label"),
    ]


#: The words that a sheet's parts are known by.
TITLE_WORDS = ("title", "project", "drawing", "scale", "date", "sheet")
SCHEDULE_WORDS = ("schedule", "room", "door", "area", "finish", "qty", "type")
LEGEND_WORDS = ("legend", "symbol", "key", "note")
STAMP_WORDS = ("revision", "approval", "stamp", "date", "checked")
NOTE_WORDS = ("general note", "specification", "contractor", "verify")


def sheet_part(text: Column, x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> list[Column]:
    """label and confidence of a box with text on a sheet of width and height, by place and words; notes where no rule fits."""
    said = F.lower(F.coalesce(text, F.lit("")))
    any_of = lambda words: said.rlike("|".join(words))
    least = lambda v: F.greatest(v, F.lit(1.0))
    share = (x1 - x0) * (y1 - y0) / least(width * height)
    below, right, left, above = (height - y1) / least(height), (width - x1) / least(width), x0 / least(width), y0 / least(height)
    # A box without height is as long as can be, one without width has no share to ask for.
    long_ = F.coalesce(F.when(y1 != y0, F.greatest((x1 - x0) / (y1 - y0), F.try_divide(y1 - y0, x1 - x0))), F.lit(float("inf")))
    rules = [
        ((below < 0.15) & (right < 0.35) & (share > 0.01) & any_of(TITLE_WORDS), "title_block", 0.92),
        ((share > 0.02) & (long_ < 3) & any_of(SCHEDULE_WORDS), "schedule", 0.88),
        ((right < 0.2) & ((y0 + y1) / 2 > height * 0.3) & any_of(LEGEND_WORDS), "legend", 0.85),
        ((share < 0.02) & (long_ < 2) & any_of(STAMP_WORDS), "stamp", 0.82),
        ((left < 0.1) & (above > 0.05) & any_of(NOTE_WORDS), "notes", 0.80),
    ]
    label, trust = F.lit("notes"), F.lit(0.5)
    for test, name, value in reversed(rules):
        label, trust = F.when(test, name).otherwise(label), F.when(test, value).otherwise(trust)
    return [label.alias("label"), trust.alias("confidence")]
