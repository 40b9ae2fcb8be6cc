"""Text rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise_label(text: Column) -> Column:
    """Lower case, letters, digits and dots only, other runs as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9.]+", " "))


def error_rate(gold: Column, found: Column) -> Column:
    """Edit distance over the gold length; 0 for two empty texts, 1 for an empty gold text only."""
    n = F.length(gold)
    return F.when(n > 0, F.levenshtein(gold, found) / n).otherwise((F.length(found) > 0).cast("double"))


def label_tokens(text: Column) -> Column:
    """Words of camel-case and separated labels, in lower case."""
    spaced = F.regexp_replace(F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2"), r"[^A-Za-z0-9]+", " ")
    return F.filter(F.split(F.lower(spaced), " "), lambda w: w != "")


def xml_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def style_map(text: Column) -> Column:
    """Map of a "k:v;k:v" string."""
    pairs = F.filter(F.split(text, ";"), lambda p: F.contains(p, F.lit(":")))
    named = F.transform(pairs, lambda p: F.struct(F.trim(F.substring_index(p, ":", 1)).alias("k"), F.trim(F.regexp_replace(p, "^[^:]*:", "")).alias("v")))
    # of keys that come twice the last one counts
    last = F.filter(named, lambda p, i: ~F.exists(F.slice(named, i + 2, F.greatest(F.size(named) - i - 1, F.lit(0))), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def safe_double(text: Column, default: float = 0.0) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(default))


def pair(text: Column) -> tuple[Column, Column]:
    parts = F.split(text, r"[,\s]+")
    return F.try_element_at(parts, F.lit(1)).try_cast("double"), F.try_element_at(parts, F.lit(2)).try_cast("double")


def contains_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def confidence(value: Column, default: float = 0.0) -> Column:
    """Parsed and kept within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value.try_cast("double"), F.lit(default))))


def text_class(text: Column) -> Column:
    """number, tolerance, view_label, material or note, by the first rule that fits."""
    return (
        F.when(text.rlike(r"^[+-]?[0-9]+([.][0-9]+)?$"), "number")
        .when(F.contains(text, F.lit("+/-")) | F.contains(text, F.lit("±")), "tolerance")
        .when(text.rlike(r"(?i)^(view|section)\b"), "view_label")
        .when(text.rlike(r"(?i)steel|brass|copper|nickel|tin"), "material")
        .otherwise("note")
    )


def dimension(text: Column) -> list[Column]:
    """nominal, tolerance and round_shape of a dimension text."""
    number = r"([0-9]+(?:[.][0-9]+)?)"
    return [F.regexp_extract(text, number, 1).try_cast("double").alias("nominal"), F.regexp_extract(text, r"(?:±|[+]/-)\s*" + number, 1).try_cast("double").alias("tolerance"), text.rlike(r"[ØR]\s*[0-9]").alias("round_shape")]


def fold_text(text: Column) -> Column:
    """Lower case, three letters without their marks, and dots, slashes and dashes as spaces."""
    return F.translate(F.lower(text), "öäå./-", "oaa   ")


def looks_like_dimension(text: Column) -> Column:
    """A number with or without a unit of length or area, or one whole number by another."""
    return F.replace(F.lower(F.trim(text)), F.lit(","), F.lit(".")).rlike(r"^(\d+(\.\d+)?\s*(m|mm|cm|m2|m²)?|\d+\s*[x×]\s*\d+)$")


def plain_mtext(text: Column) -> Column:
    """Formatted drawing text without its codes: line and paragraph breaks, hard spaces, colours, line gaps and braces."""
    for code, mark in ((r"\\\\", "\u0001"), (r"\\\{", "\u0002"), (r"\\\}", "\u0003"), (r"\\[Xxn]", "\n"), (r"\\[Pp]", "\n\n"), (r"\\~", " "), (r"\\[CcLl][0-9]*", ""), (r"[{}]", "")):
        text = F.regexp_replace(text, code, mark)
    return F.regexp_replace(F.translate(text, "\u0001\u0002\u0003", "\\{}"), r"^\s+|\s+$", "")


def unescape_pdf(text: Column) -> Column:
    """A string with its escapes resolved: letters, brackets, backslashes and octal codes up to 377; an escaped line end goes."""
    named = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}
    parts = F.regexp_extract_all(text, F.lit(r"(?s)(\\[0-7]{1,3}|\\.|[^\\]+|\\)"), F.lit(1))

    def one(p):
        out = F.when(p.rlike(r"^\\[0-7]{1,3}$"), F.char(F.conv(F.substring(p, 2, 3), 8, 10).cast("int") % 256))
        for letter, sign in named.items():
            out = out.when(p == "\\" + letter, sign)
        return out.when(p == "\\\n", "").when((F.length(p) == 2) & F.startswith(p, F.lit("\\")), F.substring(p, 2, 1)).otherwise(p)

    return F.array_join(F.transform(parts, one), "")


def without_rotation(path: Column) -> Column:
    """A path without the rotation mark before its extension."""
    return F.regexp_replace(path, r"[-_](rot|r)(90|180|270)(\.[a-z]+)$", "$3")


def feature_vector(features: Column, names: list[str]) -> Column:
    """The values of a map under names, in their order; 0 for those it lacks."""
    return F.array(*(F.coalesce(F.try_element_at(features, F.lit(n)).cast("double"), F.lit(0.0)) for n in names))


def set_overlap(a: Column, b: Column) -> tuple[Column, Column]:
    """Intersection over union, and over the smaller set; 0 where either is empty."""
    both = F.size(F.array_intersect(a, b))
    none = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(none, 0.0).otherwise(both / F.size(F.array_union(a, b))), F.when(none, 0.0).otherwise(both / F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))))


def utc_stamp(time: Column) -> Column:
    """ISO text of a timestamp, in the session's zone, which is UTC."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")
