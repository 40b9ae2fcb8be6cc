"""URL filters: explicit rules, and path templates rejected by their labelled purity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, salted_join, split_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A segment is variable if it holds a digit run, or if its parent has this many children and it has less than SHARE of their urls.
FAN = 12
SHARE = 0.05
#: Siblings whose labelled block rates differ by less than this many standard errors are merged.
Z = 2.58
#: Labelled urls that a wider group's rate is worth in the smoothed purity of a narrower one.
SMOOTHING = 2.0
#: Urls of templates with at least this purity are rejected.
PURITY = 0.9

Rule = tuple[str, str, str]


def host_of(url):
    """After the first "://" up to "/", "?", "#" or the end, A-Z in lower case; empty for null or without "://"."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url):
    """What follows the host, up to "?", "#" or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host, path, rules: list[Rule]):
    """(rule, verdict) of the longest rule (verdict, host, path prefix) that fits; nulls if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, action).otherwise(verdict)
    return name, verdict


def domain_of(host):
    """The last two labels of a host: sibling hosts share them."""
    return F.regexp_extract(host, r"([^.]*\.)?[^.]*$", 0)


def _varies(seg):
    return seg.rlike(r"\d")


def _skip_shared(rows: DataFrame) -> DataFrame:
    """Pass over the segments that all paths of a node share, so a level of the tree is only spent where a node branches.

    Rows of nodes with one path only have ended."""
    ends = rows.groupBy("host", "template").agg(F.min("rest").alias("lo"), F.max("rest").alias("hi"))
    unlike = F.array_position(F.zip_with("lo", "hi", lambda a, b: a.eqNullSafe(b)), F.lit(False))
    shared = F.slice("lo", F.lit(1), F.when(unlike > 0, (unlike - 1).cast("int")).otherwise(F.size("lo")))
    text = F.concat_ws("", F.transform(shared, lambda s: F.when(_varies(s), "/*").otherwise(F.concat(F.lit("/"), s))))
    nodes = ends.select("host", "template", F.size(shared).alias("skip"), text.alias("more"), F.col("lo").eqNullSafe(F.col("hi")).alias("ended"))
    both = salted_join(rows, nodes, ["host", "template"], "path")
    left = F.slice("rest", F.col("skip") + 1, F.greatest(F.size("rest") - F.col("skip"), F.lit(0)))
    return both.select("host", "path", F.concat("template", "more").alias("template"), left.alias("rest"), "n", "bad", "good", "ended")


def _children(rows: DataFrame) -> DataFrame:
    """rows with one more template level: the next segment's own text, or "*" where it varies or its branch is like its siblings.

    Branches are called alike if both sides have labels and their block rates do not differ. The tree's
    nodes are counts by (host, template, segment); segments that vary by their own text need no count, so the
    rows meet the counts of the others only, and those of a hot node in parts."""
    node = rows.withColumn("seg", F.coalesce(F.try_element_at("rest", F.lit(1)), F.lit("")))
    counts = node.groupBy("host", "template", "seg").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    family = counts.groupBy("host", "template").agg(F.count("*").alias("fan"), F.sum("n").alias("all"), F.sum("bad").alias("all_bad"), F.sum("good").alias("all_good"))
    both = salted_join(counts.filter(~_varies(F.col("seg")) & (F.col("seg") != "")), family, ["host", "template"], "seg")
    seen, rest = F.col("bad") + F.col("good"), F.col("all_bad") + F.col("all_good") - F.col("bad") - F.col("good")
    rate = (F.col("all_bad") + 1) / (F.col("all_bad") + F.col("all_good") + 2)
    gap = F.col("bad") / F.greatest(seen, F.lit(1)) - (F.col("all_bad") - F.col("bad")) / F.greatest(rest, F.lit(1))
    error = F.sqrt(rate * (1 - rate) * (1 / F.greatest(seen, F.lit(1)) + 1 / F.greatest(rest, F.lit(1))))
    alike = (seen > 0) & (rest > 0) & (F.abs(gap) <= Z * error)
    wild = alike | ((F.col("fan") >= FAN) & (F.col("n") < SHARE * F.col("all")))
    levels = both.select("host", "template", "seg", F.when(wild, "/*").otherwise(F.concat(F.lit("/"), "seg")).alias("level"))
    plain = _varies(F.col("seg")) | (F.col("seg") == "")
    own = node.filter(plain).withColumn("level", F.when(F.col("seg") == "", "").otherwise("/*"))
    out = own.unionByName(salted_join(node.filter(~plain), levels, ["host", "template", "seg"], "path"))
    left = F.slice("rest", F.lit(2), F.greatest(F.size("rest") - 1, F.lit(0)))
    return out.select("host", "path", F.concat("template", "level").alias("template"), left.alias("rest"), "n", "bad", "good", (F.col("seg") == "").alias("ended"))


def path_templates(urls: DataFrame) -> DataFrame:
    """(host, path, template, purity, n) for the distinct (host, path) of urls, which has host, path, n, bad and good.

    A host's tree branches until its paths end, however deep; each round goes down one branching level of
    all hosts and is written. purity is the block rate of the template's labelled urls on its host, smoothed
    toward the template's rate over sibling hosts (same last two labels), that toward its rate over all hosts,
    and that toward the rate of all labelled urls. So a template without labels of its own is judged by what
    is known of it elsewhere, and few labels move a purity little."""
    rows = urls.groupBy("host", "path").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    rows = materialise(rows.select("host", "path", F.lit("").alias("template"), F.filter(F.split("path", "/"), lambda s: s != "").alias("rest"), "n", "bad", "good"))
    done = None
    while not rows.isEmpty():
        rows = materialise(_skip_shared(rows))
        ended = rows.filter("ended").select("host", "path", "template", "n", "bad", "good")
        done = ended if done is None else done.union(ended)
        rows = rows.filter("not ended").drop("ended")
        if rows.isEmpty():
            break
        rows = materialise(_children(rows))
        done = done.union(rows.filter("ended").select("host", "path", "template", "n", "bad", "good"))
        rows = rows.filter("not ended").drop("ended")
    done = done if done is not None else rows.drop("rest")
    sums = [F.sum("bad").alias("bad"), F.sum("good").alias("good")]
    bad, good = done.agg(*sums).first()
    smooth = lambda prior: (F.col("bad") + SMOOTHING * prior) / (F.col("bad") + F.col("good") + SMOOTHING)
    own = materialise(done.groupBy("host", "template").agg(*sums).withColumn("domain", domain_of(F.col("host"))))
    by_domain = own.groupBy("domain", "template").agg(*sums)
    base = ((bad or 0) + 1) / ((bad or 0) + (good or 0) + 2)
    pooled = own.groupBy("template").agg(*sums).select("template", smooth(F.lit(base)).alias("prior"))
    siblings = salted_join(by_domain, pooled, ["template"], "domain").select("domain", "template", smooth(F.col("prior")).alias("prior"))
    pure = materialise(salted_join(own, siblings, ["domain", "template"], "host").select("host", "template", smooth(F.col("prior")).alias("purity")))
    return salted_join(done.select("host", "path", "template", "n"), pure, ["host", "template"], "path")


def judge_urls(pages: DataFrame, rules: list[Rule], labels: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", purity: float = PURITY) -> DataFrame:
    """(id_col, host, path, rule, verdict, template, purity) for each row of pages.

    Rules come first, the longest that fits; of rules as long as each other the later one. Other urls are
    blocked if the smoothed labelled purity of their host's path template reaches purity, else allowed.
    labels holds (id_col, label), label 1 to block, where labels that disagree about an id block; without it
    the urls that rules decide are the labelled ones, blocked ones counting as 1. Distinct (host, path)
    pairs are counted before the tree is built. A null url has empty host and path, the template of an
    empty path, and is judged like any other; null ids and repeated rows each come back; very long
    paths are read whole; other columns are not read; an empty table gives an empty result."""
    base = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    name, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    base = materialise(base.withColumns({"rule": name, "ruled": verdict}))
    if labels is None:
        urls = base.withColumns({"bad": (F.col("ruled") == "block").cast("int"), "good": (F.col("ruled") == "allow").cast("int")})
    else:
        own = labels.groupBy(F.col(id_col).alias("lid")).agg(F.max(F.col("label").cast("int")).alias("label"))
        urls = base.join(own, base["id"] == own["lid"], "left").withColumns({"bad": F.col("label"), "good": 1 - F.col("label")})
    urls = urls.select("host", "path", F.lit(1).alias("n"), F.coalesce("bad", F.lit(0)).alias("bad"), F.coalesce("good", F.lit(0)).alias("good"))
    out = split_join(base, materialise(path_templates(urls)), ["host", "path"], "n")
    other = F.when(F.col("purity") >= purity, "block").otherwise("allow")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", other).alias("verdict"), "template", "purity")
