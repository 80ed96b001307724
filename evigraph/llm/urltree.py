"""URL filters by a path-template tree for each host, in DataFrame functions only.

1. Rules of (host suffix, path prefix) decide first; what they say of a url is also a label.
2. Each path segment becomes a shape (digits, and long hex runs where there is a digit, are wildcards). Where a place of the
   tree, a host and the shapes above, has many different segments that hardly repeat, the segment
   becomes ``*``.
3. Sibling branches with the same remainder are merged into ``*`` where both have labels and their
   share of blocked urls can't be told apart (a z test against the pooled share).
4. A template is rejected if its smoothed share of blocked labels reaches ``purity``. Templates
   without labels keep the prior, so they are allowed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import lower_ascii

Rule = tuple[str, str, str]  # verdict, host, path

#: The rules of the query, as its contract lists them.
RULES: tuple[Rule, ...] = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def parsed(url):
    """``(host, path)``: host after the first ``://`` up to ``/ ? #`` with A-Z lower-cased, then the path up to ``? #``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(text, pattern, 1)), F.regexp_extract(text, pattern, 2)


def ruled(host, path, rules: tuple[Rule, ...]):
    """The rule that fits with the longest text (ties: block, then by name) as a struct of rule and verdict, or null."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1:])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        said = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, said) if out is None else out.when(fits, said)
    return out if out is not None else F.lit(None).cast("struct<rule: string, verdict: string>")


def shapes(path):
    """Segments of a path as shapes; a final slash is a last, empty segment."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    plain = lambda s: F.when(s.rlike("[0-9]"), F.regexp_replace(s, "[0-9a-fA-F]{12,}", "<hex>")).otherwise(s)
    return F.transform(parts, lambda s: F.regexp_replace(plain(s), "[0-9]+", "<n>"))


def filter_urls(
    pages: DataFrame, rules: tuple[Rule, ...] = RULES, purity: float = 0.5, prior: float = 0.2, strength: float = 2.0, many: int = 20, least: int = 5, z: float = 1.96,
) -> DataFrame:
    """``pages(page_id, url)`` -> (page_id, host, path, template, rule, verdict).

    ``many``: different segments, at least half of the urls there, that make a place variable;
    ``least``: labels a branch needs to be merged; ``prior`` and ``strength``: share and number of the
    pseudo-labels in the smoothing. Null urls and urls without ``://`` have an empty host and path, and
    are judged like any others. Repeated rows and null ids stay; other columns aren't read; no rows give none.

    Everything but the last join works on distinct (host, path) pairs, aggregated before they move;
    the joins that bring results back are ones that AQE can split at a common host.
    """
    host, path = parsed(F.col("url"))
    own = pages.select("page_id", host.alias("host"), path.alias("path"))
    paths = own.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    paths = paths.select("*", F.coalesce((ruled(F.col("host"), F.col("path"), rules)["verdict"] == "block").cast("long"), F.lit(-1)).alias("blocked"), shapes(F.col("path")).alias("t"))
    # distinct shape sequences of a host, with urls and labels
    tree = paths.groupBy("host", "t").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("blocked") >= 0, F.col("n")).otherwise(0)).alias("labelled"),
        F.sum(F.when(F.col("blocked") == 1, F.col("n")).otherwise(0)).alias("bad"),
    )
    tree = tree.withColumn("was", F.col("t"))
    tree = _generalised(tree, many)
    tree = _merged(tree, least, z)
    template = tree.groupBy("host", "t").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
    template = template.select("host", "t", F.when((F.col("b") + strength * prior) / (F.col("l") + strength) >= purity, "block").otherwise("allow").alias("said"))
    said = tree.select("host", "was", "t").join(template, ["host", "t"]).select("host", "was", F.array_join("t", "/").alias("template"), "said")
    named = paths.select("host", "path", F.col("t").alias("was")).join(said, ["host", "was"]).select("host", "path", "template", "said")
    out = own.join(named, ["host", "path"]).withColumn("r", ruled(F.col("host"), F.col("path"), rules))
    return out.select(
        "page_id", "host", "path", F.concat(F.lit("/"), "template").alias("template"),
        F.col("r.rule").alias("rule"), F.coalesce("r.verdict", "said").alias("verdict"),
    )


def _generalised(tree: DataFrame, many: int) -> DataFrame:
    """Variable places become wildcards: a place is a host, a depth and the shapes above."""
    steps = tree.select("host", "was", "n", F.posexplode("t").alias("d", "seg")).withColumn("above", F.expr("slice(was, 1, d)"))
    places = steps.groupBy("host", "d", "above").agg(F.count_distinct("seg").alias("k"), F.sum("n").alias("n"))
    wide = places.where((F.col("k") >= many) & (2 * F.col("k") >= F.col("n"))).select("host", "d", "above")
    hit = steps.join(wide, ["host", "d", "above"]).groupBy("host", "was").agg(F.collect_set("d").alias("ds"))
    ds = F.coalesce("ds", F.array().cast("array<int>"))
    out = tree.join(hit, ["host", "was"], "left")
    return out.withColumn("t", F.transform("t", lambda s, i: F.when(F.array_contains(ds, i), "*").otherwise(s))).drop("ds")


def _merged(tree: DataFrame, least: int, z: float) -> DataFrame:
    """Branches that differ in one segment and have shares of blocked labels that are alike become one."""
    branches = tree.groupBy("host", "t").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b")).where(F.col("l") >= least)
    steps = branches.select("host", "t", "l", "b", F.posexplode("t").alias("d", "seg"))
    steps = steps.withColumn("rest", F.transform("t", lambda s, i: F.when(i == F.col("d"), "*").otherwise(s)))
    pool = steps.groupBy("host", "d", "rest").agg(F.sum("l").alias("pl"), F.sum("b").alias("pb"), F.count(F.lit(1)).alias("k")).where("k > 1")
    p = (F.col("pb") + 0.5) / (F.col("pl") + 1)
    alike = F.abs(F.col("b") - F.col("l") * p) <= z * F.sqrt(F.col("l") * p * (1 - p))
    tested = steps.join(pool, ["host", "d", "rest"]).where(alike)
    ds = tested.groupBy("host", "t").agg(F.collect_set("d").alias("ds"))
    out = tree.join(ds, ["host", "t"], "left")
    hit = F.coalesce("ds", F.array().cast("array<int>"))
    return out.withColumn("t", F.transform("t", lambda s, i: F.when(F.array_contains(hit, i), "*").otherwise(s))).drop("ds")
