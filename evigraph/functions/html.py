"""Page text from HTML: a small standard-library parser in a UDF, and JVM expressions for dates."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Elements whose text is dropped, and the roots tried in order.
DROPPED = {"script", "style", "noscript", "svg", "nav", "footer", "aside"}
ROOTS = ("article", "main", "body")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
PAGE = StructType([StructField("title", StringType()), StructField("content", StringType())])


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.title: list[str] = []
        self.parts: dict[str, list[str]] = {r: [] for r in (*ROOTS, "")}
        self.first: dict[str, int] = {}  # depth at which the first root of a kind opened; -1 once it is closed

    def handle_starttag(self, tag, attrs):
        if tag not in VOID:
            self.open.append(tag)
            if tag in ROOTS:
                self.first.setdefault(tag, len(self.open))

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass
            for r, depth in self.first.items():
                if depth > len(self.open):
                    self.first[r] = -1

    def handle_data(self, data):
        if "title" in self.open:
            self.title.append(data)
        if not DROPPED.intersection(self.open):
            self.parts[""].append(data)
            for r in ROOTS:
                if self.first.get(r, -1) > 0:
                    self.parts[r].append(data)


def page_text(html: str | None) -> tuple[str, str]:
    """Title and text of the first article, else main, else body, else all; white space collapsed."""
    p = _Text()
    p.feed(html or "")
    p.close()
    root = next((r for r in ROOTS if r in p.first), "")
    return " ".join(" ".join(p.title).split()), " ".join(" ".join(p.parts[root]).split())


#: Row by row, as batches of Arrow are cut by rows and not by bytes: ten thousand long pages would be in a worker at once, here it is a hundred at most.
parsed_page = F.udf(page_text, PAGE, useArrow=False)


def _attribute(tag, name: str):
    """The value of a tag's attribute, in quotes of either kind or none; empty if it isn't there."""
    pattern = rf"""(?is)[\s"']{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.concat(*(F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)))


def published_at(html):
    """The first date that can be read of: an article:published_time meta, a publishdate meta, a date meta, a time element with a
    datetime. Of each kind the first tag counts, its attributes in any order. Without a zone it is UTC (the session's zone)."""
    tags = lambda name: F.regexp_extract_all(html, F.lit(rf"(?is)<{name}\b[^>]*>"), F.lit(0))
    meta = lambda key, value: F.filter(tags("meta"), lambda t: _attribute(t, key) == value)
    found = (
        _attribute(F.get(meta("property", "article:published_time"), F.lit(0)), "content"),
        _attribute(F.get(meta("name", "publishdate"), F.lit(0)), "content"),
        _attribute(F.get(meta("name", "date"), F.lit(0)), "content"),
        _attribute(F.get(F.filter(tags("time"), lambda t: F.lower(t).rlike(r"""[\s"']datetime\s*=""")), F.lit(0)), "datetime"),
    )
    return F.coalesce(*(F.try_to_timestamp(F.nullif(F.trim(f), F.lit(""))) for f in found))


def pages_from_html(df, least: int = 100):
    """``(url, html)`` -> page rows with title, content, content_hash and published_at; short pages are left out."""
    out = df.withColumn("_p", parsed_page("html")).select("url", F.col("_p.title").alias("title"), F.col("_p.content").alias("content"), published_at(F.col("html")).alias("published_at"))
    return out.where(F.length("content") >= least).withColumn("content_hash", F.sha2("content", 256))
