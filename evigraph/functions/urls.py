"""URL and domain functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .text import strip

# Query keys that only track visits.
TRACKING_KEYS = ("fbclid", "gclid", "spm", "from", "source", "ref", "referrer")
# Domain endings and domains of authorities, and parts of industry domains.
GOVERNMENT_SUFFIXES = (".gov.cn", ".gov.hk", ".gov.mo", ".gov", ".gov.uk", ".europa.eu")
AUTHORITY_DOMAINS = ("reuters.com", "apnews.com", "bloomberg.com", "sec.gov", "people.com.cn", "xinhuanet.com", "cctv.com", "chinanews.com.cn")
INDUSTRY_MARKERS = ("robot", "robotics", "techcrunch", "theverge", "36kr", "ofweek", "ieee")

_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?//([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def _decoded(c):
    """A query's key or value; a per cent sign that begins no code stays."""
    return F.url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encoded(c):
    """The form in which letters, digits and ``_.-~`` stay and a blank is a plus."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(url):
    """One form for a page: scheme and host lower-cased, the query decoded and encoded again without tracking keys, no fragment or final
    slashes. Without a host: the trimmed text."""
    u = strip(F.coalesce(url, F.lit("")))
    scheme, host, path, query = (F.regexp_extract(u, _PARTS, i) for i in range(1, 5))
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p != ""),
        lambda p: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("k"), _decoded(F.when(p.contains("="), F.substring(p, F.instr(p, "=") + 1, F.length(p))).otherwise("")).alias("v")),
    )
    pairs = F.filter(pairs, lambda p: ~F.lower(p["k"]).startswith("utm_") & ~F.lower(p["k"]).isin(*TRACKING_KEYS))
    whole = F.transform(pairs, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"])))
    cut = F.regexp_replace(path, "/+$", "")
    shown = F.when(F.length(path) <= 1, F.lit("/")).otherwise(cut)
    tail = F.when(F.size(whole) > 0, F.concat(F.lit("?"), F.array_join(whole, "&"))).otherwise("")
    full = F.concat(F.when(scheme == "", "https").otherwise(F.lower(scheme)), F.lit("://"), F.lower(host), shown, tail)
    return F.when(host == "", u).otherwise(full)


def scoring_domain(url):
    """Host without port and ``www.``; null for an empty text."""
    u = strip(F.coalesce(url, F.lit("")))
    full = F.when(u.contains("://"), u).otherwise(F.concat(F.lit("https://"), u))
    host = F.lower(F.regexp_extract(full, r"(?s)^[^:]*://([^/?#]*)", 1))
    return F.nullif(F.regexp_replace(F.substring_index(host, ":", 1), r"^www\.", ""), F.lit(""))


def baseline_domain(url):
    """Host without user, port and ``www.``; empty for an empty text or a dash."""
    u = strip(F.coalesce(url, F.lit("")))
    full = F.when(u.contains("://"), u).otherwise(F.concat(F.lit("https://"), u))
    net = F.lower(F.regexp_extract(full, r"(?s)^[^:]*://([^/?#]*)", 1))
    host = F.regexp_replace(F.regexp_replace(net, "^.*@", ""), ":.*$", "")
    return F.when(u.isin("", "-"), F.lit("")).otherwise(F.regexp_replace(host, r"^www\.", ""))


def _under(domain, parent):
    return (domain == parent) | domain.endswith(F.concat(F.lit("."), parent) if not isinstance(parent, str) else "." + parent)


def source_kind(url, website=None):
    """official, authority, industry or other."""
    d = F.coalesce(scoring_domain(url), F.lit(""))
    authority = F.lit(False)
    for s in GOVERNMENT_SUFFIXES:
        authority = authority | d.endswith(s)
    for s in AUTHORITY_DOMAINS:
        authority = authority | _under(d, s)
    industry = F.lit(False)
    for s in INDUSTRY_MARKERS:
        industry = industry | d.contains(s)
    out = F.when(authority, "authority").when(industry, "industry").otherwise("other")
    if website is None:
        return out
    own = scoring_domain(website)
    return F.when(own.isNotNull() & _under(d, own), "official").otherwise(out)
