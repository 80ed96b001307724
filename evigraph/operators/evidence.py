"""Validation of extracted candidates against the page they came from."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions.text import collapse

# Relation types that identify a maker, event types, and the status each event supports with its rank.
STRONG_RELATIONS = ("developer", "manufacturer", "brand_owner", "publisher", "joint_developer")
EVENT_TYPES = ("product_launch", "official_show", "prototype", "mass_production", "delivery")
STATUS_OF = {"product_launch": "released", "official_show": "officially_shown", "prototype": "prototype", "mass_production": "mass_production", "delivery": "delivered"}
STATUS_RANK = {"unknown": 0, "rumor": 1, "planned": 2, "prototype": 3, "officially_shown": 4, "released": 5, "mass_production": 6, "delivered": 7}


def _once(use, **values):
    """``use`` of a struct of values, so that they are made once for all elements of an array."""
    return F.transform(F.array(F.struct(*(v.alias(k) for k, v in values.items()))), use)[0]


def _page(content):
    """Evidence form with widths folded, as quotes and pages write them as they like."""
    return text.evidence_key(text.single_forms(content))


def _keys(texts):
    return F.transform(texts, _page)


def quoted(evidence, content, exact: bool = False):
    """Evidence whose quote is in the page: in evidence form, or with white space collapsed if ``exact``."""
    quotes = F.transform(evidence, lambda e: e["quote"])
    keys, page = (F.transform(quotes, collapse), collapse(content)) if exact else (_keys(quotes), _page(content))
    hits = lambda s: F.filter(F.zip_with(s["own"], s["keys"], lambda e, k: F.when((k != "") & F.contains(s["page"], k), e)), lambda e: e.isNotNull())
    return _once(hits, own=evidence, keys=keys, page=page)


def identifies(evidence, *names):
    """Whether a quote has one of the names or the model number in it."""
    found = lambda s: F.exists(s["quotes"], lambda q: F.exists(s["names"], lambda k: (k != "") & F.contains(q, k)))
    return _once(found, quotes=_keys(F.transform(evidence, lambda e: e["quote"])), names=_keys(F.array(*names)))


def valid_relations(relations, content, *names):
    """Mainland relations whose quote is in the page and names both the company, which must have a name, and the product."""
    quotes, companies = _keys(F.transform(relations, lambda r: r["evidence_quote"])), _keys(F.transform(relations, lambda r: r["company_name"]))

    def fits(s):
        named = F.zip_with(s["quotes"], s["companies"], lambda q, c: (q != "") & F.contains(s["page"], q) & (c != "") & F.contains(q, c) & F.exists(s["names"], lambda k: (k != "") & F.contains(q, k)))
        return F.filter(F.zip_with(s["own"], named, lambda r, n: F.when(n & (r["company_region_type"] == "mainland_china"), r)), lambda r: r.isNotNull())

    return _once(fits, own=relations, quotes=quotes, companies=companies, page=_page(content), names=_keys(F.array(*names)))


def has_strong_relation(relations):
    return F.exists(relations, lambda r: r["relation_type"].isin(*STRONG_RELATIONS))


def _map(values: dict):
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def supported_status(evidence, claimed):
    """The highest status that evidence supports; without any, a claimed rumor or plan; else unknown."""
    of, rank = _map(STATUS_OF), _map(STATUS_RANK)
    seen = F.filter(F.transform(evidence, lambda e: of[e["evidence_type"]]), lambda s: s.isNotNull())
    best = F.array_max(F.transform(seen, lambda s: F.struct(rank[s].alias("r"), s.alias("s"))))["s"]
    return F.coalesce(best, F.when(claimed.isin("rumor", "planned"), claimed), F.lit("unknown"))


def claim_fingerprint(evidence, content_hash):
    """SHA-256 of the sorted claims, or the page's hash if there are none."""
    none = lambda c: F.coalesce(c, F.lit(""))
    lines = F.zip_with(evidence, _keys(F.transform(evidence, lambda e: e["quote"])), lambda e, k: F.concat_ws("|", none(e["evidence_type"]), k, none(e["value"]), none(e["evidence_date"].cast("string"))))
    return F.when(F.size(evidence) > 0, F.sha2(F.array_join(F.array_sort(lines), "\n"), 256)).otherwise(content_hash)


def parsed_strings(c):
    """A JSON list of strings; text that isn't one is a list of itself."""
    text = F.coalesce(c, F.lit(""))
    return F.coalesce(F.from_json(text, "array<string>"), F.when(F.trim(text) == "", F.array().cast("array<string>")).otherwise(F.array(text)))


def parsed_objects(c, fields: str):
    """A JSON list of objects; other entries go, other texts give an empty list."""
    kind = f"array<struct<{fields}>>"
    return F.coalesce(F.filter(F.from_json(c, kind), lambda x: x.isNotNull()), F.array().cast(kind))


def unfenced(c):
    """JSON without a code fence around it."""
    return F.regexp_replace(F.trim(c), r"(?s)^```(?:json)?\s*|\s*```$", "")
