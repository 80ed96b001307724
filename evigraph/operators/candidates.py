"""Model output as rows: VARIANTs of JSON, candidates repaired and validated, and counts of what was rejected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.text import blank_to_empty
from ..functions.urls import source_kind
from .evidence import EVENT_TYPES, has_strong_relation, identifies, quoted, unfenced, valid_relations

# What candidates may say, and other words for it.
STATUSES = ("rumor", "planned", "prototype", "officially_shown", "released", "mass_production", "delivered", "unknown")
EVIDENCE_TYPES = ("product_identity", "product_launch", "official_show", "prototype", "technical_spec", "mass_production", "delivery", "order", "official_product_page")
EVIDENCE_ALIASES = {
    "product": "product_identity", "product_name": "product_identity", "identity": "product_identity", "launch": "product_launch",
    "release": "product_launch", "specification": "technical_spec", "official_page": "official_product_page",
}
RELATION_TYPES = ("developer", "manufacturer", "brand_owner", "publisher", "joint_developer", "integrator", "distributor", "customer", "investor", "partner", "unknown")
RELATION_ALIASES = {"owner": "brand_owner", "brand": "brand_owner", "producer": "manufacturer", "maker": "manufacturer", "joint": "joint_developer"}
REGIONS = ("mainland_china", "hong_kong", "macau", "taiwan", "foreign", "unknown")
TEXT_FIELDS = ("english_name", "model_number", "series_name", "robot_category", "product_description")
NO_DATE = ("none", "null", "unknown", "未知")


def kind_of(v):
    """What a VARIANT is: OBJECT, ARRAY, STRING, BOOLEAN, VOID (a JSON null), a kind of number; null if there is none."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def field_of(v, name: str):
    return F.try_variant_get(v, f"$.{name}", "variant")


def text_of(v):
    """The text of a VARIANT, trimmed; empty for null or nothing."""
    said = F.try_variant_get(v, "$", "string")
    return blank_to_empty(F.when(kind_of(v) == "BOOLEAN", F.initcap(said)).otherwise(said))


def first_field(v, *names: str):
    """The first field of an object that isn't blank, trimmed; empty if there is none."""
    return F.coalesce(*(F.nullif(text_of(field_of(v, n)), F.lit("")) for n in names), F.lit(""))


def items_of(v):
    """The elements of a list, or the only one of an object; of anything else none."""
    none = F.array().cast("array<variant>")
    kind = kind_of(v)
    return F.coalesce(F.when(kind == "ARRAY", F.try_variant_get(v, "$", "array<variant>")).when((kind == "OBJECT") & (F.try_variant_get(v, "$", "string") != "{}"), F.array(v)), none)


def variant_score(v):
    """A number, halves rounded to even, or a label as a score of 0 to 100; other texts, null and nothing are 0."""
    kind = kind_of(v)
    number = F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("int").cast("double")).when(~kind.isin("STRING", "OBJECT", "ARRAY", "VOID"), F.try_variant_get(v, "$", "double"))
    return F.coalesce(F.when(number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.bround(number)))).cast("int"), F.when(kind == "STRING", scoring.label_score(F.try_variant_get(v, "$", "string"))), F.lit(0))


def candidate_date(c):
    """ISO dates, the day of ISO datetimes with a T, and ``Y年M月D日``; anything else is null."""
    t = blank_to_empty(c)
    cjk = F.regexp_extract(t, r"^(\d{4})年(\d{1,2})月(\d{1,2})日$", 1)
    part = lambda i: F.lpad(F.regexp_extract(t, r"^(\d{4})年(\d{1,2})月(\d{1,2})日$", i), 2, "0")
    iso = F.when(cjk != "", F.concat_ws("-", cjk, part(2), part(3))).when(t.rlike(r"(?s)^\d{4}-\d{2}-\d{2}T"), F.left(t, F.lit(10))).otherwise(t)
    return F.when(~F.lower(t).isin(*NO_DATE) & iso.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(iso, "yyyy-MM-dd").cast("string"))


def _alias(c, aliases: dict[str, str]):
    return F.coalesce(F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv))[c], c)


def _is_object(v):
    return F.coalesce(kind_of(v) == "OBJECT", F.lit(False))


def raw_candidates(pages: DataFrame, reply: str, *columns: str) -> DataFrame:
    """One row for each entry of the reply's ``candidates`` with its place ``pos`` and the VARIANT ``item``; a code fence goes first,
    one object counts as a list of one, a reply that is no JSON object, a JSON text with JSON in it too, has none."""
    whole = F.try_parse_json(unfenced(F.col(reply)))
    return pages.select(*columns, F.posexplode(items_of(field_of(whole, "candidates"))).alias("pos", "item"))


def repaired_candidates(rows: DataFrame) -> DataFrame:
    """Adds the repaired fields of each VARIANT ``item``, whether anything was ``repaired``, and how much evidence was ``rejected``.

    Entries that aren't objects get ``is_object`` false. Texts that are numbers, nulls or have blanks around them count as repaired, fields that
    aren't there don't; a relevance that is no number does.
    """
    item, field = F.col("item"), lambda n: field_of(F.col("item"), n)
    names = {n: text_of(field(n)) for n in ("original_name", "canonical_name")}
    filled = {"original_name": F.when(names["original_name"] == "", names["canonical_name"]).otherwise(names["original_name"]), "canonical_name": F.when(names["canonical_name"] == "", names["original_name"]).otherwise(names["canonical_name"])}
    texts = {n: text_of(field(n)) for n in TEXT_FIELDS}
    plain = lambda v: F.try_variant_get(v, "$", "string")
    as_said = lambda v, shown: v.isNull() | ((kind_of(v) == "STRING") & (plain(v) == shown))
    day, status = candidate_date(text_of(field("launch_date"))), F.when(kind_of(field("launch_status")) == "STRING", plain(field("launch_status")))
    evidence, relations = items_of(field("field_evidence")), items_of(field("company_relations"))

    said = lambda e: F.lower(text_of(field_of(e, "evidence_type")))
    quote = lambda e: first_field(e, "quote", "source_quote", "evidence_quote", "text", "value")
    fits = lambda e: _is_object(e) & _alias(said(e), EVIDENCE_ALIASES).isin(*EVIDENCE_TYPES) & (quote(e) != "")
    kept = F.transform(F.filter(evidence, fits), lambda e: F.struct(
        _alias(said(e), EVIDENCE_ALIASES).alias("evidence_type"), quote(e).alias("quote"), first_field(e, "value").alias("value"), candidate_date(text_of(field_of(e, "evidence_date"))).alias("evidence_date"),
    ))
    other_words = F.exists(evidence, lambda e: _is_object(e) & (_alias(said(e), EVIDENCE_ALIASES) != said(e)))
    other_quotes = F.exists(evidence, lambda e: fits(e) & (first_field(e, "quote") == ""))

    claim = lambda r: first_field(r, "evidence_quote", "quote", "source_quote", "text")
    named = lambda r: _is_object(r) & (first_field(r, "company_name") != "") & (claim(r) != "")
    type_of = lambda r: _alias(F.lower(first_field(r, "relation_type")), RELATION_ALIASES)
    region = lambda r: F.lower(first_field(r, "company_region_type"))
    known = lambda c, values: F.when(c.isin(*values), c).otherwise("unknown")
    related = F.transform(F.filter(relations, named), lambda r: F.struct(
        first_field(r, "company_name").alias("company_name"), known(type_of(r), RELATION_TYPES).alias("relation_type"), claim(r).alias("evidence_quote"),
        variant_score(field_of(r, "confidence")).alias("confidence"), known(region(r), REGIONS).alias("company_region_type"),
    ))
    unknown = F.exists(relations, lambda r: named(r) & (~type_of(r).isin(*RELATION_TYPES) | ~region(r).isin(*REGIONS)))

    # a list that is an object, or something else that isn't empty
    no_list = lambda v: ~kind_of(v).isin("ARRAY", "VOID") & ~plain(v).isin("", "{}", "0", "0.0", "false")
    changed = [
        filled["original_name"] != names["original_name"], filled["canonical_name"] != names["canonical_name"],
        *(~as_said(field(n), texts[n]) for n in TEXT_FIELDS), ~(as_said(field("launch_date"), day) | ((kind_of(field("launch_date")) == "VOID") & day.isNull())), ~status.isin(*STATUSES),
        kind_of(field("product_relevance")).isin("STRING", "VOID", "OBJECT", "ARRAY"), field("product_relevance").isNull(), status.isNull(),
        other_words, other_quotes, unknown, no_list(field("field_evidence")), no_list(field("company_relations")),
    ]
    any_ = F.lit(False)
    for c in changed:
        any_ = any_ | F.coalesce(c, F.lit(False))
    # a date that can't be read is a change too
    any_ = any_ | F.coalesce(day.isNull() & field("launch_date").isNotNull() & (kind_of(field("launch_date")) != "VOID"), F.lit(False))
    return rows.select(
        "*", _is_object(item).alias("is_object"), *(c.alias(n) for n, c in (filled | texts).items()), day.alias("launch_date"), known(status, STATUSES).alias("launch_status"),
        F.lower(text_of(field("novelty_claimed"))).isin("1", "true", "yes", "是").alias("novelty_claimed"), kept.alias("field_evidence"), related.alias("company_relations"),
        (_is_object(item) & any_).alias("repaired"), F.when(_is_object(item), F.size(evidence) - F.size(kept) + F.size(relations) - F.size(related)).otherwise(0).alias("rejected"),
    )


def validated_candidates(rows: DataFrame, content: str, url: str) -> DataFrame:
    """Evidence and relations that the page bears out, ``valid`` for candidates that keep an identity and a strong mainland relation,
    their ``product_relevance``, and all that was ``rejected``."""
    names = [F.col(n) for n in ("original_name", "canonical_name", "model_number")]
    d = rows.withColumn("_evidence", quoted(F.col("field_evidence"), F.col(content)))
    d = d.withColumn("_relations", valid_relations(F.col("company_relations"), F.col(content), *names)).withColumn("_identity", F.col("is_object") & F.coalesce(identifies(F.col("_evidence"), *names), F.lit(False)))
    valid = F.col("_identity") & has_strong_relation(F.col("_relations"))
    lost = F.size("field_evidence") - F.size("_evidence") + F.when(F.col("_identity"), F.size("company_relations") - F.size("_relations")).otherwise(0)
    detail = (F.col("model_number") != "") | F.col("launch_date").isNotNull() | F.exists("_evidence", lambda e: (e["evidence_type"] == "technical_spec") | e["evidence_date"].isNotNull())
    score = scoring.relevance(F.lit(True), F.exists("_evidence", lambda e: e["evidence_type"].isin(*EVENT_TYPES)), F.size("_relations") > 0, source_kind(F.col(url)).isin("official", "authority"), detail)
    kept = [c for c in rows.columns if c not in ("field_evidence", "company_relations", "rejected")]
    return d.select(
        *kept, F.col("_evidence").alias("field_evidence"), F.col("_relations").alias("company_relations"), (F.col("rejected") + F.when(F.col("is_object"), lost).otherwise(0)).alias("rejected"),
        valid.alias("valid"), F.when(valid, score).alias("product_relevance"),
    )


def extraction_report(rows: DataFrame, *by: str) -> DataFrame:
    """Counts by page, or over all: candidates that came, that were repaired, that are invalid or valid, and evidence that was rejected."""
    n = lambda c: F.count_if(c)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("raw_candidates"), n(F.col("repaired")).alias("repaired_candidates"), n(~F.col("valid")).alias("invalid_candidates"),
        n(F.col("valid")).alias("valid_candidates"), F.coalesce(F.sum("rejected"), F.lit(0)).alias("evidence_rejected"),
    )
