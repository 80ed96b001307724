"""Company entries in JSON replies of unknown form: found under any wrapper, read by known field names, else by what keys and values look like; and the form itself."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

#: JSON texts within JSON texts that are read, containers within containers that are searched, and levels and keys that a form shows.
TEXTS, DEEP, SHOWN, KEYS = 3, 8, 3, 20
# Where lists of entries lie, most likely first.
WRAPPERS = ("Result", "result", "records", "rows", "list", "items", "data", "Data")
# Names of an entry's fields, most likely first.
FIELDS = {
    "name": (
        "Name", "name", "CompanyName", "companyName", "company_name", "EnterpriseName", "enterpriseName", "EntName", "entName", "QCCName", "qccName",
        "CompanyFullName", "companyFullName", "company_full_name", "RegisteredName", "registeredName", "registered_name", "企业名称", "企业全称", "公司名称", "名称",
    ),
    "credit_code": (
        "CreditCode", "creditCode", "credit_code", "SocialCreditCode", "socialCreditCode", "UnifiedSocialCreditCode", "unifiedSocialCreditCode",
        "unified_social_credit_code", "UnifiedCode", "unifiedCode", "unified_code", "USCC", "uscc", "CreditNo", "creditNo", "统一社会信用代码", "社会信用代码", "信用代码",
    ),
    "key_no": ("KeyNo", "keyNo", "key_no", "QCCKeyNo", "qccKeyNo"),
    "registration_number": ("No", "no", "RegNo", "regNo", "registrationNumber", "注册号"),
    "start_date": ("StartDate", "startDate", "start_date", "成立日期"),
    "operator_name": ("OperName", "operName", "OperatorName", "operatorName", "LegalPerson", "legalPerson", "LegalRepresentative", "legalRepresentative", "法定代表人"),
    "status": ("Status", "status", "RegStatus", "regStatus", "登记状态"),
    "address": ("Address", "address", "RegisteredAddress", "registeredAddress", "地址"),
}
# What keys and values look like that hold a name or a code, and names of legal entities.
LIKE = {
    "name": (r"(?:company|enterprise|ent|qcc).?name|企业.?名称|企业.?全称|公司.?名称", r".{2,}(?:有限责任公司|股份有限公司|集团有限公司|有限公司|公司)"),
    "credit_code": (r"(?:unified|social|credit|uscc).?(?:code|no)|统一.?社会.?信用.?代码|社会.?信用.?代码|信用.?代码", r"[0-9A-Z]{18}"),
}
LEGAL = r"(?:有限责任公司|股份有限公司|集团有限公司|有限公司|集团公司|公司|合伙企业|个人独资企业)$"
ELSEWHERE = "香港|澳门|澳門|台湾|台灣"
_ENTRY = StructType([StructField(f, StringType()) for f in FIELDS])


def _read(value):
    """What a JSON text holds, if it looks like a container, a few texts deep; other values as they are."""
    for _ in range(TEXTS):
        if not (isinstance(value, str) and value.strip()[:1] in ("[", "{")):
            break
        try:
            value = json.loads(value.strip())
        except ValueError:
            break
    return value


def _shown(value) -> str:
    return "" if value is None else str(value).strip()


def _scalars(value, level: int = 0) -> Iterator[tuple[str, str]]:
    """Keys and texts of all values that aren't containers, in order."""
    value = _read(value)
    if level > SHOWN or not isinstance(value, (dict, list)):
        return
    for key, v in value.items() if isinstance(value, dict) else (("", v) for v in value):
        if isinstance(v, (dict, list)) or isinstance(value, list):
            yield from _scalars(v, level + 1)
        elif _shown(v):
            yield key, _shown(v)


def entry_of(item: dict) -> dict[str, str] | None:
    """The entry's fields, or None if it has no name or nothing that makes it a registered company."""
    out = {field: next((t for k in names if (t := _shown(item.get(k)))), "") for field, names in FIELDS.items()}
    for field, (key_like, value_like) in LIKE.items():
        if not out[field]:
            pairs = list(_scalars(item))
            by_key = (v for k, v in pairs if re.search(key_like, re.sub(r"[\s_\-]", "", k).casefold(), re.I))
            by_value = (v for _, v in pairs if re.fullmatch(value_like, v, re.I))
            out[field] = next(by_key, None) or next(by_value, "")
    out["name"] = " ".join(re.sub(r"<[^>]+>", "", out["name"]).split())
    out["credit_code"] = out["credit_code"].upper()
    sure = out["credit_code"] or out["key_no"] or out["registration_number"] or re.search(LEGAL, out["name"])
    return out if out["name"] and sure else None


def items_of(value, level: int = 0) -> list[dict]:
    """The objects of the first list that has any: under the known wrappers first, else under all keys in order; an object without any is one itself if it is an entry."""
    value = _read(value)
    if level > DEEP or not isinstance(value, (dict, list)):
        return []
    if isinstance(value, list):
        return [v for v in value if isinstance(v, dict)] or [i for v in value for i in items_of(v, level + 1)]
    for key in WRAPPERS:
        if key in value and (found := items_of(value[key], level + 1)):
            return found
    return [i for v in value.values() for i in items_of(v, level + 1)] or ([value] if entry_of(value) else [])


def form_of(value, level: int = 0) -> str:
    """Keys and kinds of a JSON value without what it says: lists with their length and first element's form, a few levels and keys."""
    if level > SHOWN:
        return "…"
    value = _read(value)
    if isinstance(value, dict):
        inner = [f"{str(k)[:40]}:{form_of(v, level + 1)}" for k, v in list(value.items())[:KEYS]] + ["…"] * (len(value) > KEYS)
        return "{" + ",".join(inner) + "}"
    if isinstance(value, list):
        first = form_of(value[0], level + 1) if value else ""
        return f"list[{len(value)}]" + (f"<{first}>" if first else "")
    return "null" if value is None else "boolean" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "string"


def _loaded(text):
    try:
        return json.loads(text) if text is not None else None
    except ValueError:
        return text


@F.pandas_udf(ArrayType(_ENTRY))
def entries_of(replies: pd.Series) -> pd.Series:
    return pd.Series([[e for i in items_of(_loaded(t)) if (e := entry_of(i))] for t in replies])


@F.pandas_udf(StringType())
def form(replies: pd.Series) -> pd.Series:
    """The form of each reply; of a text that is no JSON ``string``, of null ``null``."""
    return pd.Series([form_of(_loaded(t)) for t in replies])


def registry_entries(replies: DataFrame, reply: str, *columns: str) -> DataFrame:
    """One row for each company of a reply that lies on the mainland, with its place ``pos`` among all its companies and its fields, empty where it has none.

    A reply is JSON under any wrappers, which may be JSON texts themselves. Replies that are null, no JSON or hold no company give no rows.
    """
    rows = replies.select(*columns, F.posexplode(entries_of(F.col(reply))).alias("pos", "e")).select(*columns, "pos", "e.*")
    return rows.where(~F.concat_ws(" ", "name", "address").rlike(ELSEWHERE))


def merged_forms(rows: DataFrame, text: str, *by: str) -> DataFrame:
    """``form``: one form for all JSON texts of a group, as a VARIANT's type; the aggregate merges, so it is the same however rows lie. Texts that are no JSON don't count."""
    return rows.groupBy(*by).agg(F.schema_of_variant_agg(F.try_parse_json(text)).alias("form"))
