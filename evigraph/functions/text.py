"""Text normalizers. There are several on purpose: each stage keys on its own."""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Suffixes of the baseline normalizer, in the order in which they are taken off.
BASELINE_SUFFIXES = (
    "股份有限公司", "有限责任公司", "有限公司", "集团公司", "集团",
    "incorporated", "corporation", "limited", "company", "inc", "corp", "ltd", "co",
)
# Traditional characters and their simplified forms.
TRADITIONAL = "術臺灣數華國機網絡電腦資訊實業創聯動產發責團"
SIMPLIFIED = "术台湾数华国机网络电脑资讯实业创联动产发责团"
# Legal forms, longest first.
LEGAL_SUFFIXES = (
    "集团股份有限责任公司", "集团股份有限公司", "股份有限责任公司", "特殊普通合伙企业", "有限合伙企业", "普通合伙企业",
    "有限责任公司", "股份有限公司", "集团有限公司", "股份公司", "有限合伙", "普通合伙", "有限公司", "集团公司", "公司",
)
# The endings that search words are made without, in the order in which they are tried.
SEARCH_LEGAL = ("集团股份有限公司", "集团有限公司", "股份有限公司", "有限责任公司", "有限公司", "公司")
SEARCH_BUSINESS = ("人工智能科技", "智能科技", "机器人科技", "网络科技", "信息科技", "科技")
# Patterns of secret-looking values, final robot nouns, dashes of shown names, model tokens and what evidence is compared without.
SECRET_VALUE = r"(?i)\b(api[-_ ]?key|secret|token|authorization|key)\b\s*[:=]\s*[^\s,;]+"
ROBOT_NOUN = "(?:人形|工业|服务|特种)?机器人$"
DASHES = r"(?U)\s*[-‐‑‒–—]\s*"
MODEL_TOKEN = r"(?<![A-Za-z0-9])([A-Za-z]{0,8}\d[A-Za-z0-9.-]{0,15})(?![A-Za-z0-9])"
EVIDENCE_MARKS = r"(?U)[\s\-_/—–·,，。:：;；()（）\[\]【】]+"


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """NFKC, which Spark has no function for."""
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


@functools.cache
def _single_forms() -> tuple[str, str]:
    """Characters whose NFKC is one other character, and those."""
    own = [chr(c) for c in range(0x80, 0xFFFF) if not 0xD800 <= c < 0xE000]
    pairs = [(c, f) for c in own if (f := unicodedata.normalize("NFKC", c)) != c and len(f) == 1]
    return "".join(c for c, _ in pairs), "".join(f for _, f in pairs)


def single_forms(c):
    """Wide, narrow, circled and other forms of one character as that character: NFKC but for forms of several characters (as ㈱), which
    stay, and for composition. It needs no Python, so it may stand in functions of arrays."""
    return F.translate(c, *_single_forms())


def casefold(c):
    """Lower case with ß as ss: equals casefold for all letters of the supported languages."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def compat(c, unicode: bool):
    """NFKC where asked for; plain ASCII input needs none and stays in the JVM."""
    return nfkc(c) if unicode else c


def strip(c):
    """Trim of all Unicode white space; null stays null."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c):
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def blank_to_empty(c):
    return F.coalesce(strip(c), F.lit(""))


def company_key(c):
    """Baseline company key: no punctuation, then each suffix taken off once, in turn."""
    out = F.regexp_replace(strip(casefold(F.coalesce(c, F.lit("")))), r"(?U)[\s\-_,.，。()（）·]+", "")
    for suffix in BASELINE_SUFFIXES:
        out = F.regexp_replace(out, suffix + "$", "")
    return out


def registry_key(c, unicode: bool = True):
    """Registry company key: compatibility forms folded, simplified, and only digits, a-z and CJK kept."""
    folded = casefold(compat(F.coalesce(c, F.lit("")), unicode))
    return F.regexp_replace(F.translate(folded, TRADITIONAL, SIMPLIFIED), "[^0-9a-z㐀-鿿]+", "")


def without_legal_suffix(key):
    """``(rest, suffix)`` as a struct; the longest suffix that leaves something."""
    rest, suffix = F.lit(None).cast("string"), F.lit(None).cast("string")
    for s in reversed(LEGAL_SUFFIXES):
        fits = key.endswith(s) & (F.length(key) > len(s))
        rest = F.when(fits, F.regexp_replace(key, s + "$", "")).otherwise(rest)
        suffix = F.when(fits, F.lit(s)).otherwise(suffix)
    return F.struct(F.coalesce(rest, key).alias("rest"), F.coalesce(suffix, F.lit("")).alias("suffix"))


def display_name(c, unicode: bool = True):
    """Shown product name: one blank for white space, dashes as ``-`` without blanks around."""
    return F.regexp_replace(collapse(compat(F.coalesce(c, F.lit("")), unicode)), DASHES, "-")


def product_key(c, unicode: bool = True):
    """Product key: final robot nouns go, then all but digits, a-z and CJK."""
    folded = strip(casefold(compat(F.coalesce(c, F.lit("")), unicode)))
    return F.regexp_replace(F.regexp_replace(folded, ROBOT_NOUN, ""), "[^0-9a-z一-鿿]+", "")


def model_token(display):
    """The last token of a shown name that has a digit in it; empty if there is none."""
    found = F.regexp_extract_all(display, F.lit(MODEL_TOKEN), F.lit(1))
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(""))


def product_identity(name, model=None, series=None, unicode: bool = True):
    """Struct of canonical_name, normalized_name, model_number, model_key, series_key and identity_key."""
    shown = display_name(name, unicode)
    given = display_name(model, unicode) if model is not None else F.lit("")
    number = F.when(given == "", model_token(shown)).otherwise(given)
    key, model_key = product_key(shown, False), product_key(number, False)
    series_key = product_key(display_name(series, unicode), False) if series is not None else F.lit("")
    parts = F.filter(F.array(key, model_key), lambda p: p != "")
    return F.struct(
        shown.alias("canonical_name"), key.alias("normalized_name"), number.alias("model_number"),
        model_key.alias("model_key"), series_key.alias("series_key"), F.array_join(parts, "|").alias("identity_key"),
    )


def inventory_key(c, unicode: bool = True):
    return F.regexp_replace(casefold(compat(F.coalesce(c, F.lit("")), unicode)), "[^0-9a-z一-鿿]", "")


def evidence_key(c, unicode: bool = False):
    """Evidence text without white space, dashes, commas, stops, colons and brackets."""
    return F.regexp_replace(casefold(compat(F.coalesce(c, F.lit("")), unicode)), EVIDENCE_MARKS, "")


def credit_code(c):
    return F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^0-9A-Z]", "")


def cache_key(c):
    return casefold(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", ""))


def has_cjk(c):
    return F.coalesce(c, F.lit("")).rlike("[一-鿿]")


def aliases(c):
    """Alias cell cut at full- and half-width separators; blanks and empty parts go."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[；;、|\n]"), strip), lambda p: p != "")


def without_tags(c):
    return collapse(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", ""))


def truncated(c, most: int = 32_000, marker: str = "…"):
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - len(marker)), F.lit(marker))).otherwise(c)


def redacted(c, secrets: tuple[str, ...] = (), most: int = 500):
    """Known secrets, then values of secret-looking keys, are starred in the text with white space collapsed; the rest is cut."""
    out = collapse(F.coalesce(c, F.lit("")))
    for s in secrets:
        if s:
            out = F.replace(out, F.lit(s), F.lit("***"))
    return F.substring(F.regexp_replace(out, SECRET_VALUE, "$1=***"), 1, most)


def keyword_variants(c):
    """Search words for a registry: the name without white space, without its legal form, and without a business word too; each is
    taken off once and leaves two characters or more."""
    name = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "")
    legal = _without_one(name, SEARCH_LEGAL)
    business = _without_one(legal, SEARCH_BUSINESS)
    return F.slice(F.array_distinct(F.filter(F.array(name, legal, business), lambda w: F.length(w) >= 2)), 1, 3)


def _without_one(c, suffixes: tuple[str, ...]):
    """The text without the first of the suffixes that it ends with and that leaves two characters."""
    out = None
    for s in suffixes:
        fits, rest = c.endswith(s) & (F.length(c) > len(s) + 1), F.left(c, F.length(c) - len(s))
        out = F.when(fits, rest) if out is None else out.when(fits, rest)
    return out.otherwise(c)


# Words by which a quote claims that a product is new, or better than one before.
NOVELTY_CLAIM = "新品|首款|新一代|新型号|首次发布|全新"
UPGRADE_CLAIM = "升级|迭代|第.{0,3}代|新一代"


def claims_novelty(c):
    return F.coalesce(c, F.lit("")).rlike(NOVELTY_CLAIM)


def claims_upgrade(c):
    return F.coalesce(c, F.lit("")).rlike(UPGRADE_CLAIM)


def english_name(english, canonical, original, chinese, translated):
    """The name to be translated: the first of English, canonical and original name that has a Latin letter; empty where a Chinese one is known."""
    known = (F.coalesce(chinese, F.lit("")) != "") | (F.coalesce(translated, F.lit("")) != "") | has_cjk(canonical) | has_cjk(original)
    fits = [F.when(F.coalesce(c, F.lit("")).rlike("[A-Za-z]") & ~has_cjk(c), strip(c)) for c in (english, canonical, original)]
    return F.when(known, F.lit("")).otherwise(F.coalesce(*fits, F.lit("")))
