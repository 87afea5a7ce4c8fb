"""Masking of phone numbers, e-mail addresses, id numbers and postal addresses."""

from __future__ import annotations

import json
import re
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What is masked, and the keys whose values are always masked.
PHONE = r"(?<!\d)(1[3-9]\d)(\d{4})(\d{4})(?!\d)"
EMAIL = (r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{0,63}"
         r"@([A-Za-z0-9.-]+\.[A-Za-z]{2,})(?![A-Za-z0-9.-])")
ID_NUMBER = r"(?<!\d)(\d{6})(\d{8})(\d{3}[0-9Xx])(?!\d)"
ADDRESS = (r"([一-鿿]{2,}(?:省|市|自治区|自治州|县|区))"
           r"([一-鿿A-Za-z0-9号弄栋单元室路街道镇乡村]{4,})")
SENSITIVE_KEYS = (
    "phone", "mobile", "telephone", "email", "id_card", "identity_card", "address",
    "手机号", "联系电话", "移动电话", "邮箱", "身份证号", "身份证", "住址", "地址")
SECRET_QUERY_KEYS = (
    "access_token", "api_key", "apikey", "auth", "authorization", "code", "credential", "key",
    "password", "secret", "session", "session_id", "signature", "sig", "token")
HIDDEN_KEYS = (
    "chain_of_thought", "chain-of-thought", "cot", "reasoning", "hidden_reasoning", "thinking",
    "system_prompt", "full_prompt")

MASKS = ((PHONE, "$1****$3"), (EMAIL, "$1***@$2"), (ID_NUMBER, "$1********$3"), (ADDRESS, "$1***"))


def redact_phone(col: Column) -> Column:
    return F.regexp_replace(col, PHONE, MASKS[0][1])


def redact_email(col: Column) -> Column:
    return F.regexp_replace(col, EMAIL, MASKS[1][1])


def redact_id_number(col: Column) -> Column:
    return F.regexp_replace(col, ID_NUMBER, MASKS[2][1])


def redact_address(col: Column) -> Column:
    return F.regexp_replace(col, ADDRESS, MASKS[3][1])


def redact_text(col: Column) -> Column:
    """All masks; phone, e-mail, id and address in this order."""
    for pattern, mask in MASKS:
        col = F.regexp_replace(col, pattern, mask)
    return col


def redact_url(url: Column) -> Column:
    """Drop the fragment, mask secret query values, redact the other values."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")

    def encode(col: Column) -> Column:
        text = F.url_encode(col)
        return F.replace(F.replace(text, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))

    def pair(p: Column) -> Column:
        raw_key, raw_value = F.substring_index(p, "=", 1), F.regexp_extract(p, r"=(.*)$", 1)
        key = F.coalesce(F.try_url_decode(raw_key), raw_key)
        value = F.coalesce(F.try_url_decode(raw_value), raw_value)
        safe = F.when(F.lower(key).isin(*SECRET_QUERY_KEYS), "***").otherwise(redact_text(value))
        return F.concat(encode(key), F.lit("="), encode(safe))

    safe_query = F.array_join(F.transform(pairs, pair), "&")
    base = F.regexp_extract(url, r"^[^?#]*", 0)
    return F.concat(base, F.when(safe_query != "", F.concat(F.lit("?"), safe_query)).otherwise(F.lit("")))


def bounded_json(json_col: Column, max_length: int = 1000) -> Column:
    """Redacted JSON text cut to the summary length."""
    return F.substring(redact_text(json_col), 1, max(32, max_length))


def _python_masks() -> list[tuple[re.Pattern[str], str]]:
    return [(re.compile(p), m.replace("$", "\\")) for p, m in MASKS]


def _mask_by_kind(text: str, key: str, masks) -> str:
    groups = ((("phone", "mobile", "电话", "手机"), 0), (("email", "邮箱"), 1), (("id", "身份证"), 2))
    for words, mask in groups:
        if any(w in key for w in words):
            if masks[mask][0].search(text):
                for pattern, repl in masks:
                    text = pattern.sub(repl, text)
                return text
            return "***"
    return "***"


def _rewritten(text: str | None, walk) -> str | None:
    """JSON text after a walk over its value; null where it is no JSON, so nothing unread gets through."""
    if text is None:
        return None
    try:
        value = json.loads(text)
    except ValueError:
        return None
    return json.dumps(walk(value), ensure_ascii=False)


@F.pandas_udf(T.StringType())
def redact_by_key(values: pd.Series) -> pd.Series:
    """Mask a JSON value by its keys at any depth; other text by pattern."""
    masks, sensitive = _python_masks(), {k.casefold() for k in SENSITIVE_KEYS}

    def clean_url(text: str) -> str:
        parts = urlsplit(text)
        pairs = [(k, "***" if k.casefold() in SECRET_QUERY_KEYS else plain(v))
                 for k, v in parse_qsl(parts.query, keep_blank_values=True)]
        return urlunsplit((parts.scheme, parts.netloc, parts.path, urlencode(pairs), ""))

    def plain(text: str) -> str:
        for pattern, repl in masks:
            text = pattern.sub(repl, text)
        return text

    def walk(value, key=""):
        name = key.strip().casefold()
        if name in ("url", "canonical_url") and isinstance(value, str):
            return clean_url(value)
        if name in sensitive:
            return None if value is None else _mask_by_kind(str(value), name, masks)
        if isinstance(value, dict):
            return {k: walk(v, k) for k, v in value.items()}
        if isinstance(value, list):
            return [walk(v) for v in value]
        return plain(value) if isinstance(value, str) else value

    return values.map(lambda t: _rewritten(t, walk))


@F.pandas_udf(T.StringType())
def strip_hidden_keys(values: pd.Series) -> pd.Series:
    """Remove prompt and reasoning keys of a JSON value at any depth."""
    hidden = set(HIDDEN_KEYS)

    def walk(value):
        if isinstance(value, dict):
            return {k: walk(v) for k, v in value.items() if k.strip().casefold() not in hidden}
        return [walk(v) for v in value] if isinstance(value, list) else value

    return values.map(lambda t: _rewritten(t, walk))
