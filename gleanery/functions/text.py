"""Text helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_blank(col: Column) -> Column:
    """Null, or text without any non-space character."""
    return col.isNull() | ~col.cast("string").rlike(r"(?U)\S")


def not_blank(col: Column) -> Column:
    return ~is_blank(col)


def strip(col: Column) -> Column:
    """Trim every kind of Unicode space, which ``trim`` does not."""
    return F.regexp_replace(col.cast("string"), r"(?U)^\s+|\s+$", "")


def fold(col: Column) -> Column:
    """Lower case plus the sharp-s expansion."""
    return F.replace(F.lower(col), F.lit("ß"), F.lit("ss"))


def norm_key(col: Column) -> Column:
    """Stripped, case-folded comparison key; null becomes the empty string."""
    return F.coalesce(fold(strip(col)), F.lit(""))


def norm_field_name(col: Column) -> Column:
    return F.lower(F.regexp_replace(col, r"(?U)[\s_\-（）()]+", ""))


def collapse_space(col: Column) -> Column:
    return strip(F.regexp_replace(col, r"(?U)\s+", " "))


def search_tokens(col: Column) -> Column:
    """Words, single CJK characters, and bigrams over the CJK characters."""
    low = fold(col)
    words = F.regexp_extract_all(low, F.lit(r"[a-z0-9]+"), F.lit(0))
    cjk = F.regexp_extract_all(low, F.lit(r"[\u4e00-\u9fff]"), F.lit(0))
    # neighbours are zipped, since a lambda body would extract the characters anew per index
    pairs = F.array_compact(F.zip_with(cjk, F.slice(cjk, F.lit(2), F.greatest(F.size(cjk) - 1, F.lit(0))), lambda a, b: F.concat(a, b)))
    # most texts have none, and one look is cheaper than three extractions
    return F.when(low.rlike(r"[\u4e00-\u9fff]"), F.concat(words, cjk, pairs)).otherwise(words)


def term_set(col: Column) -> Column:
    return F.array_distinct(
        F.regexp_extract_all(fold(col), F.lit(r"[a-z0-9]+|[\u4e00-\u9fff]"), F.lit(0)))


def term_overlap(query_terms: Column, text_terms: Column) -> Column:
    """Share of the query terms that the text has; 0 for a query without terms."""
    n = F.size(query_terms)
    return F.when(n > 0, F.size(F.array_intersect(query_terms, text_terms)) / n).otherwise(F.lit(0.0))


def excerpt(text: Column, query: Column, limit: int = 240, lead: int = 80) -> Column:
    """Window of ``limit`` characters around the first hit, with marks where text was cut."""
    flat = collapse_space(text)
    hit = F.call_function("instr", fold(flat), fold(strip(query)))
    start = F.greatest(F.when(hit > 0, hit - 1 - lead).otherwise(F.lit(0)), F.lit(0))
    body = F.substring(flat, start + 1, F.lit(limit))
    return F.concat(
        F.when(start > 0, F.lit("…")).otherwise(F.lit("")), body,
        F.when(start + limit < F.length(flat), F.lit("…")).otherwise(F.lit("")))


def claim_normal(col: Column) -> Column:
    """Claim text without any space or closing mark, case-folded."""
    bare = F.regexp_replace(col, r"(?U)\s+", "")
    return fold(F.btrim(bare, F.lit("。.!！?？;；")))


def split_claims(draft: Column) -> Column:
    """Array of claims: sentence or line pieces, without headings and table rules."""
    parts = F.transform(F.split(draft, r"[。！？!?；;\n]+|(?<=\.)(?U:\s+)"), strip)
    return F.filter(
        parts,
        lambda p: (p != "") & ~p.rlike(r"^(?:#{1,6}\s+[^\n]+|[|\s:\-]+)$"))


def value_key(col: Column) -> Column:
    """Comparable form of a scalar given as text: a plain number without closing zeros, or the text."""
    text = strip(col)
    number = text.try_cast("decimal(38,18)")
    plain = F.regexp_replace(
        F.regexp_replace(number.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return (F.when(col.isNull() | (text == ""), F.lit(None).cast("string"))
            .when(number.isNotNull(), F.concat(F.lit("number:"), plain))
            .otherwise(F.concat(F.lit("text:"), text)))


def is_timestamp(col: Column) -> Column:
    """ISO date or date-time with dashes, ``Z`` or an offset allowed."""
    text = strip(col)
    shaped = text.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:\d{2})?)?$")
    return F.coalesce(shaped & F.try_to_timestamp(text).isNotNull(), F.lit(False))


def duration_ms(start: Column, end: Column) -> Column:
    """Whole non-negative milliseconds between two timestamps; null if either is null."""
    def micros(c: Column) -> Column:
        return F.unix_micros(c.cast("timestamp"))
    return F.greatest(F.lit(0), F.floor((micros(end) - micros(start)) / 1000)).cast("bigint") + F.when(
        start.isNull() | end.isNull(), F.lit(None).cast("bigint")).otherwise(F.lit(0))


def years_in(col: Column) -> Column:
    return F.array_distinct(
        F.regexp_extract_all(col, F.lit(r"(?<!\d)(?:19\d{2}|20\d{2}|2100)(?!\d)"), F.lit(0)))


def single_year(col: Column) -> Column:
    """The year of a text that holds exactly one distinct year, else null."""
    years = years_in(col)
    return F.when(F.size(years) == 1, F.element_at(years, 1).cast("int"))
