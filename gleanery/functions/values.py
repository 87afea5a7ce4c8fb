"""Typing of raw text cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.text import strip

INTEGER_PATTERN = r"^[-+]?\d+$"
FLOAT_PATTERN = r"^[-+]?(?:\d+\.\d*|\d*\.\d+)(?:[Ee][-+]?\d+)?$"


def cell_kind(raw: Column) -> Column:
    """empty, boolean, integer, number or string, judged on the text of one cell."""
    text = strip(raw)
    return (F.when(raw.isNull() | (text == ""), "empty")
            .when(F.lower(text).isin("true", "false"), "boolean")
            .when(text.rlike(INTEGER_PATTERN), "integer")
            .when(text.rlike(FLOAT_PATTERN), "number")
            .otherwise("string"))


def typed_cell(raw: Column) -> Column:
    """Struct(kind, s, i, d, b): the text and its typed value where it has one.

    Whole numbers beyond 38 digits keep their text only.
    """
    text, kind = strip(raw), cell_kind(raw)
    return F.struct(
        kind.alias("kind"),
        F.when(kind != "empty", text).alias("s"),
        F.when(kind == "integer", text.try_cast("decimal(38,0)")).alias("i"),
        F.when(kind == "number", text.try_cast("double")).alias("d"),
        F.when(kind == "boolean", F.lower(text) == "true").alias("b"))


def type_of_kinds(kinds: Column) -> Column:
    """Column type from the set of its non-empty cell kinds."""
    return (F.when(F.size(kinds) == 0, "empty")
            .when(F.size(F.array_except(kinds, F.array(F.lit("integer"), F.lit("number")))) == 0,
                  F.when(F.array_contains(kinds, "number"), "number").otherwise("integer"))
            .when(F.size(kinds) == 1, F.element_at(kinds, 1))
            .otherwise("mixed"))
