"""One allow-listed comparison against a dotted path of a Variant value."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = ("eq", "ne", "gt", "gte", "lt", "lte", "in", "not_in", "exists")


@dataclass(frozen=True)
class Condition:
    ref: str
    operator: str
    value: Any = True


def variant_path(ref: str) -> str:
    """``a.0.b`` as a JSON path."""
    parts = ref.split(".")
    if not ref.strip() or any(not p for p in parts):
        raise ValueError("ref must be a dotted path")
    return "$" + "".join(
        f"[{p}]" if p.isdigit() else f".{p}" if re.fullmatch(r"\w+", p) else f"[{json.dumps(p)}]" for p in parts)


def _kind(value: Any) -> str:
    if isinstance(value, bool):
        return "boolean"
    return "double" if isinstance(value, (int, float)) else "string"


def holds(source: Column, condition: Condition) -> Column:
    """Boolean Column: a missing path is false except for ``exists``."""
    if condition.operator not in OPERATORS:
        raise ValueError(f"unknown operator {condition.operator}")
    path = variant_path(condition.ref)
    node = F.try_variant_get(source, path, "variant")
    present = node.isNotNull()
    if condition.operator == "exists":
        real = present & ~F.coalesce(F.is_variant_null(node), F.lit(False))
        return F.coalesce(real, F.lit(False)) == F.lit(bool(condition.value))

    def same(value: Any) -> Column:
        # values of another kind never equal; the schema tells strings from numbers
        typed = F.try_variant_get(source, path, _kind(value))
        textual = F.schema_of_variant(node) == "STRING"
        match = typed == F.lit(value)
        return F.coalesce(match & (textual if _kind(value) == "string" else ~textual), F.lit(False))

    op = condition.operator
    if op in ("eq", "ne"):
        hit = same(condition.value)
        return F.coalesce(present, F.lit(False)) & (hit if op == "eq" else ~hit)
    if op in ("in", "not_in"):
        values: Sequence[Any] = condition.value if isinstance(condition.value, (list, tuple)) else ()
        if not isinstance(condition.value, (list, tuple, set, frozenset)):
            return F.lit(False)
        hit = reduce(lambda a, b: a | b, [same(v) for v in values], F.lit(False))
        return F.coalesce(present, F.lit(False)) & (hit if op == "in" else ~hit)
    typed = F.try_variant_get(source, path, _kind(condition.value))
    value = F.lit(condition.value)
    test = {"gt": typed > value, "gte": typed >= value, "lt": typed < value, "lte": typed <= value}[op]
    return F.coalesce(test, F.lit(False))
