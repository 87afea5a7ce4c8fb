"""Filter, order, project and aggregate one table through plain argument records."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions.text import is_blank, not_blank

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
NUMBERS = (T.FloatType, T.DoubleType, T.DecimalType)
STAMPS = (T.TimestampType, T.TimestampNTZType)
OPERATIONS = ("count", "sum", "avg", "min", "max")


class ArgumentError(ValueError):
    """A request that cannot be planned; ``code`` says why."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass(frozen=True)
class Filter:
    field: str
    op: str
    value: Any = None


@dataclass(frozen=True)
class Order:
    field: str
    direction: str = "asc"


@dataclass(frozen=True)
class TableQuery:
    select: Sequence[str]
    filters: Sequence[Filter] = ()
    order_by: Sequence[Order] = ()
    limit: int | None = None


@dataclass(frozen=True)
class Aggregate:
    operation: str
    field: str | None = None
    group_by: Sequence[str] = ()
    filters: Sequence[Filter] = ()


def missing_fields(df: DataFrame, requested: Sequence[str]) -> list[str]:
    return [f for f in dict.fromkeys(requested) if f not in df.columns]


def check_fields(df: DataFrame, requested: Sequence[str]) -> None:
    absent = missing_fields(df, requested)
    if absent:
        raise ArgumentError("FIELD_NOT_FOUND", f"missing {absent}, available {df.columns}")


def coerce_literal(value: Any, data_type: T.DataType) -> Any:
    """Literal in the type of the column, or ArgumentError."""
    try:
        if isinstance(data_type, INTEGERS):
            if isinstance(value, bool) or (isinstance(value, float) and not value.is_integer()):
                raise ValueError(value)
            return int(value)
        if isinstance(data_type, T.DecimalType) and not isinstance(value, bool):
            return Decimal(str(value))
        if isinstance(data_type, NUMBERS):
            if isinstance(value, bool):
                raise ValueError(value)
            return float(value)
        if isinstance(data_type, T.BooleanType):
            if isinstance(value, bool):
                return value
            if str(value).lower() in ("true", "false"):
                return str(value).lower() == "true"
            raise ValueError(value)
        if isinstance(data_type, T.DateType):
            return dt.date.fromisoformat(str(value))
        if isinstance(data_type, STAMPS):
            return dt.datetime.fromisoformat(str(value))
        return str(value)
    except (TypeError, ValueError, InvalidOperation) as exc:
        raise ArgumentError("INVALID_FILTER_VALUE", f"{value!r} for {data_type.simpleString()}") from exc


def predicate(df: DataFrame, f: Filter) -> Column:
    col, kind = F.col(f"`{f.field}`"), df.schema[f.field].dataType
    text = isinstance(kind, T.StringType)
    if f.op == "is_null":
        return is_blank(col) if text else col.isNull()
    if f.op == "not_null":
        return not_blank(col) if text else col.isNotNull()
    if f.value is None:
        raise ArgumentError("INVALID_FILTER_VALUE", f"{f.op} needs a value")
    if f.op == "contains":
        hit = col.cast("string").contains(str(f.value))
        return not_blank(col) & hit if text else hit
    value = F.lit(coerce_literal(f.value, kind))
    if isinstance(kind, STAMPS):
        value = value.cast(kind)
    tests = {"=": col == value, "!=": col != value, ">": col > value,
             ">=": col >= value, "<": col < value, "<=": col <= value}
    if f.op not in tests:
        raise ArgumentError("INVALID_OPERATOR", f.op)
    # blank text never compares; spelled only where a blank could pass
    return not_blank(col) & tests[f.op] if text and f.op != "=" else tests[f.op]


def apply_filters(df: DataFrame, filters: Sequence[Filter]) -> DataFrame:
    check_fields(df, [f.field for f in filters])
    if not filters:
        return df
    return df.filter(reduce(lambda a, b: a & b, [predicate(df, f) for f in filters]))


def order_keys(df: DataFrame, orders: Sequence[Order], row_number: str) -> list[Column]:
    """Sort keys with null and blank last both ways and source order as the tie break."""
    check_fields(df, [o.field for o in orders])
    keys: list[Column] = []
    for o in orders:
        col = F.col(f"`{o.field}`")
        blank = is_blank(col) if isinstance(df.schema[o.field].dataType, T.StringType) else col.isNull()
        keys += [blank.asc(), F.when(~blank, col).desc() if o.direction == "desc" else F.when(~blank, col).asc()]
    return [*keys, F.col(row_number).asc()]


def iso_text(df: DataFrame, name: str) -> Column:
    """Output form of a column: dates and times as ISO text."""
    kind, col = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, STAMPS):
        return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss").alias(name)
    return (col.cast("string") if isinstance(kind, T.DateType) else col).alias(name)


def query_table(df: DataFrame, query: TableQuery, row_number: str = "row_number") -> DataFrame:
    if not query.select or len(set(query.select)) != len(query.select):
        raise ArgumentError("INVALID_QUERY_ARGUMENTS", "select must be non-empty and free of repeats")
    if query.limit is not None and query.limit < 1:
        raise ArgumentError("INVALID_QUERY_ARGUMENTS", "limit must be 1 or more")
    check_fields(df, query.select)
    out = apply_filters(df, query.filters)
    if query.order_by or query.limit is not None:
        out = out.orderBy(*order_keys(df, query.order_by, row_number))
    if query.limit is not None:
        out = out.limit(query.limit)
    return out.select(*[iso_text(df, name) for name in query.select])


def query_warnings(matched: DataFrame, query: TableQuery, profile: DataFrame) -> DataFrame:
    """Warning rows: selected sensitive columns, and a limit that cut rows."""
    sensitive = (profile.filter(F.col("sensitive") & F.col("source_name").isin(list(query.select)))
                 .select(F.lit("SENSITIVE_FIELD").alias("code"), F.col("source_name").alias("detail")))
    if query.limit is None:
        return sensitive
    cut = (matched.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > query.limit)
           .select(F.lit("LIMIT_CUT").alias("code"), F.col("n").cast("string").alias("detail")))
    return sensitive.unionByName(cut)


def value_expr(df: DataFrame, operation: str, name: str | None) -> Column:
    if name is None:
        if operation != "count":
            raise ArgumentError("INVALID_AGGREGATE_ARGUMENTS", f"{operation} needs a field")
        return F.count(F.lit(1))
    kind, col = df.schema[name].dataType, F.col(f"`{name}`")
    present = not_blank(col) if isinstance(kind, T.StringType) else col.isNotNull()
    if operation == "count":
        return F.count(F.when(present, F.lit(1)))
    if operation in ("sum", "avg"):
        if not isinstance(kind, INTEGERS + NUMBERS):
            raise ArgumentError("NON_NUMERIC_FIELD", name)
        return F.sum(col) if operation == "sum" else F.round(F.avg(col), 6)
    if operation not in OPERATIONS:
        raise ArgumentError("INVALID_AGGREGATE_ARGUMENTS", operation)
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        raise ArgumentError("NON_COMPARABLE_FIELD", name)
    value = F.when(present, col)
    return F.min(value) if operation == "min" else F.max(value)


def aggregate_table(df: DataFrame, request: Aggregate) -> DataFrame:
    """One row per group with ``value``; a request without groups always gives one row."""
    check_fields(df, [*request.group_by, *([request.field] if request.field else [])])
    rows = apply_filters(df, request.filters)
    value = value_expr(df, request.operation, request.field).alias("value")
    if not request.group_by:
        return rows.agg(value)
    return rows.groupBy(*[F.col(f"`{g}`") for g in request.group_by]).agg(value)


def aggregate_status(df: DataFrame, request: Aggregate) -> DataFrame:
    """Status of a whole aggregate: not_found, no_record or found."""
    rows = apply_filters(df, request.filters)
    field_count = (value_expr(df, "count", request.field) if request.field else F.count(F.lit(1)))
    counts = rows.agg(F.count(F.lit(1)).alias("matched_rows"), field_count.alias("n"))
    found = F.lit(True) if request.operation == "count" else F.col("n") > 0
    return counts.select(
        F.when(F.col("matched_rows") == 0, "not_found").when(~found, "no_record")
        .otherwise("found").alias("status"), "matched_rows")


def aggregate_lineage(df: DataFrame, request: Aggregate, file_id: str, sheet: str,
                      columns: Sequence[str], row_number: str = "row_number") -> DataFrame:
    """Cells that fed an aggregate, one row each, addressed by group key.

    Kept as rows so that a large group never becomes one large list.
    """
    from gleanery.functions.ids import evidence_id, json_number, json_text

    names = list(dict.fromkeys(
        [*request.group_by, *([request.field] if request.field else []),
         *[f.field for f in request.filters]])) or [columns[0]]
    rows = apply_filters(df, request.filters)
    numeric = {n: isinstance(df.schema[n].dataType, INTEGERS + NUMBERS) for n in names}
    cells = F.array(*[
        F.struct(
            F.lit(n).alias("field"),
            F.lit(column_letter(columns.index(n) + 1)).alias("letter"),
            F.col(f"`{n}`").cast("string").alias("value_text"),
            (json_number if numeric[n] else json_text)(F.col(f"`{n}`")).alias("value_json"))
        for n in names])
    groups = [F.col(f"`{g}`").cast("string").alias(f"group_{g}") for g in request.group_by]
    flat = rows.select(*groups, F.col(row_number).alias("row_number"), F.explode(cells).alias("c"))
    cell = F.concat(F.col("c.letter"), F.col("row_number").cast("string"))
    return flat.select(
        *[f"group_{g}" for g in request.group_by], "row_number", F.col("c.field").alias("field"),
        cell.alias("cell"), F.coalesce(F.col("c.value_text"), F.lit("null")).alias("value_summary"),
        evidence_id({
            "file_id": json_text(F.lit(file_id)), "sheet": json_text(F.lit(sheet)),
            "row": json_number(F.col("row_number")), "field": json_text(F.col("c.field")),
            "table": json_text(F.lit(sheet)), "cell": json_text(cell),
            "value": F.col("c.value_json")}).alias("evidence_id"))


def column_letter(index: int) -> str:
    """Spreadsheet letters of a 1-based column index."""
    letters = ""
    while index:
        index, rest = divmod(index - 1, 26)
        letters = chr(65 + rest) + letters
    return letters
