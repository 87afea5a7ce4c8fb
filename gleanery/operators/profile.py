"""Column profiles: null and distinct counts, inferred type, meaning, key candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions.semantics import semantics_columns
from gleanery.functions.text import is_blank, strip
from gleanery.functions.values import cell_kind, type_of_kinds


def long_cells(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(source_name, source_index, value) for every cell of every column."""
    keep = keep or []
    cells = F.array(*[
        F.struct(F.lit(c).alias("source_name"), F.lit(i + 1).alias("source_index"),
                 F.col(f"`{c}`").cast("string").alias("value"))
        for i, c in enumerate(c for c in df.columns if c not in keep)])
    return df.select(*keep, F.explode(cells).alias("c")).select(*keep, "c.*")


def _type_name(kind: T.DataType) -> str:
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "number"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return {T.BooleanType: "boolean", T.DateType: "date", T.StringType: "string"}.get(type(kind), "other")


def value_counts(df: DataFrame) -> DataFrame:
    """(source_name, source_index, value, n): how often each column holds each stripped text; null for blanks.

    The one pass over the cells that profiles and checks share.
    """
    cells = F.array(*[
        F.struct(F.lit(c).alias("source_name"), F.lit(i).alias("source_index"),
                 F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(df.columns, start=1)])
    stripped = F.when(~is_blank(F.col("c.value")), strip(F.col("c.value")))
    return (df.select(F.explode(cells).alias("c")).select("c.source_name", "c.source_index", stripped.alias("value"))
            .groupBy("source_name", "source_index", "value").agg(F.count(F.lit(1)).alias("n")))


def field_profile(df: DataFrame, semantics: bool = False) -> DataFrame:
    """One row per column with null and distinct counts, from the counts of its values."""
    totals = value_counts(df).groupBy("source_name", "source_index").agg(
        F.sum("n").cast("bigint").alias("row_count"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).cast("bigint").alias("null_count"),
        F.count(F.col("value")).cast("bigint").alias("unique_count"))
    kinds = F.create_map(*[x for f in df.schema for x in (F.lit(f.name), F.lit(_type_name(f.dataType)))])
    out = totals.select(
        "source_name", "source_index", "row_count", "null_count",
        F.round(F.col("null_count") / F.col("row_count"), 6).alias("null_ratio"),
        (F.col("null_count") > 0).alias("nullable"), "unique_count",
        F.when(F.col("null_count") == F.col("row_count"), "empty")
        .otherwise(kinds[F.col("source_name")]).alias("inferred_type"))
    return out.select("*", *semantics_columns(F.col("source_name"))) if semantics else out


def inferred_types(cells: DataFrame, name: str = "source_name", value: str = "value") -> DataFrame:
    """Type per column of raw text cells."""
    kinds = cells.groupBy(name).agg(F.array_sort(F.collect_set(
        F.when(cell_kind(F.col(value)) != "empty", cell_kind(F.col(value))))).alias("kinds"))
    return kinds.select(name, type_of_kinds(F.col("kinds")).alias("inferred_type"))


def key_candidates(profile: DataFrame) -> DataFrame:
    """Role rows: possible_unique, possible_name and possible_sensitive columns."""
    roles = F.array_compact(F.array(
        F.when((F.col("row_count") >= 2) & (F.col("null_count") == 0)
               & (F.col("unique_count") == F.col("row_count")), "possible_unique"),
        F.when(F.col("semantic_type") == "name", "possible_name"),
        F.when(F.col("sensitive"), "possible_sensitive")))
    return profile.select("source_name", F.explode(roles).alias("role"))
