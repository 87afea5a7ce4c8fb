"""Data quality checks on tables and on entities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.semantics import field_semantics
from gleanery.functions.text import norm_key, strip
from gleanery.functions.values import cell_kind, type_of_kinds
from gleanery.operators.profile import value_counts

# Shapes of contact data and the limits of the checks.
PHONE_SHAPE = r"^(?:\+?\d[\d\s-]{5,19})$"
EMAIL_SHAPE = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
HIGH_MISSING_RATIO = 0.5


def contact_valid(kind: str, value: Column) -> Column:
    return strip(value).rlike(PHONE_SHAPE if kind == "phone" else EMAIL_SHAPE)


KINDS = ("boolean", "integer", "number", "string")

# people columns: meanings that make a sheet a person sheet
PERSON_MEANINGS = ("name", "college", "grade", "class", "student_id")


def column_facts(df: DataFrame) -> DataFrame:
    """One row per column of a table of raw text: row_count, null_count, what its cells read as, and its faulty and repeated values.

    Values are counted once (``value_counts``); everything else is summed from these counts, so
    the table is read once. Parts of a table can be summed alike and added up.
    """
    value, meaning, filled = F.col("value"), F.col("canonical_name"), F.col("value").isNotNull()
    kind = cell_kind(value)
    counts = value_counts(df).select("*", F.when(filled, kind).alias("kind"), field_semantics(F.col("source_name"))["canonical_name"].alias("canonical_name"))
    number = value.try_cast("double")
    wrong_range = (meaning == "score") & (~F.col("kind").isin("integer", "number") | ~number.between(0, 100))
    wrong_contact = ((meaning == "phone") & ~contact_valid("phone", value)) | ((meaning == "email") & ~contact_valid("email", value))
    weigh = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    columns = ["source_name", "source_index", "canonical_name"]
    # ids and names are compared by their folded key, all other values of a column share one group
    per_key = counts.groupBy(*columns, F.when(filled & meaning.isin("student_id", "name"), norm_key(value)).alias("key")).agg(
        F.sum("n").alias("n"), weigh(~filled).alias("nulls"), weigh(filled & wrong_range).alias("range"), weigh(filled & wrong_contact).alias("contact"),
        *[F.count_if(F.col("kind") == k).alias(k) for k in KINDS])
    return per_key.groupBy(*columns).agg(
        F.sum("n").cast("bigint").alias("row_count"), F.sum("nulls").cast("bigint").alias("null_count"), F.sum("range").alias("range"),
        F.sum("contact").alias("contact"), F.count_if(F.col("key").isNotNull() & (F.col("n") > 1)).alias("groups"),
        F.filter(F.array(*[F.when(F.sum(k) > 0, k) for k in KINDS]), lambda k: k.isNotNull()).alias("kinds"))


def validate_table(df: DataFrame, sheet: str) -> DataFrame:
    """Issue rows (sheet, field, issue_type, severity, detail) of one table of raw text."""
    facts = column_facts(df).withColumns({
        "null_ratio": F.round(F.col("null_count") / F.col("row_count"), 6), "inferred_type": type_of_kinds(F.col("kinds"))})

    def issue(test: Column, kind: str, severity: str, detail: Column) -> Column:
        return F.when(test, F.struct(F.lit(kind).alias("issue_type"), F.lit(severity).alias("severity"),
                                     detail.cast("string").alias("detail")))

    meaning = F.col("canonical_name")
    issues = F.array_compact(F.array(
        issue(F.col("null_count") > 0, "null_value", "warning", F.col("null_count")),
        issue(F.col("null_ratio") >= HIGH_MISSING_RATIO, "high_missing_ratio", "error", F.col("null_ratio")),
        issue(F.col("inferred_type").isin("mixed", "other"), "type_anomaly", "warning", F.col("inferred_type")),
        issue(F.col("range") > 0, "numeric_range_anomaly", "error", F.lit(None)),
        issue(F.col("contact") > 0, "invalid_contact_format", "error", F.lit(None)),
        issue((F.col("groups") > 0) & (meaning == "student_id"), "duplicate_student_id", "error", F.col("groups")),
        issue((F.col("groups") > 0) & (meaning == "name"), "duplicate_name", "warning", F.col("groups"))))
    per_field = facts.select(F.lit(sheet).alias("sheet"), F.col("source_name").alias("field"),
                             F.explode(issues).alias("i")).select("sheet", "field", "i.*")
    person = facts.agg(F.bool_or(meaning.isin(*PERSON_MEANINGS)).alias("person"),
                         F.coalesce(F.bool_or(meaning == "student_id"), F.lit(False)).alias("has_id"))
    lacking = person.filter("person and not has_id").select(
        F.lit(sheet).alias("sheet"), F.lit(None).cast("string").alias("field"),
        F.lit("missing_required_field").alias("issue_type"), F.lit("error").alias("severity"),
        F.lit("student_id").alias("detail"))
    return per_field.unionByName(lacking)


def table_status(issues: DataFrame, row_count: Column) -> DataFrame:
    """no_record, invalid_data or found from the worst issue."""
    return issues.agg(F.count_if(F.col("severity") == "error").alias("errors"),
                      F.count_if(F.col("severity") == "warning").alias("warnings")).select(
        F.when(row_count == 0, "no_record").when(F.col("errors") > 0, "invalid_data").otherwise("found").alias("status"),
        "errors", "warnings")


def duplicate_records(df: DataFrame, keys: Sequence[str], row_number: str = "row_number") -> DataFrame:
    """Rows of key tuples seen more than once, with the count of their group.

    Null and blank keys count as values. A large group stays many rows: counts are
    pre-aggregated, and the join back is on keys that repeat only.
    """
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count")).filter("count > 1")
    cond = F.lit(True)
    right = groups.select(*[F.col(k).alias("__" + k) for k in keys], "count")
    for k in keys:
        cond = cond & df[k].eqNullSafe(right["__" + k])
    return df.join(right, cond).select(*keys, "count", row_number)
