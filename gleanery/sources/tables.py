"""Raw tables read as text: delimited files and schema-bound rows."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.text import is_blank
from gleanery.functions.values import typed_cell
from gleanery.sources.delimited import read_records

DELIMITERS = (",", "\t", ";", "|")


def found_delimiter(spark: SparkSession, path: str) -> str:
    """The delimiter that parts the first line into the most cells; a comma where none does."""
    first = spark.read.text(path).filter("trim(value) <> ''").first()
    line = re.sub(r'"[^"]*"', "", first["value"] if first else "")
    return max(DELIMITERS, key=lambda d: (line.count(d), -DELIMITERS.index(d)))


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = ",", line_breaks: bool = True) -> DataFrame:
    """All columns as text; the header must be non-blank and unique.

    Without ``delimiter`` it is found from the first line. Short rows are padded with null
    and long rows cut to the header; rows without any text are dropped. Quoted cells may
    hold line breaks; files are read split by split all the same (``delimited``), in two
    passes. Where ``line_breaks`` is off, every line is taken for a record in one pass.
    """
    delimiter = delimiter or found_delimiter(spark, path)
    if delimiter not in DELIMITERS:
        raise ValueError(f"delimiter must be one of {DELIMITERS}")
    options = {"sep": delimiter, "escape": '"', "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True}
    # Read as a row, since the reader renames repeated and blank names of a header.
    header = spark.read.csv(path, header=False, inferSchema=False, multiLine=line_breaks, **options).first()
    names = [(c or "").strip() for c in header or ()]
    if not names or not all(names) or len(set(names)) != len(names):
        raise ValueError("header must be non-blank and unique")
    records = read_records(spark, path, delimiter) if line_breaks else None
    if records is None:
        rows = spark.read.csv(path, header=True, inferSchema=False, enforceSchema=True, **options)
    else:
        schema = ", ".join(f"_c{i} string" for i in range(len(names)))
        rows = records.filter("not first").select(F.from_csv("record", schema, options | {"maxCharsPerColumn": -1}).alias("r")).select("r.*")
    return drop_blank_rows(rows.toDF(*names), names)


def drop_blank_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.filter(~reduce(lambda a, b: a & b, [is_blank(F.col(f"`{c}`")) for c in columns]))


def typed_rows(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Every cell as struct(kind, s, i, d, b), judged value by value."""
    return df.select(*keep, *[typed_cell(F.col(f"`{c}`")).alias(c) for c in df.columns if c not in keep])


def bind_schema(raw: DataFrame, fields: Mapping[str, int], required: Sequence[str] = (),
                row_number: str = "row_number") -> tuple[DataFrame, list[str]]:
    """Project 1-based source columns to field names and drop empty rows.

    Returns the rows and the required fields that the schema lacks.
    """
    columns = [c for c in raw.columns if c != row_number]
    bound = raw.select(row_number, *[
        (F.col(columns[i - 1]) if i <= len(columns) else F.lit(None).cast("string")).alias(name)
        for name, i in fields.items()])
    return drop_blank_rows(bound, list(fields)), [r for r in required if r not in fields]
