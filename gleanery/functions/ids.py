"""Stable identifiers from canonical JSON text and SHA-256."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_hash(col: Column) -> Column:
    return F.sha2(col, 256)


def json_text(col: Column) -> Column:
    """A quoted JSON string, non-ASCII kept; null prints as ``null``."""
    escaped = F.replace(F.replace(col.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, mark in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(mark))
    return F.coalesce(F.concat(F.lit('"'), escaped, F.lit('"')), F.lit("null"))


def json_number(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit("null"))


def canonical_json(parts: Mapping[str, Column]) -> Column:
    """Key-sorted object text with ``", "`` and ``": "``; values are rendered JSON."""
    pieces: list[Column] = []
    for i, key in enumerate(sorted(parts)):
        pieces += [F.lit((", " if i else "{") + f'"{key}": '), parts[key]]
    return F.concat(*pieces, F.lit("}"))


def evidence_id(parts: Mapping[str, Column]) -> Column:
    return F.substring(text_hash(canonical_json(parts)), 1, 24)


def short_hash(col: Column) -> Column:
    return F.substring(text_hash(col), 1, 32)


def block_id(file_id: Column, sequence: Column, block_type: Column, content: Column,
             page_no: Column, parent_id: Column, parser: Column) -> Column:
    """Identifier of a block without geometry."""
    return short_hash(canonical_json({
        "file_id": json_text(file_id), "sequence": json_number(sequence),
        "page_no": json_number(page_no), "block_type": json_text(block_type),
        "content": json_text(content), "bbox": F.lit("null"),
        "parent_id": json_text(parent_id), "source_parser": json_text(parser)}))


def chunk_id(block: Column, offset: Column, hash_: Column) -> Column:
    return short_hash(F.concat_ws(":", block, offset.cast("string"), hash_))


def cell_id(table_id: Column, row: Column, column: Column) -> Column:
    return short_hash(F.concat_ws(":", table_id, F.lit("cell"), row.cast("string"), column.cast("string")))
