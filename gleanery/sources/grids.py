"""Rectangular grids to cell rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions.ids import cell_id
from gleanery.functions.labels import injection_labels_visual


def grid_cells(grids: DataFrame, table_id: str = "table_id", rows: str = "rows") -> DataFrame:
    """Cells of rectangular grids; an irregular or empty grid is one degraded row with its raw text."""
    widths = F.transform(F.col(rows), lambda r: F.size(r))
    regular = (F.size(rows) > 0) & (F.array_min(widths) > 0) & (F.array_min(widths) == F.array_max(widths))
    marked = grids.select(F.col(table_id).alias("table_id"), F.col(rows).alias("rows"), F.coalesce(regular, F.lit(False)).alias("regular"))
    cells = (marked.filter("regular").select("table_id", F.posexplode("rows").alias("row_index", "r"))
             .select("table_id", "row_index", F.posexplode("r").alias("column_index", "cell_text")))
    normal = cells.select(
        "table_id", "row_index", "column_index", cell_id(F.col("table_id"), F.col("row_index"), F.col("column_index")).alias("cell_id"),
        "cell_text", F.array_join(injection_labels_visual(F.col("cell_text")), ",").alias("detected_patterns"),
        F.lit("normal").alias("status"), F.lit(None).cast("string").alias("warning"))
    none = F.lit(None)
    raw = F.array_join(F.transform("rows", lambda r: F.array_join(r, "\t")), "\n")
    degraded = marked.filter("not regular").select(
        "table_id", none.cast("int").alias("row_index"), none.cast("int").alias("column_index"), none.cast("string").alias("cell_id"),
        raw.alias("cell_text"), none.cast("string").alias("detected_patterns"), F.lit("degraded").alias("status"),
        F.lit("IRREGULAR_GRID").alias("warning"))
    return normal.unionByName(degraded)
