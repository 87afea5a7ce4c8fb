"""Which files and metadata a request may look at."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOCUMENT_TYPES = ("pdf", "word", "image", "presentation", "txt", "json", "markdown")


def metadata_value(metadata: Column, key: str) -> Column:
    """A metadata value by key, at the top or under ``document_metadata``."""
    return F.coalesce(F.get_json_object(metadata, f"$.{key}"),
                      F.get_json_object(metadata, f"$.document_metadata.{key}"))


def scoped_files(files: DataFrame, wanted: DataFrame | None = None, file_type: str | None = None,
                 page_no: int | None = None) -> DataFrame:
    """Files that are ready, indexed, queryable and of a document type, inside the scope."""
    out = files.filter((F.col("lifecycle_status") == "ready") & (F.col("index_status") == "indexed")
                       & F.col("queryable") & F.col("file_type").isin(*DOCUMENT_TYPES))
    if file_type is not None:
        out = out.filter(F.col("file_type") == file_type)
    if page_no is not None:
        out = out.filter(F.col("page_no") == page_no)
    return out if wanted is None else out.join(wanted.select("file_id"), "file_id", "left_semi")


def search_scope(conditions: DataFrame, files: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(query_id, file_id): files whose metadata meets all conditions (query_id, key, value) of a query.

    Files have file_id and metadata as JSON; ``keys`` are the metadata keys that conditions
    name. Files and conditions meet by key and value, and the hits are counted.
    """
    stated = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), metadata_value(F.col("metadata"), k).alias("value")) for k in keys]))
    facts = files.select("file_id", stated.alias("f")).select("file_id", "f.key", "f.value").filter("value is not null").distinct()
    asked = conditions.select("query_id", "key", "value").distinct()
    wanted = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("wanted"))
    met = asked.join(facts, ["key", "value"]).groupBy("query_id", "file_id").agg(F.count(F.lit(1)).alias("met"))
    return met.join(wanted, "query_id").filter("met = wanted").select("query_id", "file_id")


def scope_violations(ids_asked: DataFrame, ids_allowed: DataFrame, keys_asked: DataFrame,
                     keys_allowed: DataFrame) -> DataFrame:
    """Rows where a need asks for more than its caller's scope.

    Ids are (need_id, file_id) rows, other keys (need_id, scope_key, value) rows; a
    need without allowed ids is not bounded by ids.
    """
    bounded = ids_asked.join(ids_allowed.select("need_id").distinct(), "need_id", "left_semi")
    wider = (bounded.join(ids_allowed, ["need_id", "file_id"], "left_anti").select("need_id").distinct()
             .select("need_id", F.lit("file_ids").alias("scope_key"), F.lit("WIDER_THAN_SCOPE").alias("reason")))
    limits = keys_allowed.withColumnRenamed("value", "bound")
    other = (keys_asked.join(limits, ["need_id", "scope_key"])
             .filter(F.col("value") != F.col("bound")).select("need_id", "scope_key").distinct()
             .withColumn("reason", F.lit("DIFFERS_FROM_SCOPE")))
    return wider.unionByName(other)
