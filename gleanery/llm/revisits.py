"""WARC: resolving not-modified revisits against the latest earlier full response.

Records meet by canonical URL. They are range-partitioned by URL, date and id, so that the
records of a much crawled URL spread over slices; a revisit takes the last response before
it in its slice, or what the slices before left open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gleanery.operators.storage import settle

#: Headers that a not-modified answer may update in a stored response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical_url(url: str | Column) -> Column:
    """A URL without scheme, fragment, default port, tracking parameters and trailing slash; host in lower case.

    Null stays null; text without :// is taken as it is."""
    bare = F.regexp_replace(url, r"#[\s\S]*\z", "")
    rest = F.regexp_replace(bare, r"\A[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"\A[^/?]*", 0)), r":(80|443)\z", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"\A[^/?]*([^?]*)", 1), r"/+\z", "")
    query = F.array_join(F.filter(F.split(F.regexp_extract(rest, r"\?([\s\S]*)\z", 1), "&"),
                                  lambda p: (p != "") & ~p.startswith("utm_")), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


#: What a judgement rests on. A record_id alone may stand on several records.
IDENTITY = ("record_id", "uri", "date", "etag", "modified")


def _identity(*columns: str) -> Column:
    return F.struct(*[F.col(c).alias(name) for c, name in zip(columns, IDENTITY)])


def _strong(etag: Column) -> Column:
    return F.regexp_replace(etag, r"\AW/", "")


def resolve_revisits(records: DataFrame, slices: int | None = None) -> DataFrame:
    """One row per revisit: record_id, uri (canonical), response_id, ``status``, ``headers`` (merged map) and payload ``digest``.

    ``records`` has record_id, record_type (response or revisit; others are left out), target_uri, warc_date,
    headers (map with lower-case names) and payload. A revisit refers to the latest response of its canonical URL that is
    earlier by (warc_date, record_id). Status is ``resolved`` where the validators agree (etag, compared weakly; else
    last-modified), ``changed`` where they differ, ``unchecked`` where no validator stands on both sides, and ``orphan``
    without an earlier response. Headers are the response's, updated by those that a not-modified answer may carry, when
    resolved or unchecked; otherwise the revisit's own. Records without URL or date resolve nothing: such revisits
    are orphans. Repeated records give repeated rows; records that share a record_id are judged each by its own URL, date
    and validators. Of responses equal in all of these, the one of least digest and headers answers.
    """
    n = slices or int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    etag = F.try_element_at("headers", F.lit("etag"))
    modified = F.try_element_at("headers", F.lit("last-modified"))
    full = F.col("record_type") == "response"
    keyed = records.filter(F.col("record_type").isin("response", "revisit")).select(
        "record_id", full.alias("full"), canonical_url("target_uri").alias("uri"), F.col("warc_date").alias("date"),
        _strong(etag).alias("etag"), modified.alias("modified"), "headers", F.when(full, F.sha2(F.col("payload").cast("binary"), 256)).alias("digest"))
    light = (keyed.select("record_id", "full", "uri", "date", "etag", "modified").filter("uri is not null and date is not null")
             .repartitionByRange(n, "uri", "date", "record_id").withColumn("slice", F.spark_partition_id()))
    light = settle(light)
    response = F.struct("date", "record_id", "etag", "modified")
    inside = Window.partitionBy("uri", "slice").orderBy("date", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    left = light.filter("full").groupBy("uri", "slice").agg(F.max(response).alias("last"))
    every = light.select("uri", "slice").distinct().join(left, ["uri", "slice"], "left")
    before = Window.partitionBy("uri").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = settle(every.select("uri", "slice", F.last("last", True).over(before).alias("carried")).filter("carried is not null"))
    met = light.withColumn("found", F.last(F.when(F.col("full"), response), True).over(inside)).filter("not full")
    met = met.join(carried, ["uri", "slice"], "left").withColumn("found", F.coalesce("found", "carried"))
    agree = F.coalesce(F.col("etag") == F.col("found.etag"), F.col("modified") == F.col("found.modified"))
    status = (F.when(F.col("found").isNull(), "orphan").when(agree.isNull(), "unchecked").when(agree, "resolved").otherwise("changed"))
    response_key = F.when(F.col("found").isNotNull(), _identity("found.record_id", "uri", "found.date", "found.etag", "found.modified"))
    judged = settle(met.select(_identity(*IDENTITY).alias("key"), response_key.alias("response"), status.alias("status")).distinct())
    stored = (keyed.filter("full").select(_identity(*IDENTITY).alias("response"), F.struct(F.col("headers").alias("stored"), "digest").alias("body"))
              .join(judged.select("response").distinct(), "response", "left_semi"))
    wanted = settle(stored.groupBy("response").agg(F.min_by("body", F.struct("body.digest", header_lines("body.stored"))).alias("body")))
    rows = (keyed.filter("not full").select(_identity(*IDENTITY).alias("key"), "record_id", "uri", "headers").join(judged, "key", "left")
            .join(wanted, "response", "left")
            .select("record_id", "uri", F.col("response.record_id").alias("response_id"), "status", "headers", "body.stored", "body.digest"))
    used = F.col("status").isin("resolved", "unchecked")
    fresh = F.map_filter("headers", lambda k, _: k.isin(*PERMITTED))
    kept = F.map_filter("stored", lambda k, _: ~F.map_contains_key(fresh, k))
    return rows.select("record_id", "uri", "response_id", F.coalesce("status", F.lit("orphan")).alias("status"),
                       F.when(used, F.map_concat(kept, fresh)).otherwise(F.col("headers")).alias("headers"),
                       F.when(used, F.col("digest")).alias("digest"))


def header_lines(headers: str) -> Column:
    """Headers as lines in order of name."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
