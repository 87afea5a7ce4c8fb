"""Order-dependent operators."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.operators.ranking import last_seen, previous_in_group, sliced, top_n, with_slices
from gleanery.operators.storage import settle

MAX_LEVEL = 6


def heading_path(blocks: DataFrame, group: str = "file_id", order: str = "line_number", slices: int | None = None) -> DataFrame:
    """Titles above each block: a level counts while no smaller level came after it.

    ``blocks`` has heading_level (null for text) and content; a group is one document of any
    length. A heading sets the title of its level and takes away those of the levels
    below, so each level is the last of these events before a block.
    """
    level, none = F.col("heading_level"), F.lit(None).cast("string")
    events = {f"__h{n}": F.when(level == n, F.struct(F.col("content").alias("title"))).when(level < n, F.struct(none.alias("title")))
              for n in range(1, MAX_LEVEL + 1)}
    seen = last_seen(blocks, [group], [order], events, slices)
    return seen.select(*blocks.columns, F.array_compact(F.array(*[F.col(n)["title"] for n in events])).alias("heading_path"))


# How a header row is told from data.
TEXT_SHARE, COVERAGE, MIN_SCORE = 0.8, 0.5, 0.78


def header_rows(cells: DataFrame, merged: DataFrame | None = None) -> DataFrame:
    """Header per sheet from a cell ledger (sheet, row, col, value, is_text).

    ``merged`` has the row and column span of merged ranges (sheet, row, first_col, last_col).
    """
    filled = cells.filter(F.col("value").isNotNull() & F.col("value").rlike(r"(?U)\S"))
    rows = filled.groupBy("sheet", "row").agg(
        F.count(F.lit(1)).alias("n"), F.min("col").alias("first"), F.max("col").alias("last"),
        F.count_if("is_text").alias("texts"), F.count_distinct(F.trim("value")).alias("names"),
        F.collect_list(F.struct("col", "is_text")).alias("cells"))
    following = rows.select("sheet", (F.col("row") - 1).alias("row"), F.col("first").alias("next_first"),
                            F.col("last").alias("next_last"), F.col("n").alias("next_n"), F.col("cells").alias("next_cells"))
    r = rows.filter("n >= 2").join(following, ["sheet", "row"], "left")
    width = F.col("last") - F.col("first") + 1
    inside = F.filter(F.coalesce("next_cells", F.array().cast("array<struct<col:bigint,is_text:boolean>>")),
                      lambda c: c["col"].between(F.col("first"), F.col("last")))
    r = r.withColumn("inside", inside).withColumn("text_share", F.col("texts") / width).withColumn(
        "cover", F.size("inside") / width).withColumn("broken", (F.col("n") != width) | (F.col("names") != F.col("n")))
    contrast = F.when(F.size("inside") > 0, F.size(F.filter("inside", lambda c: ~c["is_text"])) / F.size("inside")).otherwise(0.0)
    r = r.withColumn("score", F.round(0.35 * F.col("text_share") + 0.35 + 0.20 * F.col("cover") + 0.10 * contrast, 4))
    like = (F.col("text_share") >= TEXT_SHARE) & (F.col("cover") >= COVERAGE)
    wider = F.coalesce((F.col("next_first") < F.col("first")) | (F.col("next_last") > F.col("last")) | (F.col("next_n") > width), F.lit(False))
    good = r.filter(like & ~F.col("broken") & ~wider & (F.col("score") >= MIN_SCORE))
    if merged is not None:
        hits = good.join(merged.withColumnRenamed("first_col", "mf").withColumnRenamed("last_col", "ml"), ["sheet", "row"])
        over = hits.filter((F.col("ml") > F.col("mf")) & (F.col("ml") >= F.col("first")) & (F.col("mf") <= F.col("last")))
        good = good.join(over.select("sheet", "row").distinct(), ["sheet", "row"], "left_anti")
    best = top_n(good.select("sheet", "row", "first", "last", "score"), ["sheet"],
                 [F.col("score").desc(), (F.col("last") - F.col("first")).desc(), F.col("row")], 1).drop("position")
    above = r.filter(like & F.col("broken")).select("sheet", (F.col("row") + 1).alias("row"), "first", "last")
    refused = best.join(above, ["sheet", "row", "first", "last"], "left_semi").select("sheet").distinct()
    sheets = cells.select("sheet").distinct()
    found = best.join(refused, "sheet", "left_anti")
    return sheets.join(found, "sheet", "left").select(
        "sheet", F.when(F.col("row").isNull(), "failed").otherwise("detected").alias("detection_status"),
        F.col("row").alias("header_row"), F.col("first").alias("first_column"), F.col("last").alias("last_column"),
        F.coalesce("score", F.lit(0.0)).alias("confidence"))


# Lifecycle states and where each may go next.
TRANSITIONS = {
    "UPLOADED": ("DETECTING", "FAILED"),
    "DETECTING": ("PARSING", "VISUAL_PROCESSING", "OCR_PROCESSING", "FAILED"),
    "PARSING": ("OCR_PROCESSING", "LAYOUT_PROCESSING", "INDEXING", "QUERYABLE", "FAILED"),
    "OCR_PROCESSING": ("LAYOUT_PROCESSING", "INDEXING", "REINDEXING", "FAILED"),
    "VISUAL_PROCESSING": ("LAYOUT_PROCESSING", "INDEXING", "REINDEXING", "QUERYABLE", "FAILED"),
    "LAYOUT_PROCESSING": ("INDEXING", "REINDEXING", "QUERYABLE", "FAILED"),
    "INDEXING": ("QUERYABLE", "FAILED"),
    "QUERYABLE": ("OCR_PROCESSING", "INDEXING", "REPROCESSING", "REINDEXING", "FAILED"),
    "REPROCESSING": ("VISUAL_PROCESSING", "OCR_PROCESSING", "LAYOUT_PROCESSING", "REINDEXING", "QUERYABLE"),
    "REINDEXING": ("VISUAL_PROCESSING", "OCR_PROCESSING", "QUERYABLE"),
    "FAILED": (),
}


def status_transition_audit(states: DataFrame, group: str = "file_id", order: str = "seq") -> DataFrame:
    """Steps whose change of status is not allowed."""
    steps = previous_in_group(states, [group], order, ["status"]).filter(F.col("prev_status").isNotNull())
    allowed = F.lit(False)
    for source, targets in TRANSITIONS.items():
        if targets:
            allowed = allowed | ((F.col("prev_status") == source) & F.col("status").isin(*targets))
    return steps.filter(~allowed)


def _ways(period: int, keys: Sequence[str]):
    """The times of a slice at which a chain may come in, with the last time that it accepts there."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("__t")
        t = table.column("__t").to_numpy()
        after = np.searchsorted(t, t + period, side="right")
        last = np.where(after < len(t), after, np.arange(len(t)))
        while (last[last] != last).any():
            last = last[last]
        # the end of the slice before is the latest that may have been accepted
        end = table.column("__end")[0].as_py()
        enter = np.arange(1 if end is None else min(np.searchsorted(t, end + period, side="right") + 1, len(t)))
        to = table.take(last[enter])
        return table.take(enter).select([*keys, "__s", "__t"]).append_column("__exit", to.column("__t")).append_column("__exit_id", to.column("__first"))
    return run


def _accepted(period: int, keys: Sequence[str]):
    """Each time of a slice with the request that was last accepted, here or in a slice before."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("__t")
        t, begin = table.column("__t").to_numpy(), table.column("__begin")[0].as_py()
        after = np.searchsorted(t, t + period, side="right")
        chain, at = [], len(t) if begin is None else int(np.searchsorted(t, begin))
        while at < len(t):
            chain.append(at)
            at = int(after[at])
        which = np.searchsorted(chain, np.arange(len(t)), side="right") - 1
        ids = pa.concat_arrays([table.column("__carried").combine_chunks()[:1], table.column("__first").combine_chunks().take(pa.array(chain, pa.int64()))])
        return table.select([*keys, "__t"]).append_column("__accepted", ids.take(pa.array(which + 1)))
    return run


def repeat_requests(requests: DataFrame, keys: Sequence[str], at: str, request_id: str, seconds: int = 300,
                    slices: int | None = None) -> DataFrame:
    """For each request the accepted one it returns, itself when it was accepted.

    The first request of a key is accepted, and after an accepted one the first beyond its
    period. The distinct times are cut into slices. A chain of accepted ones comes into a slice within a
    period of its start, or at the first time after that; for these times alone it is told where the chain leaves
    the slice and comes in next. Such pointers double their reach each round, so n slices
    take log2(n) rounds of joins; then each slice follows the chain from where it came in.
    """
    period, keys = seconds * 1_000_000, list(keys)
    requests = requests.withColumn("__t", F.unix_micros(F.col(at).cast("timestamp")))
    times = requests.filter("__t is not null").groupBy(*keys, "__t").agg(F.min(request_id).alias("__first"))
    base, part = sliced(times, keys, ["__t"], slices), [*keys, "__s"]
    ends = base.groupBy(*part).agg(F.max("__t").alias("__max"))
    bounds = settle(ends.select(*part, F.lag("__max").over(W.partitionBy(*keys).orderBy("__s")).alias("__end")))
    fields = [base.schema[c] for c in keys]
    kind = base.schema["__first"].dataType
    ways = T.StructType([*fields, base.schema["__s"], base.schema["__t"], T.StructField("__exit", T.LongType()), T.StructField("__exit_id", kind)])
    entries = settle(with_slices(base, bounds, keys).select(*[base[c] for c in base.columns], "__end").groupBy(*part).applyInArrow(_ways(period, keys), ways))
    # probes look back from the end of each period; a time on the end itself is within
    probes = entries.select(*keys, "__exit").distinct().select(
        *keys, (-(F.col("__exit") + period)).alias("__back"), F.lit(0).alias("__real"), F.col("__exit").alias("__t"))
    marks = entries.select(*keys, (-F.col("__t")).alias("__back"), F.lit(1).alias("__real"), "__t")
    following = last_seen(probes.unionByName(marks), keys, ["__back", "__real"], {"__jump": F.when(F.col("__real") == 1, F.col("__t"))}, slices)
    jumps = following.filter("__real = 0").select(*keys, F.col("__t").alias("__exit"), "__jump")
    starts = bounds.filter("__end is null").select(*part, F.lit(True).alias("__on"))
    nodes = settle(entries.join(jumps, [*keys, "__exit"], "left").join(starts, part, "left").select(*keys, "__t", F.coalesce("__on", F.lit(False)).alias("__on"), "__jump"))
    while not nodes.filter("__on and __jump is not null").isEmpty():
        reached = nodes.filter("__on and __jump is not null").select(*keys, F.col("__jump").alias("__t"), F.lit(True).alias("__hit")).distinct()
        hops = nodes.filter("__jump is not null").select(*keys, F.col("__t").alias("__jump"), F.col("__jump").alias("__far"))
        nodes = settle(nodes.join(reached, [*keys, "__t"], "left").join(hops, [*keys, "__jump"], "left").select(
            *keys, "__t", (F.col("__on") | F.coalesce("__hit", F.lit(False))).alias("__on"), F.col("__far").alias("__jump")))
    taken = entries.join(nodes.filter("__on").select(*keys, "__t"), [*keys, "__t"], "left_semi").select(*part, F.col("__t").alias("__begin"), "__exit_id")
    carried = F.last("__exit_id", ignorenulls=True).over(W.partitionBy(*keys).orderBy("__s").rowsBetween(W.unboundedPreceding, -1))
    passed = settle(bounds.join(taken, part, "left").select(*part, "__begin", carried.alias("__carried")))
    out = T.StructType([*fields, base.schema["__t"], T.StructField("__accepted", kind)])
    marked = with_slices(base, passed, keys).select(*[base[c] for c in base.columns], "__begin", "__carried").groupBy(*part).applyInArrow(_accepted(period, keys), out)
    return requests.join(marked, [*keys, "__t"]).select(
        *[c for c in requests.columns if c != "__t"], F.col("__accepted").alias("accepted_id"))
