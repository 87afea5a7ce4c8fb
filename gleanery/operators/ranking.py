"""Positions and neighbours inside groups of any size.

A plain window puts a whole group in one task. These helpers deal the rows out by
ranges of group and order first, so one group that holds much of the data still runs on
many tasks; what a slice adds is summed over slices and joined back.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.operators.storage import settle


def sliced(df: DataFrame, groups: Sequence[str], order: Sequence[str], slices: int | None = None) -> DataFrame:
    """The rows cut into ranges of (groups, order), with the number of the range as ``__s``; stored.

    A large group fills many ranges, small ones share one. The ranges are sampled while the
    rows are dealt, so they are stored before anything is computed on them twice.
    """
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settle(df.repartitionByRange(n, *groups, *order).withColumn("__s", F.spark_partition_id()))


def position_in_group(df: DataFrame, groups: Sequence[str], value: str, tie: str,
                      descending: bool = False, name: str = "position",
                      slices: int | None = None) -> DataFrame:
    """1-based position by ``value`` then ``tie`` (``value`` numeric where descending, ``tie`` unique in a group)."""
    key = -F.col(value) if descending else F.col(value)
    base = sliced(df.withColumn("__key", key), groups, ["__key", tie], slices)
    part = [*groups, "__s"]
    counts = base.groupBy(*part).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(_earlier(groups))
    offsets = counts.select(*part, F.coalesce(before, F.lit(0)).alias("__before"))
    numbered = base.withColumn("__local", F.row_number().over(W.partitionBy(*part).orderBy("__key", tie)))
    joined = with_slices(numbered, offsets, groups)
    return joined.select(*[numbered[c] for c in df.columns],
                         (F.col("__before") + F.col("__local")).cast("bigint").alias(name))


def running_sum(df: DataFrame, groups: Sequence[str], order: str, value: str, name: str,
                slices: int | None = None) -> DataFrame:
    """Sum of ``value`` over the rows before, in ``order`` (unique in a group)."""
    base, part = sliced(df, groups, [order], slices), [*groups, "__s"]
    starts = (base.groupBy(*part).agg(F.sum(value).alias("__v"))
              .select(*part, F.coalesce(F.sum("__v").over(_earlier(groups)), F.lit(0)).alias("__before")))
    inner = base.withColumn("__local", F.coalesce(F.sum(value).over(
        W.partitionBy(*part).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    joined = with_slices(inner, starts, groups)
    return joined.select(*[inner[c] for c in df.columns], (F.col("__before") + F.col("__local")).alias(name))


def previous_in_group(df: DataFrame, groups: Sequence[str], order: str, carry: Sequence[str],
                      prefix: str = "prev_", slices: int | None = None) -> DataFrame:
    """Values of the row before, in ``order`` (unique in a group)."""
    base, part = sliced(df, groups, [order], slices), [*groups, "__s"]
    tails = base.groupBy(*part).agg(F.max_by(F.struct(*carry), F.col(order)).alias("__tail"))
    earlier = tails.select(
        *part, F.lag("__tail").over(W.partitionBy(*groups).orderBy("__s")).alias("__tail"))
    inner = base.withColumn(
        "__prev", F.lag(F.struct(*carry)).over(W.partitionBy(*part).orderBy(order)))
    joined = with_slices(inner, earlier, groups)
    return joined.select(
        *[inner[c] for c in df.columns],
        *[F.coalesce(F.col("__prev"), F.col("__tail"))[c].alias(prefix + c) for c in carry])


def last_seen(df: DataFrame, groups: Sequence[str], order: Sequence[str], values: Mapping[str, Column],
              slices: int | None = None) -> DataFrame:
    """For each name the last value that is not null up to the row itself, in ``order`` (unique in a group).

    A slice passes on its own last values where it has any, else those that it was passed.
    """
    base = sliced(df.select("*", *[v.alias(f"__v_{n}") for n, v in values.items()]), groups, order, slices)
    part, at = [*groups, "__s"], F.struct(*order)
    inside = W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    tails = base.groupBy(*part).agg(*[
        F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), at)).alias(f"__t_{n}") for n in values])
    passed = tails.select(*part, *[F.last(f"__t_{n}", ignorenulls=True).over(_earlier(groups)).alias(f"__p_{n}") for n in values])
    inner = base.select("*", *[F.last(f"__v_{n}", ignorenulls=True).over(inside).alias(f"__l_{n}") for n in values])
    joined = with_slices(inner, passed, groups)
    return joined.select(*[inner[c] for c in df.columns],
                         *[F.coalesce(F.col(f"__l_{n}"), F.col(f"__p_{n}")).alias(n) for n in values])


def _earlier(groups: Sequence[str]) -> WindowSpec:
    """The slices of a group before a slice."""
    return W.partitionBy(*groups).orderBy("__s").rowsBetween(W.unboundedPreceding, -1)


def with_slices(rows: DataFrame, per_slice: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Rows with what is known of their group and slice."""
    return rows.join(per_slice, _all([rows[c].eqNullSafe(per_slice[c]) for c in [*groups, "__s"]]), "left")


def nearest_rank(df: DataFrame, groups: Sequence[str], value: str, quantile: float,
                 name: str) -> DataFrame:
    """Exact nearest-rank percentile from counts per distinct value."""
    counts = (df.filter(F.col(value).isNotNull()).groupBy(*groups, value)
              .agg(F.count(F.lit(1)).alias("__n")))
    upto = W.partitionBy(*groups).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*groups)
    return (counts.withColumn("__c", F.sum("__n").over(upto)).withColumn("__t", F.sum("__n").over(whole))
            .filter(F.col("__c") >= F.greatest(F.lit(1), F.floor(F.col("__t") * quantile + 0.999999)))
            .groupBy(*groups).agg(F.min(value).alias(name)))


def first_per_key(df: DataFrame, keys: Sequence[str], position: Column, last: bool = False) -> DataFrame:
    """First (or last) row per key by an explicit position, as a map-side aggregate.

    Rows of equal position are told apart by their other columns, in column order.
    """
    rest = [c for c in df.columns if c not in keys]
    # the position stands in front of the row, so that a row is held once
    pick = (F.max if last else F.min)(F.struct(position.alias("__position"), *rest))
    out = df.groupBy(*keys).agg(pick.alias("__row"))
    return out.select(*keys, *[F.col("__row")[c].alias(c) for c in rest]).select(*df.columns)


def top_n(df: DataFrame, groups: Sequence[str], order: Sequence[Column], n: Column | int,
          name: str = "position") -> DataFrame:
    """Rows ranked up to ``n`` per group; the limit is applied before the shuffle too."""
    ranked = df.withColumn(name, F.row_number().over(W.partitionBy(*groups).orderBy(*order)))
    return ranked.filter(F.col(name) <= n)


def _all(conditions: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
