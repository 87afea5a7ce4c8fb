"""Document fingerprints from closed syncmers, in DataFrame expressions only.

Units are words, long ones cut into pieces. A run of five units is an anchor when the
least hash among its runs of two stands at either edge. Whether a run is an anchor
depends on the run alone, so an edit moves no anchor outside the runs it touches.
The fingerprint keeps the anchors of least hash with their positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

UNIT = r"[^\x20\x09-\x0D]{1,16}"
RUN, INNER = 5, 2
ANCHORS = 64
#: Units by which a matching anchor may have moved.
DRIFT = 256
_PLACE_BITS = 24


def _anchors(units: Column, inner: Column) -> Column:
    """Anchors as longs: 32 bits of hash over 24 bits of position."""
    starts = F.sequence(F.lit(0), F.size(units) - RUN)
    last = RUN - INNER

    def closed(i: Column) -> Column:
        edges = F.least(F.get(inner, i), F.get(inner, i + last))
        return edges <= F.least(*[F.get(inner, i + j) for j in range(1, last)])

    def packed(hashed: Column, place: Column) -> Column:
        return F.shiftleft(hashed.bitwiseAND(F.lit((1 << 32) - 1)), _PLACE_BITS) + F.least(place, F.lit((1 << _PLACE_BITS) - 1))

    def anchor(i: Column) -> Column:
        return packed(F.xxhash64(F.get(inner, i), F.get(inner, i + 2), F.get(units, i + RUN - 1)), i)

    chosen = F.transform(F.filter(starts, closed), anchor)
    every = F.transform(starts, anchor)
    whole = F.array(packed(F.xxhash64(units), F.lit(0)))
    return (F.when(F.size(units) >= RUN, F.when(F.exists(starts, closed), chosen).otherwise(every))
            .when(F.size(units) > 0, whole).otherwise(F.array().cast("array<bigint>")))


def _hash_of(x: Column) -> Column:
    return F.shiftright(x, _PLACE_BITS)


def _firsts(ordered: Column) -> Column:
    """Of equal hashes the first entry only."""
    return F.filter(ordered, lambda x, i: (i == 0) | (_hash_of(x) != _hash_of(F.get(ordered, i - 1))))


def with_entries(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with column ``name``: the fingerprint entries of a text column, in order of hash."""
    units, inner, found = f"{name}_units", f"{name}_inner", f"{name}_found"
    step = df.withColumn(units, F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(UNIT), F.lit(0)), lambda x: F.xxhash64(x)))
    step = step.withColumn(inner, F.zip_with(units, F.slice(units, F.lit(2), F.greatest(F.size(units) - 1, F.lit(0))), lambda x, y: F.xxhash64(x, y)))
    step = step.withColumn(found, F.sort_array(_anchors(F.col(units), F.col(inner))))
    return step.withColumn(name, F.slice(_firsts(F.col(found)), 1, ANCHORS)).drop(units, inner, found)


def fingerprint(entries: str) -> Column:
    """The entries as text: hash and position of each anchor."""
    def show(x: Column) -> Column:
        return F.concat(F.lower(F.lpad(F.hex(_hash_of(x)), 8, "0")), F.lit("@"), x.bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).cast("string"))
    return F.array_join(F.transform(entries, show), " ")


def with_likeness(df: DataFrame, one: str, other: str, name: str, drift: int = DRIFT) -> DataFrame:
    """``df`` with column ``name``, from 0 to 1: among the anchors of least hash of both fingerprints, the share
    that stands in both at positions at most ``drift`` units apart. Two empty fingerprints are alike, an empty
    and another one are not."""
    merged, kept = f"{name}_merged", f"{name}_kept"
    place = lambda x: x.bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    step = df.withColumn(merged, F.sort_array(F.concat(one, other)))
    step = step.withColumn(kept, F.slice(_firsts(F.col(merged)), 1, ANCHORS))
    limit = _hash_of(F.element_at(kept, -1))

    def matches(x: Column, i: Column) -> Column:
        after = F.get(merged, i + 1)
        return (_hash_of(x) == _hash_of(after)) & (F.abs(place(x) - place(after)) <= drift) & (_hash_of(x) <= limit)

    shared = F.size(F.filter(merged, matches)) / F.size(kept)
    return step.withColumn(name, F.when(F.size(kept) == 0, F.lit(1.0)).otherwise(shared)).drop(merged, kept)


def with_moved_likeness(df: DataFrame, one: str, other: str, name: str, spread: int = DRIFT) -> DataFrame:
    """As ``with_likeness``, with anchors that have moved any way together: of the shared anchors those of the best run
    of shifts count, a run being the shifts at most ``spread`` units above one of them."""
    merged, kept, shifts = f"{name}_merged", f"{name}_kept", f"{name}_shifts"
    place = lambda x: x.bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    sided = lambda side, number: F.transform(side, lambda x: F.struct(x.alias("x"), F.lit(number).alias("side")))
    step = df.withColumn(merged, F.sort_array(F.concat(sided(one, 0), sided(other, 1))))
    step = step.withColumn(kept, F.slice(_firsts(F.col(f"{merged}.x")), 1, ANCHORS))
    limit = _hash_of(F.element_at(kept, -1))

    def shift(e: Column, i: Column) -> Column:
        after = F.get(merged, i + 1)
        both = (_hash_of(e["x"]) == _hash_of(after["x"])) & (_hash_of(e["x"]) <= limit)
        return F.when(both, (place(after["x"]) - place(e["x"])) * F.when(e["side"] == 0, 1).otherwise(-1))

    step = step.withColumn(shifts, F.array_compact(F.transform(merged, shift)))
    runs = F.transform(shifts, lambda s: F.size(F.filter(shifts, lambda o: o.between(s, s + spread))))
    shared = F.coalesce(F.array_max(runs), F.lit(0)) / F.size(kept)
    return step.withColumn(name, F.when(F.size(kept) == 0, F.lit(1.0)).otherwise(shared)).drop(merged, kept, shifts)


def _bucketed(docs: DataFrame, parts: int) -> DataFrame:
    """Rows with ``bucket``, a range in the order of (doc_id, hash of the text), and copies (``copy``) of each
    bucket's first rows at the end of the bucket before, the first bucket's in the last."""
    keyed = docs.withColumn("hash", F.xxhash64("text"))
    key = F.struct("doc_id", "hash")
    # One row per partition of a range partitioning comes to the driver, to name the ranges.
    found = (keyed.select("doc_id", "hash").repartitionByRange(parts, "doc_id", "hash")
             .groupBy(F.spark_partition_id().alias("part")).agg(F.min(key).alias("cut")).collect())
    cuts = sorted({(r["cut"]["doc_id"], r["cut"]["hash"]) for r in found}, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    if not cuts:
        return keyed.withColumns({"bucket": F.lit(0), "copy": F.lit(False)})
    known = F.array(*[F.struct(F.lit(i).cast("long").alias("doc_id"), F.lit(h).cast("long").alias("hash")) for i, h in cuts])
    own = F.size(F.filter(known, lambda c: c <= key)) - 1
    placed = keyed.withColumn("own", own)
    place = lambda bucket, copy: F.struct(bucket.alias("bucket"), F.lit(copy).alias("copy"))
    before = F.pmod(F.col("own") - 1, F.lit(len(cuts)))
    again = F.array(place(F.col("own"), False), place(before, True))
    is_first = F.get(known, F.col("own")) == key
    return (placed.withColumn("at", F.explode(F.when(is_first, again).otherwise(F.array(place(F.col("own"), False)))))
            .withColumns({"bucket": F.col("at.bucket"), "copy": F.col("at.copy")}).drop("at", "own"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of each document and of an edited text, and their likeness.

    The edited text has the last half of the code points replaced by as many of the next
    document, in order of doc_id (nulls first, equal ids by the hash of the text; after the
    last comes the first). Null texts count as empty; a single document is its own next.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = _bucketed(with_entries(texts, "text", "entries"), parts)
    order = Window.partitionBy("bucket").orderBy("copy", "doc_id", "hash")
    length = F.char_length("text")
    half = F.floor(length / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), length - half), F.substring("next_text", F.lit(1), half))
    paired = (rows.withColumn("next_text", F.lead("text").over(order)).withColumn("next_entries", F.lead("entries").over(order))
              .filter(~F.col("copy")).select("doc_id", length.cast("long").alias("n_chars"), "entries", "next_entries", edited.alias("edited")))
    done = with_entries(paired, "edited", "edited_entries")
    done = with_moved_likeness(with_moved_likeness(done, "entries", "edited_entries", "near_edited"), "entries", "next_entries", "near_next")
    return done.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint("entries").alias("fingerprint"),
                       fingerprint("edited_entries").alias("edited_fingerprint"), "near_edited", "near_next")
