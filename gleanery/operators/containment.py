"""Which texts hold which phrases, for tables of both.

Containment is no equi-join. Every phrase is looked up by one run of its bytes, the one
that the fewest texts hold. A first walk over the texts counts the runs that phrases offer,
a second one looks for the chosen runs; both test each position against a filter of the
asked runs while they walk, so nothing leaves a text but its hits. A hit brings
the bytes around it, as far as its longest phrase reaches, and is compared in full.
Where phrases and texts meet in groups, this is left to groups with many of both; in
all others each phrase is looked for in each text of its group.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gleanery.operators.storage import settle

#: Run lengths in bytes: a phrase is looked up by the longest one that it fills.
RUNS = (24, 12, 6, 3, 1)
#: Asked runs per walk, which bounds what is sent to tasks; more of them take further walks.
WALK_RUNS = 2_000_000
#: A group with at most that many phrases, or at most that many texts, is joined by its key instead of walked.
FEW = 256
_PIECE = 1 << 18
_FILTER_BITS = 24
_rng = np.random.default_rng(20250611)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class RunHashes:
    """Hashes of all runs of a length in a buffer, from prefix sums of a polynomial over its bytes."""

    def __init__(self):
        powers = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            factors = np.full(_PIECE + 64, base, dtype=np.uint64)
            factors[0] = 1
            powers.append(np.multiply.accumulate(factors))
        self.power, self.inverse = powers

    def of(self, raw: np.ndarray, lengths: Sequence[int]) -> Iterator[tuple[int, int, np.ndarray]]:
        """(length, first position, hashes) for pieces of the buffer."""
        longest = max(lengths, default=0)
        for at in range(0, len(raw), _PIECE):
            part = raw[at:at + _PIECE + longest - 1]
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(_BYTE[part] * self.power[:len(part)], out=sums[1:])
            for n in lengths:
                count = min(_PIECE, len(part) - n + 1)
                if count > 0:
                    yield n, at, _spread((sums[n:n + count] - sums[:count]) * self.inverse[:count] + np.uint64(n))


class AskedRuns:
    """Sorted 64-bit keys with a bit table in front, so that most positions cost one look."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys)
        bits = min(_FILTER_BITS, max(10, int(len(keys)).bit_length() + 4))
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.table = np.zeros(1 << bits, dtype=bool)
        self.table[self.keys >> self.shift] = True
        self.second = np.zeros(1 << bits, dtype=bool)
        self.second[self.keys & self.mask] = True

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of asked keys in ``hashes``, and the place of each key."""
        at = np.flatnonzero(self.table[hashes >> self.shift])
        at = at[self.second[hashes[at] & self.mask]]
        place = np.searchsorted(self.keys, hashes[at])
        found = place < len(self.keys)
        found[found] = self.keys[place[found]] == hashes[at][found]
        return at[found], place[found]


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column, and the bounds of its values in them; nulls are empty."""
    column = column.fill_null("" if pa.types.is_string(column.type) else b"")
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[bounds[0]:bounds[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, bounds - bounds[0]


def _walk(batch: pa.RecordBatch, asked: AskedRuns, lengths: Sequence[int], hashes: RunHashes, salted: bool):
    """(text, position, key place) of every hit in a batch, with the bytes and bounds of its texts."""
    raw, bounds = _buffer(batch.column("body"))
    salt = batch.column("salt").to_numpy().view(np.uint64) if salted else None
    texts, at, places = [], [], []
    for n, start, found in hashes.of(raw, lengths):
        if salted:
            found = _spread(found ^ np.repeat(salt, np.diff(np.clip(bounds, start, start + len(found)))))
        position, place = asked.hits(found)
        position = position + start
        text = np.searchsorted(bounds, position, side="right") - 1
        inside = position + n <= bounds[text + 1]
        texts.append(text[inside])
        at.append(position[inside])
        places.append(place[inside])
    join = lambda parts: np.concatenate([np.empty(0, np.int64), *parts])
    return raw, bounds, join(texts), join(at), join(places)


def _phrase_runs(salted: bool, names: list[str]):
    """A phrase's runs side by side and its last one: key, offset in the phrase, and bytes of run and phrase."""
    def run(batches):
        hashes = RunHashes()
        for batch in batches:
            raw, bounds = _buffer(batch.column("phrase"))
            size = np.diff(bounds)
            salt = batch.column("salt").to_numpy().view(np.uint64) if salted else None
            rows, keys, offsets, lengths = [], [], [], []
            for i in np.flatnonzero(size):
                n = next(x for x in RUNS if x <= size[i])
                wanted = np.unique(np.append(np.arange(0, size[i] - n + 1, n), size[i] - n))
                for _, start, found in hashes.of(raw[bounds[i]:bounds[i + 1]], [n]):
                    here = wanted[(wanted >= start) & (wanted < start + len(found))]
                    found = found[here - start]
                    keys.append(_spread(found ^ salt[i]) if salted else found)
                    rows.append(np.full(len(here), i))
                    offsets.append(here)
                    lengths.append(np.full(len(here), n))
            join = lambda parts: np.concatenate([np.empty(0, np.int64), *parts])
            at = join(rows)
            key = np.concatenate([np.empty(0, np.uint64), *keys]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pa.array(at)) for c in names), pa.array(key),
                 *(pa.array(x.astype(np.int32)) for x in (join(offsets), join(lengths), size[at]))],
                names=[*names, "key", "offset", "run", "size"])
    return run


def _count(asked: AskedRuns, lengths: Sequence[int], salted: bool):
    """Texts of a task that hold each asked run."""
    def run(batches):
        hashes, total = RunHashes(), np.zeros(len(asked.keys), dtype=np.int64)
        for batch in batches:
            _, _, texts, _, places = _walk(batch, asked, lengths, hashes, salted)
            held = np.unique(texts * len(asked.keys) + places)
            total += np.bincount(held % max(1, len(asked.keys)), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(asked.keys[some].view(np.int64)), pa.array(total[some])], names=["key", "texts"])
    return run


def _find(asked: AskedRuns, before: np.ndarray, after: np.ndarray, lengths: Sequence[int], salted: bool, names: list[str]):
    """Hits of a text with the bytes around them; equal ones of a text are one row with a count."""
    def run(batches):
        hashes = RunHashes()
        for batch in batches:
            raw, bounds, texts, at, places = _walk(batch, asked, lengths, hashes, salted)
            low = np.maximum(bounds[texts], at - before[places])
            high = np.minimum(bounds[texts + 1], at + after[places])
            found = Counter()
            for text, place, a, b, offset in zip(texts.tolist(), places.tolist(), low.tolist(), high.tolist(), (at - low).tolist()):
                found[text, place, offset, raw[a:b].tobytes()] += 1
            rows = list(found)
            key = asked.keys[np.array([x[1] for x in rows], dtype=np.int64)].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pa.array([x[0] for x in rows], pa.int64())) for c in names), pa.array(key),
                 pa.array([x[2] for x in rows], pa.int32()), pa.array([x[3] for x in rows], pa.binary()), pa.array(list(found.values()), pa.int64())],
                names=[*names, "key", "at", "around", "n"])
    return run


def _fields(df: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)


def _volumes(keys: DataFrame, limit: int) -> list[Column]:
    """Filters that part the keys into sets of about ``limit`` at most."""
    n = -(-keys.count() // limit)
    return [F.pmod(F.xxhash64("key"), F.lit(n)) == i for i in range(n)]


def containment(texts: DataFrame, phrases: DataFrame, on: Sequence[str] = (), carry: Sequence[str] = (), limit: int = WALK_RUNS, few: int = FEW) -> DataFrame:
    """Pairs where a text holds a whole phrase: (on..., carry..., phrase_id, text_id, n).

    ``texts`` has text_id, body and any columns to ``carry``, ``phrases`` has phrase_id and
    phrase; with ``on`` both meet only where these columns are equal. ``n`` counts
    the places, overlapping ones too. Empty and null phrases are in no text. Groups of ``on`` with
    more than ``few`` texts and more than ``few`` phrases, and all rows without ``on``, are walked: the texts are read
    twice for every ``limit`` runs that phrases offer and once for every ``limit`` chosen ones.
    """
    on, carry = list(on), list(carry)
    if not on:
        return _walked(texts, phrases, on, carry, limit)
    phrases = settle(phrases.select(*on, "phrase_id", "phrase").filter("phrase <> ''"), lean=True)
    many = lambda df: df.groupBy(*on).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > few).select(*on)
    # texts are counted for groups of many phrases only
    asking = settle(many(phrases), lean=True)
    large = asking if asking.isEmpty() else settle(many(texts.select(*on).join(asking, on, "left_semi")), lean=True)
    if large.isEmpty():
        return _joined(texts, phrases, on, carry)
    small, big = ([df.join(large, on, how) for df in (texts, phrases)] for how in ("left_anti", "left_semi"))
    return _joined(*small, on, carry).unionByName(_walked(*big, on, carry, limit))


def _joined(texts: DataFrame, phrases: DataFrame, on: list[str], carry: list[str]) -> DataFrame:
    """Each phrase looked for in each text of its group; stored, so that a task's share of a large group can be split."""
    ahead = F.concat(F.lit(r"(?=\Q"), F.replace("phrase", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    met = texts.select(*on, *carry, "text_id", "body").join(phrases, on).filter(F.contains("body", "phrase"))
    held = settle(met.select(*on, *carry, "phrase_id", "text_id", F.regexp_count("body", ahead).alias("n")), lean=True)
    group = [*on, "phrase_id", "text_id"]
    found = held.groupBy(*group).agg(*[F.any_value(c).alias(c) for c in carry], F.sum("n").alias("n"))
    return found.select(*on, *carry, "phrase_id", "text_id", "n")


def _walked(texts: DataFrame, phrases: DataFrame, on: list[str], carry: list[str], limit: int) -> DataFrame:
    salted = bool(on)
    salt = [F.xxhash64(*on).alias("salt")] if on else []
    names = [*on, "phrase_id"]
    offered = settle(phrases.select(*names, "phrase", *salt).mapInArrow(
        _phrase_runs(salted, names), f"{_fields(phrases, names)}, key long, offset int, run int, size int"))
    lengths = sorted(r["run"] for r in offered.select("run").distinct().collect())
    walked = texts.select(*on, *carry, "text_id", "body", *salt)

    def keys_of(df: DataFrame) -> np.ndarray:
        return df.toArrow().column("key").to_numpy().view(np.uint64)

    counted = None
    distinct = offered.select("key").distinct()
    for part in _volumes(distinct, limit):
        found = walked.select("body", *(["salt"] if on else [])).mapInArrow(
            _count(AskedRuns(keys_of(distinct.filter(part))), lengths, salted), "key long, texts long")
        counted = found if counted is None else counted.unionByName(found)
    out = f"{_fields(texts, [*on, *carry, 'text_id'])}, key long, at int, around binary, n long"
    empty = texts.sparkSession.createDataFrame([], out)
    if counted is None:
        return _matches(empty, phrases, offered, on, carry)
    # a run that no text holds leaves its phrase without hits
    rates = counted.groupBy("key").agg(F.sum("texts").alias("texts"))
    rated = offered.join(rates, "key", "left")
    chosen = settle(rated.groupBy(*names).agg(
        F.min_by(F.struct("key", "offset", "size"), F.struct(F.coalesce("texts", F.lit(0)), "offset")).alias("c"),
        F.bool_and(F.col("texts").isNotNull()).alias("held")).filter("held").select(*names, "c.*"))
    spans = settle(chosen.groupBy("key").agg(F.max("offset").alias("before"), F.max(F.col("size") - F.col("offset")).alias("after")))
    hits = [empty]
    for part in _volumes(spans, limit):
        table = spans.filter(part).toArrow().sort_by("key")
        keys = table.column("key").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        before, after = (table.column(c).to_numpy()[order].astype(np.int64) for c in ("before", "after"))
        hits.append(walked.mapInArrow(_find(AskedRuns(keys), before, after, lengths, salted, [*on, *carry, "text_id"]), out))
    return _matches(reduce(DataFrame.unionByName, hits), phrases, chosen, on, carry)


def _matches(hits: DataFrame, phrases: DataFrame, chosen: DataFrame, on: list[str], carry: list[str]) -> DataFrame:
    """Hits whose surroundings are the phrase, summed per phrase and text."""
    asked = chosen.select(*on, "phrase_id", "key", "offset", "size").join(
        phrases.select(*on, "phrase_id", F.encode("phrase", "UTF-8").alias("whole")), [*on, "phrase_id"])
    met = hits.join(asked, [*on, "key"]).filter("at >= offset and substring(around, at - offset + 1, size) = whole")
    group = [*on, "phrase_id", "text_id"]
    return met.groupBy(*group).agg(*[F.any_value(c).alias(c) for c in carry], F.sum("n").alias("n")).select(*on, *carry, "phrase_id", "text_id", "n")
