"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Benchmark items give word n-grams. Their document counts over the whole corpus tell
which of an item's n-grams are rare; these are its seeds. Where a document holds seeds
of an item, the stretch around them is aligned with the item, so that edited and
partly paraphrased copies are found too.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gleanery.llm.words import batches_by_size, grams, word_hashes
from gleanery.operators.storage import settle

SEED_WORDS = 4
#: N-grams on either side that tell whether one is rare.
NEIGHBOURS = 6
#: Benchmark words handled in one pass over the corpus; larger benchmarks take more passes.
VOLUME_WORDS = 2_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
_BITS = 20


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of an item in a stretch of text, and where it ends (exclusive)."""
    steps = np.arange(len(text), dtype=np.int64) * -GAP
    row, best, end = np.zeros(len(text) + 1, dtype=np.int64), 0, 0
    for word in item:
        cell = np.maximum(row[:-1] + np.where(text == word, MATCH, MISMATCH), row[1:] + GAP)
        np.maximum(cell, 0, out=cell)
        cell = np.maximum.accumulate(cell + steps) - steps
        top = int(cell.argmax())
        if cell[top] > best:
            best, end = int(cell[top]), top + 1
        row[1:] = cell
    return best, end


class Volume:
    """Items of one pass: their words, and their n-grams as sorted hashes with the places they stand at."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]], seeds: np.ndarray | None = None):
        self.items = items
        found = [grams(words, SEED_WORDS) for _, words in items]
        values = np.concatenate(found) if found else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(found)), [len(x) for x in found])
        offset = np.concatenate([np.arange(len(x)) for x in found]) if found else np.empty(0, np.int64)
        if seeds is not None:
            values, owner, offset = values[seeds], owner[seeds], offset[seeds]
        self.order = np.argsort(values, kind="stable")
        self.values, self.owner, self.offset = values[self.order], owner[self.order], offset[self.order]
        self.mask = np.zeros(1 << _BITS, dtype=bool)
        self.mask[(self.values >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def places(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word positions of a text where an n-gram of the items stands, and its first place among ``values``."""
        if len(words) < SEED_WORDS or not len(self.values):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        found = grams(words, SEED_WORDS)
        at = np.flatnonzero(self.mask[(found >> np.uint64(64 - _BITS)).astype(np.int64)])
        index = np.minimum(np.searchsorted(self.values, found[at]), len(self.values) - 1)
        hit = self.values[index] == found[at]
        return at[hit], index[hit]

    def leaks(self, words: np.ndarray, least: float) -> list[tuple[int | None, float, int, int, int]]:
        """(item_id, score, from, to, seeds) of each item whose best alignment in the text scores ``least`` or more."""
        starts: dict[int, list[int]] = defaultdict(list)
        for at, index in zip(*self.places(words)):
            value = self.values[index]
            while index < len(self.values) and self.values[index] == value:
                starts[int(self.owner[index])].append(int(at - self.offset[index]))
                index += 1
        out = []
        for owner, found in starts.items():
            item_id, item = self.items[owner]
            found.sort()
            best = (0.0, 0, 0)
            group = [found[0]]
            for start in [*found[1:], None]:
                if start is not None and start - group[-1] <= len(item):
                    group.append(start)
                    continue
                low, high = max(0, group[0] - len(item) // 2), min(len(words), group[-1] + len(item) + len(item) // 2)
                score, end = align(item, words[low:high])
                if score / (MATCH * len(item)) > best[0]:
                    best = (score / (MATCH * len(item)), low, low + end)
                group = [start]
            if best[0] >= least:
                _, back = align(item[::-1], words[best[1]:best[2]][::-1])
                out.append((item_id, best[0], best[2] - back, best[2], len(found)))
        return out


def _count(volume: Volume):
    def run(batches):
        total = np.zeros(len(volume.values), dtype=np.int64)
        for batch in batches:
            for rows in batches_by_size(batch, "text", 4 << 20):
                for words in word_hashes(rows.column("text").to_pylist()):
                    total[np.unique(volume.places(words)[1])] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["place", "n"])
    return run


def rare_places(counts: np.ndarray) -> np.ndarray:
    """Which n-grams of an item are seeds: those at most twice as common as the median of their neighbours, so that every
    stretch of the item keeps seeds however common it is. N-grams that no document holds count as nothing."""
    near = np.pad(counts.astype(float), NEIGHBOURS, constant_values=np.nan)
    near[near == 0] = np.nan
    around = np.lib.stride_tricks.sliding_window_view(near, 2 * NEIGHBOURS + 1)
    held = counts > 0
    out = np.zeros(len(counts), dtype=bool)
    out[held] = counts[held] <= 2 * np.nanmedian(around[held], axis=1)
    return out


def _volumes(docs: DataFrame, benchmark: DataFrame):
    """Volumes whose n-grams are the seeds."""
    def words_of(batches):
        for batch in batches:
            found = [x.tobytes() for x in word_hashes(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(found, pa.binary())], names=["item_id", "words"])

    items = settle(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
                   .mapInArrow(words_of, "item_id long, words binary")
                   .filter(F.octet_length("words") >= 8 * SEED_WORDS).groupBy("words").agg(F.min("item_id").alias("item_id")))
    many = items.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0)) / 8).first()[0]
    passes = 1 + int(many // VOLUME_WORDS)
    for i in range(passes):
        # One volume has about VOLUME_WORDS words at most, so it is small enough for the driver and the tasks.
        rows = items.filter(F.pmod(F.xxhash64("words"), F.lit(passes)) == i).collect()
        found = sorted(((r["item_id"], bytes(r["words"])) for r in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        every = Volume([(i, np.frombuffer(w, np.uint64)) for i, w in found])
        if not len(every.values):
            continue
        first = np.searchsorted(every.values, every.values)
        counts = np.zeros(len(first), dtype=np.int64)
        for r in docs.select("text").mapInArrow(_count(every), "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
            counts[r["place"]] = r["n"]
        common = counts[first]
        placed = np.empty(len(common), dtype=np.int64)
        placed[every.order] = common
        ends = np.cumsum([len(w) - SEED_WORDS + 1 for _, w in every.items])
        yield Volume(every.items, np.flatnonzero(np.concatenate([rare_places(part) for part in np.split(placed, ends[:-1])])))


def _report(volume: Volume, least: float):
    def run(batches):
        for batch in batches:
            for rows in batches_by_size(batch, "text", 4 << 20):
                ids = rows.column("doc_id").to_pylist()
                found = [(ids[i], *leak) for i, words in enumerate(word_hashes(rows.column("text").to_pylist()))
                         for leak in volume.leaks(words, least)]
                columns = list(zip(*found)) if found else [[]] * 6
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                                 names=["doc_id", "item_id", "score", "word_from", "word_to", "n_seeds"])
    return run


def _clean(volume: Volume, least: float):
    def run(batches):
        for batch in batches:
            for rows in batches_by_size(batch, "text", 4 << 20):
                keep = [not volume.leaks(words, least) for words in word_hashes(rows.column("text").to_pylist())]
                yield rows.filter(pa.array(keep, pa.bool_()))
    return run


LEAKS = "doc_id long, item_id long, score double, word_from long, word_to long, n_seeds long"


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.5) -> DataFrame:
    """Benchmark items that documents hold: doc_id, item_id, score (1 for a whole exact copy), the words
    ``word_from`` to ``word_to`` (exclusive) of the best alignment, and the seeds found.

    Each document row gives a row per item with a score of ``least`` or more. Items with the same
    words count as one, under their least item_id; items of fewer than four words match nothing.
    Null and empty texts hold nothing.
    """
    out = docs.sparkSession.createDataFrame([], LEAKS)
    for volume in _volumes(docs, benchmark):
        out = out.union(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_report(volume, least), LEAKS))
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    out = docs
    for volume in _volumes(docs, benchmark):
        out = out.mapInArrow(_clean(volume, least), docs.schema)
    return out
