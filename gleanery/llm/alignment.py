"""Cross-tokenizer alignment by interval coalescing.

The tokens of two tokenizers over the same bytes are intervals. Sorted together by start,
with the running maximum of their ends, they fall into groups wherever a start reaches
that maximum; inside a group every overlapping pair is expanded. Whole batches of texts are
aligned at once, each text moved behind the last one. Corpus-wide counts of id pairs whose
tokens end together are small: one of the two tokens ends with the other, so there are
no more pairs than bytes in the two vocabularies.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gleanery.llm.tokens import ByteLevel, Pieces, public_path
from gleanery.llm.words import batches_by_size
from gleanery.operators.storage import settle

_SHIFT = 32


def coalesce(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the intervals by start and end, and the group of each in that order."""
    order = np.lexsort((end, start))
    start, end = start[order], end[order]
    breaks = np.zeros(len(start), dtype=bool)
    breaks[1:] = start[1:] >= np.maximum.accumulate(end)[:-1]
    return order, np.cumsum(breaks)


def overlaps(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs of an A and a B token that share a byte; both sides in order, without gaps."""
    low = np.searchsorted(b_end, a_start, side="right")
    n = np.searchsorted(b_start, a_end, side="left") - low
    a = np.repeat(np.arange(len(a_start)), n)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


class Aligned:
    """A batch of texts under both tokenizers: ids, groups and links, text after text."""

    def __init__(self, a_ids: list[np.ndarray], b_ids: list[np.ndarray], a_size: np.ndarray, b_size: np.ndarray):
        self.vocabulary = max(len(a_size), len(b_size))
        self.n_a, self.n_b = (np.array([len(x) for x in ids], dtype=np.int64) for ids in (a_ids, b_ids))
        self.a, self.b = (np.concatenate([np.empty(0, np.uint32), *ids]).astype(np.int64) for ids in (a_ids, b_ids))
        # each side tiles the bytes of its texts, and both sides hold the same bytes
        a_end, b_end = np.cumsum(a_size[self.a]), np.cumsum(b_size[self.b])
        a_start, b_start = a_end - a_size[self.a], b_end - b_size[self.b]
        order, group = coalesce(np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end]))
        self.group = np.empty(len(order), dtype=np.int64)
        self.group[order] = group
        a_text = np.repeat(np.arange(len(self.n_a)), self.n_a)
        last = np.flatnonzero(np.diff(self.group[:len(self.a)], append=-1))
        self.n_groups = np.bincount(a_text[last], minlength=len(self.n_a))
        self.overlap = overlaps(a_start, a_end, b_start, b_end)
        ends_together = a_end[self.overlap[0]] == b_end[self.overlap[1]]
        self.linked = tuple(x[ends_together] for x in self.overlap)
        self.n_links = np.bincount(a_text[self.linked[0]], minlength=len(self.n_a))

    def written(self, names: np.ndarray) -> list[str]:
        """Groups of each text: A ids, a bar, B ids; groups parted by semicolons. ``names`` has a row per separator."""
        order = np.argsort(self.group, kind="stable")  # A tokens stand first
        side, group = (order >= len(self.a)).astype(np.int8), self.group[order]
        mark = np.where(np.diff(group, append=-1) != 0, 2, np.where(np.diff(side, append=1) != 0, 1, 0))
        words = names[mark, np.concatenate([self.a, self.b])[order]].tolist()
        bounds = np.cumsum([0, *(self.n_a + self.n_b)])
        return ["".join(words[i:j])[:-1] for i, j in zip(bounds, bounds[1:])]


def _sizes(pieces: dict[int, bytes]) -> np.ndarray:
    out = np.zeros(max(pieces) + 1, dtype=np.int64)
    out[list(pieces)] = [len(x) for x in pieces.values()]
    return out


def _align(batches, a_path: str, b_path: str, limit: int = 1 << 20):
    """(rows, Aligned) of slices of the batches. Texts that either side does not give back byte by byte have no tokens."""
    a, b = ByteLevel(a_path, special=False), Pieces(b_path)
    a_size, b_size, none = _sizes(a.pieces), _sizes(b.pieces), np.empty(0, np.uint32)
    for batch in batches:
        for rows in batches_by_size(batch, "text", limit):
            sides = []
            for text in rows.column("text").to_pylist():
                ids = (a.ids(f" {text}"), b.ids(text)) if text else (none, none)
                want = f" {text}".encode() if text else b""
                same = all(b"".join(map(s.pieces.__getitem__, x.tolist())) == want for s, x in zip((a, b), ids))
                sides.append(ids if same else (none, none))
            yield rows, Aligned([x for x, _ in sides], [x for _, x in sides], a_size, b_size)


def _nested(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.cumsum([0, *counts]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values).cast(kind))


def _tokens(a_path: str, b_path: str):
    def run(batches):
        for rows, x in _align(batches, a_path, b_path):
            a_group, b_group = x.group[:len(x.a)], x.group[len(x.a):]
            first = np.cumsum(x.n_groups) - x.n_groups
            a_base, b_base = (np.cumsum(n) - n for n in (x.n_a, x.n_b))
            a, b = x.overlap
            text = np.repeat(np.arange(len(x.n_a)), x.n_a)[a]
            many = np.bincount(text, minlength=len(x.n_a))
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), _nested(x.a, x.n_a, pa.int32()), _nested(x.b, x.n_b, pa.int32()),
                 _nested(a_group - np.repeat(first, x.n_a), x.n_a, pa.int32()), _nested(b_group - np.repeat(first, x.n_b), x.n_b, pa.int32()),
                 _nested(a - a_base[text], many, pa.int32()), _nested(b - b_base[text], many, pa.int32())],
                names=["doc_id", "a_ids", "b_ids", "a_groups", "b_groups", "overlap_a", "overlap_b"])
    return run


def aligned_tokens(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, the ids of both tokenizers, the group of each token, and the positions of all overlapping pairs.

    Nulls, empty and very long texts, repeated rows, empty tables and further columns as in ``alignment_report``.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    lists = ", ".join(f"{c} array<int>" for c in ("a_ids", "b_ids", "a_groups", "b_groups", "overlap_a", "overlap_b"))
    return docs.select("doc_id", "text").mapInArrow(
        _tokens(a_path or public_path("byte_bpe_50k.json"), b_path or public_path("piece_bpe_32k.model")), f"doc_id {kind}, {lists}")


def _digest(a_path: str, b_path: str):
    def run(batches):
        names = None
        for rows, x in _align(batches, a_path, b_path):
            if names is None:
                names = np.array([[f"{i}{mark}" for i in range(x.vocabulary)] for mark in ",|;"], dtype=object)
            hashes = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in x.written(names)]
            links = (x.a[x.linked[0]] << _SHIFT) + x.b[x.linked[1]]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), *map(pa.array, (x.n_a, x.n_b, x.n_groups, x.n_links)), pa.array(hashes, pa.string()),
                 _nested(links, x.n_links, pa.int64())],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])
    return run


def _tally(batches):
    """Links of a task by pair; memory is bounded by the number of distinct pairs."""
    keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        # not .values, which ignores the slice that a batch may be
        more, n = np.unique(batch.column("links").flatten().to_numpy(), return_counts=True)
        merged, at = np.unique(np.concatenate([keys, more]), return_inverse=True)
        total = np.zeros(len(merged), dtype=np.int64)
        np.add.at(total, at, np.concatenate([counts, n]))
        keys, counts = merged, total
    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["pair", "n"])


def _scored(keys: np.ndarray, counts: np.ndarray, carried: list[str]):
    def run(batches):
        second = keys & ((1 << _SHIFT) - 1)
        best = np.zeros(int(second.max(initial=0)) + 1, dtype=np.int64)
        np.maximum.at(best, second, counts)
        is_best = counts == best[second]
        for batch in batches:
            links = batch.column("links")
            size = links.value_lengths().to_numpy()
            row = np.repeat(np.arange(len(size)), size)
            at = np.searchsorted(keys, links.flatten().to_numpy())
            total = np.zeros(len(size), dtype=np.int64)
            np.add.at(total, row, counts[at])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in carried), pa.array(np.bincount(row[is_best[at]], minlength=len(size)).astype(np.int64)), pa.array(total)],
                names=[*carried, "n_best", "count_sum"])
    return run


def alignment_report(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best and count_sum of every row.

    ``docs`` has doc_id (any type) and text; other columns, whatever their names, are left
    out. A gets a blank and the text, B the text; special tokens are plain text. A null or
    empty text, or one whose bytes either side does not give back, has no tokens: zeros and an
    empty hash. Links are pairs of an A and a B token that end together. A pair's count is
    taken over all rows, repeated ones as often as they come; ``n_best`` are links whose
    count no other pair of the same B id exceeds. An empty table gives no rows. Each row
    is tokenised once, and its links are stored; the counts of pairs, at most as many as the
    vocabularies have bytes, go to every task.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    carried = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    fields = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    paths = a_path or public_path("byte_bpe_50k.json"), b_path or public_path("piece_bpe_32k.model")
    found = settle(docs.select("doc_id", "text").mapInArrow(_digest(*paths), f"{fields}, links array<long>"))
    tallied = found.select("links").mapInArrow(_tally, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    keys, counts = (tallied.sort_by("pair").column(c).to_numpy() for c in ("pair", "n"))
    return found.mapInArrow(_scored(keys, counts, carried), f"{fields}, n_best long, count_sum long")
