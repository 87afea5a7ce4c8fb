"""Sparse hash vectors of texts, and the similarity join of stored vectors with queries.

A text's vector is one row: the buckets of its tokens and their weights. The join walks
these rows with a volume of query postings at hand. Buckets are ordered from rare to
common; from any bucket on, a pair can gain at most the product of what is left
of both norms. Only pairs whose rarest common bucket still allows the score asked
for become candidates, and these are scored exactly. With ``best``, the score asked for
rises to the best-th score that the task has met for the query. Against few queries the
products of all common buckets are summed up instead, which is less work than telling
the candidates. Rows may name the queries that they are for; no others meet them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from gleanery.functions import text as tx
from gleanery.operators.storage import settle

DIMENSIONS = 2048
#: Query postings per walk, which bounds what is sent to tasks; more of them take further walks.
WALK_POSTINGS = 1_000_000
DIGITS = 8
#: Stored rows, tokens, and places of queries that a task holds in arrays at a time, and tokens whose buckets it remembers.
_ROWS, _TOKENS, _PLACES, _KNOWN = 1000, 200_000, 1_000_000, 500_000
_SLACK = 1e-7
#: Products and sums for each stored posting up to which all of a batch are made.
_SUMMED = 64
#: Queries that a row may name at a time, about.
LISTED = 10_000


def _parts(batch: pa.RecordBatch, lists: str, most: int):
    """Slices of a batch with about ``most`` list elements, or a single row with more."""
    ends = np.cumsum(batch.column(lists).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        upto = min(max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")), at + 1), at + _ROWS, batch.num_rows)
        yield batch.slice(at, upto - at)
        at = upto


def _shares(sizes: np.ndarray, most: int):
    """(first, last) of consecutive items whose sizes sum up to about ``most``, or of a single larger item."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        upto = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")), at + 1)
        yield at, upto
        at = upto


def _vectors(keep: Sequence[str], dimensions: int):
    def run(batches):
        known: dict[str, int] = {}
        for batch in (part for whole in batches for part in _parts(whole, "tokens", _TOKENS)):
            tokens = batch.column("tokens")
            if len(known) > _KNOWN:
                known.clear()
            row = np.repeat(np.arange(len(tokens)), tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            coded = tokens.flatten().dictionary_encode()
            buckets = np.empty(len(coded.dictionary), dtype=np.int64)
            for i, token in enumerate(coded.dictionary.to_pylist()):
                if token not in known:
                    known[token] = int.from_bytes(hashlib.sha256(token.encode()).digest()[:4], "big") % dimensions
                buckets[i] = known[token]
            pairs, n = np.unique(row * dimensions + buckets[coded.indices.to_numpy()], return_counts=True)
            row = pairs // dimensions
            norms = np.sqrt(np.bincount(row, n * n, minlength=len(tokens)))
            offsets = pa.array(np.searchsorted(row, np.arange(len(tokens) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.ListArray.from_arrays(offsets, pa.array((pairs % dimensions).astype(np.int32))),
                 pa.ListArray.from_arrays(offsets, pa.array(n / norms[row]))], names=[*keep, "buckets", "weights"])
    return run


def _fields(df: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)


def text_vectors(df: DataFrame, text: str, keep: Sequence[str], dimensions: int = DIMENSIONS) -> DataFrame:
    """The columns to keep, with ``buckets`` and ``weights`` of the unit vector of hashed token counts; no shuffle."""
    rows = df.select(*keep, tx.search_tokens(F.col(text)).alias("tokens"))
    return rows.mapInArrow(_vectors(list(keep), dimensions), f"{_fields(df, keep)}, buckets array<int>, weights array<double>")


def hash_vectors(df: DataFrame, key: str, text: str) -> DataFrame:
    """Sparse unit vectors as rows (key, bucket, weight)."""
    pairs = F.arrays_zip(F.col("buckets").alias("bucket"), F.col("weights").alias("weight"))
    return text_vectors(df, text, (key,)).select(key, F.explode(pairs).alias("p")).select(
        key, F.col("p.bucket").cast("bigint").alias("bucket"), F.col("p.weight").alias("weight"))


def _tails(group: np.ndarray, rank: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of postings by group and rank, and in it the norm of each group from there on."""
    order = np.lexsort((rank, group))
    squares = weight[order] ** 2
    upto, ends = np.cumsum(squares), np.flatnonzero(np.diff(group[order], append=-1))
    total = np.repeat(upto[ends], np.diff(ends, prepend=-1))
    return order, np.sqrt(np.maximum(total - upto + squares, 0))


class QueryPostings:
    """A volume of query vectors, ready to be met by batches of stored ones."""

    def __init__(self, query: np.ndarray, bucket: np.ndarray, weight: np.ndarray, queries: int, least: float, best: int | None, dimensions: int):
        order = np.argsort(query, kind="stable")
        self.query, self.bucket, self.weight = query[order], bucket[order], weight[order]
        self.first = np.searchsorted(self.query, np.arange(queries + 1))
        self.dimensions, self.best, self.least = dimensions, best, least
        self.floor = np.full(queries, float(least))
        self.top = np.full((queries, best), -1.0) if best else None
        self.rank: np.ndarray | None = None
        self.batches = self.candidates = 0

    def _arrange(self) -> None:
        """Postings of each bucket by how far the rest of their query's norm exceeds its floor, the largest first."""
        order, tail = _tails(self.query, self.rank[self.bucket], self.weight)
        ratio = tail / np.maximum(self.floor[self.query[order]] - _SLACK, _SLACK)
        bucket = self.bucket[order]
        by = np.lexsort((-ratio, bucket))
        self.posted, self.scale = self.query[order][by], float(max(ratio.max(initial=1), 1)) * 2
        self.held = self.weight[order][by]
        self.place = bucket[by] * self.scale - ratio[by]
        self.start = np.searchsorted(bucket[by], np.arange(self.dimensions + 1))

    def meet(self, row: np.ndarray, bucket: np.ndarray, weight: np.ndarray, rows: int, allowed: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, query, score) of the pairs that reach the floors, among the ``allowed`` (row, query) where these are given; in the order of rows."""
        if self.rank is None:  # any order is right; that of the first batch is near enough
            self.rank = np.argsort(np.argsort(np.bincount(bucket, minlength=self.dimensions), kind="stable"))
        if not self.batches & (self.batches - 1):
            self._arrange()
        self.batches += 1
        dense = np.zeros((rows, self.dimensions))
        dense[row, bucket] = weight
        only = None if allowed is None else np.unique(allowed[0] * len(self.floor) + allowed[1])
        n = self.start[bucket + 1] - self.start[bucket]
        few = n.sum() + rows * len(self.floor) <= _SUMMED * len(bucket)
        found = []
        for pairs in self._summed(row, bucket, weight, rows, n, only) if few else self._reached(row, bucket, weight, rows, only):
            self.candidates += len(pairs)
            for c, d in _shares(self._sizes(pairs % len(self.floor)), _PLACES):
                found.append(self._exact(*np.divmod(pairs[c:d], len(self.floor)), dense))
        r, q, score = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        if self.best and len(q):
            self._raise(q, score)
            high = score >= self.floor[q]
            r, q, score = r[high], q[high], score[high]
        return r, q, score

    def _places(self, here: slice, bucket: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The first ``n`` query postings of each bucket."""
        m = n[here]
        return np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(self.start[bucket[here]], m)

    def _summed(self, row: np.ndarray, bucket: np.ndarray, weight: np.ndarray, rows: int, n: np.ndarray, only: np.ndarray | None) -> Iterator[np.ndarray]:
        """Pairs whose products sum up to their floors."""
        order = np.argsort(row, kind="stable")
        row, bucket, weight, n = row[order], bucket[order], weight[order], n[order]
        queries = len(self.floor)
        first = np.searchsorted(row, np.arange(rows + 1))
        upto = np.concatenate([[0], np.cumsum(n)])
        for a, b in _shares(upto[first[1:]] - upto[first[:-1]] + queries, _PLACES):
            here = slice(first[a], first[b])
            at = self._places(here, bucket, n)
            pairs = np.repeat((row[here] - a) * queries, n[here]) + self.posted[at]
            sums = np.bincount(pairs, np.repeat(weight[here], n[here]) * self.held[at], minlength=(b - a) * queries)
            if only is None:
                yield np.flatnonzero(sums.reshape(b - a, queries) >= self.floor - _SLACK) + a * queries
            else:
                some = only[slice(*np.searchsorted(only, (a * queries, b * queries)))]
                yield some[sums[some - a * queries] >= self.floor[some % queries] - _SLACK]

    def _reached(self, row: np.ndarray, bucket: np.ndarray, weight: np.ndarray, rows: int, only: np.ndarray | None) -> Iterator[np.ndarray]:
        """Pairs whose rarest common bucket allows their floors."""
        order, tail = _tails(row, self.rank[bucket], weight)
        row, bucket, weight = row[order], bucket[order], weight[order]
        reach = np.searchsorted(self.place, bucket * self.scale - (1 - _SLACK) / np.maximum(tail, _SLACK), side="right")
        n = np.maximum(np.minimum(reach, self.start[bucket + 1]) - self.start[bucket], 0)
        # the postings are in the order of rows, so a share of whole rows has all of their pairs
        first = np.searchsorted(row, np.arange(rows + 1))
        upto = np.concatenate([[0], np.cumsum(n)])
        for a, b in _shares(upto[first[1:]] - upto[first[:-1]], _PLACES):
            here = slice(first[a], first[b])
            pairs = np.unique(np.repeat(row[here], n[here]) * len(self.floor) + self.posted[self._places(here, bucket, n)])
            yield pairs if only is None else pairs[np.isin(pairs, only, assume_unique=True)]

    def _sizes(self, query: np.ndarray) -> np.ndarray:
        return self.first[query + 1] - self.first[query]

    def _exact(self, r: np.ndarray, q: np.ndarray, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs that reach their floor, with their scores."""
        size = self._sizes(q)
        which = np.repeat(np.arange(len(q)), size)
        at = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.first[q], size)
        exact = np.bincount(which, dense[r[which], self.bucket[at]] * self.weight[at], minlength=len(q))
        high = (exact >= self.least) & (exact >= self.floor[q])
        return r[high], q[high], exact[high]

    def _raise(self, query: np.ndarray, score: np.ndarray) -> None:
        """Keep the best scores of the queries met; a full list lifts the floor to its least score."""
        met = np.unique(query)
        owner = np.concatenate([np.repeat(met, self.best), query])
        scores = np.concatenate([self.top[met].ravel(), score])
        order = np.lexsort((-scores, owner))
        owner, scores = owner[order], scores[order]
        start = np.searchsorted(owner, met)
        self.top[met] = scores[start[:, None] + np.arange(self.best)]
        # what rounds to the same score stays
        self.floor[met] = np.maximum(self.floor[met], self.top[met, -1] - 10.0 ** -DIGITS)


def _named(batch: pa.RecordBatch, keys: pa.Array) -> tuple[np.ndarray, np.ndarray] | None:
    """(row, query) of the queries that rows name, as far as they are among the keys."""
    if "queries" not in batch.schema.names:
        return None
    lists = batch.column("queries")
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    place = pc.index_in(lists.flatten(), value_set=keys).to_numpy(zero_copy_only=False)
    known = ~np.isnan(place.astype(float))
    return row[known], place[known].astype(np.int64)


def _search(keys: pa.Array, postings: tuple[np.ndarray, ...], least: float, best: int | None, keep: Sequence[str], key: str, dimensions: int):
    def run(batches):
        asked = QueryPostings(*postings, len(keys), least, best, dimensions)
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                buckets, weights = batch.column("buckets"), batch.column("weights")
                row = np.repeat(np.arange(len(buckets)), buckets.value_lengths().to_numpy().astype(np.int64))
                r, q, score = asked.meet(row, buckets.flatten().to_numpy().astype(np.int64), weights.flatten().to_numpy(), len(buckets), _named(batch, keys))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(r)) for c in keep), keys.take(pa.array(q)), pa.array(score)],
                                                 names=[*keep, key, "score"])
    return run


def similar_vectors(vectors: DataFrame, queries: DataFrame, key: str, least: float, best: int | None = None, dimensions: int = DIMENSIONS) -> DataFrame:
    """Pairs of a stored vector and a query with a cosine of ``least`` or more: the columns of both but for the vectors, and score.

    With ``best``, pairs that cannot be among the best so many of their query (ties included)
    may be missing. The vectors are read once for every ``WALK_POSTINGS`` postings of
    queries, and nothing is shuffled. Where ``vectors`` have a list ``queries`` of keys (of their
    type), a row meets no others.
    """
    asked = settle(queries.select(key, "buckets", "weights").filter(F.size("buckets") > 0))
    total = asked.agg(F.coalesce(F.sum(F.size("buckets")), F.lit(0)).alias("n")).first()["n"]
    volumes = -(-total // WALK_POSTINGS)
    keep = [c for c in vectors.columns if c not in ("buckets", "weights", "queries")]
    schema = f"{_fields(vectors, keep)}, {_fields(queries, [key])}, score double"
    found = [vectors.sparkSession.createDataFrame([], schema)]
    for i in range(volumes):
        table = asked.filter(F.pmod(F.xxhash64(key), F.lit(volumes)) == i).toArrow().combine_chunks()
        if table.num_rows:
            buckets, weights = (table.column(c).combine_chunks() for c in ("buckets", "weights"))
            owner = np.repeat(np.arange(table.num_rows), buckets.value_lengths().to_numpy().astype(np.int64))
            postings = owner, buckets.flatten().to_numpy().astype(np.int64), weights.flatten().to_numpy()
            found.append(vectors.mapInArrow(_search(table.column(key).combine_chunks(), postings, least, best, keep, key, dimensions), schema))
    return reduce(DataFrame.unionByName, found).withColumn("score", F.round("score", DIGITS))
