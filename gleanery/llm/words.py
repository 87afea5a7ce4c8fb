"""Word hashes of whole texts, computed over bytes with numpy.

A word is a maximal run of ASCII letters, digits and non-ASCII characters of the
lower-cased text. Its hash is a polynomial over its bytes modulo 2**64, taken from
prefix sums, so a batch of texts is hashed without a loop over words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

PIECE = 1 << 18
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_WORD = np.zeros(256, dtype=bool)
_WORD[128:] = True
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _WORD[_c] = True
_STEP = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + 4096)
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            factors = np.full(size, base, dtype=np.uint64)
            factors[0] = 1
            tables.append(np.multiply.accumulate(factors))
        _powers[:] = tables
    return _powers


def _hash_piece(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start bytes of the words of one piece."""
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = np.concatenate(([False], _WORD[raw], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    power, inverse = _power_tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * power[:len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts]), starts


def _cut(data: bytes) -> Iterator[bytes]:
    """Pieces of a long text, cut where no word is."""
    at = 0
    while len(data) - at > PIECE:
        end = at + PIECE
        stop = max(data.rfind(b" ", at, end), data.rfind(b"\n", at, end))
        if stop <= at:
            found = [x for x in (data.find(b" ", end), data.find(b"\n", end)) if x >= 0]
            stop = min(found) if found else len(data)
        yield data[at:stop]
        at = stop
    yield data[at:]


def word_hashes(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """The word hashes of each text, in text order; none for null and empty texts."""
    waiting: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        hashes, starts = _hash_piece(b"\n".join(waiting))
        bounds = np.cumsum([0] + [len(x) + 1 for x in waiting])
        cuts = np.searchsorted(starts, bounds)
        for i in range(len(waiting)):
            yield hashes[cuts[i]:cuts[i + 1]]

    for text in texts:
        data = (text or "").lower().encode()
        if size + len(data) > PIECE and waiting:
            yield from flush()
            waiting, size = [], 0
        if len(data) > PIECE:
            yield np.concatenate([_hash_piece(x)[0] for x in _cut(data)])
        else:
            waiting.append(data)
            size += len(data)
    if waiting:
        yield from flush()


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words; one run of all words where there are fewer."""
    if len(words) == 0:
        return words
    n = min(n, len(words))
    out = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for i in range(n):
        out += words[i:len(words) - n + 1 + i] * _STEP[i]
    return mix(out + np.uint64(n))


def batches_by_size(table, column: str, limit: int = 8 << 20) -> Iterator:
    """Slices of an Arrow table or batch with about ``limit`` bytes in a string column."""
    import pyarrow.compute as pc
    sizes = np.cumsum(pc.fill_null(pc.binary_length(table.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < table.num_rows:
        base = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, base + limit, side="right")))
        yield table.slice(at, end - at)
        at = end


def small_batches(spark, rows: int = 1000) -> None:
    """Hand texts to Python in batches of at most ``rows``, so that the copies on both sides stay small.

    A setting of the session, for programs that run these operators over long texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, str(min(rows, int(spark.conf.get(name)))))
