"""Best-fit packing by exact-complement hashing.

Tokenised documents are cut into pieces of at most ``size`` tokens. Only the number of
pieces of each length (at most ``size`` rows) is needed to plan: sums of one, two and
three lengths are indexed, combinations that fill a gap exactly are used up as often as
their lengths last, and what is left is packed best-fit, longest first. A plan names
patterns of lengths and how often each is filled. Pieces are then numbered within their
length, so each finds its sequence and offset from its own number, whatever share of
the pieces has the same length.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from gleanery.llm.tokens import ByteLevel, public_path
from gleanery.llm.words import batches_by_size
from gleanery.operators.storage import settle

SIZE = 1024
END = 2
#: Numbers of pieces of one length stay below this.
_NUMBERS = 1 << 40

Pattern = list[tuple[int, int]]


class SumIndex:
    """Combinations of up to three available lengths by their sum, those with the longest piece first.

    Counts only fall while exact fills are taken, so a combination that has run out is
    never looked at again: each sum keeps the place where its search goes on.
    """

    def __init__(self, left: list[int]):
        self.left = left
        self._pairs: dict[int, int] = {}

    def _has(self, wanted: Counter) -> bool:
        return all(self.left[x] >= n for x, n in wanted.items())

    def single(self, total: int, used: Counter) -> Counter | None:
        wanted = used + Counter([total])
        return wanted if self._has(wanted) else None

    def pair(self, total: int, used: Counter) -> Counter | None:
        a = self._pairs.get(total, total - 1)
        while 2 * a >= total and not self._has(Counter([a, total - a])):
            a -= 1
        self._pairs[total] = a
        while 2 * a >= total:
            wanted = used + Counter([a, total - a])
            if self._has(wanted):
                return wanted
            a -= 1
        return None

    def triple(self, total: int, used: Counter, start: int) -> tuple[Counter | None, int]:
        """Also the longest length to go on from for the same total."""
        for a in range(start, 0, -1):
            if self.left[a]:
                found = self.pair(total - a, used + Counter([a])) if total - a >= 2 else None
                if found and self._has(found):
                    return found, a
        return None, 0


def exact_fills(left: list[int], size: int) -> list[tuple[int, Pattern]]:
    """Use up combinations that fill a sequence: (times, lengths with copies). Lowers ``left``."""
    index, plan = SumIndex(left), []
    for length in range(size, 0, -1):
        gap, own, start = size - length, Counter([length]), size - length - 2
        while left[length]:
            found = own if gap == 0 else index.single(gap, own) or (index.pair(gap, own) if gap >= 2 else None)
            if found is None and gap >= 3:
                found, start = index.triple(gap, own, start)
            if found is None:
                break
            times = min(left[x] // n for x, n in found.items())
            for x, n in found.items():
                left[x] -= times * n
            plan.append((times, sorted(found.items(), reverse=True)))
    return plan


def best_fit(left: list[int], size: int) -> list[tuple[int, Pattern]]:
    """Pack what is left, longest first, each piece into the smallest gap that takes it.

    Sequences filled alike are one entry with a count, so the work depends on the number
    of lengths only.
    """
    open_: dict[int, list[tuple[int, Pattern]]] = {}
    gaps: list[int] = []

    def put(times: int, gap: int, pattern: Pattern) -> None:
        if times:
            if gap not in open_:
                bisect.insort(gaps, gap)
            open_.setdefault(gap, []).append((times, pattern))

    for length in range(size, 0, -1):
        count = left[length]
        while count:
            at = bisect.bisect_left(gaps, length)
            gap = gaps[at] if at < len(gaps) else size
            if at < len(gaps):
                times, pattern = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap]
                    gaps.pop(at)
            else:
                times, pattern = -(-count // (size // length)), []
            each = gap // length
            full = min(times, count // each)
            rest = min(count - full * each, each) if full < times else 0
            put(full, gap - each * length, [*pattern, (length, each)])
            put(1 if rest else 0, gap - rest * length, [*pattern, (length, rest)])
            put(times - full - bool(rest), gap, pattern)
            count -= full * each + rest
    return [x for rows in open_.values() for x in rows]


def plan_packing(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, Pattern]]:
    """Patterns that hold exactly ``counts[length]`` pieces of each length."""
    left = [0] * (size + 1)
    for length, n in counts.items():
        left[length] = n
    return exact_fills(left, size) + best_fit(left, size)


def _runs(plan: list[tuple[int, Pattern]]) -> dict[str, np.ndarray]:
    """For each length, which numbers of its pieces go to which sequences."""
    rows, sequence, given = [], 0, Counter()
    for times, pattern in plan:
        offset = 0
        for length, copies in pattern:
            rows.append((length * _NUMBERS + given[length], given[length], sequence, copies, offset))
            given[length] += times * copies
            offset += length * copies
        sequence += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("key", "first", "sequence", "copies", "offset"), table.T.copy()))


def _cut(path: str, size: int, end: int, with_ids: bool):
    def run(batches):
        tokenizer, number, part = ByteLevel(path, special=True), Counter(), TaskContext.get().partitionId()
        for batch in batches:
            for rows in batches_by_size(batch, "text", 2 << 20):
                at, out, kept = [], [], []
                for i, text in enumerate(rows.column("text").to_pylist()):
                    ids = np.append(tokenizer.ids(text or ""), np.uint32(end)).astype("<u4")
                    first = (len(ids) - 1) % size + 1
                    bounds = [0, *range(first, len(ids) + 1, size)]
                    for piece, (a, b) in enumerate(zip(bounds, bounds[1:])):
                        at.append(i)
                        out.append((piece, a, b - a, zlib.crc32(ids[a:b].tobytes()), number[b - a]))
                        number[b - a] += 1
                        if with_ids:
                            kept.append(ids[a:b].astype(np.int32))
                columns = [pa.array(np.array([x[c] for x in out], dtype=np.int64)) for c in range(5)]
                columns[0] = columns[0].cast(pa.int32())
                arrays = [rows.column("doc_id").take(pa.array(at, pa.int64())), *columns, pa.array(np.full(len(out), part, np.int32))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "number", "part"]
                if with_ids:
                    arrays.append(pa.array(kept, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)
    return run


def pieces(docs: DataFrame, path: str | None = None, size: int = SIZE, end: int = END, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, on request, ids of every document's pieces; stored.

    A document is its ids and ``end``. One of more than ``size`` ids is cut into pieces of
    ``size``, the first of which may be shorter. ``part`` and ``number`` count the pieces
    of each length within the task that made them.
    """
    path = path or public_path("byte_bpe_50k.json")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, number long, part int" + (", ids array<int>" if with_ids else "")
    return settle(docs.select("doc_id", "text").mapInArrow(_cut(path, size, end, with_ids), schema))


def _place(runs: dict[str, np.ndarray], carried: list[str]):
    def run(batches):
        for batch in batches:
            length, number = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(runs["key"], length * _NUMBERS + number, side="right") - 1
            copy = number - runs["first"][at]
            sequence = runs["sequence"][at] + copy // runs["copies"][at]
            offset = runs["offset"][at] + copy % runs["copies"][at] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(sequence), pa.array(offset)],
                                             names=[*carried, "sequence_id", "offset"])
    return run


def place(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """The stored ``pieces`` with the sequence_id and offset of each.

    The driver sees one count per length, and the plan's runs go to every task: at most
    ``size`` counts, and some ten patterns per length of at most sqrt(2 * size) lengths each.
    """
    counted = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counted.select("length", "part", before.alias("before"))
    carried = [c for c in cut.columns if c not in ("number", "part")]
    ranked = cut.join(starts, ["length", "part"]).select(*carried, (F.col("before") + F.col("number")).alias("rank"))
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in cut.schema if f.name in carried]
    return ranked.mapInArrow(_place(_runs(plan_packing(counts, size)), carried), ", ".join([*fields, "sequence_id long", "offset long"]))


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, end: int = END, with_ids: bool = False) -> DataFrame:
    """Pack documents into sequences of at most ``size`` tokens; a row per piece.

    ``docs`` has doc_id (any type) and text; other columns, whatever their names, are left
    out. A null or empty text is the end token alone. Texts of any length are cut, none is
    dropped; repeated rows and ids are packed as often as they come; an empty table gives no
    rows. Sequences are numbered from 0 and have no gaps. Which of the equally long pieces
    goes where depends on how Spark splits the input; the number of sequences does not.
    """
    return place(pieces(docs, path, size, end, with_ids), size)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids, and doc_ids with the offsets where they start.

    ``packed`` must carry ids. A sequence has at most as many pieces as tokens.
    """
    members = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    rows = packed.groupBy("sequence_id").agg(members.alias("m"))
    return rows.select("sequence_id", F.flatten("m.ids").alias("ids"), F.col("m.offset").alias("offsets"), F.col("m.doc_id").alias("doc_ids"))
