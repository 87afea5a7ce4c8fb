"""Records of delimited files whose quoted cells may hold line breaks, read split by split.

Whether a line starts inside a quoted cell depends on all lines before it. Each split of a
file is therefore read as a map from that state at its start to the one at its end; the maps
are composed over the splits of a file, and a second pass, which knows how its split
starts, cuts records at the breaks outside of quotes. What is left open at the edges
of splits is put together from the few pieces that splits hand over.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_CLOSING = re.compile(r'(?:[^"]|"")*+"')
_BLANKS = re.compile(r"[ \t]*")
HEAD, WHOLE, TAIL = 0, 1, 2


def state_after(sep: str) -> Callable[[str, bool], bool]:
    """(line, inside) to inside: whether a quoted cell is open after a line. Quotes count at the start of a cell only."""
    def after(line: str, inside: bool) -> bool:
        at = 0
        while True:
            if inside:
                end = _CLOSING.match(line, at)
                if end is None:
                    return True
                at = end.end()
            elif '"' not in line[at:]:
                return False
            else:
                start = at if sep == "\t" else _BLANKS.match(line, at).end()
                if line.startswith('"', start):
                    at, inside = start + 1, True
                    continue
            at, inside = line.find(sep, at) + 1, False
            if not at:
                return False
    return after


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _maps(sep: str):
    """For each split: the state at its end from either state at its start, and whether a line ever ends inside a cell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after, found = state_after(sep), {}
        for batch in batches:
            for file, start, line in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "value"))):
                outside, inside, opened = found.get((file, start), (False, True, False))
                outside, inside = after(line, outside), after(line, inside)
                found[file, start] = outside, inside, opened or outside
        rows = [(*k, *v) for k, v in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()),
                                          *[pa.array([r[i] for r in rows], pa.bool_()) for i in (2, 3, 4)]],
                                         names=["file", "start", "outside", "inside", "opened"])
    return run


def open_stretches(maps: DataFrame) -> DataFrame:
    """(file, start, until): splits after ``start`` up to ``until`` start inside a cell; null where that lasts to the end of the file.

    A split's map keeps the state, turns it round, or forgets it, so the state at its end
    is that of the last split that forgets, turned by those since.
    """
    by_file = W.partitionBy("file").orderBy("start")
    upto = by_file.rowsBetween(W.unboundedPreceding, 0)
    fixed = F.col("outside") == F.col("inside")
    turns = F.sum((~fixed & F.col("outside")).cast("int")).over(upto)
    rows = maps.select("file", "start", turns.alias("turns"), F.lead("start").over(by_file).alias("until"),
                       F.when(fixed, F.struct(turns.alias("turns"), F.col("outside").cast("int").alias("state"))).alias("fixed"))
    last = F.last("fixed", ignorenulls=True).over(upto)
    state = F.coalesce(last["state"], F.lit(0)) + F.col("turns") - F.coalesce(last["turns"], F.lit(0))
    return rows.select("file", "start", "until", (state % 2 == 1).alias("open")).filter("open").drop("open")


def _cut(sep: str, stretches: dict[str, list[tuple[int, int | None]]]):
    def starts_inside(file: str, start: int) -> bool:
        mine = stretches.get(file, [])
        at = bisect.bisect_left(mine, (start,)) - 1
        return at >= 0 and (mine[at][1] is None or start <= mine[at][1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after, here, inside, kind, parts, first = state_after(sep), None, False, WHOLE, [], False
        for batch in batches:
            out = []

            def give(kind: int) -> None:
                out.append((*here, kind, first, "\n".join(parts)))
            for file, start, line in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "value"))):
                if (file, start) != here:
                    if parts:
                        give(HEAD if kind == HEAD else TAIL)
                    here, inside, parts, first = (file, start), starts_inside(file, start), [], start == 0
                    kind = HEAD if inside else WHOLE
                parts.append(line)
                inside = after(line, inside)
                if not inside:
                    give(kind)
                    kind, parts, first = WHOLE, [], False
            yield _pieces(out)
        if parts:
            yield _pieces([(*here, HEAD if kind == HEAD else TAIL, first, "\n".join(parts))])
    return run


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                      names=["file", "start", "kind", "first", "record"])


def read_records(spark: SparkSession, path: str, sep: str) -> DataFrame | None:
    """(file, first, record): the records of a file or folder, ``first`` for the first one of each file.

    None where no cell holds a line break, since every line is a record then. Splits that start inside
    a cell are told to all tasks: at most as many stretches as splits, as a rule none.
    """
    lines = _lines(spark, path)
    maps = lines.filter(F.contains("value", F.lit('"'))).mapInArrow(
        _maps(sep), "file string, start long, outside boolean, inside boolean, opened boolean")
    if not maps.agg(F.coalesce(F.bool_or("opened"), F.lit(False)).alias("o")).first()["o"]:
        return None
    stretches: dict[str, list[tuple[int, int | None]]] = {}
    for row in open_stretches(maps).orderBy("file", "start").collect():
        stretches.setdefault(row["file"], []).append((row["start"], row["until"]))
    pieces = lines.mapInArrow(_cut(sep, stretches), "file string, start long, kind int, first boolean, record string")
    whole = pieces.filter(F.col("kind") == WHOLE).select("file", "first", "record")
    if not stretches:
        return whole.unionByName(pieces.filter(F.col("kind") == TAIL).select("file", "first", "record"))
    edges = pieces.filter(F.col("kind") != WHOLE)
    number = F.count_if(F.col("kind") == TAIL).over(W.partitionBy("file").orderBy("start", "kind"))
    joined = edges.withColumn("number", number).groupBy("file", "number").agg(
        F.bool_or("first").alias("first"), F.array_sort(F.collect_list(F.struct("start", "kind", "record"))).alias("parts"))
    return whole.unionByName(joined.select("file", "first", F.array_join("parts.record", "\n").alias("record")))
