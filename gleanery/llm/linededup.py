"""Line dedup through sharded minimal perfect hashes over distinct line hashes.

Every line long enough gives a 128-bit hash. Lines counted in enough documents are
split into shards; each shard builds a minimal perfect hash whose slots index compact
arrays of fingerprints, document counts and keepers. Documents are dealt into parts;
a part sends each of its distinct line hashes once to the arrays and gets back the
lines it has to drop, so a line that a third of all documents share still costs one
probe per part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gleanery.llm.words import batches_by_size, mix
from gleanery.operators.storage import settle

SPACE = b" \t\n\x0b\x0c\r"
SHARD_PROBES = 5_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


class PerfectHash:
    """Minimal perfect hash over distinct pairs of 64-bit values.

    Keys claim a bit in the first level where no other key falls on it; the slot of a
    key is the number of bits before its own.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, before = [], 0
        for bits in levels:
            counts = np.cumsum(bits, dtype=np.int64)
            self.ranks.append(before + counts - bits)
            before += int(counts[-1])

    @staticmethod
    def _place(first: np.ndarray, second: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(first * _ODD[0] + second * _ODD[1] + np.uint64(level + 1) * _ODD[2]) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, first: np.ndarray, second: np.ndarray) -> PerfectHash:
        levels = []
        while len(first):
            size = 2 * len(first) + 1
            at = cls._place(first, second, len(levels), size)
            bits = np.bincount(at, minlength=size) == 1
            levels.append(bits)
            rest = ~bits[at]
            first, second = first[rest], second[rest]
        return cls(levels)

    def slots(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Slot of each key; foreign keys get some slot or -1."""
        out = np.full(len(first), -1, dtype=np.int64)
        open_ = np.arange(len(first))
        for level, (bits, rank) in enumerate(zip(self.levels, self.ranks)):
            if not len(open_):
                break
            at = self._place(first[open_], second[open_], level, len(bits))
            hit = bits[at]
            out[open_[hit]] = rank[at[hit]]
            open_ = open_[~hit]
        return out

    def dump(self) -> list[bytes]:
        return [len(x).to_bytes(8, "little") + np.packbits(x).tobytes() for x in self.levels]

    @classmethod
    def load(cls, parts: list[bytes]) -> PerfectHash:
        return cls([np.unpackbits(np.frombuffer(x, np.uint8, offset=8), count=int.from_bytes(x[:8], "little")).astype(bool)
                    for x in parts])


def line_keys(text: str | None, min_chars: int) -> list[bytes | None]:
    """The 128-bit hash of each line's key; None for lines that are too short."""
    out: list[bytes | None] = []
    for line in (text or "").encode().split(b"\n"):
        key = line.strip(SPACE).lower()
        long_enough = len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars)
        out.append(xxhash.xxh3_128_digest(key) if long_enough else None)
    return out


def _part(parts: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int")


def _gather(min_chars: int):
    def run(batches):
        for batch in batches:
            for rows in batches_by_size(batch, "text"):
                found, parts, ids = [], [], []
                for doc_id, text, part in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "text", "part"))):
                    keys = {k for k in line_keys(text, min_chars) if k is not None}
                    found.extend(keys)
                    parts.extend([part] * len(keys))
                    ids.extend([doc_id] * len(keys))
                pairs = np.frombuffer(b"".join(found), dtype=np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), pa.array(parts, pa.int32()), pa.array(ids, pa.int64())],
                    names=["h1", "h2", "part", "doc_id"])
    return run


def _build(table: pa.Table) -> pa.Table:
    first, second = (table.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
    index = PerfectHash.build(first, second)
    slots = index.slots(first, second)

    def arranged(column: str, fill: int) -> np.ndarray:
        out = np.empty(len(slots), dtype=np.int64)
        out[slots] = table.column(column).fill_null(fill).to_numpy()
        return out

    fingerprints = np.empty(len(slots), dtype=np.uint64)
    fingerprints[slots] = second
    return pa.table({
        "shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "levels": pa.array([index.dump()], pa.list_(pa.binary())),
        "fingerprints": pa.array([fingerprints.tobytes()], pa.binary()),
        "counts": pa.array([np.minimum(arranged("n", 0), 2**32 - 1).astype(np.uint32).tobytes()], pa.binary()),
        "keepers": pa.array([arranged("keeper", 0).tobytes()], pa.binary()),
        "unowned": pa.array([np.packbits(arranged("lost", 0).astype(bool)).tobytes()], pa.binary())})


def _probe(min_docs: int):
    def run(probes: pa.Table, arrays: pa.Table) -> pa.Table:
        columns = {c: np.empty(0, np.int64) for c in ("h1", "h2", "part", "keeper")}
        owned = np.empty(0, bool)
        if probes.num_rows and arrays.num_rows:
            row = {c: arrays.column(c)[0].as_py() for c in arrays.column_names}
            index = PerfectHash.load(row["levels"])
            first, second, part = (probes.column(c).to_numpy() for c in ("h1", "h2", "part"))
            slots = index.slots(first.view(np.uint64), second.view(np.uint64))
            at = np.maximum(slots, 0)
            hit = ((slots >= 0) & (np.frombuffer(row["fingerprints"], np.uint64)[at] == second.view(np.uint64))
                   & (np.frombuffer(row["counts"], np.uint32)[at] >= min_docs))
            keepers = np.frombuffer(row["keepers"], np.int64)
            lost = np.unpackbits(np.frombuffer(row["unowned"], np.uint8), count=len(keepers)).astype(bool)
            columns = {"h1": first[hit], "h2": second[hit], "part": part[hit], "keeper": keepers[at[hit]]}
            owned = ~lost[at[hit]]
        return pa.table({"h1": pa.array(columns["h1"], pa.int64()), "h2": pa.array(columns["h2"], pa.int64()),
                         "part": pa.array(columns["part"], pa.int32()),
                         "keeper": pa.array(columns["keeper"], pa.int64(), mask=~owned)})
    return run


def _rewrite(min_chars: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        keys = np.stack([answers.column("h1").to_numpy(), answers.column("h2").to_numpy()], axis=1).astype(np.int64)
        keepers = {keys[i].tobytes(): keeper for i, keeper in enumerate(answers.column("keeper").to_pylist())}
        texts, lines, dropped = [], [], []
        for doc_id, text in zip(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist()):
            drop = [k is not None and k in keepers and keepers[k] != doc_id for k in line_keys(text, min_chars)]
            lines.append(len(drop))
            dropped.append(sum(drop))
            texts.append("\n".join(x for x, gone in zip(text.split("\n"), drop) if not gone) if any(drop) else text)
        at = docs.column_names.index("text")
        out = docs.set_column(at, "text", pa.array(texts, pa.string())).drop_columns(["part"])
        return out.append_column("n_lines", pa.array(lines, pa.int64())).append_column("n_dropped", pa.array(dropped, pa.int64()))
    return run


def _counted(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """Lines with ``n``, how many documents a row adds to its key's count: 1, but for doc_ids of several rows, which add 1 once."""
    shared = settle(docs.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id"))
    several = lines.join(shared, "doc_id", "left_semi")
    parts = [(lines.join(shared, "doc_id", "left_anti"), 1), (several, 0),
             (several.groupBy("h1", "h2", "doc_id").agg(F.min("part").alias("part")), 1)]
    single, asked, counted = (rows.select("h1", "h2", "part", "doc_id", F.lit(n).cast("long").alias("n")) for rows, n in parts)
    return single.unionByName(asked).unionByName(counted)


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Documents without the lines that other documents hold as well.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of
    at least ``min_chars`` code points found in at least ``min_docs`` documents lose all their
    lines, except in the largest doc_id that holds them. Returns the columns of ``docs`` with
    the kept text, and ``n_lines`` (before dropping) and ``n_dropped``; columns of these two
    names or named ``part`` in ``docs`` are replaced. A null text is left null and counts as one
    empty line; rows that share a doc_id are one document, each row without doc_id is one of its
    own; a key held only by rows without doc_id stays in all of them. Line breaks other than \\n
    stay inside lines.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped", "part")
    parts = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.withColumn("part", _part(parts))
    lines = settle(dealt.select("doc_id", "text", "part").mapInArrow(_gather(min_chars), "h1 long, h2 long, part int, doc_id long"))
    probes = settle(_counted(lines, docs).groupBy("h1", "h2", "part").agg(F.sum("n").alias("n"), F.max("doc_id").alias("keeper")))
    shards = 1 + probes.count() // SHARD_PROBES
    shard = F.pmod("h1", F.lit(shards)).cast("int").alias("shard")
    index = (probes.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper"))
             .filter(F.col("n") >= min_docs).withColumn("lost", F.col("keeper").isNull().cast("long")).select("*", shard)
             .groupBy("shard").applyInArrow(_build, "shard int, levels array<binary>, fingerprints binary, counts binary, "
                                                    "keepers binary, unowned binary"))
    answers = (probes.select("h1", "h2", "part", shard).groupBy("shard").cogroup(settle(index).groupBy("shard"))
               .applyInArrow(_probe(min_docs), "h1 long, h2 long, part int, keeper long"))
    counts = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    return dealt.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(
        _rewrite(min_chars), T.StructType(docs.schema.fields + counts))
