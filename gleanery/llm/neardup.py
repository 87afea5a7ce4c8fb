"""Near duplicates by Order MinHash, verified by banded alignment.

A document is its sequence of five-word shingles. A sketch takes, for one hash function,
the few shingles (labelled with their occurrence number) of least hash and keeps them in
text order, so texts agree in a sketch when they share shingles in the same order. Texts
that meet in a sketch are aligned within the band that the wanted similarity leaves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from gleanery.llm.components import components
from gleanery.llm.words import batches_by_size, grams, mix, word_hashes
from gleanery.operators.storage import settle

WORDS = 5
SIMILARITY = 0.8
#: Sketches of a text, and shingles in each.
SKETCHES, KEPT = 24, 3
#: Sketches in which a pair must agree to be aligned after the first round. Pairs of similarity 0.8 agree in one with
#: probability 0.8**3, so in fewer than three of 24 in one case of 90,000.
AGREED = 3
#: Rows of a bucket, and bytes of their shingles, that one task compares with one another.
BLOCK, BLOCK_BYTES = 500, 8 << 20
_rng = np.random.default_rng(11)
_FLIP = _rng.integers(1, 1 << 63, SKETCHES, dtype=np.uint64)
_TIMES = _rng.integers(1, 1 << 62, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 1 << 62, KEPT, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def text_class(text: str = "text") -> Column:
    """128-bit name of an exact text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def labelled(shingles: np.ndarray) -> np.ndarray:
    """Shingle hashes with their occurrence number in the text mixed in."""
    if not len(shingles):
        return shingles
    order = np.argsort(shingles, kind="stable")
    ordered = shingles[order]
    first = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    start = np.maximum.accumulate(np.where(first, np.arange(len(ordered)), 0))
    out = np.empty_like(shingles)
    out[order] = ordered + (np.arange(len(ordered)) - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(out)


def order_sketches(shingles: np.ndarray) -> np.ndarray:
    """The Order MinHash sketches of a shingle sequence."""
    marked = labelled(shingles)
    kept = min(KEPT, len(marked))
    out = np.empty(SKETCHES, dtype=np.uint64)
    for i in range(SKETCHES):
        values = (marked ^ _FLIP[i]) * _TIMES[i]
        at = np.sort(np.argpartition(values, kept - 1)[:kept]) if len(values) > kept else np.arange(kept)
        out[i] = (marked[at] * _PLACE[:kept]).sum(dtype=np.uint64)
    return mix(out ^ _FLIP)


def common_in_order(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence whose steps stay within ``band`` of the diagonal.

    Exact when the best alignment stays in the band, otherwise a lower bound. The row of the
    table is one integer with a bit per element of b; a block of rows touches only its window.
    """
    n, m = len(a), len(b)
    lead = 0
    same = np.flatnonzero(a[:min(n, m)] != b[:min(n, m)])
    lead = int(same[0]) if len(same) else min(n, m)
    a, b = a[lead:], b[lead:]
    n, m = len(a), len(b)
    tail = np.flatnonzero(a[::-1][:min(n, m)] != b[::-1][:min(n, m)])
    trail = int(tail[0]) if len(tail) else min(n, m)
    a, b = a[:n - trail], b[:m - trail]
    n, m = len(a), len(b)
    if not n or not m:
        return lead + trail
    places: dict[int, int] = {}
    for j, x in enumerate(b.tolist()):
        places[x] = places.get(x, 0) | (1 << j)
    row, step = (1 << m) - 1, max(64, 2 * band)
    values = a.tolist()
    for at in range(0, n, step):
        low, high = max(0, at - band), min(m, at + step + band)
        if low >= m:
            break
        mask = (1 << (high - low)) - 1
        window = (row >> low) & mask
        for x in values[at:at + step]:
            match = (places.get(x, 0) >> low) & mask
            if match:
                both = window & match
                window = ((window + both) | (window - both)) & mask
        row = (row & ~(mask << low)) | (window << low)
    return lead + trail + m - row.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Shingles that two sequences share in order, out of all of both; 0 where it is under ``least``."""
    n, m = len(a), len(b)
    if not n or not m:
        return 1.0 if n == m else 0.0
    if min(n, m) < least * max(n, m):
        return 0.0
    # common >= least * (n + m - common) leaves room for this many unmatched shingles
    room = int((n + m) * (1 - 2 * least / (1 + least))) + 1
    common = common_in_order(a, b, room)
    found = common / (n + m - common)
    return found if found >= least - 1e-12 else 0.0


def _sketch(batches):
    for batch in batches:
        for rows in batches_by_size(batch, "text", 4 << 20):
            texts, keep, sizes, out = rows.column("text").to_pylist(), [], [], []
            for i, words in enumerate(word_hashes(texts)):
                if len(words):
                    keep.append(i)
                    sizes.append(max(1, len(words) - WORDS + 1))
                    out.append(order_sketches(grams(words, WORDS)).view(np.int64))
            flat = pa.array(np.concatenate(out) if out else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [rows.column("class").take(pa.array(keep, pa.int64())), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(
                    pa.array(np.arange(len(keep) + 1) * SKETCHES, pa.int32()), flat)], names=["class", "size", "sketches"])


def _sequences(batches):
    for batch in batches:
        for rows in batches_by_size(batch, "text", 4 << 20):
            found = [(grams(w, WORDS) >> np.uint64(32)).astype(np.uint32).tobytes() for w in word_hashes(rows.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([rows.column("class"), pa.array(found, pa.binary())], names=["class", "shingles"])


def _aligned(least: float):
    def run(batches):
        for batch in batches:
            for rows in batches_by_size(batch, "left", 16 << 20):
                found = [similarity(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), least)
                         for x, y in zip(rows.column("left").to_pylist(), rows.column("right").to_pylist())]
                out = pa.RecordBatch.from_arrays([rows.column("a"), rows.column("b"), pa.array(found, pa.float64())],
                                                 names=["a", "b", "similarity"])
                yield out.filter(pc.greater(out.column("similarity"), 0.0))
    return run


def _align(pairs: DataFrame, shingles: DataFrame, least: float) -> DataFrame:
    """Verified links (a, b, similarity) of candidate pairs."""
    left = shingles.select(F.col("class").alias("a"), F.col("shingles").alias("left"))
    right = shingles.select(F.col("class").alias("b"), F.col("shingles").alias("right"))
    return settle(pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
                  .mapInArrow(_aligned(least), "a binary, b binary, similarity double"))


def _cell_links(least: float):
    """Links (a, b) inside one cell of a bucket, between the components of near texts.

    A pair is looked at in the first bucket that both share only, in one cell only, and only until
    their components hang together. The shingles that both hold, in any order, bound what they
    share in order, so few pairs are aligned."""
    def run(table: pa.Table) -> pa.Table:
        place, one, two = (table.column(c)[0].as_py() for c in ("place", "one", "two"))
        sketches = pc.list_flatten(table.column("sketches").combine_chunks()).to_numpy().reshape(-1, SKETCHES)
        block, roots = table.column("block").to_numpy(), {}
        root = np.array([roots.setdefault(x, len(roots)) for x in table.column("root").to_pylist()])
        names = list(roots)
        joined = list(range(len(names)))
        sequences = [np.frombuffer(x, np.uint32) for x in table.column("shingles").to_pylist()]

        def top(i: int) -> int:
            while joined[i] != i:
                joined[i] = joined[joined[i]]
                i = joined[i]
            return i

        left, right = np.flatnonzero(block == one), np.flatnonzero(block == two)
        agreed = np.zeros((len(left), len(right)), dtype=np.int8)
        earlier = np.zeros((len(left), len(right)), dtype=bool)
        for i in range(SKETCHES):
            equal = sketches[left, i][:, None] == sketches[right, i][None, :]
            agreed += equal
            if i < place:
                earlier |= equal
        wanted = (agreed >= AGREED) & ~earlier & (root[left][:, None] != root[right][None, :])
        if one == two:
            wanted &= left[:, None] < right[None, :]
        sizes = np.array([len(x) for x in sequences])
        marked = [labelled(x.astype(np.uint64)) for x in sequences]
        pool = np.concatenate([marked[j] for j in right]) if len(right) else np.empty(0, np.uint64)
        values, place_of = np.unique(pool, return_inverse=True)
        owner = np.repeat(np.arange(len(right)), sizes[right])
        found: list[tuple[bytes, bytes]] = []
        for x in np.flatnonzero(wanted.any(axis=1)):
            held = np.zeros(len(values) + 1, dtype=bool)
            at = np.searchsorted(values, marked[left[x]])
            held[at[values[np.minimum(at, len(values) - 1)] == marked[left[x]]]] = True
            common = np.bincount(owner[held[place_of]], minlength=len(right))
            may = wanted[x] & (common >= least * (sizes[left[x]] + sizes[right] - common) - 1e-9)
            for y in np.flatnonzero(may):
                one_top, two_top = top(root[left[x]]), top(root[right[y]])
                if one_top != two_top and similarity(sequences[left[x]], sequences[right[y]], least):
                    joined[two_top] = one_top
                    found.append((names[root[left[x]]], names[root[right[y]]]))
        columns = list(zip(*found)) if found else [[]] * 2
        return pa.table({"a": pa.array(columns[0], pa.binary()), "b": pa.array(columns[1], pa.binary())})
    return run


def near_roots(docs: DataFrame, least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Two tables (node, root) that lead from a text to its group: first by its name, then by the root found.

    First each text is aligned with one leader of each of its buckets, another one in each, so that
    large groups of copies join with work in proportion to their size. Then the buckets whose texts
    are still in different components are cut into cells of bounded size. A cell looks at its pairs of
    different components that agree in enough sketches, and links components with near texts.
    """
    texts = docs.select(text_class().alias("class"), "text")
    sketched = settle(texts.mapInArrow(_sketch, "class binary, size long, sketches array<long>")
                      .groupBy("class").agg(F.first("size").alias("size"), F.first("sketches").alias("sketches")))
    rows = (sketched.select("class", "size", F.posexplode("sketches").alias("place", "value"))
            .select(F.xxhash64("place", "value").alias("key"), "place", "class", "size"))
    # A leader is the member of least hash, and the hash depends on the bucket.
    leader = F.min(F.struct(F.xxhash64("class", "key").alias("hash"), F.col("class").alias("lead")))
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, 4 * F.sum("size") / BLOCK_BYTES)).cast("int")
    shared = settle(rows.groupBy("key").agg(F.count("*").alias("n"), blocks.alias("blocks"), leader.alias("least")).filter("n > 1")
                    .select("key", "blocks", "least.lead"))
    met = settle(rows.join(shared, "key").select("key", "place", "blocks", "class", "lead"))
    wanted = settle(met.select("class").distinct())
    # Merged by sort at every size, since the texts have to meet their names somewhere.
    shingles = settle(texts.join(wanted.hint("merge"), "class", "left_semi").mapInArrow(_sequences, "class binary, shingles binary")
                      .groupBy("class").agg(F.first("shingles").alias("shingles")))
    pairs = met.filter("class <> lead").select(F.least("class", "lead").alias("a"), F.greatest("class", "lead").alias("b")).distinct()
    first = _align(pairs, shingles, least)
    roots = components(first)
    members = settle(met.join(roots, F.col("class") == F.col("node"), "left")
                     .select("key", "place", "blocks", "class", F.coalesce("root", "class").alias("root")))
    mixed = settle(members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key"))
    cells = (members.join(mixed, "key").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
             .join(sketched.select("class", "sketches"), "class").join(shingles, "class")
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other"))
             .select("key", "place", "one", "two", "block", "class", "root", "sketches", "shingles"))
    rest = cells.groupBy("key", "place", "one", "two").applyInArrow(_cell_links(least), "a binary, b binary")
    # Written once: a cell may link its components in another order when it runs again.
    return roots, components(settle(rest))


def near_groups(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, ``class`` of its exact text, ``class_id`` (least doc_id of the class)
    and ``group_id`` (least doc_id of all texts that hang together by similarity of ``least`` or more), with the
    group's ``root`` class and ``group_size``.

    Texts without words are near only their exact copies. Null texts count as empty. Rows
    without doc_id belong to classes and groups, whose ids are null only where no row has one.
    """
    first, second = near_roots(docs, least)
    named = docs.select("doc_id", text_class().alias("class"))
    classes = named.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    rooted = settle(classes.join(first, F.col("class") == F.col("node"), "left")
                    .select("class", "class_id", "class_size", F.coalesce("root", "class").alias("root")))
    later = second.withColumnsRenamed({"node": "later_node", "root": "later_root"})
    rooted = settle(rooted.join(later, F.col("root") == F.col("later_node"), "left")
                    .select("class", "class_id", "class_size", F.coalesce("later_root", "root").alias("root")))
    groups = settle(rooted.groupBy("root").agg(F.min("class_id").alias("group_id"), F.sum("class_size").alias("group_size")))
    known = settle(rooted.join(groups, "root").select("class", "class_id", "root", "group_id", "group_size"))
    return named.join(known, "class")


def keep_one(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One document of each group, with all columns of ``docs``: the row of least doc_id (nulls last), one
    of them where rows repeat."""
    groups = near_groups(docs, least)
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "class")).alias("kept"))
    rows = groups.groupBy("doc_id", "class").agg(F.count("*").alias("n"))
    kept = settle(first.select(F.col("kept.doc_id").alias("kept_id"), F.col("kept.class").alias("kept_class"))
                  .join(rows, F.col("kept_id").eqNullSafe(F.col("doc_id")) & (F.col("kept_class") == F.col("class")))
                  .select("kept_id", "kept_class", "n"))
    named = docs.withColumn("text_class", text_class())

    def chosen(keys: DataFrame) -> DataFrame:
        return named.join(keys, named["doc_id"].eqNullSafe(keys["kept_id"]) & (named["text_class"] == keys["kept_class"]), "left_semi")

    repeated = chosen(kept.filter("n > 1")).dropDuplicates(["doc_id", "text_class"])
    return chosen(kept.filter("n = 1")).union(repeated).drop("text_class")
