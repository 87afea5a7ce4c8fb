"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

The words of a source, its documents put in hash order, are cut into blocks of equal size. A target
share becomes an exact number of blocks of each source. A tree splits these quotas among
output shards: at every node the left half draws its blocks without replacement, source
by source, so each shard gets exactly its number of blocks, in random proportions that
add up to the quotas. Shards then take disjoint runs of each source's blocks in a random
permutation: the words of these blocks are cut out of the texts, sent to their shard and
put there in hash order of the blocks. All of it is DataFrame expressions; random values
are hashes, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from gleanery.operators.storage import settle

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block where a source is large, and the least number of blocks where it is small.
BLOCK_WORDS = 4096
LEAST_BLOCKS = 256
SHARDS = 16
ROUNDS = 16


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _whole(x: Column, y: Column) -> Column:
    """Whole-number division of non-negative longs."""
    return F.call_function("div", x, y)


def hypergeometric(population: Column, marked: Column, drawn: Column, uniform: Column) -> Column:
    """How many of ``drawn`` items without replacement are among the ``marked`` of a population.

    Inverts the distribution by sums outward from its mode; both arms reach past twelve
    standard deviations, beyond what a double can tell from zero.
    """
    real = lambda x: x.cast("double")

    def up(x: Column) -> Column:
        return real(marked - x) * real(drawn - x) / (real(x + 1) * real(population - marked - drawn + x + 1))

    def down(x: Column) -> Column:
        return real(x) * real(population - marked - drawn + x) / (real(marked - x + 1) * real(drawn - x + 1))

    least = F.greatest(F.lit(0).cast("long"), drawn - (population - marked))
    most = F.least(drawn, marked)
    mode = F.least(most, F.greatest(least, F.floor(real(drawn + 1) * real(marked + 1) / real(population + 2))))
    share = real(marked) / real(population)
    reach = 20 + F.ceil(12 * F.sqrt(F.greatest(F.lit(0.0), real(drawn) * share * (1 - share))))

    def arms(v: Column) -> Column:
        right, left = F.least(v["most"], v["mode"] + v["reach"]), F.greatest(v["least"], v["mode"] - v["reach"])
        steps = ((F.sequence(v["mode"], right), up), (F.sequence(v["mode"], left, F.lit(-1).cast("long")), down))

        def total(xs: Column, ratio: Callable) -> Column:
            start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
            return F.aggregate(xs, start, lambda a, x: F.struct((a["w"] * ratio(x)).alias("w"), (a["sum"] + a["w"]).alias("sum")),
                               lambda a: a["sum"])

        def pick(xs: Column, ratio: Callable, begin: Column, goal: Column) -> Column:
            start = F.struct(F.lit(1.0).alias("w"), begin.alias("sum"), F.lit(None).cast("long").alias("at"))
            return F.aggregate(xs, start, lambda a, x: F.struct(
                (a["w"] * ratio(x)).alias("w"), (a["sum"] + a["w"]).alias("sum"),
                F.coalesce(a["at"], F.when(a["sum"] + a["w"] > goal, x)).alias("at")), lambda a: a["at"])

        def choose(s: Column) -> Column:
            goal = uniform * (s["right"] + s["left"] - 1)
            return F.coalesce(pick(*steps[0], F.lit(0.0), goal), pick(*steps[1], s["right"] - 1, goal), v["mode"])

        return _let(F.struct(total(*steps[0]).alias("right"), total(*steps[1]).alias("left")), choose)

    given = F.struct(least.alias("least"), most.alias("most"), mode.cast("long").alias("mode"), reach.cast("long").alias("reach"))
    return F.when(least >= most, least).otherwise(_let(given, arms))


def _uniform(*parts) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)).cast("double") / float(1 << 53)


def split_quotas(quotas: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """(source_no, starts): for each source the number of its draws before each shard.

    ``quotas`` has (source_no, drawn), a row per source. Shards get equal numbers of blocks,
    within one. The sources stand in one array of each tree node, so their number, not
    their size, is bounded by a row.
    """
    bound = lambda j, total: j * _whole(total, F.lit(shards)) + F.least(j, total % shards)
    nodes = (quotas.agg(F.array_sort(F.collect_list(F.struct("source_no", "drawn"))).alias("q"))
             .select(F.lit(0).cast("long").alias("leaf"), F.lit(shards).cast("long").alias("n"), F.col("q.source_no").alias("sources"),
                     F.col("q.drawn").alias("drawn"), F.aggregate("q.drawn", F.lit(0).cast("long"), lambda a, x: a + x).alias("total")))
    for _ in range((shards - 1).bit_length()):
        half = _whole(F.col("n"), F.lit(2))
        begin = F.struct(F.aggregate("drawn", F.lit(0).cast("long"), lambda a, x: a + x).alias("left"),
                         (bound(F.col("leaf") + half, F.col("total")) - bound(F.col("leaf"), F.col("total"))).alias("want"),
                         F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("taken"))

        def draw(a: Column, k: Column) -> Column:
            taken = hypergeometric(a["left"], k, a["want"], _uniform(F.lit(seed), F.lit(shards), F.col("leaf"), F.col("n"), a["at"]))
            return _let(taken.cast("long"), lambda x: F.struct(
                (a["left"] - k).alias("left"), (a["want"] - x).alias("want"), (a["at"] + 1).alias("at"),
                F.concat(a["taken"], F.array(x)).alias("taken")))

        cut = nodes.withColumn("half", half).withColumn("taken", F.when(F.col("half") > 0, F.aggregate("drawn", begin, draw, lambda a: a["taken"])))
        left = F.struct("leaf", F.col("half").alias("n"), F.col("taken").alias("drawn"))
        right = F.struct((F.col("leaf") + F.col("half")).alias("leaf"), (F.col("n") - F.col("half")).alias("n"),
                         F.zip_with("drawn", "taken", lambda x, y: x - y).alias("drawn"))
        same = F.struct("leaf", "n", "drawn")
        nodes = (cut.withColumn("child", F.explode(F.when(F.col("half") > 0, F.array(left, right)).otherwise(F.array(same))))
                 .select("child.leaf", "child.n", "sources", "child.drawn", "total"))
    leaves = nodes.select("leaf", F.explode(F.arrays_zip("sources", "drawn")).alias("z")).select(
        "leaf", F.col("z.sources").alias("source_no"), F.col("z.drawn").alias("drawn"))
    ordered = leaves.groupBy("source_no").agg(F.array_sort(F.collect_list(F.struct("leaf", "drawn"))).alias("leaves"))
    sums = F.aggregate("leaves", F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("out")),
                       lambda a, x: F.struct((a["sum"] + x["drawn"]).alias("sum"), F.concat(a["out"], F.array(a["sum"])).alias("out")),
                       lambda a: a["out"])
    return ordered.select("source_no", sums.alias("starts"))


def source_targets(sized: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Per source: number in code-point order (null last), size, rows, weight and target.

    Targets share ``share`` times all sizes by weight; none is above ``most`` times its source's
    size, and what a source cannot take is shared again. ``weights`` repeat over the sources.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    numbered = (totals.withColumn("source_no", F.row_number().over(order) - 1)
                .withColumn("weight", F.get(pattern, F.col("source_no") % len(weights)))
                .withColumn("bound", most * F.col("source_size")))
    # The level at which weights fill the total: sources of low bound per weight are full first.
    by_level = Window.orderBy(F.col("bound") / F.col("weight"), "source_no")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    level = ((share * F.sum("source_size").over(everything) - F.coalesce(F.sum("bound").over(before), F.lit(0.0)))
             / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    holds = F.when(F.col("level") <= F.col("bound") / F.col("weight"), F.col("turn"))
    levelled = (numbered.withColumn("level", level).withColumn("turn", F.row_number().over(by_level))
                .withColumn("level", F.min_by("level", holds).over(everything)))
    target = F.least(F.col("bound"), F.coalesce(F.col("weight") * F.col("level"), F.col("bound")))
    return levelled.select("source", "source_no", "source_size", "rows", target.alias("target"))


def _block_bound(block: Column) -> Column:
    size, n = F.col("source_size"), F.col("blocks")
    return block * _whole(size, n) + F.least(block, size % n)


def _block_of(word: Column) -> Column:
    size, n = F.col("source_size"), F.col("blocks")
    wide = _whole(size, n) + 1
    edge = (size % n) * wide
    return F.when(word < edge, _whole(word, wide)).otherwise(size % n + _whole(word - edge, wide - 1))


def _rank(block: Column, turn: Column, seed: int) -> Column:
    """Place of a block in its source's permutation: swap-or-not rounds, each of them its own inverse."""
    def swap(x: Column, i: Column) -> Column:
        other = F.pmod(F.xxhash64(F.lit(seed), F.col("source_no"), turn, i) - x, F.col("blocks"))
        return _let(other, lambda y: F.when(F.pmod(
            F.xxhash64(F.lit(seed + 1), F.col("source_no"), turn, i, F.greatest(x, y)), F.lit(2)) == 1, y).otherwise(x))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), block, swap)


def _row_hash(doc_id: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), doc_id, F.coalesce("text", F.lit("")))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, shards: int = SHARDS,
        block_words: int = BLOCK_WORDS, least_blocks: int = LEAST_BLOCKS, seed: int = 0) -> DataFrame:
    """The plan, one row per document: doc_id, source, size (words), source_size, target (its source's),
    ``pieces``: what the mix takes of it, each (shard, place, turn, block, word_from, word_to), and what
    ``shard_texts`` finds the text by: ``row_hash`` (of doc_id and text), source_no and ``at``, the words before it
    in its source.

    A word is a run of characters other than ASCII white space; null texts have none. Pieces of a
    shard are read by ``place``. Each source gives a whole number of blocks, so its words come
    within a block or so of its target. A source is drawn at most ``most`` times over. Repeated
    rows are documents of their own; documents without words have no pieces.
    """
    text = F.coalesce("text", F.lit(""))
    sized = settle(docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
                               _row_hash("doc_id", seed).alias("hash")))
    targets = settle(source_targets(sized, weights, share, float(most)))
    blocks = F.least(F.col("source_size"), F.greatest(F.lit(least_blocks).cast("long"), F.ceil(F.col("source_size") / block_words)))
    wanted = F.round(F.try_divide(F.col("target") * F.col("blocks"), F.col("source_size"))).cast("long")
    quotas = (targets.withColumn("blocks", blocks)
              .withColumn("drawn", F.coalesce(F.least(most * F.col("blocks"), wanted), F.lit(0).cast("long"))))
    plan = settle(quotas.join(split_quotas(quotas.select("source_no", "drawn"), shards, seed), "source_no"))
    # A source is cut into about as many slices as a slice has rows, so neither sum meets a whole source.
    sliced = (sized.join(plan.withColumnRenamed("source", "planned"), F.col("source").eqNullSafe(F.col("planned")))
              .withColumn("slice", F.pmod("hash", F.ceil(F.sqrt("rows")))).drop("planned"))
    inside = Window.partitionBy("source_no", "slice").orderBy("hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("source_no").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = (sliced.groupBy("source_no", "slice").agg(F.sum("size").alias("words"))
             .select("source_no", "slice", F.coalesce(F.sum("words").over(across), F.lit(0).cast("long")).alias("base")))
    placed = (sliced.withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0).cast("long")))
              .join(settle(bases), ["source_no", "slice"]).withColumn("at", F.col("at") + F.col("base")))

    def drawn(block: Column, turn: int) -> Column:
        return turn * F.col("blocks") + _rank(block, F.lit(turn), seed)

    def piece(block: Column, turn: int) -> Column:
        def placed_at(number: Column) -> Column:
            shard = (F.size(F.filter("starts", lambda s: s <= number)) - 1).cast("int")
            start = F.greatest(F.col("at"), _block_bound(block)) - F.col("at")
            end = F.least(F.col("at") + F.col("size"), _block_bound(block + 1)) - F.col("at")
            return F.when(number < F.col("drawn"), F.struct(
                shard.alias("shard"), F.xxhash64(F.lit(seed + 2), "source_no", F.lit(turn), block).alias("place"),
                F.lit(turn).alias("turn"), block.alias("block"), start.alias("word_from"), end.alias("word_to")))
        return _let(drawn(block, turn), placed_at)

    touched = F.sequence(_block_of(F.col("at")), _block_of(F.col("at") + F.col("size") - 1))
    found = F.flatten(F.transform(touched, lambda b: F.array(*[piece(b, t) for t in range(most)])))
    pieces = F.when(F.col("size") > 0, F.filter(found, lambda p: p.isNotNull()))
    return placed.select("doc_id", "source", "size", "source_size", "target", pieces.alias("pieces"),
                         F.col("hash").alias("row_hash"), "source_no", "at")


def shard_texts(docs: DataFrame, mixed: DataFrame, seed: int = 0) -> DataFrame:
    """The mix itself, one row per piece of a document: shard, place, turn, block, doc_id, source, size (the document's
    words), source_size, target, word_from, ``taken`` (words of the piece) and ``text``, its words joined by blanks; also
    source_no and at, which tell one document row from all others.

    ``docs`` and ``seed`` are those of the plan ``mixed``. Texts are cut in one pass per document and dealt by shard and
    range of places, so that a shard may fill many tasks; the rows of a partition stand by shard, place and document.
    Repeated rows, and rows that share a doc_id, each give the words that the plan takes of them.
    """
    texts = docs.select(F.col("doc_id").alias("text_id"), _row_hash("doc_id", seed).alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
    # A row of the plan has to meet its text once: the texts of repeated rows are told apart by nothing, so one stands for all.
    repeated = settle(mixed.groupBy(F.col("row_hash").alias("text_hash")).count().filter("count > 1").select("text_hash"))
    single = texts.join(repeated, "text_hash", "left_anti").select(texts.columns)
    several = texts.join(repeated, "text_hash", "left_semi").select(texts.columns).dropDuplicates(["text_hash", "text_id"])
    met = (mixed.filter(F.size("pieces") > 0)
           .join(single.unionByName(several), (F.col("row_hash") == F.col("text_hash")) & F.col("doc_id").eqNullSafe(F.col("text_id"))))

    def cut(words: Column) -> Column:
        part = lambda p: F.slice(words, (p["word_from"] + 1).cast("int"), (p["word_to"] - p["word_from"]).cast("int"))
        return F.transform("pieces", lambda p: F.struct(
            p["shard"].alias("shard"), p["place"].alias("place"), p["turn"].alias("turn"), p["block"].alias("block"),
            p["word_from"].alias("word_from"), F.array_join(part(p), " ").alias("text")))

    drawn = met.select("doc_id", "source", "size", "source_size", "target", "source_no", "at",
                       F.explode(_let(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), cut)).alias("p"))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stretch = F.floor((F.col("p.place").cast("double") / float(1 << 64) + 0.5) * tasks)
    return (drawn.repartition(tasks, "p.shard", stretch)
            .select("p.shard", "p.place", "p.turn", "p.block", "doc_id", "source", "size", "source_size", "target", "p.word_from",
                    F.regexp_count("p.text", F.lit(WORD)).cast("long").alias("taken"), "p.text", "source_no", "at")
            .sortWithinPartitions("shard", "place", "at"))


def taken_words(mixed: DataFrame, pieces: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, ``taken`` (words of its ``pieces`` as drawn by ``shard_texts``, repeats counted) and
    the number of ``shards`` they went to, for every document of the plan."""
    counts = (pieces.groupBy(F.col("source_no").alias("from_no"), F.col("at").alias("from_at"))
              .agg(F.sum("taken").alias("taken"), F.size(F.collect_set("shard")).alias("shards")))
    same = (F.col("source_no") == F.col("from_no")) & (F.col("at") == F.col("from_at")) & (F.col("size") > 0)
    return mixed.join(counts, same, "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"),
        F.coalesce("shards", F.lit(0)).alias("shards"))
