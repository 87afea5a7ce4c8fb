"""Keyword and vector retrieval for whole tables of queries.

Chunk rows carry chunk_id, file_id, chunk_index and chunk_text. Query rows carry
query_id and query. Nothing here depends on the number of queries being small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.functions import text as tx
from gleanery.operators.containment import containment
from gleanery.operators.ranking import top_n
from gleanery.operators.storage import settle
from gleanery.operators.vectors import LISTED, similar_vectors, text_vectors

RRF_K = 60
VECTOR_MIN_SCORE = 0.12
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
LEAST_PHRASE = 3


def cosine(left: Column, right: Column) -> Column:
    """Cosine of two dense arrays of equal length; 0 for a zero vector."""
    def dot(a: Column, b: Column) -> Column:
        products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)

    norm = F.sqrt(dot(left, left)) * F.sqrt(dot(right, right))
    value = F.when(norm == 0, F.lit(0.0)).otherwise(dot(left, right) / norm)
    same = (F.size(left) == F.size(right)) & (F.size(left) > 0)
    return F.when(same, value).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("double"))


ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def like_search(chunks: DataFrame, phrase: str) -> DataFrame:
    """Substring search that folds ASCII case only; marks of LIKE have no meaning."""
    needle = phrase.translate(str.maketrans(ASCII_UPPER, ASCII_LOWER))
    return chunks.filter(F.translate("chunk_text", ASCII_UPPER, ASCII_LOWER).contains(needle)).orderBy("chunk_index")


def phrase_hits(chunks: DataFrame, queries: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """(query_id, chunk_id, carry..., tf): chunks that hold the whole query text, ignoring case; under three characters none."""
    texts = chunks.select(F.col("chunk_id").alias("text_id"), F.lower("chunk_text").alias("body"), *carry)
    phrases = queries.filter(F.length("query") >= LEAST_PHRASE).select(F.col("query_id").alias("phrase_id"), F.lower("query").alias("phrase"))
    return containment(texts, phrases, carry=carry).select(
        F.col("phrase_id").alias("query_id"), F.col("text_id").alias("chunk_id"), *carry, F.col("n").alias("tf"))


def in_scope(scored: DataFrame, chunks: DataFrame, scope: DataFrame) -> DataFrame:
    """The rows that a scope allows, before any ranking.

    A scope has query_id and any of file_id, page_no and chunk_id; ``chunks`` carries the
    columns that the rows lack.
    """
    keys = [c for c in ("query_id", "file_id", "page_no", "chunk_id") if c in scope.columns]
    lacking = [c for c in keys if c not in scored.columns]
    rows = scored.join(chunks.select("chunk_id", *lacking), "chunk_id") if lacking else scored
    return rows.join(scope.select(*keys), keys, "left_semi").select(*scored.columns)


def keyword_retrieve(chunks: DataFrame, queries: DataFrame, limit: Column | int, scope: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, file_id, chunk_index, rank, keyword_position), best first.

    BM25 over one phrase; document statistics come from all chunks, the scope (see
    ``in_scope``) only cuts the list. A lower rank is better.
    """
    size = F.greatest(F.length("chunk_text") - 2, F.lit(0))
    # few rows, read twice below
    hits = settle(phrase_hits(chunks.withColumn("d", size), queries, ("file_id", "chunk_index", "d")))
    stats = chunks.agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg(size).alias("mean")).alias("s")).scalar()
    df = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("df"))
    rows = hits.join(df, "query_id").withColumn("s", stats)
    idf = F.log((F.col("s.n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf <= 0, IDF_FLOOR).otherwise(idf)
    tf = F.col("tf")
    rank = -idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("d") / F.col("s.mean")))
    scored = rows.select("query_id", "chunk_id", "file_id", "chunk_index", rank.alias("rank"))
    if scope is not None:
        scored = in_scope(scored, chunks, scope)
    return top_n(scored, ["query_id"], [F.col("rank"), F.col("chunk_index"), F.col("file_id")], limit, "keyword_position")


def chunk_vectors(chunks: DataFrame) -> DataFrame:
    """Sparse vectors of chunks, to be stored once and searched many times."""
    return text_vectors(chunks, "chunk_text", ("chunk_id", "file_id", "chunk_index"))


def _searched(vectors: DataFrame, queries: DataFrame, best: int | None) -> DataFrame:
    found = similar_vectors(vectors, text_vectors(queries, "query", ("query_id",)), "query_id", VECTOR_MIN_SCORE, best)
    return found.withColumnRenamed("score", "vector_score")


def vector_scores(chunks: DataFrame, queries: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """Cosine of hash vectors for chunk and query pairs at or above the least score."""
    return _searched(chunk_vectors(chunks) if vectors is None else vectors, queries, None).select("query_id", "chunk_id", "vector_score")


def named_in_scope(chunks: DataFrame, queries: DataFrame, scope: DataFrame) -> DataFrame:
    """Chunks with the ``queries`` whose scope allows them; with very many queries a chunk has a row for each share of them."""
    keys = [c for c in ("file_id", "page_no", "chunk_id") if c in scope.columns]
    shares = max(1, -(-queries.count() // LISTED))
    same = scope.select(F.col("query_id").cast(queries.schema["query_id"].dataType), *keys)
    share = F.pmod(F.xxhash64("query_id"), F.lit(shares))
    named = same.join(queries.select("query_id"), "query_id", "left_semi").groupBy(*keys, share.alias("__share")).agg(F.collect_set("query_id").alias("queries"))
    return chunks.join(named, keys).drop("__share") if keys else chunks.join(named.drop("__share"))


def vector_retrieve(chunks: DataFrame, queries: DataFrame, limit: int, scope: DataFrame | None = None,
                    vectors: DataFrame | None = None) -> DataFrame:
    """The best chunks of each query; a scope names the pairs before they are scored, and only pairs that can still be among the best are."""
    if scope is not None:
        if vectors is None:
            vectors = text_vectors(named_in_scope(chunks, queries, scope), "chunk_text", ("chunk_id", "file_id", "chunk_index", "queries"))
        else:
            paged = vectors.join(chunks.select("chunk_id", "page_no"), "chunk_id") if "page_no" in scope.columns else vectors
            vectors = named_in_scope(paged, queries, scope).select(*vectors.columns, "queries")
    scored = _searched(chunk_vectors(chunks) if vectors is None else vectors, queries, limit)
    return top_n(scored, ["query_id"], [F.col("vector_score").desc(), F.col("file_id"), F.col("chunk_index")], limit, "vector_position").select(
        "query_id", "chunk_id", "file_id", "chunk_index", "vector_score", "vector_position")


def fuse(keyword: DataFrame, vector: DataFrame) -> DataFrame:
    """Reciprocal rank fusion; both lists meet in one grouping instead of an outer join."""
    none = F.lit(None)
    k = keyword.select("query_id", "chunk_id", "file_id", "chunk_index", "keyword_position",
                       none.cast("int").alias("vector_position"), none.cast("double").alias("vector_score"))
    v = vector.select("query_id", "chunk_id", "file_id", "chunk_index", none.cast("int").alias("keyword_position"),
                      "vector_position", "vector_score")
    both = k.unionByName(v).groupBy("query_id", "chunk_id").agg(
        F.min("file_id").alias("file_id"), F.min("chunk_index").alias("chunk_index"),
        F.max("keyword_position").alias("kp"), F.max("vector_position").alias("vp"), F.max("vector_score").alias("vs"))

    def part(position: str) -> Column:
        return F.coalesce(1.0 / (RRF_K + F.col(position)), F.lit(0.0))

    return both.select(
        "query_id", "chunk_id", "file_id", "chunk_index",
        F.round(part("kp") + part("vp"), 8).alias("combined_score"),
        F.round(F.coalesce(1.0 / F.col("kp"), F.lit(0.0)), 8).alias("keyword_score"),
        F.coalesce("vs", F.lit(0.0)).alias("vector_score"),
        F.concat_ws(",", F.when(F.col("kp").isNotNull(), "keyword"), F.when(F.col("vp").isNotNull(), "vector")).alias("sources"))


def candidate_limit(limit: int) -> int:
    """Candidates that a search for ``limit`` rows ranks."""
    return max(20, limit * 4)


def hybrid_order(fused: DataFrame, n: int) -> DataFrame:
    return top_n(fused, ["query_id"], [F.col("combined_score").desc(), F.col("vector_score").desc(),
                                       F.col("file_id"), F.col("chunk_index")], n, "fused_position")


def scored(candidates: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Candidates with the default ``score``."""
    best = F.max("combined_score").over(W.partitionBy("query_id"))
    rows = (candidates.withColumn("best", best).join(chunks.select("chunk_id", "chunk_text"), "chunk_id")
            .join(queries.select("query_id", "query"), "query_id"))
    overlap = tx.term_overlap(tx.term_set(F.col("query")), tx.term_set(F.col("chunk_text")))
    score = (0.6 * F.col("combined_score") / F.when(F.col("best") == 0, 1.0).otherwise(F.col("best"))
             + 0.25 * F.greatest(F.lit(0.0), "vector_score") + 0.15 * overlap)
    return rows.select(*candidates.columns, F.round(F.least(F.lit(1.0), score), 8).alias("score"))


def rerank(candidates: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Default ranking of fused candidates: (query_id, chunk_id, score)."""
    return scored(candidates, chunks, queries).select("query_id", "chunk_id", "score")


def checked_ranking(candidates: DataFrame, ranking: DataFrame) -> DataFrame:
    """Per query, whether a ranking names the same ids once each with finite scores."""
    want = candidates.select("query_id", "chunk_id", F.lit(1).alias("c"))
    got = ranking.groupBy("query_id", "chunk_id").agg(
        F.count(F.lit(1)).alias("times"),
        F.bool_and(F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") != float("inf"))).alias("finite"))
    pair = want.join(got, ["query_id", "chunk_id"], "full")
    fine = F.col("c").isNotNull() & (F.col("times") == 1) & F.col("finite")
    return pair.groupBy("query_id").agg(F.bool_and(F.coalesce(fine, F.lit(False))).alias("valid"))


def apply_ranking(candidates: DataFrame, ranking: DataFrame, limit: int) -> DataFrame:
    """Top rows by a ranking, or by the fused order where the ranking is not valid."""
    valid = checked_ranking(candidates, ranking)
    one = ranking.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    rows = candidates.join(valid, "query_id", "left").join(one, ["query_id", "chunk_id"], "left").withColumn(
        "retrieval_score", F.when(F.col("valid"), F.round("score", 8)).otherwise(F.col("combined_score")))
    order = [F.when(F.col("valid"), F.col("retrieval_score")).desc(), F.when(F.col("valid"), F.col("chunk_id")),
             F.col("fused_position")]
    return top_n(rows, ["query_id"], order, limit, "final_position").select(
        "query_id", "chunk_id", "file_id", "chunk_index", "keyword_score", "vector_score", "combined_score",
        "retrieval_score", F.when(F.col("valid"), "hybrid").otherwise("rerank_fallback").alias("mode"), "final_position")


def keyword_fallback(keyword: DataFrame, limit: int) -> DataFrame:
    """The list when no vectors are at hand."""
    score = F.round(1.0 / F.col("keyword_position"), 8)
    return keyword.filter(F.col("keyword_position") <= limit).select(
        "query_id", "chunk_id", "file_id", "chunk_index", score.alias("retrieval_score"), F.lit("keyword").alias("sources"))


def hybrid_retrieve(chunks: DataFrame, queries: DataFrame, limit: int = 5, scope: DataFrame | None = None,
                    ranker=None, vectors: DataFrame | None = None) -> DataFrame:
    """Keyword and vector recall, fusion, rerank, and the best rows per query.

    ``ranker(candidates, chunks, queries)`` may replace the default ranking; only a
    foreign ranking needs the check of its ids and scores.
    """
    n = candidate_limit(limit)
    fused = fuse(keyword_retrieve(chunks, queries, n, scope), vector_retrieve(chunks, queries, n, scope, vectors))
    # few rows: stored, they are sent to the chunks instead of the texts to them
    candidates = settle(hybrid_order(fused, n))
    if ranker is not None:
        return apply_ranking(candidates, ranker(candidates, chunks, queries), limit)
    ranked = top_n(scored(candidates, chunks, queries), ["query_id"], [F.col("score").desc(), F.col("chunk_id")], limit, "final_position")
    return ranked.select("query_id", "chunk_id", "file_id", "chunk_index", "keyword_score", "vector_score", "combined_score",
                         F.col("score").alias("retrieval_score"), F.lit("hybrid").alias("mode"), "final_position")
