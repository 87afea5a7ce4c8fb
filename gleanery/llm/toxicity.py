"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Each text is the set of its hashed character n-grams. Every n-gram weighs the log of the
ratio of its smoothed document rates in toxic and other texts; n-grams whose ratio could
be chance are left out. A logistic regression over the scaled features gives the score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gleanery.llm.words import batches_by_size
from gleanery.operators.storage import settle

SIZES = (3, 4, 5)
BITS = 20
#: Labelled documents to learn from, about; more are thinned by the hash of their id.
TRAINING_ROWS = 20_000
_STEP = np.random.default_rng(7).integers(1, 1 << 62, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
_CHUNK = 1 << 20


def char_grams(text: str | None) -> np.ndarray:
    """Bucket of each character n-gram of the whole lower-cased text, with repeats."""
    code = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = []
    for at in range(0, max(1, len(code) - max(SIZES) + 1), _CHUNK):
        part = code[at:at + _CHUNK + max(SIZES) - 1].astype(np.uint64)
        last = at + _CHUNK + max(SIZES) - 1 >= len(code)
        total = np.zeros(len(part), dtype=np.uint64)
        for i in range(min(max(SIZES), len(part))):
            total = total[:len(part) - i] + part[i:] * _STEP[i]
            if i + 1 in SIZES:
                grams = total if last else total[:_CHUNK]
                out.append((((grams ^ (grams >> np.uint64(29))) * _SPREAD) >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(out) if out else np.empty(0, dtype=np.int64)


@dataclass
class Model:
    """Weights of the n-grams that count, and the intercept."""
    buckets: np.ndarray
    weights: np.ndarray
    intercept: float

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS)
        out[self.buckets] = self.weights
        return out


def held_out(doc_id: str) -> Column:
    """Rows that no model may learn from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) == 0, F.lit(False))


def _counts(batches):
    """Documents of each class per n-gram, summed inside a task."""
    seen = np.zeros((2, 1 << BITS), dtype=np.int32)
    for batch in batches:
        for rows in batches_by_size(batch, "text"):
            for text, toxic in zip(rows.column("text").to_pylist(), rows.column("toxic").to_pylist()):
                seen[toxic][np.unique(char_grams(text))] += 1
    at = np.flatnonzero(seen.any(axis=0))
    for i in range(0, len(at), 50_000):
        part = at[i:i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(seen[0][part], pa.int64()), pa.array(seen[1][part], pa.int64())],
                                         names=["bucket", "clean", "toxic"])


def _features(buckets: np.ndarray, ratios: np.ndarray):
    def run(batches):
        place = np.full(1 << BITS, -1, dtype=np.int32)
        place[buckets] = np.arange(len(buckets))
        for batch in batches:
            for rows in batches_by_size(batch, "text"):
                at = [np.unique(x[x >= 0]) for x in (place[char_grams(t)] for t in rows.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([float(x) for x in rows.column("toxic").to_pylist()]), pa.array([x.tolist() for x in at], pa.list_(pa.int64())),
                     pa.array([ratios[x].tolist() for x in at], pa.list_(pa.float64()))], names=["label", "at", "value"])
    return run


def train(docs: DataFrame, labels: DataFrame, training_rows: int = TRAINING_ROWS, smoothing: float = 1.0,
          surprise: float = 3.0, regularisation: float = 1e-3) -> Model:
    """Fit on labelled documents outside the held-out fold.

    About ``training_rows`` labelled documents are used, chosen by the hash of doc_id: all of
    them where there are fewer. N-grams count whose log ratio is over ``surprise`` standard
    errors. Null labels are left out; a document labelled both ways is toxic; of repeated
    doc_ids the least text is read. With one class only the model is its smoothed rate.
    """
    known = (labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1) and doc_id is not null")
             .filter(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    many = known.count()
    share = int(1_000_000 * min(1.0, training_rows / max(1, many)))
    # At most about training_rows short rows by the filter above, so the side is small enough to send everywhere.
    chosen = F.broadcast(known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share))
    sample = settle(docs.select("doc_id", "text").join(chosen, "doc_id")
                    .groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic"))
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    prior = float(np.log((toxic + 1) / (clean + 1)))
    if not clean or not toxic:
        return Model(np.empty(0, np.int64), np.empty(0), prior)
    rate = lambda side, n: (F.col(side) + smoothing) / (n + 2 * smoothing)
    ratio = F.log(rate("toxic", toxic) / rate("clean", clean))
    error = F.sqrt(1 / (F.col("toxic") + smoothing) + 1 / (F.col("clean") + smoothing))
    counted = (sample.mapInArrow(_counts, "bucket long, clean long, toxic long").groupBy("bucket")
               .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
               .filter(F.abs(ratio) > surprise * error).select("bucket", ratio.alias("ratio")).toPandas().sort_values("bucket"))
    buckets, ratios = counted["bucket"].to_numpy(np.int64), counted["ratio"].to_numpy(float)
    if not len(buckets):
        return Model(buckets, ratios, prior)
    vector = F.udf(lambda at, value: Vectors.sparse(len(ratios), at, value), VectorUDT())
    rows = settle(sample.mapInArrow(_features(buckets, ratios), "label double, at array<long>, value array<double>"))
    fitted = LogisticRegression(maxIter=40, regParam=regularisation, standardization=False).fit(
        rows.select("label", vector("at", "value").alias("features")))
    return Model(buckets, fitted.coefficients.toArray() * ratios, float(fitted.intercept))


def _scores(model: Model):
    def run(batches):
        table = model.table()
        for batch in batches:
            for rows in batches_by_size(batch, "text"):
                scores = []
                for text in rows.column("text").to_pylist():
                    grams = char_grams(text)
                    hits = np.unique(grams[table[grams] != 0])
                    scores.append(1 / (1 + np.exp(-np.clip(model.intercept + table[hits].sum(), -500, 500))))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(scores, pa.float64())],
                                                 names=[*rows.schema.names, "toxic_score"])
    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``toxic_score`` from 0 to 1 for each whole text; null and empty texts score as having no n-grams
    beyond their edges. A column of that name in ``docs`` is replaced."""
    docs = docs.drop("toxic_score")
    return docs.mapInArrow(_scores(model), T.StructType([*docs.schema.fields, T.StructField("toxic_score", T.DoubleType())]))
