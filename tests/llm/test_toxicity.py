import random

import numpy as np
from helpers import docs_frame, prose
from pyspark.sql import functions as F

from gleanery.llm.toxicity import Model, char_grams, held_out, score, train


def corpus():
    r, rows, labels = random.Random(5), [], []
    for i in range(400):
        toxic = i % 4 == 0
        body = prose(i, 80).split()
        for _ in range(3 * toxic):
            body.insert(r.randrange(len(body)), r.choice(["vexquat", "vexquon", "zzorble"]) + r.choice("aeiou"))
        rows.append((i, " ".join(body)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_learns_and_leaves_the_fold_alone(spark):
    rows, labels = corpus()
    rows += [(1000, None), (1001, ""), (1002, "x" * 2_000_000), (0, rows[0][1]), (None, rows[4][1])]
    docs, known = docs_frame(spark, rows, True), spark.createDataFrame([*labels, (7, None), (None, 1), labels[0]], "doc_id long, toxic int")
    model = train(docs, known)
    out = score(docs, model)
    assert out.count() == len(rows) and out.columns == [*docs.columns, "toxic_score"]
    got = {r["doc_id"]: r["toxic_score"] for r in out.select("doc_id", "toxic_score", held_out("doc_id").alias("h")).filter("h").collect()}
    right = [(got[i] >= 0.5) == bool(y) for i, y in labels if i in got]
    assert len(right) > 50 and np.mean(right) > 0.95
    scores = {r["doc_id"]: r["toxic_score"] for r in out.collect()}
    assert scores[1000] == scores[1001] and all(0 <= x <= 1 for x in scores.values())
    flipped = known.withColumn("toxic", F.when(held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = train(docs, flipped)
    assert (again.buckets == model.buckets).all() and np.allclose(again.weights, model.weights)


def test_one_class_no_labels_no_rows(spark):
    rows, labels = corpus()
    docs = docs_frame(spark, rows[:20])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert train(docs, none).intercept == 0 and train(docs, spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")).intercept < 0
    assert score(docs_frame(spark, []), Model(np.empty(0, np.int64), np.empty(0), 0.0)).count() == 0


def test_grams_of_long_texts_are_those_of_their_parts():
    text = prose(1, 400_000)
    code = np.frombuffer(f" {text} ".encode("utf-32-le"), np.uint32)
    assert len(char_grams(text)) == sum(len(code) - n + 1 for n in (3, 4, 5))
    assert set(char_grams("abcdef")) <= set(char_grams("x abcdef y"))
