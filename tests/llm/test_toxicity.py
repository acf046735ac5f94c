import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from bindery.llm import toxicity


def corpus(n=900, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(400)]
    bad = ["zorkig", "blaffel", "grunzt"]
    rows = []
    for k in range(n):
        text = rng.choices(words, k=rng.randint(5, 60))
        toxic = int(rng.random() < 0.25)
        if toxic:
            for _ in range(2):
                text.insert(rng.randrange(len(text)), rng.choice(bad))
        rows.append((k, " ".join(text), "en", toxic))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    df = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    found = {r["doc_id"]: r for r in toxicity.toxicity(df, labels).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert all(found[r[0]]["held_out"] == (zlib.crc32(str(r[0]).encode()) % 5 == 0) for r in rows)
    right = [found[r[0]]["predicted"] == r[3] for r in held]
    assert sum(right) >= 0.95 * len(right)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found.values())


def test_held_out_labels_teach_nothing(spark):
    rows = corpus(300)
    df = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    turned = [(r[0], 1 - r[3] if zlib.crc32(str(r[0]).encode()) % 5 == 0 else r[3]) for r in rows]
    scores = [{r["doc_id"]: r["score"] for r in toxicity.toxicity(df, spark.createDataFrame(given, "doc_id long, toxic int")).collect()} for given in ([(r[0], r[3]) for r in rows], turned)]
    assert scores[0] == scores[1]


def test_scores_read_the_text_alone(spark):
    rows = corpus(300)
    texts, toxic = [r[1].encode() for r in rows], np.array([r[3] for r in rows])
    score = toxicity.Scorer(toxicity.fit(texts, toxic, np.arange(len(rows)) % 4 == 0))
    whole = score(texts)
    assert np.allclose(whole, [score([t])[0] for t in texts])
    assert np.allclose(whole[::-1], score(texts[::-1]))


def test_strange_rows(spark, docs, strange_rows):
    labels = spark.createDataFrame([(k, k % 3 == 0 if k % 7 else None) for k in range(60)] + [(None, True)], "doc_id long, t boolean").select("doc_id", F.col("t").cast("int").alias("toxic"), F.lit(1).alias("text"), F.lit("x").alias("lang"))
    found = toxicity.toxicity(docs, labels).collect()
    assert len(found) == len(strange_rows) and all(0 <= r["score"] <= 1 for r in found)
    assert all(r["held_out"] is False for r in found if r["doc_id"] is None)


def test_one_class_rejects_nothing(spark, docs):
    labels = spark.createDataFrame([(k, 0) for k in range(50)], "doc_id long, toxic int")
    assert toxicity.toxicity(docs, labels).where("predicted = 1").count() == 0


def test_empty(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity(empty, labels).count() == 0
