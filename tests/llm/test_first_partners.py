"""Near copies of which many pairs lie below the similarity: one comparison a set leaves half of them in groups of their own."""

import random

from pyspark.sql import functions as F

from yesterlog.llm import minmax


def test_a_set_meets_several_heads(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    base = rng.choices(words, k=150)
    texts = []
    for _ in range(120):
        copy = list(base)
        for at in rng.sample(range(len(copy)), 4):
            copy[at] = rng.choice(words)
        texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    classes = minmax.cut(minmax._marked(docs, 4).select("h", "keys").dropDuplicates(["h"]), "test-classes")
    met = minmax.cut(minmax._buckets(classes), "test-buckets")
    pairs = minmax._first_partners(met, classes)
    of = pairs.select(F.col("a").alias("h")).unionByName(pairs.select(F.col("b").alias("h"))).groupBy("h").count()
    assert pairs.count() > classes.count()
    assert of.agg(F.max("count")).first()[0] < 120
