"""Quality scores: held-out accuracy, the risk's gradient, corner rows."""

import numpy as np
from pyspark.sql import functions as F

from backtrail.llm import quality
from backtrail.llm.common import read
from backtrail.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    got = QUERIES["op9_quality_classifier"](spark, FOLDER)
    assert {"doc_id", "held_out", "score", "predicted"} <= set(got.columns)
    rows = got.join(read(spark, FOLDER, "labels"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    good = [r.predicted for r in held if r.quality == 1]
    bad = [r.predicted for r in held if r.quality == 0]
    print(np.mean(good), np.mean(bad))
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.1
    assert got.count() == 10_000 and all(0 <= r.score <= 1 for r in rows)


def test_corner_rows(spark):
    good = "Here is a plain sentence of the usual kind, number {}. It goes on for a while.\nAnd there is more."
    rows = [(i, good.format("one two three four five six".split()[i % 6]) + " word" * (i % 5)) for i in range(60)]
    rows += [(100 + i, "BUY!! NOW!! $$$ ### | | | " * (3 + i % 4)) for i in range(20)]
    rows += [(200, None), (201, ""), (202, "|"), (None, good), (5, good), (203, "w " * 500_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("x", F.lit("a")).withColumn("score", F.lit("b"))
    labels = spark.createDataFrame([(i, 1 if i < 60 else 0, None) for i in [*range(0, 50, 2), *range(100, 105)]] + [(None, 1, None), (1, None, None), (3, 1, None), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = quality.score(docs, labels, F.lit(True)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r.score for r in got}
    assert np.mean([by_id[i] > 0.7 for i in range(60)]) > 0.9 and np.mean([by_id[i] > 0.7 for i in range(100, 120)]) < 0.1
    kept = quality.accept(docs, labels, F.lit(True))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {None, 1}
    assert {r.score for r in quality.score(docs, labels.limit(0), F.lit(True)).collect()} == {0.5}
    assert quality.score(docs.limit(0), labels, F.lit(True)).count() == 0
