"""Language identification: held-out accuracy, n-grams against a plain count, corner rows."""

import numpy as np
from pyspark.sql import functions as F

from backtrail.llm import language
from backtrail.llm.common import read
from backtrail.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = QUERIES["op8_language_id"](spark, FOLDER)
    assert {"doc_id", "held_out", "lang_pred", "score"} <= set(got.columns)
    rows = got.join(read(spark, FOLDER, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.rejected for r in held]) < 0.1


def test_ngrams_of_pieces_equal_those_of_the_whole(monkeypatch):
    text = "Größe ÉTÉ niño 12 abc, the quick brown fox " * 5
    whole = language.ngrams(text)
    monkeypatch.setattr(language, "PIECE", 7)
    assert (language.ngrams(text) == whole).all()
    assert whole.sum() == (len(text) + 1) + len(text)


def test_a_language_of_copies_has_centroids(spark):
    """Few texts with many copies each: all of the texts are learnt, each once."""
    words = "der hund und die katze mit dem ball auf einem baum".split()
    copied = [" ".join(np.random.default_rng(i).permutation(words)) for i in range(4)]
    rows = [(i, copied[i % 4], "de") for i in range(4000)] + [(5000 + i, f"the cat and the dog with that ball in tree {i}", "en") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    model = language.fit(docs, sample=50)
    assert model.languages.count("de") == 4 and 1 <= model.languages.count("en") <= 4
    found = language.identify(docs, model).groupBy("lang_pred").count().collect()
    assert {r.lang_pred: r["count"] for r in found} == {"de": 4000, "en": 400}


def test_corner_rows(spark):
    rows = [(i, "the cat and the dog with that " * 3, "en") for i in range(8)] + [(i + 10, "der hund und die katze mit dem " * 3, "de") for i in range(8)]
    rows += [(30, None, "en"), (31, "", "de"), (32, "123 !?", None), (33, "x", None), (34, "a" * 3_000_000, None), (None, "und die katze", None), (5, rows[5][1], "en"), (35, "ⅷ ½", None), (36, "漢字", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("s")).withColumn("_body", F.lit(1))
    model = language.fit(docs)
    got = sorted([tuple(r) for r in language.identify(docs, model).collect()], key=str)
    assert len(got) == len(rows)
    preds = {}
    for i, lang, score, rejected in got:
        preds.setdefault(i, []).append((lang, rejected))
    assert preds[5] == [("en", False)] * 2 and preds[12] == [("de", False)] and preds[None][0][0] == "de"
    assert all(preds[i] == [("und", True)] for i in (30, 31, 32, 35))
    assert preds[36][0][1] and preds[34][0][1]
    empty = language.fit(docs.limit(0))
    assert {r.lang_pred for r in language.identify(docs, empty).collect()} == {"und"}
    assert language.identify(docs.limit(0), model).count() == 0
