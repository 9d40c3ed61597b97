"""License scans against counting every block's words, and places against a walk over the words."""

import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from backtrail.llm import licenses
from backtrail.llm.queries import QUERIES

SMALL = (("a", "one two three four five"), ("b", "six seven"), ("c", "one seven eight nine ten eleven twelve one one"), ("d", "Été - ZWÖLF"))


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(text, templates, threshold):
    found, body = [], plain_words(text)
    for t, (label, notice) in enumerate(templates):
        own, half = set(plain_words(notice)), 1
        while half < len(plain_words(notice)):
            half *= 2
        for start in range(0, len(body), half):
            shared = len(own & set(body[start : start + 2 * half]))
            if Fraction(shared, len(own)) >= Fraction(threshold):
                found.append((label, t, start, min(start + 2 * half, len(body)), shared / len(own)))
    return sorted(found, key=lambda b: (b[2], b[1]))


def texts(seed=3, n=120):
    rng = np.random.default_rng(seed)
    known = sorted({w for _, t in SMALL for w in plain_words(t)})
    pool = [*known, *known, "other", "the", "One", "SIX", "zwölf", "Été", "née"]
    return [" ".join(rng.choice(pool, int(rng.integers(0, 90)), p=None)) + str(rng.choice([".", "\n", "\x00!", ""])) for _ in range(n)]


@pytest.mark.parametrize("threshold", ["0.8", "1", "0.5", "0.01"])
def test_blocks_equal_counting_every_block(spark, threshold):
    rows = list(enumerate(texts()))
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates=SMALL, threshold=threshold).collect()
    assert {r.doc_id: [tuple(b) for b in r.blocks] for r in got} == {i: plain(t, SMALL, threshold) for i, t in rows}
    assert {r.doc_id: r.n_words for r in got} == {i: len(plain_words(t)) for i, t in rows}
    assert sum(len(r.blocks) for r in got) > 20


def test_places_with_overlaps(spark):
    phrases = (("a a", "x"), ("a b", "y"), ("b", "z"))
    text = "A a, A\tb a-a-a b"
    body = plain_words(text)
    want = sorted((i, label) for p, label in phrases for i in range(len(body)) if body[i : i + len(p.split())] == p.split())
    (got,) = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), phrases=phrases).collect()
    assert [(p.word, p.label) for p in got.places] == want and len(want) == 8


def test_rarest_words_first(spark):
    docs = spark.createDataFrame([(1, "b b c"), (2, "B x d d d"), (3, None)], "doc_id long, text string")
    assert licenses.word_order(docs, "text", {b"a", b"b", b"c", b"d"}) == [b"a", b"c", b"b", b"d"]


def test_notices_are_found_and_plain_texts_left_alone(spark):
    notices = [(i, f"Some words before. {t}\nand some after it.") for i, (_, t) in enumerate(licenses.TEMPLATES)]
    clean = [(100, "The law of this work is a matter of the people under the sun."), (101, "Er kam mit dem Hund under the sun, released at last.")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(notices + clean, "doc_id long, text string")).collect()}
    for i, (label, _) in enumerate(licenses.TEMPLATES):
        assert label in {b.label for b in got[i].blocks}
    assert got[100].blocks == [] and got[101].blocks == []


def test_corner_rows(spark):
    long = "released under the mit license " + "word " * 300_000 + "all rights reserved"
    rows = [(1, None), (2, ""), (3, " .\n"), (None, "cc by"), (4, "cc by"), (4, "cc by"), (5, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("x")).withColumn("_text", F.lit(1))
    got = licenses.scan(df).collect()
    assert sorted((r.doc_id or 0, r.n_words, len(r.places), len(r.blocks)) for r in got) == [
        (0, 2, 1, 0), (1, 0, 0, 0), (2, 0, 0, 0), (3, 0, 0, 0), (4, 2, 1, 0), (4, 2, 1, 0), (5, 300_008, 1, 1),
    ]
    assert licenses.scan(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(df, templates=(("x", " - "),))


def test_query_of_an_empty_table_has_its_columns(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op12_license_scans"](spark, str(tmp_path))
    assert got.columns[:8] == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"] and got.count() == 0
