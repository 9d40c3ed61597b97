"""Language of a text against a plain version: counts, IDF, centroids, floors, nearest centroid, rejection."""

import math

import numpy as np
import pytest

from backtrail.llm import language

M = (1 << 64) - 1


def _plain_counts(text):
    """Hashed 2- and 3-grams with whole numbers, one gram at a time."""
    codes = [ord(c) if ord(c) >= 128 or "a" <= c <= "z" else 32 for c in f" {text.lower()} "]
    counts = {}
    for size in (2, 3):
        for i in range(len(codes) - size + 1):
            h = (codes[i] * 0x9E3779B97F4A7C15 + codes[i + 1] * 0xC2B2AE3D27D4EB4F) & M
            if size == 3:
                h = (h * 0x165667B19E3779F9 + codes[i + 2] * 0x27D4EB2F165667C5) & M
            place = ((h * 0xD6E8FEB86659FD93) & M) >> 52
            counts[place] = counts.get(place, 0) + 1
    return counts


def _plain_vector(text, idf):
    out = {p: math.sqrt(n) * idf[p] for p, n in _plain_counts(text).items()}
    length = math.sqrt(sum(v * v for v in out.values()))
    return {p: v / length for p, v in out.items()}


def _texts():
    draw = np.random.default_rng(3)
    words = {"en": "the cat and dog with that ball in a tree of this".split(), "de": "der hund und die katze mit dem ball auf einem baum größe".split()}
    return [(" ".join(draw.choice(w, 8 + i % 9)), name) for name, w in words.items() for i in range(25)]


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, t, n) for i, (t, n) in enumerate(_texts())]
    rows += [(100, rows[0][1], "en"), (101, "12 34", "en"), (102, None, "de")]  # a copy, and rows that don't count
    return language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4))


def test_counts(model):
    for text, _ in _texts()[:10] + _texts()[-10:]:
        got = language.ngrams(text)
        assert {int(p): int(got[p]) for p in np.flatnonzero(got)} == _plain_counts(text)


def test_idf_counts_every_row_with_a_letter(model):
    rows = [t for t, _ in _texts()] + [_texts()[0][0]]
    seen = {}
    for text in rows:
        for p in _plain_counts(text):
            seen[p] = seen.get(p, 0) + 1
    want = [math.log((1 + len(rows)) / (1 + seen.get(p, 0))) + 0.1 for p in range(language.DIMENSIONS)]
    assert model.idf == pytest.approx(np.array(want))


def _cosine(vector, centroid):
    return sum(v * centroid[p] for p, v in vector.items())


def test_centroids_and_floors(model):
    """Each centroid is the unit mean of the texts nearest to it; the floor leaves a hundredth of them out."""
    for name in ("en", "de"):
        own = [i for i, n in enumerate(model.languages) if n == name]
        assert 1 < len(own) <= 4
        vectors = [_plain_vector(t, model.idf) for t in sorted({t for t, n in _texts() if n == name})]
        cosines = [[_cosine(v, model.centroids[i]) for i in own] for v in vectors]
        for k, i in enumerate(own):
            mean = np.zeros(language.DIMENSIONS)
            for v, c in zip(vectors, cosines):
                if max(c) == c[k]:
                    for p, x in v.items():
                        mean[p] += x
            assert model.centroids[i] == pytest.approx(mean / np.linalg.norm(mean), abs=1e-5)
        assert model.floors[own] == pytest.approx(np.quantile([max(c) for c in cosines], 0.01), abs=1e-5)


def test_nearest_centroid_and_rejection(spark, model):
    texts = [t for t, _ in _texts()] + ["the hund and katze with baum", "zzz qqq xxx", "漢字", "the", "", None, "42"]
    got = language.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    assert len(got) == len(texts) and any(r.rejected for r in got) and not all(r.rejected for r in got)
    for r in got:
        text = texts[r.doc_id]
        if not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        vector = _plain_vector(text, model.idf)
        cosines = [_cosine(vector, c) for c in model.centroids]
        best = int(np.argmax(cosines))
        assert r.lang_pred == model.languages[best] and r.score == pytest.approx(cosines[best])
        assert r.rejected == (cosines[best] < model.floors[best])
