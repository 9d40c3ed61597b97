"""Phrase collocations against plain counting, and the automata against dictionaries."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from backtrail.llm import phrases

KIND = "doc_id long, lang string, text string"


def grams(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for piece in re.split("[.,;:!?\n-\r]", low):
        ws = re.findall("[^ \t]+", piece)
        for k in (1, 2, 3):
            yield from (tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))


def plain(rows, least=10, inside=50, most=2000):
    by_lang = {}
    for _, lang, text in rows:
        by_lang.setdefault("und" if lang is None else lang, Counter()).update(grams(text))
    out = []
    for lang, f in by_lang.items():
        some = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {q for p, a in some.items() if len(p) == 3 for q in (p[:2], p[1:]) if 100 * a >= inside * f[q]}
        found = []
        for p, a in some.items():
            score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            if p not in gone:
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        n = sum(c for p, c in f.items() if len(p) == 1)
        out += [(lang, i, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


def texts(n=150, seed=5, words=14):
    rng = np.random.default_rng(seed)
    pool = [f"w{i}" for i in range(words)] + ["The", "été", "\x1c", "zé"]
    weight = 1 / np.arange(1, len(pool) + 1)
    rows = []
    for i in range(n):
        body = [str(w) for w in rng.choice(pool, int(rng.integers(0, 60)), p=weight / weight.sum())]
        ends = [str(e) for e in rng.choice([" ", " ", " ", " ", "\t ", ". ", ",", "\n", "!?"], len(body))]
        rows.append((i, [None, "en", "de", "und"][int(rng.integers(0, 4))], "".join(a + b for a, b in zip(body, ends))))
    return rows + [(1000 + i, "en", "the very same text of new york city. new york city") for i in range(30)]


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("shard", "chunk", "ranges", "most"), [(1 << 21, 1 << 22, None, 2000), (50, 64, 40, 2000), (7, 16, 3, 5), (300, 1, 300, 20)])
def test_equals_plain_counting(spark, monkeypatch, shard, chunk, ranges, most):
    rows = texts()
    wanted = plain(rows, most=most)
    for name, value in (("SHARD", shard), ("CHUNK", chunk)):
        monkeypatch.setattr(phrases, name, value)
    got = phrases.collocations(spark.createDataFrame(rows, KIND).repartition(5), most=most, ranges=ranges)
    assert rows_of(got) == wanted and len(wanted) >= 15
    assert {r[0] for r in wanted} == {"und", "en", "de"}


def test_parts_inside_longer_phrases_go(spark):
    got = {r[2] for r in rows_of(phrases.collocations(spark.createDataFrame(texts(), KIND)).filter("lang = 'en'"))}
    assert "new york city" in got and "new york" not in got and "york city" not in got


def some_counts(seed, n=400, words=9):
    rng = np.random.default_rng(seed)
    vocabulary = [b"", *sorted({bytes([97 + int(i)]) * int(rng.integers(1, 3)) for i in rng.integers(0, words, 20)})]
    ids = rng.integers(0, len(vocabulary), n)
    return phrases.counted(np.concatenate([ids, [0, 0]]), vocabulary), [vocabulary[i] for i in ids]


def paths(a):
    v, out = len(a.words), {}
    for arc, n in zip(a.one.tolist(), a.n_one.tolist()):
        out[(a.words[arc],)] = n
    for arc, n in zip(a.two.tolist(), a.n_two.tolist()):
        out[(a.words[arc // v], a.words[arc % v])] = n
    for arc, n in zip(a.three.tolist(), a.n_three.tolist()):
        pair = int(a.two[arc // v])
        out[(a.words[pair // v], a.words[pair % v], a.words[arc % v])] = n
    return out


def test_automata_equal_dictionaries():
    rng = np.random.default_rng(0)
    for seed in range(20):
        a, stream = some_counts(seed)
        want = Counter(tuple(stream[i : i + k]) for k in (1, 2, 3) for i in range(len(stream) - k + 1) if b"" not in stream[i : i + k])
        assert paths(a) == want
        assert paths(phrases.thawed(phrases.frozen(a))) == want
        b, _ = some_counts(seed + 100)
        assert paths(phrases.united([a, b])) == want + Counter(paths(b))
        assert paths(phrases.pruned(a, 3)) == {p: n for p, n in want.items() if n >= 3}
        cuts = sorted({(bytes([97 + int(i)]), bytes([97 + int(j)])) for i, j in rng.integers(0, 10, (4, 2))})
        ends = [(b"", b""), *cuts, (b"\xff", b"")]
        for k, piece in enumerate(phrases.between(a, cuts)):
            assert paths(piece) == {p: n for p, n in want.items() if ends[k] <= (p + (b"",))[:2] < ends[k + 1]}
            assert set(piece.words) == {b"", *(w for p in paths(piece) for w in p)}
        sought = phrases.automaton({p: 1 for p in list(want)[::2] if len(p) < 3} | {(b"no",): 1, (b"a", b"no"): 1})
        assert paths(phrases.composed(sought, a)) == {p: want[p] for p in paths(sought) if p in want}


def test_one_shared_arc_for_equal_ways_on():
    many = [w for i in range(2000) for w in (b"a%d" % i, b"b%d" % i, b"z", b"")]
    words = sorted({b"", *many})
    number = {w: i for i, w in enumerate(words)}
    a = phrases.counted(np.array([number[w] for w in many] + [0, 0]), words)
    assert paths(phrases.thawed(phrases.frozen(a))) == paths(a) and len(a.three) == 2000


def test_scores_are_exact_beyond_64_bits():
    a, left, right = 3 * 10**12, 3 * 10**12 + 1, 7 * 10**12
    words = (b"x", b"y")
    assert phrases._lowest_cut(words, a, a, {(b"x",): left, (b"y",): right}) == (10**6 * a * a // (left * right), left, right)
    # the earlier of two cuts with equal scores after flooring
    n = {(b"x",): 100, (b"y", b"z"): 100, (b"z",): 101}
    assert phrases._lowest_cut((b"x", b"y", b"z"), 10, 100, n) == (9900, 100, 101)
    n[(b"z",)] = 100
    assert phrases._lowest_cut((b"x", b"y", b"z"), 10, 100, n) == (10000, 100, 100)


def test_corner_rows(spark):
    long = "to be or " * 100_000
    rows = [(1, "en", None), (2, None, ""), (None, "en", "..."), (3, "fr", long), (3, "fr", long), (4, "en", "lone"), (5, "de", "x " * 12)]
    df = spark.createDataFrame(rows, KIND).withColumn("n", F.lit("x")).withColumn("_text", F.lit(1))
    assert rows_of(phrases.collocations(df)) == plain(rows)
    got = phrases.collocations(df.limit(0))
    assert got.count() == 0 and got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
