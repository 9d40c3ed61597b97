"""Near-duplicates by shingles against the Jaccard similarity of all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from backtrail.llm import shingles, simhash
from backtrail.llm.graph import components
from backtrail.settings import ensure_checkpoint_folder

KIND = "doc_id long, text string"


def plain(rows, width=5, least=0.8):
    """doc_id -> smallest id that links reach; rows: (doc_id, text), ids once."""
    def own(text):
        words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if w]
        return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()

    sets, root = {i: own(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if min(len(a), len(b)) >= least * max(len(a), len(b)) and (a == b or 10 * len(a & b) >= 10 * least * len(a | b)):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def changed(words, share, rng):
    out = list(words)
    for at in np.flatnonzero(rng.random(len(out)) < share):
        out[at] = f"x{rng.integers(0, 10**9)}"
    return out


def corpus(seed=7):
    """Unrelated texts of 20 to 5,000 words, near copies at all similarities, a large group, a passage that many share."""
    rng = np.random.default_rng(seed)
    word = lambda n: [f"w{i}" for i in rng.zipf(1.3, n) % 3000]
    texts = [word(int(n)) for n in rng.choice([20, 25, 40, 60, 150, 400], 120)] + [word(5000), word(3000)]
    for i in range(90):
        texts.append(changed(texts[i], float(rng.choice([0.005, 0.01, 0.02, 0.03, 0.05])), rng))
    texts += [changed(texts[120], 0.01, rng), changed(texts[121], 0.02, rng)]
    base = word(100)
    texts += [changed(base, 0.02, rng) for _ in range(150)]
    passage = word(60)
    for own in rng.integers(5, 80, 100):  # between a passage with a few own words and mostly own words
        texts.append(word(int(own)) + passage)
    texts += [base, base, passage, passage, ["Short", "one"], ["short", "ONE"], ["short"], [], []]
    order = rng.permutation(len(texts))
    return [(int(i), " ".join(texts[j]) or None) for i, j in enumerate(order)]


@pytest.mark.parametrize(("small", "rounds", "block", "bits"), [(8, 6, 256, 3), (2, 2, 16, 0), (1, 0, 8, 2), (4, 1, 5, 3)])
def test_equals_comparing_all_pairs(spark, monkeypatch, small, rounds, block, bits):
    for name, value in (("SMALL", small), ("ROUNDS", rounds), ("BLOCK", block)):
        monkeypatch.setattr(shingles, name, value)
    rows = corpus()
    got = {r.doc_id: r.component_id for r in shingles.near_duplicates(spark.createDataFrame(rows, KIND), bits=bits).collect()}
    want = plain(rows)
    assert got == want
    assert max(list(want.values()).count(c) for c in set(want.values())) > 100


def test_fingerprint_is_that_of_simhash():
    for text in ("", "one", "A b  c\td e f g\n\x0bh", "é ü " * 50):
        assert shingles.majority(shingles.shingle_hashes(text, 5)) == simhash.fingerprint(text, 5)


def test_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(3, text, "a"), (1, text.upper(), "b"), (1, "other text", "c"), (None, text, "d"), (None, text, "d"), (7, None, "e"), (8, " ", "f"), (9, text + " more", "g"), (5, "other text", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("id", F.lit("x")).withColumn("n", F.lit(1))
    kept = sorted((r.doc_id or 0, r.source) for r in shingles.keep_one(df).collect())
    # of the rows with key 1 the smaller text stays, in capitals here
    assert kept == [(0, "d"), (0, "d"), (1, "b"), (5, "h"), (7, "e")]
    assert shingles.keep_one(df).columns == df.columns
    assert shingles.keep_one(df.limit(0)).count() == 0


def test_very_long_text(spark):
    long = [f"w{i % 7919}y{i % 31}" for i in range(120_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:-3000])), (3, " ".join(long[60_000:])), (4, "short")]
    got = {r.doc_id: r.component_id for r in shingles.near_duplicates(spark.createDataFrame(rows, KIND)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def tables_left(spark):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext._jsc.sc().getCheckpointDir().get())
    found = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    return {s.getPath().getName() for s in found}


def test_rounds_of_components_leave_one_table(spark):
    ensure_checkpoint_folder(spark)
    before = tables_left(spark)
    chain = spark.createDataFrame([(i, i + 1) for i in range(9)], "a bigint, b bigint")
    roots = components(chain)
    assert [name.rsplit("-", 1)[0] for name in tables_left(spark) - before] == ["links"]
    assert {tuple(r) for r in roots.collect()} == {(i, 0) for i in range(1, 10)}


def test_near_duplicates_remove_the_sets_of_shingles(spark):
    ensure_checkpoint_folder(spark)
    before = tables_left(spark)
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join([*words[:39], f"v{i}"])) for i in range(12)], "doc_id bigint, text string")
    found = shingles.near_duplicates(docs)
    kinds = {n.rsplit("-", 1)[0] for n in tables_left(spark) - before}
    assert not kinds & {"sets", "classes", "prints", "profiles", "groups", "known", "least", "large"}
    assert {r.component_id for r in found.collect()} == {0}
