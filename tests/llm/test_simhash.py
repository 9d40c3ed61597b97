"""SimHash near-duplicates against a comparison of all fingerprints."""

from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from backtrail.llm import simhash
from backtrail.llm.common import read

FOLDER = "/root/testdata/sf0.001"


def plain_fingerprint(text, width=3):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lowered + " ":
        if c in " \t\n\r\x0b\x0c":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, bits=2, close=None):
    """id -> smallest id reachable; prints: (id, unsigned fingerprint)."""
    close = close or (lambda x, y: (x ^ y).bit_count() <= bits)
    links = defaultdict(set)
    for i, (a, x) in enumerate(prints):
        for b, y in prints[i + 1 :]:
            if close(x, y):
                links[a].add(b)
                links[b].add(a)
    found = {}
    for a, _ in sorted(prints):
        todo = [a]
        while todo:
            b = todo.pop()
            if b not in found:
                found[b] = a
                todo += links[b]
    return found


def test_equals_comparing_all(spark):
    docs = read(spark, FOLDER, "documents")
    rows = docs.select("doc_id", "text").collect()
    prints = [(r.doc_id, plain_fingerprint(r.text)) for r in rows]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    want = plain_components(prints)
    assert got == {i: (x - (1 << 64) if x >> 63 else x, want[i]) for i, x in prints}
    assert len(set(want.values())) < len(want)


@pytest.mark.parametrize(("bucket", "bits"), [(256, 2), (3, 2), (3, 3)])
def test_blocks_find_every_close_pair(spark, monkeypatch, bucket, bits):
    """Crowded fingerprints, also with keys that are split down to the last bits."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 1 << 63, 30)]
    prints = set(base)
    for x in base[:6]:
        for _ in range(40):
            prints.add(x ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False)))
    prints |= {0, 1, 3, 7, (1 << 64) - 1, (1 << 64) - 2}
    rows = list(enumerate(sorted(prints)))
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, 0, i) for i, x in rows], "fp long, second long, id long")
    roots = {r.node: r.root for r in simhash.components(simhash.close_links(df, bits)).collect()}
    assert {i: roots.get(i, i) for i, _ in rows} == plain_components(rows, bits)


def test_second_fingerprint_verifies(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents").filter("length(text) > 400")
    rows = [(r.doc_id, plain_fingerprint(r.text, 1), plain_fingerprint(r.text, 5)) for r in docs.collect()]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, width=1, bits=4, second=5, second_bits=14).collect()}
    close = lambda x, y: (x[0] ^ y[0]).bit_count() <= 4 and (x[1] ^ y[1]).bit_count() <= 14
    assert got == plain_components([(i, (a, b)) for i, a, b in rows], close=close)


def test_no_task_holds_a_crowded_key(spark, monkeypatch):
    """Few first fingerprints with many second ones: dealt over pairs of blocks, and every close pair is linked."""
    monkeypatch.setattr(simhash, "ROWS", 20)
    rng = np.random.default_rng(7)
    base = [int(x) for x in rng.integers(0, 1 << 62, 12)]
    seconds = {x ^ sum(1 << int(b) for b in rng.choice(62, rng.integers(1, 9), replace=False)) for x in base for _ in range(25)}
    rows = [(i, (i % 3, x)) for i, x in enumerate(sorted(seconds))]
    df = spark.createDataFrame([(a, b, i) for i, (a, b) in rows], "fp long, second long, id long")
    close = lambda x, y: (x[0] ^ y[0]).bit_count() <= 4 and (x[1] ^ y[1]).bit_count() <= 8
    roots = {r.node: r.root for r in simhash.components(simhash.close_links(df, 4, 8)).collect()}
    assert {i: roots.get(i, i) for i, _ in rows} == plain_components(rows, close=close)
    ways = {100 + i: w for i, w in enumerate(simhash._masks(list(range(64)), 4))}
    keyed = simhash._keyed(df, ways)
    dealt = simhash._dealt(keyed, simhash._sizes(keyed, 8))
    assert dealt.groupBy("path", "key", "pair").count().agg(F.max("count")).first()[0] < 4 * simhash.ROWS < len(rows)


def test_corner_rows(spark):
    long = "word another third " * 60_000
    rows = [(4, None), (2, ""), (9, " \n"), (7, "one"), (8, "ONE"), (1, long), (3, long), (3, long), (None, long), (5, "a b"), (5, "completely different words here now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit("x")).withColumn("component_id", F.lit(0))
    got = sorted(((r.doc_id or -1), r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(-1, None), (1, 1), (2, 2), (3, 1), (3, 1), (4, 2), (5, 5), (5, 5), (7, 7), (8, 7), (9, 2)]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 2, 5, 7]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.keep_one(docs.limit(0)).count() == 0
