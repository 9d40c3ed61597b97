"""The corpus pipeline, stage by stage against plain versions, and over corner rows."""

from collections import Counter, defaultdict

import pytest
from test_secrets import plain_base
from test_shingles import plain as plain_near
from tokenizers import Tokenizer

import corpus_pipeline as cp
from backtrail.llm import packing, quality
from backtrail.llm.common import fold, read

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows that go into each stage, and those of the last."""
    docs, found = read(spark, FOLDER, "documents"), []
    for i, (_, stage) in enumerate(cp.STAGES):
        found.append(docs)
        path = str(tmp_path_factory.mktemp("stages") / str(i))
        stage(spark, docs, FOLDER).write.parquet(path)
        docs = spark.read.parquet(path)
    return [*found, docs]


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(stages):
    assert all(df.columns == stages[0].columns for df in stages[:-1])


def test_quality_stage(spark, stages):
    scores = quality.score(stages[0], read(spark, FOLDER, "labels"), fold("doc_id", 4) != 2).collect()
    assert set(texts(stages[1])) == {r.doc_id for r in scores if r.score >= 0.7}
    labels = {r.doc_id: r.quality for r in read(spark, FOLDER, "labels").collect()}
    kept = Counter((labels[i], i in texts(stages[1])) for i in labels)
    assert kept[1, True] > 0.97 * (kept[1, True] + kept[1, False]) and kept[0, True] < 0.15 * (kept[0, True] + kept[0, False])


def test_near_duplicates_stage(stages):
    """Exactly the links of five-word Jaccard 0.8 and more: none is missing, none is below."""
    docs = texts(stages[1])
    groups = plain_near(list(docs.items()))
    assert texts(stages[2]) == {i: t for i, t in docs.items() if groups[i] == i}
    assert len(set(docs.values())) >= len(texts(stages[2])) > 0.7 * len(docs)


def test_secrets_stage(stages):
    before, after = texts(stages[2]), texts(stages[3])
    held = defaultdict(set)
    for i, t in before.items():
        for start, _, stop in plain_base(t):
            held[t[start:stop]].add(i)
    assert held and set(before) == set(after)
    for i, t in before.items():
        spans = plain_base(t)
        if not spans and t == after[i]:
            continue
        assert not spans or "[secret]" in after[i]
        assert not plain_base(after[i])
    assert sum(t == after[i] for i, t in before.items()) > 0.8 * len(before)


def test_mixing_stage_keeps_every_document(stages):
    before, after = stages[3].collect(), stages[4].collect()
    assert Counter(set(after)) == Counter(set(before)) and len(before) <= len(after) < 2 * len(before)


def test_mixing_stage_brings_a_large_domain_down(spark, tmp_path):
    schema = read(spark, FOLDER, "documents").schema
    rows = [(i, f"{'calm' if i % 10 < 7 else 'rude'} words of document", "en", "s", 20) for i in range(400)]
    spark.createDataFrame([(i, 1, int(i % 10 < 7)) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    after = cp.mixing_to_targets(spark, spark.createDataFrame(rows, schema), str(tmp_path)).collect()
    calm = sum(r.text.startswith("calm") for r in after) / len(after)
    assert {r.doc_id for r in after} == set(range(400)) and abs(calm - 0.06 / 0.86) < 0.04


def test_packing_stage(stages):
    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    rows = stages[5].collect()
    copies = Counter((r.doc_id, r.text) for r in stages[4].collect())
    ids = {k: [*tokenizer.encode(k[1], add_special_tokens=False).ids, packing.END] for k in copies}
    assert sum(r.length for r in rows) == sum(n * len(ids[k]) for k, n in copies.items())
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append((r.piece, r.start, list(r.ids)))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for (doc, _), n in copies.items():
        cuts = [ids[doc, _][a : a + 4096] for a in range(0, len(ids[doc, _]), 4096)]
        assert sorted(by_doc[doc]) == sorted((i, i * 4096, c) for i, c in enumerate(cuts) for _n in range(n))
    for places in by_sequence.values():
        ends = [0, *[a + b for a, b in sorted(places)]]
        assert [a for a, _ in sorted(places)] == ends[:-1] and ends[-1] <= 4096
    assert len(by_sequence) == -(-sum(r.length for r in rows) // 4096)


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (None, "", None, "s", 0), (None, None, None, None, None), (2, "word " * 300_000, "en", "s", 5), (2, "word " * 300_000, "en", "s", 5), (3, "token=abcdefgh1", "en", "s", 15)]])
def test_corner_rows_pass_all_stages(spark, rows):
    docs = spark.createDataFrame(rows, read(spark, FOLDER, "documents").schema)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert docs.columns and docs.count() >= 0
