"""Packing: ids against the tokenizer itself, sequences gapless, as few as an exhaustive search finds."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from backtrail.llm import packing
from backtrail.llm.common import read
from backtrail.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.default_vocabulary())


def fewest(lengths, capacity):
    best = [len(lengths)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for room in set(bins):
            if room + lengths[i] <= capacity:
                k = bins.index(room)
                go(i + 1, [*bins[:k], room + lengths[i], *bins[k + 1 :]])
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best[0]


@settings(max_examples=200, deadline=None)
@given(st.integers(5, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=9))))
def test_as_few_bins_as_an_exhaustive_search(case):
    capacity, lengths = case
    bins = packing.pack_lengths(lengths, capacity, 1_000_000)
    assert sorted(s for b in bins for s in b) == sorted(lengths)
    assert all(sum(b) <= capacity for b in bins)
    assert len(bins) == fewest(sorted(lengths, reverse=True), capacity)


TEXTS = [
    "It's THE end,isn't it?! 1234 5th x y\x1cz", "é é É ́x İ İ ΟΔΟΣ ὈΔΥΣΣΕΎΣ Σ.", "<|startoftext|>a<|endoftext|> b<|ENDOFTEXT|>", "日本語テキスト 𝄞𝄞 👍🏽ok a_b-c ...,,;; don't we'll 'S 'LL",
    "", " \n\t", "Kſ ﬁ Ǆ", "x" * 3000,
]


def test_ids_equal_the_tokenizer(spark, tokenizer):
    words = packing.Words(packing.default_vocabulary())
    for text in TEXTS + [r.text for r in read(spark, FOLDER, "documents").collect()]:
        assert packing.token_ids(words, text).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, packing.END]


def check(rows, texts, tokenizer, capacity):
    """rows: (doc, piece, start, length, crc, sequence, offset)"""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for doc, piece, start, length, crc, sequence, offset in rows:
        by_doc[doc].append((piece, start, length, crc))
        by_sequence[sequence].append((offset, length))
    for doc, text in texts.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END]
        cuts = [ids[i : i + capacity] for i in range(0, len(ids), capacity)]
        assert sorted(by_doc[doc]) == [(i, i * capacity, len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for i, c in enumerate(cuts)]
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_query(spark, tokenizer):
    rows = QUERIES["op10_best_fit_packing"](spark, FOLDER).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").collect()
    texts = {r.doc_id: r.text for r in read(spark, FOLDER, "documents").collect()}
    used = check(rows, texts, tokenizer, packing.CAPACITY)
    assert used == -(-sum(r.length for r in rows) // packing.CAPACITY)


def test_corner_rows_in_several_shares(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "SHARE", 2000)
    texts = {1: None, 2: "", 3: "word " * 20_000, 4: "a b c", 6: "word " * 63, None: "no id"}
    rows = [*texts.items(), *[(5, "same row")] * 3]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as uid", "1 as ids", "2 as length", "'y' as share")
    got = packing.packed(docs, capacity=64)
    assert set(got.columns) == {"uid", "doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"}
    found = [(r.doc_id, r.piece, r.start, r.length, zlib.crc32(np.array(r.ids, "<u4").tobytes()), r.sequence_id, r.offset) for r in got.collect()]
    assert sorted(r[:5] for r in found if r[0] == 5) == [(5, 0, 0, 3, next(r[4] for r in found if r[0] == 5))] * 3
    by_sequence = defaultdict(list)
    for r in found:
        by_sequence[r[5]].append((r[6], r[3]))
    for places in by_sequence.values():
        assert sum(n for _, n in places) <= 64 and sorted(places)[0][0] == 0
    assert sum(r[3] for r in found if r[0] == 3) == 20_001
    assert packing.packed(docs.limit(0)).count() == 0


def test_a_word_is_split_once_whatever_its_capitals_and_marks(tokenizer, monkeypatch):
    words, asked = packing.Words(packing.default_vocabulary()), []
    monkeypatch.setattr(words, "letters", lambda low, real=words.letters: asked.append(low) or real(low))
    texts = [None, "Word, word. WORD?! \t", "ÄRA ära, Ära word", "x1 word x1; _x", ""]
    ids, ends = packing.all_ids(words, pa.array(texts))
    plain = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END] for t in texts]
    assert [x.tolist() for x in np.split(ids, ends)[:-1]] == plain
    assert sorted(filter(None, asked)) == sorted([b"word", "ära".encode(), "Ära".encode(), b"x1", b"_x"])


def test_ids_stay_right_when_words_are_forgotten(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "MEMO", 4)
    monkeypatch.setattr(packing, "WHOLE", 2)
    words = packing.Words(packing.default_vocabulary())
    texts = ["one two three, four five one", "six! one two x9 x8 x9?", "three 1 2 3 one"] * 3
    ids, ends = packing.all_ids(words, pa.array(texts))
    for text, own in zip(texts, np.split(ids, ends)):
        assert own.tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, packing.END]
    for text in texts:
        assert packing.token_ids(words, text).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, packing.END]
    assert len(words) <= 2 and len(words.older) <= 2 and len(words.others) <= 2


def test_runs_of_texts_hold_every_row_once():
    texts = pa.array([None, "a" * 5, "", "b" * 12, "c" * 3, "d" * 3, None], pa.string())
    assert list(packing.slices(texts, 6)) == [(0, 3), (3, 1), (4, 3)]
    assert list(packing.slices(texts.slice(4), 6)) == [(0, 3)]
    assert list(packing.slices(texts.slice(0, 0), 6)) == []
