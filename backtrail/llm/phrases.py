"""Phrase collocations, counted in weighted acyclic automata.

A shard, some million words of one language in one task, turns its n-grams of one to three words into an automaton: states
are numbered in the order of their sorted n-grams, an arc is a state and a word, its weight the n-gram's count. States of
two words that go on in the same one way share that arc. The automata are cut at borders of the first two words, and those
of one range of prefixes are united, weights of equal paths added. So a very common word or pair sends one arc per shard,
not one row per place, and a range holds about as many arcs as any other.

Phrases that are rarer than the bound leave the united automata; a part of a phrase is at least as common as the phrase, so
all parts stay. To look up the parts of its phrases a range builds an automaton of them, cuts it at the same borders and
has each piece composed with the counts of that range. What comes back is again an automaton, with the counts as weights.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from backtrail.llm.common import cut, hash_share, release
from backtrail.operators.lookups import lookup

SHARD = 1 << 21  # words that one automaton of a task is built from
CHUNK = 1 << 22  # bytes of a text that are cut into words at once
PER_RANGE = 1 << 21  # words whose n-grams one range of prefixes shall hold
SAMPLE = 2048  # documents that the borders of the ranges are taken from; they decide about balance only
PER_DOCUMENT = 32  # pairs of words that one of them gives
SALTS = 64
#: A-Z in lower case, tabs as blanks, all that parts pieces as a full stop.
PIECE_BYTES = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 9 else 46 if c in b".,;:!?" or 10 <= c <= 13 else c for c in range(256))
MOST = (1 << 63) - 1


def tokens(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text in order, with b"." wherever a piece ends, in lists of bounded size."""
    data = (text or "").encode().translate(PIECE_BYTES)
    at = 0
    while at < len(data):
        stop = data.find(b" ", at + CHUNK)
        stop = len(data) if stop < 0 else stop
        yield data[at:stop].replace(b".", b" . ").split()
        at = stop


# -- automata -----------------------------------------------------------------------------------------


class Counts(NamedTuple):
    """An automaton of n-grams: arcs (state * len(words) + word), sorted, with their weights.

    words is sorted and starts with b"", which is no word. The state of a word is its number, that of two
    words the place of their arc in `two`.
    """

    words: list[bytes]
    one: np.ndarray
    n_one: np.ndarray
    two: np.ndarray
    n_two: np.ndarray
    three: np.ndarray
    n_three: np.ndarray


def counted(ids: np.ndarray, words: list[bytes]) -> Counts:
    """N-grams that start before the last two places of ids; 0 is a gap that no n-gram spans."""
    v = len(words)
    first, second, third = (ids[k : len(ids) - 2 + k].astype(np.int64) for k in range(3))
    one, n_one = np.unique(first[first > 0], return_counts=True)
    pair = (first > 0) & (second > 0)
    two, state, n_two = np.unique(first[pair] * v + second[pair], return_inverse=True, return_counts=True)
    onward = third[pair]
    three, n_three = np.unique(state[onward > 0] * v + onward[onward > 0], return_counts=True)
    return Counts(words, one, n_one, two, n_two, three, n_three)


def between(a: Counts, cuts: list[tuple[bytes, bytes]]) -> list[Counts]:
    """The automaton cut at prefixes of two words: len(cuts) + 1 automata, each with the words that it needs."""
    v = len(a.words)
    at = []
    for w1, w2 in cuts:
        i = bisect_left(a.words, w1)
        j = bisect_left(a.words, w2) if i < v and a.words[i] == w1 else 0
        at.append(i * v + j)
    ends1 = [0, *np.searchsorted(a.one * v, at).tolist(), len(a.one)]
    ends2 = [0, *np.searchsorted(a.two, at).tolist(), len(a.two)]
    ends3 = [0, *np.searchsorted(a.three, [e * v for e in ends2[1:-1]]).tolist(), len(a.three)]
    pieces = []
    for k in range(len(cuts) + 1):
        one, two, three = a.one[ends1[k] : ends1[k + 1]], a.two[ends2[k] : ends2[k + 1]], a.three[ends3[k] : ends3[k + 1]]
        weights = a.n_one[ends1[k] : ends1[k + 1]], a.n_two[ends2[k] : ends2[k + 1]], a.n_three[ends3[k] : ends3[k + 1]]
        used = np.unique(np.concatenate([[0], one, two // v, two % v, three % v]))
        new = lambda x: np.searchsorted(used, x)
        m = len(used)
        pieces.append(Counts(
            [a.words[i] for i in used.tolist()], new(one), weights[0], new(two // v) * m + new(two % v), weights[1],
            (three // v - ends2[k]) * m + new(three % v), weights[2],
        ))
    return pieces


def united(parts: list[Counts]) -> Counts:
    """One automaton with the paths of all, weights of equal paths added."""
    words = sorted(set().union(*[p.words for p in parts], [b""]))
    number, v = {w: i for i, w in enumerate(words)}, len(words)
    to = [np.fromiter(map(number.__getitem__, p.words), np.int64, len(p.words)) for p in parts]

    def folded(arcs: list[np.ndarray], weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        both, state = np.unique(np.concatenate(arcs), return_inverse=True)
        total = np.zeros(len(both), np.int64)
        np.add.at(total, state, np.concatenate(weights))
        return both, total, state

    one, n_one, _ = folded([t[p.one] for p, t in zip(parts, to)], [p.n_one for p in parts])
    arcs = [t[p.two // len(p.words)] * v + t[p.two % len(p.words)] for p, t in zip(parts, to)]
    two, n_two, state = folded(arcs, [p.n_two for p in parts])
    starts = np.cumsum([0, *[len(p.two) for p in parts]])
    arcs = [state[s + p.three // len(p.words)] * v + t[p.three % len(p.words)] for p, t, s in zip(parts, to, starts)]
    three, n_three, _ = folded(arcs, [p.n_three for p in parts])
    return Counts(words, one, n_one, two, n_two, three, n_three)


def pruned(a: Counts, least: int) -> Counts:
    """Only n-grams of at least this weight; weights never grow along a path, so no path is torn."""
    v = len(a.words)
    keep1, keep2, keep3 = a.n_one >= least, a.n_two >= least, a.n_three >= least
    state = np.cumsum(keep2) - 1
    three = a.three[keep3]
    kept = Counts(a.words, a.one[keep1], a.n_one[keep1], a.two[keep2], a.n_two[keep2], state[three // v] * v + three % v, a.n_three[keep3])
    return between(kept, [])[0]


def weights_of(paths: list[tuple[bytes, ...]], a: Counts) -> np.ndarray:
    """The weight of each path of one or two words, 0 where the automaton has none."""
    number, v = {w: i for i, w in enumerate(a.words)}, len(a.words)
    single = np.array([number.get(p[0], -1) if len(p) == 1 else -1 for p in paths], np.int64)
    double = np.array([number.get(p[0], -v) * v + number.get(p[1], -v) if len(p) == 2 else -1 for p in paths], np.int64)
    out = np.zeros(len(paths), np.int64)
    for sought, arcs, weights in ((single, a.one, a.n_one), (double, a.two, a.n_two)):
        if len(arcs):
            at = np.minimum(np.searchsorted(arcs, sought), len(arcs) - 1)
            hit = (arcs[at] == sought) & (sought >= 0)
            out[hit] = weights[at[hit]]
    return out


def automaton(paths: dict[tuple[bytes, ...], int]) -> Counts:
    """An automaton of some paths of one or two words with their weights."""
    words = sorted({b"", *(w for p in paths for w in p)})
    number, v = {w: i for i, w in enumerate(words)}, len(words)
    one = sorted((number[p[0]], n) for p, n in paths.items() if len(p) == 1)
    two = sorted((number[p[0]] * v + number[p[1]], n) for p, n in paths.items() if len(p) == 2)
    columns = [np.array(x, np.int64) for rows in (one, two) for x in ([k for k, _ in rows], [n for _, n in rows])]
    return Counts(words, *columns, np.zeros(0, np.int64), np.zeros(0, np.int64))


def composed(sought: Counts, counts: Counts) -> Counts:
    """The paths of one or two words of `sought` with the weights that they have in `counts`; others leave."""
    v = len(sought.words)
    paths = [(sought.words[i],) for i in sought.one.tolist()] + [(sought.words[i // v], sought.words[i % v]) for i in sought.two.tolist()]
    return automaton({p: n for p, n in zip(paths, weights_of(paths, counts).tolist()) if n})


def frozen(a: Counts) -> bytes:
    """The automaton as bytes: per state its number of arcs, then the words and weights of the arcs.

    Of the states of two words with a single arc, those with equal arcs are one.
    """
    v = len(a.words)
    out1, out2 = np.bincount(a.two // v, minlength=v), np.bincount(a.three // v, minlength=len(a.two))
    word3 = a.three % v
    alone = np.repeat(out2 == 1, out2)
    arcs, shared = np.unique(np.stack([word3[alone], a.n_three[alone]]), axis=1, return_inverse=True) if alone.any() else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
    columns = [a.one, a.n_one, out1, a.two % v, a.n_two, out2, arcs[0], arcs[1], shared.ravel(), word3[~alone], a.n_three[~alone]]
    columns = [np.frombuffer(b" ".join(a.words), np.uint8), *[c.astype(np.min_scalar_type(int(c.max(initial=0)))) for c in columns]]
    head = np.array([[ord(c.dtype.char), c.nbytes] for c in columns], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(c.tobytes() for c in columns))


def thawed(data: bytes) -> Counts:
    data = zstandard.ZstdDecompressor().decompress(data)
    head, at, columns = np.frombuffer(data[: 12 * 16], np.int64).reshape(12, 2).tolist(), 12 * 16, []
    for kind, size in head:
        columns.append(np.frombuffer(data[at : at + size], chr(kind)))
        at += size
    words = columns[0].tobytes().split(b" ")
    one, n_one, out1, word2, n_two, out2, arc_word, arc_n, shared, word3, n_three = (c.astype(np.int64) for c in columns[1:])
    v = len(words)
    alone = np.repeat(out2 == 1, out2)
    every = np.zeros((2, len(alone)), np.int64)
    every[:, alone] = arc_word[shared], arc_n[shared]
    every[:, ~alone] = word3, n_three
    two = np.repeat(np.arange(v), out1) * v + word2
    return Counts(words, one, n_one, two, n_two, np.repeat(np.arange(len(two)), out2) * v + every[0], every[1])


# -- ranges of prefixes -------------------------------------------------------------------------------


class Borders:
    """Ranges of prefixes (language, first word, second word); a range starts at its border."""

    def __init__(self, at: list[tuple[str, bytes, bytes]]):
        self.at = at

    def cut(self, lang: str, a: Counts) -> Iterator[tuple[int, Counts]]:
        """(range, automaton) of the ranges that the automaton of a language has paths in."""
        first = bisect_left(self.at, (lang, b"", b""))
        own = [b[1:] for b in self.at[first : bisect_left(self.at, (lang + "\0", b"", b""))]]
        for k, piece in enumerate(between(a, own)):
            if len(piece.one) or len(piece.two):
                yield first + k, piece


def borders(docs: DataFrame, ranges: int | None) -> Borders:
    """Borders at even steps through the different word pairs of about `SAMPLE` documents. docs: (_lang, _text)."""
    total = docs.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, firsts, seconds, sizes = [], [], [], []
            for lang, x in zip(batch.column(0), batch.column(1)):
                every = [w for some in tokens(x.as_py()) for w in some]
                step = max(1, len(every) // PER_DOCUMENT)
                for a, b in zip(every[::step], every[1::step]):
                    if a != b".":
                        langs.append(lang.as_py())
                        firsts.append(a)
                        seconds.append(b"" if b == b"." else b)
                        sizes.append(len(every) / PER_DOCUMENT)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(firsts, pa.binary()), pa.array(seconds, pa.binary()), pa.array(sizes, pa.float64())], ["lang", "first", "second", "words"])

    chance = min(1.0, SAMPLE / max(1, total))
    some = docs.filter(hash_share([F.col("_text"), F.monotonically_increasing_id()]) < chance)
    found = some.mapInArrow(run, "lang string, first binary, second binary, words double").collect()
    if ranges is None:
        words = sum(r.words for r in found) / chance
        ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(words / PER_RANGE) + 1)
    pairs = sorted({(r.lang, bytes(r.first), bytes(r.second)) for r in found})
    return Borders(sorted({pairs[len(pairs) * k // ranges] for k in range(1, ranges)}) if pairs else [])


def shards(docs: DataFrame, at: Borders) -> DataFrame:
    """(range, lang, data): automata of the n-grams of each task, cut at the borders. docs: (_lang, _text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[bytes, int] = {b".": 0}
        streams: dict[str, list[np.ndarray]] = {}
        size = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal number, streams, size
            order = sorted(w for w in number if w != b".")
            words = [b"", *order]
            to = np.zeros(len(number), np.int64)
            for place, w in enumerate(order, 1):
                to[number[w]] = place
            before, carried = list(number), {}
            rows = []
            for lang, stream in streams.items():
                ids = np.concatenate([*stream, [0, 0]] if last else stream)
                rows += [(k, lang, frozen(piece)) for k, piece in at.cut(lang, counted(to[ids], words))]
                carried[lang] = [before[i] for i in ids[-2:].tolist()]
            number, size = {b".": 0}, 0
            streams = {lang: [_numbered(ends, number)] for lang, ends in carried.items()}
            for row in rows:
                yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int32()), pa.array([row[1]], pa.string()), pa.array([row[2]], pa.binary())], ["range", "lang", "data"])

        for batch in batches:
            for lang, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                stream = streams.setdefault(lang, [])
                for some in tokens(x.as_py()):
                    ids = _numbered(some, number)
                    stream.append(ids)
                    size += len(ids)
                    if size >= SHARD:
                        yield from flush(last=False)
                        stream = streams[lang]
                stream.append(np.zeros(1, np.int64))
        yield from flush(last=True)

    return docs.mapInArrow(run, "range int, lang string, data binary")


def _numbered(words: list[bytes], number: dict[bytes, int]) -> np.ndarray:
    """Numbers of the words; new words get the next ones."""
    for w in set(words).difference(number):
        number[w] = len(number)
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def phrase_counts(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = 10, ranges: int | None = None) -> tuple[DataFrame, Borders]:
    """(table, borders): one row (range, lang, n, data) per range of prefixes and language with at least one word.

    n is the number of all word occurrences that the range's first words have, data the automaton of its n-grams of at least `least`.
    """
    named = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("_lang"), F.col(text).cast("string").alias("_text"))
    at = borders(named, ranges)

    def unite(frame: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for which, group in frame.groupby("lang"):
            every = united([thawed(d) for d in group["data"]])
            rows.append((int(frame["range"].iloc[0]), which, int(every.n_one.sum()), frozen(pruned(every, least))))
        return pd.DataFrame(rows, columns=["range", "lang", "n", "data"])

    kinds = "range int, lang string, n bigint, data binary"
    return cut(shards(named, at).groupBy("range").applyInPandas(unite, kinds), "phrase-counts"), at


# -- phrases and their parts --------------------------------------------------------------------------


def _phrases(a: Counts) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(words, count, count of the first two words) of all phrases of two and three words."""
    v = len(a.words)
    for arc, n in zip(a.two.tolist(), a.n_two.tolist()):
        yield (a.words[arc // v], a.words[arc % v]), n, n
    pair, last = (a.three // v), (a.three % v).tolist()
    for arc, n_two, w, n in zip(a.two[pair].tolist(), a.n_two[pair].tolist(), last, a.n_three.tolist()):
        yield (a.words[arc // v], a.words[arc % v], a.words[w]), n, n_two


def sought_parts(counts: DataFrame, at: Borders) -> DataFrame:
    """(range, lang, asker, data): per range of the parts an automaton of those that the phrases of range `asker` need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asker, lang, data in zip(*(batch.column(c).to_pylist() for c in ("range", "lang", "data"))):
                parts: dict[tuple[bytes, ...], int] = {}
                for words, _, _ in _phrases(thawed(data)):
                    parts[words[:1]] = parts[words[1:]] = parts[words[-1:]] = 1
                rows = [(k, lang, asker, frozen(piece)) for k, piece in at.cut(lang, automaton(parts))]
                columns = [pa.array(list(c), kind) for c, kind in zip(zip(*rows), (pa.int32(), pa.string(), pa.int32(), pa.binary()))]
                if rows:
                    yield pa.RecordBatch.from_arrays(columns, ["range", "lang", "asker", "data"])

    return counts.select("range", "lang", "data").mapInArrow(run, "range int, lang string, asker int, data binary")


def answered(counts: DataFrame, sought: DataFrame) -> DataFrame:
    """(asker, lang, data): the parts sought, with their counts."""

    def run(have: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        rows, known = [], {lang: thawed(data) for lang, data in zip(have["lang"], have["data"])}
        for lang, asker, data in zip(ask["lang"], ask["asker"], ask["data"]):
            rows.append((asker, lang, frozen(composed(thawed(data), known[lang]))))
        return pd.DataFrame(rows, columns=["asker", "lang", "data"])

    return counts.groupBy("range").cogroup(sought.groupBy("range")).applyInPandas(run, "asker int, lang string, data binary")


def _lowest_cut(words: tuple[bytes, ...], a: int, n_two: int, n: dict[tuple[bytes, ...], int]) -> tuple[int, int, int]:
    """(score, l, r) of the cut with the lowest score, the earlier one on ties; exact for any count."""
    cuts = []
    for k in range(1, len(words)):
        left = n_two if k == 2 else n[words[:k]]
        cuts.append((1_000_000 * a * a // (left * n[words[k:]]), k, left, n[words[k:]]))
    score, _, left, right = min(cuts)
    return score, left, right


def scored(counts: DataFrame, answers: DataFrame, inside: int) -> DataFrame:
    """(lang, phrase, a, l, r, score) of all phrases, and rows without a score: phrases that a longer one holds too often.

    A phrase goes if a longer one that holds it has at least `inside` hundredths of its count.
    """

    def run(have: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for lang, data in zip(have["lang"], have["data"]):
            parts = [thawed(d) for d in told["data"][told["lang"] == lang]]
            n: dict[tuple[bytes, ...], int] = {}
            for p in parts:
                v = len(p.words)
                n.update(((p.words[i],), c) for i, c in zip(p.one.tolist(), p.n_one.tolist()))
                n.update(((p.words[i // v], p.words[i % v]), c) for i, c in zip(p.two.tolist(), p.n_two.tolist()))
            for words, a, n_two in _phrases(thawed(data)):
                score, left, right = _lowest_cut(words, a, n_two, n)
                rows.append((lang, b" ".join(words).decode(), a, left, right, score))
                if len(words) == 3:
                    for part, f in ((words[:2], n_two), (words[1:], n[words[1:]])):
                        if 100 * a >= inside * f:
                            rows.append((lang, b" ".join(part).decode(), None, None, None, None))
        frame = pd.DataFrame(rows, columns=["lang", "phrase", "a", "l", "r", "score"])
        return frame.astype({c: "Int64" for c in ("a", "l", "r", "score")})

    asked = answers.withColumnRenamed("asker", "range")
    return counts.groupBy("range").cogroup(asked.groupBy("range")).applyInPandas(run, "lang string, phrase string, a bigint, l bigint, r bigint, score bigint")


def collocations(
    docs: DataFrame, lang: str = "lang", text: str = "text", least: int = 10, inside: int = 50, most: int | None = 2000, ranges: int | None = None,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): phrases of two and three words by language, by score, then count, then phrase.

    Texts are lower-cased in A-Z and cut into pieces at . , ; : ! ? and line ends, pieces into words at blanks and tabs.
    a is the phrase's count in all pieces, at least `least`; score is floor(1,000,000 a a / (l r)) of the cut into two parts
    with the lowest score (the earlier on ties), l and r the counts of these parts, n the words of the language. A phrase
    inside a longer one of at least `inside` hundredths of its count is left out. most: the report's length per
    language, None for all. Rows without a language are of language `und`; null and empty texts add nothing; repeated
    rows count as often as they come; equal scores, counts and phrases do not occur. Other columns are ignored. Empty in,
    empty out. ranges: how many ranges of prefixes there are, by default as many as there are shuffle partitions, more where
    one would hold over `PER_RANGE` words.
    """
    counts, at = phrase_counts(docs, lang, text, least, ranges)
    answers = cut(answered(counts, sought_parts(counts, at)), "parts")
    every = cut(scored(counts, answers, inside), "scored")
    release(answers)
    gone = every.filter(F.col("score").isNull()).select("lang", "phrase").distinct()
    kept = every.filter(F.col("score").isNotNull()).join(gone, ["lang", "phrase"], "left_anti")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    if most is not None:  # a language's first ones are among the first of its shares
        share = kept.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
        some = share.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order)))
        kept = some.filter(F.col("rank") <= most).drop("_salt", "rank")
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
    if most is not None:
        ranked = ranked.filter(F.col("rank") <= most)
    words = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    return lookup(ranked, words, "lang", "inner").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: DuckDB SQL for `collocations` over `documents`.
SQL = """WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
listed AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM piece),
gram AS (
  SELECT lang, k, phrase, count(*) AS f FROM (
    SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase
    FROM (SELECT lang, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM listed, (VALUES (1), (2), (3)) AS size(k) WHERE len(ws) >= k))
  GROUP BY lang, k, phrase),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM gram WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM gram WHERE k > 1 AND f >= 10),
halves AS (SELECT *, array_to_string(ws[1 : j], ' ') AS head, array_to_string(ws[j + 1 :], ' ') AS rest
  FROM (SELECT *, unnest(generate_series(1, k - 1)) AS j FROM cand)),
cuts AS (SELECT c.lang, c.phrase, c.a, c.j, x.f AS l, y.f AS r, (1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS score
  FROM halves c JOIN gram x ON x.lang = c.lang AND x.phrase = c.head JOIN gram y ON y.lang = c.lang AND y.phrase = c.rest),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
held AS (SELECT lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase, a FROM cand WHERE k = 3),
gone AS (SELECT DISTINCT h.lang, h.phrase FROM held h JOIN cand c USING (lang, phrase) WHERE 100 * h.a >= 50 * c.a),
kept AS (SELECT * FROM lowest l WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.lang = l.lang AND g.phrase = l.phrase)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000"""
