"""Packing of token pieces into sequences by bin completion.

Texts become token ids once, in the task that reads them. Only the lengths take part in packing: the
pieces are dealt by hash into shares of about `SHARE` tokens, and each share is packed by itself, so
there is no task that holds all pieces, and at most one sequence per share is lost to the split.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Iterator
from operator import attrgetter
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backtrail.llm.common import cut

CAPACITY = 4096
END = 1  # the id after each document
SHARE = 1 << 21  # tokens that are packed together
NODES = 5000  # steps of the search in a share after the first dive
MEMO = 1_000_000  # words of letters whose ids a Python worker remembers at once
WHOLE = 100_000  # the same for marks, and for words that are not of letters only
TEXTS = 4 << 20  # bytes of texts whose words are looked up together


# -- bin completion -------------------------------------------------------------------------------------


class Stock:
    """How many pieces there are of each length."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        self.counts = np.bincount(lengths, minlength=capacity + 1)
        self.steps = 0
        self.limit: float = float("inf")

    def take(self, sizes: list[int]) -> None:
        for s in sizes:
            self.counts[s] -= 1

    def give(self, sizes: list[int]) -> None:
        for s in sizes:
            self.counts[s] += 1

    def largest(self, room: int) -> int:
        """The largest length that fits; 0 if none does."""
        left = np.flatnonzero(self.counts[1 : room + 1])
        return int(left[-1]) + 1 if len(left) else 0

    def pair(self, room: int) -> list[int]:
        """One or two lengths that fill the room best, larger ones first among equals."""
        self.steps += 1
        sizes = np.flatnonzero(self.counts[: room + 1])
        sizes = sizes[sizes > 0]
        if not len(sizes):
            return []
        if sizes[-1] == room:
            return [room]
        counts = self.counts
        # for each length the largest other one that fits beside it
        at = np.searchsorted(sizes, np.minimum(sizes, room - sizes), "right") - 1
        alone = (at >= 0) & (sizes[np.maximum(at, 0)] == sizes) & (counts[sizes] < 2)
        at = at - alone
        total = sizes + np.where(at >= 0, sizes[np.maximum(at, 0)], 0)
        best = len(total) - 1 - int(np.argmax(total[::-1]))
        return [int(sizes[best])] + ([int(sizes[at[best]])] if at[best] >= 0 else [])


def best_filling(stock: Stock, room: int) -> list[int]:
    """A filling with little waste: large pieces while there is room for many, then the best triple."""
    chosen: list[int] = []
    while room:
        top = stock.largest(room)
        if not top:
            break
        if room > 3 * top:
            chosen.append(top)
            stock.take([top])
            room -= top
            continue
        found = stock.pair(room)
        if sum(found) < room:
            sizes = np.flatnonzero(stock.counts[: room + 1])[::-1]
            for first in sizes[sizes > 0][:40].tolist():
                stock.take([first])
                tried = [first, *stock.pair(room - first)]
                stock.give([first])
                if sum(tried) > sum(found):
                    found = tried
                    if sum(found) == room:
                        break
        chosen += found
        stock.take(found)
        room -= sum(found)
    stock.give(chosen)
    return chosen


def fillings(stock: Stock, room: int) -> Iterator[list[int]]:
    """The best filling first, then the other undominated ones, until the stock's limit of steps.

    A filling is dominated if a piece that is left fits beside it, or in place of a smaller one.
    """
    first = best_filling(stock, room)
    yield first
    seen = {tuple(sorted(first))}
    sizes = [s for s in np.flatnonzero(stock.counts[: room + 1])[::-1].tolist() if s]

    def extend(at: int, left: int, chosen: list[int]) -> Iterator[list[int]]:
        fits = False
        for i in range(at, len(sizes)):
            s = sizes[i]
            if s <= left and stock.counts[s]:
                fits = True
                stock.steps += 1
                if stock.steps > stock.limit:
                    return
                stock.counts[s] -= 1
                yield from extend(i, left - s, [*chosen, s])
                stock.counts[s] += 1
        if not fits and not any(stock.largest(c + left) > c for c in set(chosen)) and not stock.largest(left):
            yield chosen

    for other in extend(0, room, []):
        if tuple(sorted(other)) not in seen:
            seen.add(tuple(sorted(other)))
            yield other


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each piece goes to the fullest bin that has room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = np.zeros(capacity + 1, np.int64)
    for s in sorted(lengths, reverse=True):
        fit = np.flatnonzero(rooms[s:])
        if len(fit):
            room = s + int(fit[0])
            b = by_room[room].pop()
            rooms[room] -= 1
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(s)
        by_room[room - s].append(b)
        rooms[room - s] += 1
    return bins


def pack_lengths(lengths: list[int], capacity: int = CAPACITY, nodes: int | None = None) -> list[list[int]]:
    """Bins of lengths (1 to capacity), as few as the search finds.

    Bin completion: the largest piece left opens a bin, which branches over the undominated fillings
    around it. The best-fit solution is the incumbent; a branch is left as soon as its waste shows
    that it can't beat the incumbent. The search ends at the lower bound, or `nodes` steps after the
    first dive, and then gives the incumbent.
    """
    if not len(lengths):
        return []
    nodes = NODES if nodes is None else nodes
    total = int(sum(lengths))
    bound = max(-(-total // capacity), sum(2 * s > capacity for s in lengths))
    best = best_fit(lengths, capacity)
    if len(best) == bound:
        return best
    stock = Stock(np.asarray(lengths), capacity)
    path: list[tuple[list[int], int, Iterator[list[int]]]] = []  # (bin, waste so far, further fillings)
    bins, waste = [], 0
    fresh = True
    while True:
        if fresh:
            top = stock.largest(capacity)
            if not top:
                if len(bins) < len(best):
                    best = [list(b) for b in bins]
                    if len(best) == bound:
                        return best
                fresh = False
                continue
            stock.take([top])
            path.append(([top], waste, fillings(stock, capacity - top)))
        if not path:
            return best
        head, before, more = path[-1]
        if len(bins) == len(path):  # come back to this bin: undo its filling
            stock.give(bins.pop()[1:])
        filling = next(more, None)
        if not fresh:
            stock.limit = min(stock.limit, stock.steps + nodes)
        if stock.steps > stock.limit:
            return best
        if filling is None:
            path.pop()
            stock.give(head)
            fresh = False
            continue
        waste = before + capacity - head[0] - sum(filling)
        if waste > (len(best) - 1) * capacity - total:
            fresh = False
            continue
        stock.take(filling)
        bins.append([*head, *filling])
        fresh = True


def placed(ids: np.ndarray, lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; pieces of one length are taken in the order of their ids."""
    order = np.lexsort((ids, lengths))
    queues = {int(s): iter(order[a:b]) for s, a, b in _runs(lengths[order])}
    bins, offsets = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    for b, sizes in enumerate(pack_lengths(lengths.tolist(), capacity)):
        at = 0
        for s in sizes:
            i = next(queues[s])
            bins[i], offsets[i] = b, at
            at += s
    return bins, offsets


def _runs(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    edges = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
    return ((values[a], a, b) for a, b in itertools.pairwise(edges) if b > a)


# -- on Spark ---------------------------------------------------------------------------------------------


def byte_letters() -> dict[int, str]:
    """The printable character by which byte-level vocabularies write each byte, by byte as Latin-1 code."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


FEW = [struct.Struct(f"<{n}I").pack for n in range(17)]


def little(ids: list[int]) -> bytes:
    return FEW[len(ids)](*ids) if len(ids) < len(FEW) else struct.pack(f"<{len(ids)}I", *ids)


ID = attrgetter("id")
LETTERS = byte_letters()
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())


class Words(dict):
    """Ids of lower-case words of letters, as little-endian 32-bit bytes; None for any other text without white space.

    A word of letters only goes to the model as it is, and marks that follow a word are a word of their own, as the tokenizer
    splits them; everything else goes through the whole tokenizer (`whole`). Remembers up to `MEMO` words: the newer half, and
    the half before it until it is full.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.older: dict[bytes, bytes | None] = {}
        self.others: dict[bytes, bytes] = {}

    def __missing__(self, low: bytes) -> bytes | None:
        out = self.older[low] if low in self.older else self.letters(low)
        if len(self) >= MEMO // 2:
            self.older = dict(self)
            self.clear()
        self[low] = out
        return out

    def letters(self, low: bytes) -> bytes | None:
        """Ids of a word of letters, A-Z lower-cased; None if it is something else, or its lower case or composed form is in doubt."""
        text = low.decode()
        if not low.isalpha():
            if not low:
                return low
            if not text.isalpha() or "\u03a3" in text or not is_normalized("NFC", text):
                return None
            text = text.lower()
            if not text.isalpha():
                return None
            text = text.encode().decode("latin-1").translate(LETTERS)
        return little(list(map(ID, self.model.tokenize(text))))

    def whole(self, word: bytes) -> bytes:
        """Ids of any text without white space."""
        if word not in self.others:
            if len(self.others) >= WHOLE:
                self.others.clear()
            self.others[word] = little(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids)
        return self.others[word]


WORDS: dict[str, Words] = {}


def as_bytes(texts: pa.Array) -> list[bytes]:
    return texts.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()


def strung(units: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of units in the order of `codes`, and how many ids each brings; `units` lie one after the other, `sizes` ids each."""
    counts = sizes[codes]
    # from the place of a unit's first id in the result to that among the units
    shift = (np.cumsum(sizes) - sizes)[codes] - (np.cumsum(counts) - counts)
    return units[np.arange(counts.sum()) + np.repeat(shift, counts)], counts


def spelled_ids(words: Words, spelled: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of words as they are written, one after the other, and how many each has."""
    core = pc.ascii_rtrim(spelled, characters=MARKS.decode())
    low = pc.ascii_lower(core).dictionary_encode()
    units = list(map(words.__getitem__, as_bytes(low.dictionary)))
    first, second = low.indices.to_numpy().astype(np.int64), np.full(len(spelled), len(units))
    strange = np.array([u is None for u in units], bool)[first]
    units = [u or b"" for u in units] + [b""]
    size = pc.binary_length(core).to_numpy()
    marked = np.flatnonzero((pc.binary_length(spelled).to_numpy() > size) & ~strange)
    tails = [word[n:] for word, n in zip(as_bytes(spelled.take(pa.array(marked))), size[marked].tolist())]
    at = {tail: len(units) + i for i, tail in enumerate(dict.fromkeys(tails))}
    units += map(words.whole, at)
    second[marked] = np.fromiter(map(at.__getitem__, tails), np.int64, len(tails))
    first[strange] = len(units) + np.arange(strange.sum())
    units += map(words.whole, as_bytes(spelled.filter(pa.array(strange))))
    sizes = np.fromiter(map(len, units), np.int64, len(units)) // 4
    ids, counts = strung(np.frombuffer(b"".join(units), "<u4"), sizes, np.stack([first, second], 1).ravel())
    return ids, counts.reshape(-1, 2).sum(1)


def all_ids(words: Words, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of whole texts, each followed by the end id, one text after the other, and where each text ends.

    The tokenizer drops white space and never joins over it. Each different word is looked up once.
    """
    split = pc.ascii_split_whitespace(texts.fill_null(""))
    coded = split.flatten().dictionary_encode()
    ids, sizes = spelled_ids(words, coded.dictionary)
    after = np.cumsum(pc.list_value_length(split).to_numpy())  # words up to the end of each text
    codes = np.insert(coded.indices.to_numpy(), after, len(sizes))
    found, counts = strung(np.append(ids, np.uint32(END)), np.append(sizes, 1), codes)
    return found, np.cumsum(counts)[after + np.arange(len(after))]


def token_ids(words: Words, text: str | None) -> np.ndarray:
    """The ids of a whole text and the end id."""
    return all_ids(words, pa.array([text], pa.string()))[0]


def slices(texts: pa.Array, most: int = TEXTS) -> Iterator[tuple[int, int]]:
    """(start, rows) of runs of texts with at most `most` bytes each; a longer text is a run of its own."""
    size = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy().astype(np.int64))
    start = 0
    while start < len(size):
        before = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, before + most, "right")))
        yield start, end - start
        start = end


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenised(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Pieces of every row of `docs`: uid, doc_id, piece, start, length, ids, as a written table.

    A row's ids and the end id are cut into pieces of `capacity`, the last of which may be shorter.
    A null or empty text is the end id alone. Repeated rows are rows of their own; a null id is
    kept; other columns are ignored. uid tells pieces apart. The vocabulary must drop white space.
    """
    vocabulary = vocabulary or default_vocabulary()
    names = ["uid", "doc_id", "piece", "start", "length", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in WORDS:
            WORDS[vocabulary] = Words(vocabulary)
        words = WORDS[vocabulary]
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at, size in slices(batch.column(1)):
                some = batch.slice(at, size)
                ids, ends = all_ids(words, some.column(1))
                tokens = np.diff(ends, prepend=0)
                pieces = -(-tokens // capacity)
                rows = np.repeat(np.arange(size), pieces)
                number = np.arange(len(rows)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                starts = number * capacity
                lengths = np.minimum(tokens[rows] - starts, capacity)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(uid, uid + len(rows))), some.column(0).take(pa.array(rows)), pa.array(number, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths), lists],
                    names,
                )
                uid += len(rows)

    id_type = docs.schema[doc_id].dataType.simpleString()
    shape = f"uid bigint, doc_id {id_type}, piece int, start bigint, length bigint, ids array<int>"
    return cut(docs.select(F.col(doc_id).alias("doc_id"), text).mapInArrow(run, shape), "pieces")


def layout(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(uid, sequence_id, offset) for pieces (uid, length): where each piece lies. Lengths are 1 to capacity."""
    total = pieces.agg(F.sum("length")).first()[0] or 0
    shares = -(-total // SHARE) or 1

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        bins, offsets = placed(frame["uid"].to_numpy(), frame["length"].to_numpy(), capacity)
        return pd.DataFrame({"uid": frame["uid"], "sequence_id": (int(frame["share"].iloc[0]) << 32) + bins, "offset": offsets})

    dealt = pieces.select("uid", "length", F.pmod(F.xxhash64("uid"), F.lit(shares)).alias("share"))
    return dealt.groupBy("share").applyInPandas(run, "uid bigint, sequence_id bigint, offset bigint")


def packed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Every piece of `docs` with its ids, sequence_id and offset; see `tokenised` and `layout`.

    The pieces of a sequence follow each other without a gap from offset 0. Which texts share a
    sequence depends on lengths alone.
    """
    pieces = tokenised(docs, doc_id, text, capacity, vocabulary)
    return pieces.join(cut(layout(pieces.select("uid", "length"), capacity), "layout"), "uid")


def ids_crc32(ids: str) -> Column:
    """crc32 of the ids as little-endian 32-bit numbers."""

    @F.pandas_udf("bigint")
    def of(column: pd.Series) -> pd.Series:
        return column.map(lambda x: zlib.crc32(np.asarray(x, "<u4").tobytes()))

    return of(ids)
