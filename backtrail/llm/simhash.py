"""Near-duplicates by SimHash fingerprints, found with pigeonhole blocks.

`fingerprints` makes one 64-bit fingerprint per text. Two fingerprints link when they differ in at
most n bits. Split into n + 2 blocks, such a pair agrees in at least two of them, so it shares one
key of two whole blocks. Fingerprints that share a key are compared; a key with more
than `BUCKET` fingerprints is not compared at once but split again: the bits that the key leaves open
are cut into n + 2 blocks in their turn, and so on until at most eight bits are open, when a key
holds at most 256 different fingerprints. Where a key still has more than `ROWS` rows, as many second fingerprints
can share few first ones, its rows are dealt over pairs of blocks, so that no task holds a whole key. No pair is lost.

A second fingerprint of wider shingles can be asked to agree as well: the first one finds the pairs, the
second one verifies them. Near copies whose wide shingles agree by 0.8 differ in up to a dozen bits there,
too many for blocks, but in few bits of the fingerprint of their words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backtrail.llm.common import cut
from backtrail.llm.graph import components, forest
from backtrail.operators.rows import one_per_key

BUCKET = 256  # fingerprints of one key that are compared with each other
ROWS = 4096  # rows of one key that are compared in one place; more are dealt over pairs of blocks
CHUNK = 1 << 16  # shingles whose bits are unpacked at once
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, width: int = 3) -> int:
    """Bit b is set if it is set in over half the XXH64 hashes (seed 42) of the word shingles.

    Words are cut at ASCII white space after A-Z are lower-cased; shingles count as often as they
    occur. Fewer words than `width` make one shingle, no word or a null text gives 0. As signed.
    """
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends - 1).tolist()[width - 1 :] or [len(joined)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, stops)), "<u8", len(stops))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, second: int | None = None) -> DataFrame:
    """(key, fingerprint, second) as longs for every row; second is 0 unless its width is given. Texts stay in their task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(x.as_py(), width) for x in batch.column(1)]
            wide = [fingerprint(x.as_py(), second) for x in batch.column(1)] if second else [0] * len(prints)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64()), pa.array(wide, pa.int64())], [key, "fingerprint", "second"])

    kept = docs.select(key, text)
    return kept.mapInArrow(run, f"`{key}` {kept.schema[key].dataType.simpleString()}, fingerprint bigint, second bigint")


# -- pigeonhole blocks --------------------------------------------------------------------------------


def _masks(open_bits: list[int], bits: int) -> list[tuple[int, list[int]]]:
    """Ways to fix two of bits + 2 blocks of the open bits: (the bits fixed, the bits still open)."""
    blocks = [b.tolist() for b in np.array_split(open_bits, bits + 2)]
    return [
        (sum(1 << b for b in blocks[i] + blocks[j]), [b for k, block in enumerate(blocks) if k not in (i, j) for b in block])
        for i, j in combinations(range(len(blocks)), 2)
    ]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _keyed(rows: DataFrame, ways: dict[int, tuple[int, list[int]]]) -> DataFrame:
    """Each row once per way: `path` names the way, `key` holds the bits it fixes. Rows with a path take its sub-ways."""
    below: dict[int, list[tuple[int, int]]] = {}
    for path, (mask, _) in ways.items():
        below.setdefault(path // 100, []).append((path, _signed(mask)))
    rooted = rows if "path" in rows.columns else rows.withColumn("path", F.lit(1).cast("bigint"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = batch.column(3).to_numpy()
            for path in np.unique(before).tolist():
                some = batch.filter(pa.array(before == path))
                fp = some.column(0).to_numpy()
                for sub, mask in below[path]:
                    named = pa.array(np.full(len(fp), sub, np.int64))
                    yield pa.RecordBatch.from_arrays([*some.columns[:3], named, pa.array(fp & mask)], ["fp", "second", "id", "path", "key"])

    return rooted.select("fp", "second", "id", "path").mapInArrow(run, "fp bigint, second bigint, id bigint, path bigint, key bigint")


def _sizes(rows: DataFrame, second_bits: int) -> DataFrame:
    """(path, key, prints, n) of keys with more than `BUCKET` different fingerprints or more than `ROWS` rows."""
    each = rows.groupBy("path", "key", "fp").agg(F.count("*").alias("n")) if second_bits else rows.select("path", "key", F.lit(1).alias("n"))
    counted = each.groupBy("path", "key").agg(F.count("*").alias("prints"), F.sum("n").alias("n"))
    return cut(counted.filter((F.col("prints") > BUCKET) | (F.col("n") > ROWS)), "sizes")


def _dealt(rows: DataFrame, crowded: DataFrame) -> DataFrame:
    """`rows` with a column pair: rows of one path, key and pair are compared with each other.

    crowded: (path, key, n) of keys with more than `ROWS` rows. Such a key has n / `ROWS` blocks; a row of block i is in
    the pairs of i with each other block. Any two rows of the key meet in at least one pair of blocks.
    """
    parts = crowded.select("path", "key", F.ceil(F.col("n") / ROWS).alias("parts"))
    own = F.pmod(F.xxhash64("fp", "second", "id"), F.col("parts"))
    pair = F.least("own", "other") * F.col("parts") + F.greatest("own", "other")
    columns = ["fp", "second", "id", "path", "key"]
    spread = rows.join(parts, ["path", "key"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    spread = spread.filter(F.col("own") != F.col("other")).select(*columns, pair.alias("pair"))
    return rows.join(crowded, ["path", "key"], "left_anti").select(*columns, F.lit(0).cast("bigint").alias("pair")).unionByName(spread)


def _linked(bits: int, second_bits: int):
    """Compare the rows of each key and pair, which follow each other; gives links that connect what is linked."""

    def links(path, key, pair, fp, second, ids):
        a, b = [], []
        step = 1
        while step < len(fp):
            same = np.flatnonzero((key[step:] == key[:-step]) & (path[step:] == path[:-step]) & (pair[step:] == pair[:-step]))
            if not len(same):
                break
            apart, wide = (np.bitwise_count((x[same] ^ x[same + step]).view(np.uint64)) for x in (fp, second))
            hit = same[(apart <= bits) & (wide <= second_bits)]
            a.append(ids[hit])
            b.append(ids[hit + step])
            step += 1
        return forest(np.concatenate(a), np.concatenate(b)) if a else (ids[:0], ids[:0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            now = [batch.column(c).to_numpy() for c in ("path", "key", "pair", "fp", "second", "id")]
            if left is not None:
                now = [np.concatenate(x) for x in zip(left, now)]
            # the last pair of blocks may go on in the next batch; it holds few rows
            ends = np.flatnonzero((now[1][1:] != now[1][:-1]) | (now[0][1:] != now[0][:-1]) | (now[2][1:] != now[2][:-1]))
            whole = int(ends[-1]) + 1 if len(ends) else 0
            left = [x[whole:] for x in now]
            a, b = links(*(x[:whole] for x in now))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        if left is not None:
            a, b = links(*left)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def close_links(prints: DataFrame, bits: int = 2, second_bits: int = 0) -> DataFrame:
    """Links (a, b) that connect all ids whose fingerprints differ in at most `bits` bits, and second ones in at most `second_bits`.

    prints: (fp long, second long, id long), each pair of fingerprints once, no nulls. bits is 0 to 8.
    """
    if not 0 <= bits <= 8:
        raise ValueError("blocks find pairs of at most eight differing bits")
    ways = {100 + i: w for i, w in enumerate(_masks(list(range(64)), bits))}  # a sub-way's number goes on with two digits
    rows, cold = _keyed(prints, ways), []
    while True:
        sizes = _sizes(rows, second_bits)
        crowded = sizes.filter(F.col("n") > ROWS).select("path", "key", "n")
        if len(next(iter(ways.values()))[1]) <= 8:  # at most 256 fingerprints to a key
            cold.append(_dealt(rows, crowded))
            break
        # splitting a key can part different fingerprints only
        hot = sizes.filter(F.col("prints") > BUCKET).select("path", "key")
        if hot.isEmpty():
            cold.append(_dealt(rows, crowded))
            break
        cold.append(_dealt(rows.join(hot, ["path", "key"], "left_anti").select("fp", "second", "id", "path", "key"), crowded))
        reached = {r.path for r in hot.select("path").distinct().collect()}
        ways = {100 * p + i: (m | n, o) for p, (m, still) in ways.items() if p in reached for i, (n, o) in enumerate(_masks(still, bits))}
        rows = cut(_keyed(rows.join(hot, ["path", "key"], "left_semi"), ways), "rekeyed")
    every = reduce(DataFrame.unionByName, cold)
    dealt = every.repartition("path", "key", "pair").sortWithinPartitions("path", "key", "pair")
    return dealt.mapInArrow(_linked(bits, second_bits), "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, bits: int = 2, second: int | None = None, second_bits: int = 0,
) -> DataFrame:
    """(key, fingerprint long, component_id) for every row of `docs`.

    Fingerprints within `bits` bits link; with `second`, the width of wider shingles, only where those
    fingerprints are within `second_bits` bits too. component_id is the smallest key
    that links reach, the row's own included. Equal texts meet in one fingerprint before anything is compared. Repeated rows
    are returned as often as they come; a key that comes
    with several texts has the links of each of them. A row without a key
    is returned with its fingerprint and a null component_id, and links with nothing. Keys are
    whole numbers. Other columns are ignored; an empty table gives an empty result.
    """
    rows = cut(fingerprints(docs.select(F.col(key).cast("bigint").alias("_key"), F.col(text).alias("_text")), "_key", "_text", width, second), "prints")
    known = rows.filter(F.col("_key").isNotNull())
    prints = cut(known.groupBy(F.col("fingerprint").alias("fp"), "second").agg(F.min("_key").alias("id")), "classes")
    roots = components(close_links(prints, bits, second_bits))
    named = cut(
        prints.join(roots, F.col("id") == F.col("node"), "left").select(F.col("fp").alias("fingerprint"), "second", F.coalesce("root", "id").alias("component_id")),
        "named",
    )
    found = known.join(named, ["fingerprint", "second"]).select(F.col("_key").alias(key), "fingerprint", "component_id")
    loose = rows.filter(F.col("_key").isNull()).select(F.col("_key").alias(key), "fingerprint", F.lit(None).cast("bigint").alias("component_id"))
    return found.union(loose)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """`docs` with one document of each group of near-duplicates: the one with the smallest key.

    how: as for `near_duplicates`. All columns are kept. Rows without a key stay. Of rows with the same key one stays.
    """
    found = cut(near_duplicates(docs, key, text, **how), "grouped")
    gone = found.filter(F.col(key) != F.col("component_id")).select(key).distinct()
    kept = docs.join(gone, key, "left_anti").select(*docs.columns)
    repeated = found.groupBy(key).count().filter((F.col("count") > 1) & F.col(key).isNotNull()).select(key)
    repeated = cut(repeated, "repeated")
    if repeated.isEmpty():
        return kept
    return kept.join(repeated, key, "left_anti").select(*docs.columns).union(one_per_key(kept.join(repeated, key, "left_semi").select(*docs.columns), key, []))
