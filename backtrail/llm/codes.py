"""Compression of vectors to short codes: a codebook per part, learnt by Lloyd's rounds that follow active entries.

Components become whole numbers, vectors are cut into equal parts, and each part position has its own codebook.
All arithmetic is exact. A round writes, next to each vector, the entry that each of its parts is assigned to and the
exact squared distance to it. In the next round a part whose entry stayed where it was compares only the entries that
moved against that stored distance: no other entry can have come nearer. The other parts are compared with the whole
codebook. Ties go to the lower index in both ways. Only the codebooks and the sums of their parts pass the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backtrail.llm.common import cut, release
from backtrail.operators.lookups import lookup

EXACT = 1 << 53  # whole numbers up to here are exact in double precision
STATE = "_id, _lab, _q, _codes, _dists"


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all entries, as int64."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    if x.shape[1] * 4 * most * most < EXACT:  # every sum below is a whole number under 2^53
        x, book = x.astype(float), book.astype(float)
    squares = (x * x).sum(axis=1)[:, None] + (book * book).sum(axis=1)
    return (squares - 2 * (x @ book.T)).astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry, the lower index on ties."""
    found = distances(x, book)
    at = found.argmin(axis=1)
    return at, found[np.arange(len(x)), at]


def reassigned(x: np.ndarray, book: np.ndarray, moved: np.ndarray, code: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As `nearest`, from the last assignment to a codebook in which the `moved` entries were elsewhere."""
    code, dist = code.copy(), dist.copy()
    active = np.flatnonzero(moved)
    rescan = moved[code]
    if rescan.any():
        code[rescan], dist[rescan] = nearest(x[rescan], book)
    fixed = np.flatnonzero(~rescan)
    if len(fixed) and len(active):
        at, near = nearest(x[fixed], book[active])
        at = active[at]
        closer = (near < dist[fixed]) | ((near == dist[fixed]) & (at < code[fixed]))
        code[fixed[closer]], dist[fixed[closer]] = at[closer], near[closer]
    return code, dist


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), width)


def whole_numbers(vectors: DataFrame, vec_id: str, embedding: str, label: str, parts: int, scale: int) -> tuple[DataFrame, int]:
    """(rows, dimensions): rows (_id, _lab, _q), _q being floor(scale * x) of the vectors that can be cut into equal parts."""
    plain = vectors.select(F.col(vec_id).alias("_id"), F.col(label).alias("_lab"), F.col(embedding).cast("array<double>").alias("_v"))
    finite = ~F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = plain.filter(F.col("_v").isNotNull() & finite & (F.size("_v") > 0) & (F.size("_v") % parts == 0))
    first = usable.select(F.size("_v").alias("n"), "_id").groupBy("n").agg(F.min("_id").alias("_id")).orderBy(F.col("_id").asc_nulls_last(), "n").first()
    if first is None:
        return usable.select("_id", "_lab", F.col("_v").cast("array<bigint>").alias("_q")), 0
    most = isqrt((1 << 60) // first.n)  # beyond it the distance of two vectors could pass 64 bits
    floors = F.transform("_v", lambda x: F.greatest(F.least(F.floor(F.greatest(F.least(x, F.lit(float(most))), F.lit(float(-most))) * scale), F.lit(most)), F.lit(-most)))
    return usable.filter(F.size("_v") == first.n).select("_id", "_lab", floors.cast("array<bigint>").alias("_q")), first.n


def first_entries(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    """Codebooks (part, entry, component) of the vectors with the smallest ids; of vectors that share an id the smallest counts."""
    ids = [r[0] for r in rows.select("_id").distinct().orderBy(F.col("_id").asc_nulls_last()).limit(entries).collect()]
    chosen = F.col("_id").isin([i for i in ids if i is not None])
    some = rows.filter(chosen | F.col("_id").isNull() if None in ids else chosen)
    vectors = some.groupBy("_id").agg(F.min("_q").alias("_q")).orderBy(F.col("_id").asc_nulls_last()).collect()
    start = np.array([r["_q"] for r in vectors], np.int64)
    return start.reshape(len(start), parts, -1).transpose(1, 0, 2)


def _assign(rows: DataFrame, books: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """`rows` with the entry of every part, and the distances to them; `moved` is None in the first round."""
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            q = _matrix(batch.column(2), parts * width, np.int64).reshape(n, parts, width)
            if moved is None:
                found = [nearest(q[:, p], books[p]) for p in range(parts)]
            else:
                codes = _matrix(batch.column(3), parts, np.int64)
                dists = _matrix(batch.column(4), parts, np.int64)
                found = [reassigned(q[:, p], books[p], moved[p], codes[:, p], dists[:, p]) for p in range(parts)]
            codes, dists = (np.stack(side, axis=1).ravel() for side in zip(*found))
            ends = pa.array(np.arange(n + 1, dtype=np.int32) * parts)
            made = [pa.ListArray.from_arrays(ends, pa.array(codes, pa.int16())), pa.ListArray.from_arrays(ends, pa.array(dists, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], STATE.split(", "))

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("_id", "_lab")}
    return rows.mapInArrow(run, f"_id {kinds['_id']}, _lab {kinds['_lab']}, _q array<bigint>, _codes array<smallint>, _dists array<bigint>")


def _means(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks with every used entry replaced by floor(sum / count) of its parts."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            q = _matrix(batch.column(0), parts * width, np.int64).reshape(-1, width)
            at = (_matrix(batch.column(1), parts, np.int64) + np.arange(parts) * entries).ravel()
            np.add.at(sums, at, q)
            counts += np.bincount(at, minlength=len(counts))
        used = np.flatnonzero(counts)
        slot, component = np.repeat(used, width), np.tile(np.arange(width), len(used))
        columns = [slot, component, sums[used].ravel(), np.repeat(counts[used], width)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["slot", "component", "total", "n"])

    each = state.select("_q", "_codes").mapInArrow(run, "slot bigint, component bigint, total bigint, n bigint")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    out = books.copy().reshape(parts * entries, width)
    for r in each.groupBy("slot", "component").agg(exact("total"), exact("n")).collect():
        out[r.slot, r.component] = int(r.total) // int(r.n)
    return out.reshape(books.shape)


def sha256_of(books: np.ndarray) -> str:
    """Hash of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
    parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256,
) -> tuple[DataFrame, np.ndarray]:
    """(rows, codebooks): rows (vec_id, label, codes array, error long, label_error long), codebooks (part, entry, component).

    codes has the index of each part's entry (entries <= 32,767); error is the squared distance over all parts in whole
    numbers, label_error its sum over rows with an equal label, those without a label together. Dropped are vectors
    that are null, hold null or non-finite numbers, or cannot be cut into equal parts: empty ones, lengths that are no
    multiple of `parts`, lengths other than that of the vector with the smallest id. Numbers so large that a
    distance could pass 64 bits (beyond isqrt(2^60 / dimensions) after scaling) count as that bound. A null vec_id is
    kept and comes last in the order of ids. Repeated rows are returned as often as they come and weigh that often. With
    fewer ids than entries the codebooks are smaller. label_error stops at the largest long. Other columns are
    ignored. Empty in, empty out, with empty codebooks.
    """
    rows, dimensions = whole_numbers(vectors, vec_id, embedding, label, parts, scale)
    named = [F.col("_id").alias(vec_id), F.col("_lab").alias(label)]
    if not dimensions:
        columns = {"codes": "array<smallint>", "error": "bigint", "label_error": "bigint"}
        return rows.select(*named, *[F.lit(None).cast(kind).alias(c) for c, kind in columns.items()]).limit(0), np.zeros((parts, 0, 0), np.int64)
    books = first_entries(rows, parts, entries)
    state = cut(_assign(rows, books, None), "assigned")
    for _ in range(rounds):
        after = _means(state, books)
        before, state = state, cut(_assign(state, after, (after != books).any(axis=2)), "assigned")
        release(before)
        books = after
    error = F.aggregate("_dists", F.lit(0).cast("bigint"), lambda a, d: a + d)
    # the null label is a key of its own
    key = [F.col("_lab").isNull().alias("_none"), F.coalesce(F.col("_lab").cast("string"), F.lit("")).alias("_key")]
    found = state.select("_id", "_lab", "_codes", error.alias("error"), *key)
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("bigint")
    sums = found.groupBy("_none", "_key").agg(total.alias("label_error"))
    return lookup(found, sums, ["_none", "_key"], "inner").select(*named, F.col("_codes").alias("codes"), "error", "label_error"), books


def code_text(codes: str):
    """The indexes as two hex digits each, in the order of the parts."""
    return F.array_join(F.transform(codes, lambda c: F.lower(F.lpad(F.hex(c.cast("bigint")), 2, "0"))), "")


def _sql_assigned(name: str, book: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT r, p, min(o).e AS e, min(o).d AS d FROM (
  SELECT x.r, x.p, {{'d': list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': c.e}} AS o
  FROM x JOIN {book} c USING (p)) GROUP BY r, p)"""


def _sql_moved(name: str, book: str, assigned: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.v, c.v) AS v FROM {book} c LEFT JOIN (
  SELECT p, e, list(f ORDER BY i) AS v FROM (
    SELECT p, e, i, floor(sum(v[i])::DOUBLE / count(*))::BIGINT AS f
    FROM (SELECT x.p, a.e, x.v, unnest(generate_series(1, len(x.v))) AS i FROM x JOIN {assigned} a USING (r, p)) GROUP BY p, e, i)
  GROUP BY p, e) m USING (p, e))"""


#: DuckDB SQL for the digest of `compressed` over `embeddings`: 16 parts, 64 entries, two rounds.
SQL = f"""WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
x AS MATERIALIZED (SELECT r, p, q[p * (len(q) // 16) + 1 : (p + 1) * (len(q) // 16)] AS v FROM (SELECT *, unnest(generate_series(0, 15)) AS p FROM kept)),
c0 AS MATERIALIZED (SELECT p, r - 1 AS e, v FROM x WHERE r <= 64),
{_sql_assigned("a0", "c0")},
{_sql_moved("c1", "c0", "a0")},
{_sql_assigned("a1", "c1")},
{_sql_moved("c2", "c1", "a1")},
{_sql_assigned("a2", "c2")},
coded AS (SELECT r, string_agg(lpad(lower(hex(e)), 2, '0'), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY r),
books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (r) CROSS JOIN books"""
