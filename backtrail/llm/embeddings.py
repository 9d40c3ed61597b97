"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products, one kept row per group.

Only vectors with equal labels are compared. Equal vectors meet in one class first. A vector is at home in the
cell of its nearest centroid. It also visits each cell whose border it is close enough to for a linked
vector to lie beyond: for unit x, y with cosine of at least t, x nearest to c and y nearest to d,
y . (d - c) <= sqrt(1 - t^2) |d - c|. So every link of a vector is found in its home cell. Rows of a cell are
dealt over blocks of about `BLOCK` rows, and each task compares one block of home rows with one block of the
cell. What leaves a task is a count per home row and links that connect what is linked, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backtrail.llm.common import cut, sampled
from backtrail.llm.graph import components, forest
from backtrail.llm.language import spherical_kmeans, unit

BLOCK = 1024
SAMPLE = 2_000_000  # bound of the numbers in the vectors that the centroids are learnt from
MOST_CELLS = 4_096  # bound of the centroids that every task holds
PER_CELL = 16_384  # vectors per cell that the number of cells aims at
SLACK = 1e-9


def classes(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> tuple[DataFrame, DataFrame]:
    """(rows, distinct): rows (vec_id, class) of every vector; one (class, size, label, vector) per class.

    Rows are distinct by id first. A class is the smallest id among equal vectors of one label. Vectors that link
    with nothing have no class: null, zero, with null or non-finite numbers, without label or id.
    """
    single = vectors.schema[embedding].dataType.simpleString() == "array<float>"
    numbers = F.col(embedding).cast("array<float>" if single else "array<double>")
    plain = vectors.select(F.col(vec_id).cast("bigint").alias("id"), F.col(label).cast("string").alias("lab"), numbers.alias("v")).distinct()
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    usable = F.col("id").isNotNull() & F.col("lab").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    marked = plain.withColumn("ok", F.coalesce(usable, F.lit(False)))
    good = marked.filter("ok")
    first = cut(good.groupBy("lab", "v").agg(F.min("id").alias("class"), F.count_distinct("id").alias("size")), "vectors")
    rows = good.join(first, ["lab", "v"]).select("id", "class").distinct().union(marked.filter("not ok").select("id", F.lit(None).cast("bigint")))
    return cut(rows, "rows"), first


def learn_centroids(first: DataFrame, dimensions: int, cells: int) -> np.ndarray:
    """Centroids of a sample of about `SAMPLE` / dimensions vectors of this length."""
    fit = first.filter(F.size("v") == dimensions)
    some = sampled(fit, "class", max(1000, SAMPLE // dimensions), fit.count()).select("class", "v").collect()
    return spherical_kmeans(units(np.array([r.v for r in sorted(some)], float)), cells)


def units(rows: np.ndarray) -> np.ndarray:
    """Rows as unit vectors in double precision; scaled first, so that squares stay finite."""
    return unit(rows / np.abs(rows).max(axis=1, keepdims=True))


def _placed(first: DataFrame, centroids: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """(class, size, lab, v, cell, home) once for each cell that a vector lives in or visits."""
    reach = np.sqrt(1 - threshold * threshold) + SLACK
    gaps = {d: np.sqrt(np.maximum(2 - 2 * c @ c.T, 0)) for d, c in centroids.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(v) for v in batch.column(3)])
            for d in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == d)
                v = batch.column(3).take(pa.array(at)).flatten().to_numpy().reshape(-1, d).astype(float)
                cosine = units(v) @ centroids[d].T
                home = cosine.argmax(axis=1)
                own = cosine[np.arange(len(v)), home]
                visits = own[:, None] - cosine <= reach * gaps[d][home]
                visits[np.arange(len(v)), home] = True
                row, cell = np.nonzero(visits)
                picked = batch.take(pa.array(at[row]))
                yield pa.RecordBatch.from_arrays(
                    [*picked.columns, pa.array(cell + d * MOST_CELLS), pa.array(cell == home[row])],
                    ["class", "size", "lab", "v", "cell", "home"],
                )

    kind = first.schema["v"].dataType.simpleString()
    return first.select("class", "size", "lab", "v").mapInArrow(run, f"class bigint, size bigint, lab string, v {kind}, cell bigint, home boolean")


def _compared(placed: DataFrame, threshold: float) -> DataFrame:
    """(a, b, n): with b null, n linked vectors of class a found by one task; else a link of a and b."""
    counts = cut(placed.groupBy("lab", "cell").agg(F.count_if("home").alias("homes"), F.count("*").alias("all")).filter("homes > 0"), "cells")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    sized = placed.join(counts, ["lab", "cell"]).withColumn("i", F.pmod(F.xxhash64("class", F.lit(1)), blocks("homes"))).withColumn("j", F.pmod(F.xxhash64("class", F.lit(2)), blocks("all")))
    base = ["lab", "cell", "class", "size", "v"]
    home = sized.filter("home").select(*base, "i", F.explode(F.sequence(F.lit(0), blocks("all") - 1)).alias("j"), F.lit(True).alias("home"))
    every = sized.select(*base, F.explode(F.sequence(F.lit(0), blocks("homes") - 1)).alias("i"), "j", F.lit(False).alias("home"))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        homes, others = frame[frame["home"]], frame[~frame["home"]]
        if homes.empty or others.empty:
            return pd.DataFrame({"a": [], "b": [], "n": []}).astype({"a": "int64", "b": "Int64", "n": "int64"})
        a, b = homes["class"].to_numpy(), others["class"].to_numpy()
        x, y = (units(np.stack(side["v"].to_numpy()).astype(float)) for side in (homes, others))
        near = x @ y.T >= threshold
        near &= a[:, None] != b[None, :]
        n = near @ others["size"].to_numpy()
        some = np.flatnonzero(n)
        x, y = forest(*(side[k] for side, k in zip((a, b), np.nonzero(near))))
        ends = pd.array([None] * len(some) + y.tolist(), "Int64")
        return pd.DataFrame({"a": np.concatenate([a[some], x]), "b": ends, "n": np.concatenate([n[some], np.zeros(len(x), np.int64)])})

    pairs = home.select("lab", "cell", "i", "j", "class", "size", "v", "home").unionByName(every)
    return pairs.groupBy("lab", "cell", "i", "j").applyInPandas(compare, "a bigint, b bigint, n bigint")


def near_duplicates(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = 0.93, cells: int | None = None,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every vector, linked where cosine >= threshold (0 < threshold < 1).

    n_links counts other vectors linked directly; component_id is the smallest vec_id that links reach;
    kept marks the one row of a group that stays. Vectors that are null or zero, that hold null or
    non-finite numbers, or have no label link with nothing; vectors of different length don't link.
    Repeated rows are returned once. A vec_id that comes with several vectors is returned once, with
    the links of each of them added up. A row with a null vec_id has no links and is kept. Other
    columns are ignored. Empty in, empty out.
    cells: number of centroids, by default one for `PER_CELL` vectors, at most `MOST_CELLS`.
    """
    rows, first = classes(vectors, vec_id, embedding, label)
    per = {r[0]: r[1] for r in first.groupBy(F.size("v")).count().collect()}  # vectors by length
    centroids = {d: learn_centroids(first, d, cells or min(MOST_CELLS, -(-n // PER_CELL) + 1)) for d, n in per.items()}
    found = cut(_compared(cut(_placed(first, centroids, threshold), "placed"), threshold), "compared")
    linked = found.filter(F.col("b").isNull()).groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("n"))
    roots = components(found.filter(F.col("b").isNotNull()).select("a", "b").union(_same_id(rows)))
    named = first.select("class", "size").groupBy("class").agg(F.max("size").alias("size"))
    named = named.join(linked, "class", "left").join(roots, F.col("class") == F.col("node"), "left")
    named = cut(named.select("class", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("root", "class").alias("component")), "named")
    loose = rows.filter(F.col("id").isNull()).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("class").alias("component"))
    joined = rows.filter(F.col("id").isNotNull()).join(named, "class", "left").groupBy("id").agg(F.coalesce(F.sum("n_links"), F.lit(0)).alias("n_links"), F.min("component").alias("component"))
    component = F.coalesce("component", "id")
    return joined.union(loose).select(
        F.col("id").alias(vec_id), F.col("n_links").cast("bigint").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def _same_id(rows: DataFrame) -> DataFrame:
    """Links of classes that one id belongs to."""
    several = rows.groupBy("id").agg(F.min("class").alias("b"), F.max("class").alias("high")).filter("b != high").select("id", "b")
    return rows.join(several, "id").select(F.col("class").alias("a"), "b").filter("a != b")


#: DuckDB SQL for `near_duplicates` over `embeddings`.
SQL = """WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e,
    coalesce(label IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
      AND list_bool_or(list_transform(embedding, lambda x: x <> 0)), false) AS ok FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.ok AND b.ok AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM low LEFT JOIN n USING (vec_id)"""
