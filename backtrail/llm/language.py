"""Language of a text by nearest centroid: TF-IDF character n-grams, several centroids per language.

Character 2- and 3-grams are hashed into `DIMENSIONS` places. Document frequencies come from all learning
rows, folded per task. The vectors of a bounded sample per language are clustered by spherical
k-means, each language in a task of its own. A text goes to the language of the centroid with the
largest cosine; it is rejected when it is further from there than nearly all learning texts are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backtrail.llm.common import cut, hash_share

DIMENSIONS = 4096
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"
PIECE = 1 << 20  # characters that are hashed at once


def ngrams(text: str) -> np.ndarray:
    """Counts of the hashed 2- and 3-grams of a whole text, lower-cased; what isn't a letter is one space."""
    counts = np.zeros(DIMENSIONS, np.int64)
    text = f" {text.lower()} "
    for at in range(0, len(text), PIECE):
        codes = np.frombuffer(text[max(0, at - 2) : at + PIECE].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        codes = np.where((codes < 128) & ~((codes > 96) & (codes < 123)), np.uint64(32), codes)
        new = 2 if at else 0  # the last two characters of the piece before are there for context
        two = codes[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
        three = two[:-1] * np.uint64(0x165667B19E3779F9) + codes[2:] * np.uint64(0x27D4EB2F165667C5)
        for grams, skip in ((two, max(0, new - 1)), (three, 0)):
            places = (grams[skip:] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - 12)
            counts += np.bincount(places.astype(np.int64), minlength=DIMENSIONS)
    return counts


def has_letter(text: str | None) -> bool:
    return text is not None and LETTER.search(text) is not None


def unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=-1, keepdims=True)
    return rows / np.where(length > 0, length, 1)


def spherical_kmeans(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Up to `k` unit centroids of unit rows; starts from the rows furthest from those chosen so far."""
    chosen = [0]
    near = rows @ rows[0]
    while len(chosen) < min(k, len(rows)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, rows @ rows[chosen[-1]])
    centroids = rows[chosen]
    for _ in range(rounds):
        at = np.argmax(rows @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, at, rows)
        used = np.bincount(at, minlength=len(centroids)) > 0
        centroids = unit(sums[used])
    return centroids


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    floors: np.ndarray  # least cosine of each centroid's language
    idf: np.ndarray

    def vector(self, text: str) -> np.ndarray:
        return unit(np.sqrt(ngrams(text)) * self.idf)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, cosine of the nearest centroid, rejected)"""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, True
        cosine = self.centroids @ self.vector(text)
        best = int(np.argmax(cosine))
        return self.languages[best], float(min(1.0, max(0.0, cosine[best]))), bool(cosine[best] < self.floors[best])


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", clusters: int = 4, sample: int = 300, floor_share: float = 0.01) -> LanguageModel:
    """Learn from all rows of `docs` that have a language and a letter.

    `sample` is about how many different texts per language are clustered, chosen by a hash of the text, each once
    however many copies it has; all of them where there are no more. Document frequencies are those of all rows. `floor_share` of a language's sample lies below
    its least cosine. With no such rows the model knows no language.
    """
    named = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("_body"), F.col(lang).cast("string").alias("_lang"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(DIMENSIONS, np.int64), 0
        per_lang: dict[str, int] = {}
        for batch in batches:
            for body, name in zip(batch.column(0), batch.column(1)):
                if has_letter(body.as_py()):
                    df += ngrams(body.as_py()) > 0
                    rows += 1
                    per_lang[name.as_py()] = per_lang.get(name.as_py(), 0) + 1
        names = [None] * DIMENSIONS + list(per_lang)
        places = [*range(DIMENSIONS), *[-1] * len(per_lang)]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(places), pa.array([*df.tolist(), *per_lang.values()], pa.int64())], ["name", "place", "n"])

    counts = named.mapInArrow(frequencies, "name string, place bigint, n bigint").groupBy("name", "place").agg(F.sum("n").alias("n")).collect()
    rows = {r.name: r.n for r in counts if r.place < 0}
    df = np.zeros(DIMENSIONS)
    for r in counts:
        if r.place >= 0:
            df[r.place] = r.n
    idf = np.log((1 + sum(rows.values())) / (1 + df)) + 0.1
    if not rows:
        return LanguageModel([], np.zeros((0, DIMENSIONS)), np.zeros(0), idf)

    spark = docs.sparkSession
    hashed = named.withColumn("_hash", F.xxhash64("_body"))

    def lettered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([has_letter(b.as_py()) for b in batch.column(2)], pa.bool_())).select(["_lang", "_hash"])

    # copies of a text are one text
    distinct = hashed.select("_lang", "_hash", "_body").mapInArrow(lettered, "_lang string, _hash bigint").distinct()
    rates = cut(distinct.groupBy("_lang").agg((F.lit(float(sample)) / F.count("*")).alias("_rate")), "rates")
    chosen = hashed.join(F.broadcast(rates), "_lang").filter(hash_share([F.col("_body")]) < F.col("_rate"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()  # of the sample, which is bounded
        for batch in batches:
            keep = []
            for i, (name, code, body) in enumerate(zip(*batch.columns)):
                place = (name.as_py(), code.as_py())
                if place not in seen and has_letter(body.as_py()):
                    seen.add(place)
                    keep.append(i)
            found = [np.sqrt(ngrams(batch.column(2)[i].as_py())).astype(np.float32) for i in keep]
            some = [c.take(pa.array(keep, pa.int32())) for c in batch.columns[:2]]
            yield pa.RecordBatch.from_arrays([*some, pa.array(found, pa.list_(pa.float32()))], ["lang", "hash", "tf"])

    def cluster(frame: pd.DataFrame) -> pd.DataFrame:
        rows = unit(np.stack(frame["tf"].to_numpy()).astype(float) * idf)
        rows = rows[np.lexsort(rows[:, :8].T)]  # the same start whatever the order of the rows
        centroids = spherical_kmeans(rows, clusters)
        floor = float(np.quantile((rows @ centroids.T).max(axis=1), floor_share)) - 1e-9
        return pd.DataFrame({"lang": frame["lang"].iloc[0], "floor": floor, "centroid": list(centroids)})

    sampled = chosen.select("_lang", "_hash", "_body").mapInArrow(vectors, "lang string, hash bigint, tf array<float>").dropDuplicates(["lang", "hash"])
    found = sampled.groupBy("lang").applyInPandas(cluster, "lang string, floor double, centroid array<double>").collect()
    found = sorted(found, key=lambda r: (r.lang, r.centroid))
    return LanguageModel([r.lang for r in found], np.array([r.centroid for r in found]), np.array([r.floor for r in found]), idf)


def identify(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every row of `docs`.

    lang_pred is the language of the nearest centroid, `und` when the text is null or has no letter;
    score is its cosine, 0 for `und`. rejected tells that the text is `und` or too far from every
    centroid. Repeated rows and null ids are kept; other columns are ignored.
    """
    kept = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(b.as_py()) for b in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())],
                ["_doc", "lang_pred", "score", "rejected"],
            )

    shape = f"_doc {kept.schema['_doc'].dataType.simpleString()}, lang_pred string, score double, rejected boolean"
    return kept.mapInArrow(run, shape).withColumnRenamed("_doc", doc_id)
