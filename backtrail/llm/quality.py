"""Quality scores learnt from trusted positives and unlabelled text, by the non-negative unbiased risk.

Every document becomes a short vector of shares and lengths in the task that reads it. The risk of a
linear score f with logistic loss is  prior * E_pos[loss(f)] + max(0, E_all[loss(-f)] - prior * E_pos[loss(-f)]):
unlabelled text, which is all text, stands for the negatives once the positives among it are
taken off. Each step sums the gradient over the whole table; a task sends one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backtrail.llm.common import cut

FEATURES = (
    "log_words", "mean_word", "symbols", "bars", "shouts", "capitals", "digits", "punctuation", "other_ascii",
    "distinct_words", "repeats", "top_word", "repeated_lines", "line_words", "stops", "wide",
)
UPPER, LOW, DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)
COUNTED = {"symbols": b"#$%&*<>", "bars": b"|", "shouts": b"!", "punctuation": b",;:?'\"()-", "stops": b"."}
LOSS_FLOOR = 1e-6


def features(text: str | None) -> np.ndarray:
    """`FEATURES` of a whole text: shares of characters and words, square roots so that small shares show."""
    raw = (text or "").encode()
    words = raw.split()
    out = dict.fromkeys(FEATURES, 0.0)
    if words:
        n, chars = len(words), sum(map(len, words))
        counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        letters = max(1, int(counts[UPPER].sum() + counts[LOW].sum()))
        lines = [x for x in raw.split(b"\n") if x.strip()]
        often: dict[bytes, int] = {}
        for w in words:
            often[w] = often.get(w, 0) + 1
        for name, some in COUNTED.items():
            out[name] = counts[list(some)].sum() / n
        printable = counts[33:127].sum() - counts[UPPER].sum() - counts[LOW].sum() - counts[DIGIT].sum()
        out |= {
            "mean_word": chars / n / 10, "capitals": counts[UPPER].sum() / letters, "digits": counts[DIGIT].sum() / chars,
            "other_ascii": printable / chars, "distinct_words": len(often) / n, "repeats": sum(map(eq, words, words[1:])) / n,
            "top_word": max(often.values()) / n, "repeated_lines": 1 - len(set(lines)) / len(lines), "line_words": len(lines) / n, "wide": counts[128:].sum() / chars,
        }
        out = {k: float(v) ** 0.5 for k, v in out.items()}
        out["log_words"] = np.log1p(n)
    return np.array([out[k] for k in FEATURES], np.float32)


def vectors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, x) for every row of `docs`, as a written table."""
    kept = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(b.as_py()) for b in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float32()))], ["_doc", "x"])

    return cut(kept.mapInArrow(run, f"_doc {kept.schema['_doc'].dataType.simpleString()}, x array<float>"), "features")


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last one is the constant
    prior: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(expanded(rows, self.mean, self.scale) @ self.weights, -30, 30)))


def expanded(rows: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features, the squares of their clipped values, and a constant."""
    z = np.clip((rows - mean) / scale, -8, 8)
    return np.hstack([z, np.minimum(z * z, 16) / 4, np.ones((len(z), 1))])


def _summed(table: DataFrame, of) -> np.ndarray:
    """Sum over all rows of what `of` gives for a block (x, positive); each task sends one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(float)
                part = of(x, batch.column(1).to_numpy(zero_copy_only=False).astype(bool))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total))), pa.array(total, pa.float64())], ["i", "v"])

    rows = table.select("x", "positive").mapInArrow(run, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    return np.array([r.v for r in sorted(rows)])


def fit(table: DataFrame, prior: float, steps: int = 30, rate: float = 0.4, decay: float = 1e-3) -> QualityModel | None:
    """Learn from (x, positive): `positive` marks the trusted rows, all rows stand for unlabelled text.

    prior: share of good text among all. Where the negative part of the risk is below zero it counts
    as zero and has no gradient. None without a positive or without any row.
    """
    size = len(FEATURES)
    sums = _summed(table, lambda x, p: np.concatenate([[len(x), p.sum()], x.sum(0), (x * x).sum(0)]))
    if not len(sums) or not sums[1]:
        return None
    n_all, n_pos = sums[0], sums[1]
    mean = sums[2 : 2 + size] / n_all
    scale = np.sqrt(np.maximum(sums[2 + size :] / n_all - mean**2, 1e-6))
    weights = np.zeros(2 * size + 1)
    weights[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, steps + 1):

        def gradients(x, p, weights=weights):
            z = expanded(x, mean, scale)
            f = np.clip(z @ weights, -30, 30)
            up = 1 / (1 + np.exp(-f))  # slope of loss(-f); that of loss(f) is up - 1
            low = np.log1p(np.exp(f))  # loss(-f)
            return np.concatenate([z.T @ up, z[p].T @ up[p], z[p].T @ (up[p] - 1), [low.sum(), low[p].sum()]])

        total = _summed(table, gradients)
        k = len(weights)
        all_neg, pos_neg, pos_pos = total[:k] / n_all, total[k : 2 * k] / n_pos, total[2 * k : 3 * k] / n_pos
        negative = total[-2] / n_all - prior * total[-1] / n_pos
        slope = prior * pos_pos + (all_neg - prior * pos_neg if negative > 0 else 0)
        slope = slope + decay * np.append(weights[:-1], 0)
        first, second = 0.8 * first + 0.2 * slope, 0.95 * second + 0.05 * slope**2
        move = first / (1 - 0.8**step) / (np.sqrt(second / (1 - 0.95**step)) + LOSS_FLOOR)
        weights = weights - rate * (1 - step / (steps + 1)) * move
    return QualityModel(mean, scale, weights, prior)


def estimated_prior(good: int, bad: int) -> float:
    """Share of good text among judged rows, by the rule of succession, so never 0 or 1."""
    return (good + 1) / (good + bad + 2)


def score(
    docs: DataFrame, labels: DataFrame, learn, doc_id: str = "doc_id", text: str = "text", label: str = "quality", prior: float | None = None,
) -> DataFrame:
    """(doc_id, score) for every row of `docs`; score is the estimated chance that the text is good.

    labels: (doc_id, label) of rows that may be learnt from, narrowed to those where `learn`, a condition on
    doc_id, holds. Only rows labelled 1 are positives; rows labelled 0 serve the estimate
    of the prior and nothing else, unless `prior` is given. A document labelled 1 and 0 counts as
    positive. Null labels and ids are no labels. Without a positive every score is the prior.
    Repeated rows and null ids are kept and scored; a null text is scored as an empty one.
    """
    known = labels.filter(learn & F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    known = cut(known.groupBy(F.col(doc_id).alias("_doc")).agg(F.max(label).alias("good")), "labels")
    if prior is None:
        counts = known.agg(F.count_if(F.col("good") == 1), F.count_if(F.col("good") != 1)).first()
        prior = estimated_prior(*counts)
    table = vectors(docs, doc_id, text)
    trusted = known.filter(F.col("good") == 1).select("_doc", F.lit(True).alias("positive"))
    marked = cut(table.join(trusted, "_doc", "left").select("_doc", "x", F.coalesce("positive", F.lit(False)).alias("positive")), "marked")
    model = fit(marked, prior)
    if model is None:
        return marked.select(F.col("_doc").alias(doc_id), F.lit(prior).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1).astype(float)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(rows), pa.float64())], ["_doc", "score"])

    shape = f"_doc {marked.schema['_doc'].dataType.simpleString()}, score double"
    return marked.select("_doc", "x").mapInArrow(run, shape).withColumnRenamed("_doc", doc_id)


def accept(docs: DataFrame, labels: DataFrame, learn, threshold: float = 0.7, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Rows of `docs` whose score is at least `threshold`, with all their columns. Texts move only if the join must."""
    found = score(docs, labels, learn, doc_id, text, **options)
    out = cut(found.groupBy(doc_id).agg(F.max("score").alias("_best")).filter(F.col("_best") < threshold).select(doc_id), "rejected")
    return docs.join(out, doc_id, "left_anti").select(*docs.columns)
