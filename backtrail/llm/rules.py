"""Quality rules: counts within a text, and lines that too many documents of one host share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backtrail.llm.common import cut, row_key

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """How many words lie in a window of `width` words that occurs twice or more, the first one included."""
    if len(words) <= width:
        return 0
    known: dict[bytes, int] = {}
    window = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    count = len(words) - width + 1
    code = window[:count]
    for k in range(1, width):  # name each window by a number, one word at a time, so that nothing overflows
        _, code = np.unique(code * len(known) + window[k : k + count], return_inverse=True)
    often = np.bincount(code)[code] > 1
    covered = np.zeros(len(words), bool)
    for k in range(width):
        covered[k : k + count] |= often
    return int(covered.sum())


def text_counts(text: str | None) -> tuple[tuple[int, ...], dict[int, int]]:
    """`COUNTS` of a text, and for each normalised line its hash -> the words that lines like it hold."""
    text = text or ""
    n_words, dup = 0, 0
    words: list[bytes] = []
    seen: set[bytes] = set()
    lines: dict[int, int] = {}
    for line in text.encode().split(b"\n"):
        own = line.split()
        if not own:
            continue
        dup += line in seen
        seen.add(line)
        words += own
        name = xxhash.xxh3_64_intdigest(b" ".join(own).lower()) - (1 << 63)
        lines[name] = lines.get(name, 0) + len(own)
    n_words = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    return (n_words, chars, sum(map(text.count, SYMBOLS)), dup, repeated_words(words)), lines


def counted(docs: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    """doc_id, host, row key, `COUNTS`, and lines: the distinct normalised lines as (line, words)."""
    rows = docs.select(F.col(doc_id).alias("_doc"), F.col(host).alias("_host"), *row_key(doc_id, text), F.col(text).alias("_body"))
    kept = ["_doc", "_host", "_id", "_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_counts(x.as_py()) for x in batch.column("_body")]
            columns = [pa.array([f[0][i] for f in found], pa.int64()) for i in range(len(COUNTS))]
            lines = pa.array([[{"line": k, "words": n} for k, n in f[1].items()] for f in found], pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns, lines], [*kept, *COUNTS, "lines"])

    types = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInArrow(run, f"{types}, {', '.join(f'{c} bigint' for c in COUNTS)}, lines array<struct<line:bigint,words:bigint>>")


def frequent_lines(each: DataFrame, least: int, share: float) -> DataFrame:
    """(_host, line) of lines in more than `least` documents of a host and more than `share` of them.

    each: (_host, _doc, line), every line once per row of a document. Documents are counted distinct.
    """
    often = each.distinct().groupBy("_host", "line").count().filter(F.col("count") > least)
    sizes = cut(each.select("_host", "_doc").distinct().groupBy("_host").agg(F.count("*").alias("size")), "hosts")
    often = cut(often, "often")
    same_host = often["_host"].eqNullSafe(sizes["_host"])
    return often.join(sizes, same_host).filter(F.col("count") > F.col("size") * share).select(often["_host"], "line")


def rules(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
    least_words: int = 50, most_repeated: float = 0.5, most_documents: int = 20, most_share: float = 0.0, left_over: float = 0.3,
) -> DataFrame:
    """doc_id, host, `COUNTS`, removed_lines, removed_words, base_failed, kept for every row of `docs`.

    A line is removed when more than `most_documents` documents of one host have it, whatever the host's size;
    `most_share` asks for more than that share of its documents besides. Lines are compared with A-Z lower-cased and
    white space collapsed.
    A document fails when it has under `least_words` words, when more than `most_repeated` of its
    words lie in repeated three-word windows, or when less than `left_over` of its words are left.
    A null text has no words. A null host is one host. Repeated rows come back as often as they
    are given, and count as one document. Other columns are ignored; an empty table gives none.
    """
    rows = cut(counted(docs, doc_id, text, host), "counted")
    lines = rows.select("_host", F.struct("_doc").alias("_doc"), "_id", "_text", F.explode("lines").alias("l")).select("_host", "_doc", "_id", "_text", "l.*")
    often = cut(frequent_lines(lines.select("_host", "_doc", "line"), most_documents, most_share), "frequent")
    flat = lines.withColumn("_at", F.coalesce(F.col("_host").cast("string"), F.lit(""))).withColumn("_none", F.col("_host").isNull())
    named = often.select(F.coalesce(F.col("_host").cast("string"), F.lit("")).alias("_at"), F.col("_host").isNull().alias("_none"), "line")
    gone = (
        flat.drop("_host", "_doc").join(named, ["_at", "_none", "line"], "left_semi").select("_id", "_text", "line", "words")
        .distinct().groupBy("_id", "_text").agg(F.count("*").alias("removed_lines"), F.sum("words").alias("removed_words"))
    )
    zero = F.lit(0).cast("bigint")
    joined = rows.drop("lines").join(gone, ["_id", "_text"], "left")
    removed = F.coalesce("removed_words", zero)
    failed = (F.col("n_words") < least_words) | (F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    depleted = F.col("n_words") - removed < left_over * F.col("n_words")
    return joined.select(
        F.col("_doc").alias(doc_id), F.col("_host").alias("host"), *COUNTS,
        F.coalesce("removed_lines", zero).alias("removed_lines"), removed.alias("removed_words"),
        failed.alias("base_failed"), (~failed & ~depleted).alias("kept"),
    )
