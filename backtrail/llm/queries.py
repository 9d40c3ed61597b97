"""The queries of the corpus operators, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from backtrail.llm import chat, codes, embeddings, language, licenses, mixing, packing, phrases, quality, rules, secret_scan, simhash, toxicity
from backtrail.llm.common import fold, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return add


@query("op5_simhash_near_duplicates")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, folder, "documents"))
    return found.withColumn("fingerprint", F.lpad(F.lower(F.hex("fingerprint")), 16, "0"))


@query("op2_secret_scans", secret_scan.sql())
def op2(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.scan(read(spark, folder, "documents"))
    ranks = F.transform("base", lambda s: s["rank"])
    counts = [
        (F.size("base") - F.size(F.array_remove(ranks, rank))).cast("bigint").alias(f"n_{kind}")
        for rank, kind in enumerate(secret_scan.KINDS[:3])
    ]
    live = F.size(F.filter("spans", lambda s: s["live"])).cast("bigint")
    return found.select(
        "doc_id", *counts, F.sha2(secret_scan.written("base"), 256).alias("base_sha256"), secret_scan.written("spans").alias("spans"), live.alias("n_live")
    )


@query("op10_best_fit_packing")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.tokenised(read(spark, folder, "documents"))
    digest = pieces.select("uid", "doc_id", "piece", "start", "length", packing.ids_crc32("ids").alias("ids_crc32"))
    return digest.join(packing.layout(pieces.select("uid", "length")), "uid").drop("uid")


@query("op6_quality_rules")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    found = rules.rules(read(spark, folder, "documents"))
    return found.select("doc_id", *rules.COUNTS, "base_failed", "kept", "removed_lines", "removed_words")


@query("op8_language_id")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = fold("doc_id", 3) == 1
    model = language.fit(docs.filter(~held_out))
    return language.identify(docs, model).withColumn("held_out", held_out)


@query("op9_quality_classifier")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    held_out = fold("doc_id", 4) == 2
    found = quality.score(read(spark, folder, "documents"), read(spark, folder, "labels"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op4_toxicity")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs, held_out = read(spark, folder, "documents"), fold("doc_id", 4) == 2
    found = toxicity.score(docs, toxicity.fit(docs, read(spark, folder, "labels"), ~held_out))
    neighbours = F.concat_ws(",", F.transform("evidence", lambda e: e["example"].cast("string")))
    return found.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), neighbours.alias("neighbours")
    )


@query("op1_embedding_near_duplicates", embeddings.SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_duplicates(read(spark, folder, "embeddings"))


#: Shares of the tokens by label, quality and toxicity, that the mixture shall have.
DOMAIN_WEIGHTS = {"q1t0": 0.8, "q1t1": 0.06, "q0t0": 0.12, "q0t1": 0.02}


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labelled rows."""
    return labels.select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string")).alias("domain"))


@query("op3_mixing_to_targets")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    mixed, _ = mixing.mix(read(spark, folder, "documents"), label_domains(read(spark, folder, "labels")), DOMAIN_WEIGHTS)
    return mixed.select("doc_id", "n_rows", "tokens", "posterior", "rate")


@query("op7_chat_preferences", chat.SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return chat.preferences(*chat.swapped_answers(read(spark, folder, "conversations")))


@query("op11_vector_code_compression", codes.SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    found, books = codes.compressed(read(spark, folder, "embeddings"))
    digest = F.lit(codes.sha256_of(books)).alias("codebooks_sha256")
    return found.select("vec_id", codes.code_text("codes").alias("code"), "error", "label_error", digest)


@query("op12_license_scans", licenses.sql())
def op12(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan(read(spark, folder, "documents"))
    starts, base = F.transform("places", lambda p: p["word"]), F.transform("places", lambda p: p["label"])
    method, contained = F.transform("blocks", lambda b: b["label"]), F.transform("blocks", lambda b: b["containment"])
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        listed(base).alias("base_labels"), listed(F.concat(base, method)).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max(contained), F.lit(0.0))).alias("score"),
        F.size("blocks").cast("bigint").alias("n_blocks"),
    )


@query("op13_phrase_collocations", phrases.SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(read(spark, folder, "documents"))
