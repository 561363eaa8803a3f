"""The registered queries of the operators, over whole tables, and their SQL counterparts."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headwise.llm import (
    chat_format,
    decontaminate,
    language_id,
    line_dedup,
    near_dedup,
    quality_rules,
    source_mix,
    storage,
    substring_dedup,
    token_counts,
    token_files,
    toxicity,
    training,
    vector_codes,
    vector_file,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.rotate(_table(spark, sf_dir, "conversations"))


def mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = source_mix.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.components(_table(spark, sf_dir, "documents"), percent=85)


def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = decontaminate.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return scanned.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").withColumn("held_out", training.held_out(3, 1))
    model = language_id.train(documents.where("not held_out"))
    return documents.select("doc_id", "held_out", language_id.predict(F.col("text"), model).alias("p")).select(
        "doc_id", "held_out", "p.lang_pred", "p.score"
    )


def toxic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").withColumn("held_out", training.held_out(4, 2))
    labels = _table(spark, sf_dir, "labels").where(~training.held_out(4, 2))
    model = toxicity.train(documents.where("not held_out"), labels)
    scored = documents.select("doc_id", "held_out", toxicity.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{storage.folder(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    ids = token_files.read(spark, path)
    return ids.select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.remove_runs(_table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(text, 256).alias("kept_sha256"))


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )


def substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"), window=35)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = vector_file.cluster(_table(spark, sf_dir, "embeddings"))
    found = storage.staged(found, "clusters")
    names = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    digests = spark.createDataFrame(names, "cluster int, centroid_sha256 string")
    # A row for each cluster.
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = found.agg(F.sum("distance").alias("inertia"))
    return found.join(F.broadcast(sums.join(digests, "cluster")), "cluster").withColumn("inertia", total.scalar())


def token_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    return token_counts.count(_table(spark, sf_dir, "documents"), path).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.encode(_table(spark, sf_dir, "embeddings"))
    found = vector_codes.with_label_errors(storage.staged(coded, "codes"))
    return found.select("vec_id", "code", "error", "label_error").withColumn("codebooks_sha256", F.lit(vector_codes.digest(books)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": perspectives,
    "op2_source_mix": mixture,
    "op3_near_dedup": near_duplicates,
    "op4_decontaminate": contamination,
    "op5_language_id": languages,
    "op6_toxicity": toxic_documents,
    "op7_token_files": token_ids,
    "op8_line_dedup": lines,
    "op9_quality_rules": quality,
    "op10_substring_dedup": substrings,
    "op11_vector_file": clusters,
    "op12_token_counts": token_numbers,
    "op13_vector_codes": codes,
}

ORACLES: dict[str, str] = {
    "op1_chat_format": chat_format.ORACLE,
    "op2_source_mix": source_mix.ORACLE,
    "op4_decontaminate": decontaminate.ORACLE,
    "op8_line_dedup": line_dedup.ORACLE,
    "op11_vector_file": vector_file.ORACLE,
    "op13_vector_codes": vector_codes.ORACLE,
}
