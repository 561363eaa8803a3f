"""A training corpus from raw documents: clean, deduplicate, decontaminate, mix, write as token ids.

Each stage takes what its predecessor kept and is written to the folder that all executors share. run() gives the
documents as read back from the token files.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headwise.llm import decontaminate, near_dedup, source_mix, storage, token_files, toxicity, training


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that a model of the labelled ones (three of four folds) calls toxic."""
    learned = ~training.held_out(4, 2)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(learned)
    return toxicity.clean(docs, toxicity.train(docs.where(learned), labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dedup.representatives(docs, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold passages of the benchmark."""
    return decontaminate.without_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the target weights of the sources take it."""
    return source_mix.emit(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and from them a row for each document of the mix."""
    path = f"{storage.folder(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read(spark, path).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("token_ids", write_tokens),
]

#: Learned models, similarity components and token ids have no SQL form; the operators' own tests stand in.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = storage.staged(stage(spark, docs, sf_dir), name)
    return docs
