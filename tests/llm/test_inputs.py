"""Every operator on the awkward inputs: nulls, empty and very long texts, repeated rows, clashing columns, no rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from headwise.llm import (
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
)

OWN = "_source _copy _doc _key _gone _text _lines _toxicity _near_id _near_row _w _h _p size copies".split()
LONG = ["x" * 300_000, "word " * 40_000, "a\n" * 40_000, "QUJD" * 50_000]


@pytest.fixture(scope="module")
def awkward(spark):
    texts = [None, "", " \n", "½ ² Ⅳ", "x² ǅ", "the same text here again", "the same text here again", *LONG]
    rows = [(i, t, "en" if i % 2 else None, ["s", None][i % 2]) for i, t in enumerate(texts)]
    rows += [rows[5], (None, "no name at all", "en", "s"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit("99x") for c in OWN}).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 1), (None, 1, 1), (77, None, None)], "doc_id long, quality int, toxic int")


def _stages(spark, df, labels):
    """What each operator makes of the documents, and how many rows of them it must return (None: it may drop some)."""
    n = df.count()
    benchmark = spark.createDataFrame([("b", "the same text here again"), (None, None)], "item_id string, text string")
    model = toxicity.train(df, labels)
    found = language_id.train(df)
    return {
        "mix": (source_mix.mix(df), n),
        "emit": (source_mix.emit(df), None),
        "near": (near_dedup.components(df), n),
        "representatives": (near_dedup.representatives(df), None),
        "benchmark": (decontaminate.scan(df, benchmark), n),
        "language": (df.select("*", language_id.predict(F.col("text"), found).alias("p")), n),
        "clean": (toxicity.clean(df, model), None),
        "lines": (line_dedup.remove_runs(df), n),
        "quality": (quality_rules.judge(df, labels), n),
        "substrings": (substring_dedup.remove_repeats(df), n),
        "counts": (token_counts.count(df, corpus_pipeline.public_tokenizers.path("piece_bpe_32k.model")), n),
    }


def test_awkward_documents(spark, awkward, labels):
    results = _stages(spark, awkward, labels)
    for name, (df, n) in results.items():
        rows = df.collect()
        assert n is None or len(rows) == n, name
        if name in ("emit", "representatives", "clean"):
            assert df.columns == awkward.columns, name
        for own in set(OWN) & set(df.columns) - ({"size", "copies"} if name == "mix" else set()):
            assert {r[own] for r in rows} == {"99x"}, (name, own)
    predicted = {r.text: r.p for r in results["language"][0].collect()}
    assert predicted["½ ² Ⅳ"] == ("und", 0.0) and predicted[None] == ("und", 0.0) and predicted["x² ǅ"].lang_pred == "en"
    kept = [r.text for r in results["representatives"][0].collect()]
    assert kept.count("the same text here again") == 1


def test_no_documents(spark, awkward, labels):
    for name, (df, _) in _stages(spark, awkward.limit(0), labels).items():
        assert df.collect() == [], name


def test_nothing_to_learn_languages_from(spark, awkward):
    model = language_id.train(awkward.withColumn("lang", F.lit(None).cast("string")))
    got = awkward.select(language_id.predict(F.col("text"), model).alias("p")).collect()
    assert {tuple(r.p) for r in got} == {("und", 0.0)}


def test_token_files_of_awkward_documents(spark, awkward, tmp_path):
    tokenizer = corpus_pipeline.public_tokenizers.path("word_bpe_49k.json")
    for df in (awkward, awkward.limit(0)):
        path = str(tmp_path / str(df.count()))
        token_files.write(df, path, tokenizer)
        assert token_files.read(spark, path).count() == df.count()


def test_texts_go_to_workers_in_small_batches(spark):
    storage.small_batches(spark)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").startswith(str(storage.BATCH_BYTES))
    sizes = F.pandas_udf(lambda x: x.map(lambda _: len(x)), "long")
    most = spark.range(400, numPartitions=1).select(sizes(F.repeat(F.lit("x"), 100_000)).alias("n")).agg(F.max("n")).first()[0]
    assert most < 100
