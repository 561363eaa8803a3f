"""Operators whose queries have no SQL, or none for hot groups, against plain versions."""

from __future__ import annotations

import itertools
import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
import regex
from pyspark.sql import functions as F

from headwise.llm import chat_format, language_id, quality_rules, source_mix, toxicity, training


def test_a_hot_conversation_equals_its_sql(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "PART_ROWS", 20)
    rnd = random.Random(4)
    rows = [(1 if i % 3 else None, rnd.randrange(600), rnd.choice(["ann", "bob", "system", None]), f"text {i} é") for i in range(700)]
    rows += rows[:50] + [(2, 0, "cy", None), (2, 1, "ann", "")]
    got = chat_format.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64"})  # noqa: F841
    names = ["conv_id", "part", "piece", "perspective", "n_turns", "text", "mask"]
    want = duckdb.sql(f"SELECT {', '.join(names)} FROM ({chat_format._oracle(20)})").fetchall()
    assert len({r[2] for r in want}) > 5
    assert sorted(map(str, (tuple(r) for r in got.select(names).collect()))) == sorted(map(str, want))


def enumerated_kernel(s: str, t: str) -> float:
    """The kernel from its definition: every pair of equal subsequences, weighted by all characters each spans."""

    def spans(word: str) -> dict[str, list[int]]:
        found: dict[str, list[int]] = {}
        for places in itertools.combinations(range(len(word)), toxicity.LENGTH):
            found.setdefault("".join(word[i] for i in places), []).append(places[-1] - places[0] + 1)
        return found

    left, right = spans(s), spans(t)
    return sum(toxicity.DECAY ** (a + b) for key in left.keys() & right.keys() for a in left[key] for b in right[key])


def test_kernel_equals_direct_enumeration():
    rnd = random.Random(7)
    words = ["^" + "".join(rnd.choice("abcé") for _ in range(rnd.randrange(0, 8))) for _ in range(40)] + ["^", "^a", "^ab", "^idiot", "^id.iot"]
    got = toxicity.kernel(words, words[:12])
    want = np.array([[enumerated_kernel(a, b) for b in words[:12]] for a in words])
    assert np.allclose(got, want, rtol=1e-4, atol=1e-6)
    assert np.allclose(toxicity.own(words), [enumerated_kernel(w, w) for w in words], rtol=1e-4, atol=1e-6)


def test_comparison_filter_loses_no_similar_word():
    """Words made from landmarks by inserting, dropping and changing characters: what is left out is below FLOOR."""
    rnd = random.Random(8)
    marks = ["^" + "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(4, 12))) for _ in range(25)]
    words = set()
    for _ in range(4000):
        word = list(rnd.choice(marks)[1:])
        for _ in range(rnd.randrange(4)):
            i = rnd.randrange(len(word) + 1)
            kind = rnd.randrange(3)
            word[i : i + (kind > 0)] = [rnd.choice("abcdefghij")] if kind < 2 else []
        words.add("^" + "".join(word)[: toxicity.PIECE - 1])
    words = sorted(words)
    scale = toxicity.own(marks)
    norm = np.sqrt(np.maximum(toxicity.own(words), 1e-12)[:, None] * scale[None, :])
    value = toxicity.kernel(words, marks) / norm
    full = np.where(value >= toxicity.FLOOR, value, 0)
    got = toxicity.similarity(words, marks, scale)
    lost = (full > 0) & (got == 0)
    assert (full > 0).sum() > 1000
    assert lost.mean() < 0.0005 and (not lost.any() or full[lost].max() < toxicity.FLOOR + 0.1)
    assert np.allclose(got[~lost], full[~lost], atol=1e-4)


def plain_languages(texts, langs):
    """Log frequencies of all words and n-grams that occur twice, from one loop over the texts."""
    words: dict = {}
    grams: list[dict] = [{} for _ in range(language_id.ORDER)]
    names = sorted(set(langs))
    for text, lang in zip(texts, langs, strict=True):
        for word in regex.findall(r"\p{L}+", text.lower()):
            words.setdefault(word, [0] * len(names))[names.index(lang)] += 1
            padded = f"<{word}>"
            for order in range(1, language_id.ORDER + 1):
                for i in range(max(len(padded) - order + 1, 1)):
                    grams[order - 1].setdefault(padded[i : i + order], [0] * len(names))[names.index(lang)] += 1

    def logs(table):
        kept = {k: np.array(v) + language_id.SMOOTHING for k, v in table.items() if sum(v) > 1}
        total = sum(kept.values())
        return {k: np.log(v) - np.log(total) for k, v in kept.items()}

    found: dict = {}
    for table in grams:
        found |= logs(table)
    return names, logs(words), found


def test_languages_are_learned_and_told_like_plain_ones(spark):
    rnd = random.Random(9)
    letters = {"aa": "abcdé", "bb": "cdefg", "cc": "aegxy"}
    rows = []
    for i in range(120):
        lang = rnd.choice(sorted(letters))
        rows.append((i, " ".join("".join(rnd.choice(letters[lang]) for _ in range(rnd.randrange(1, 6))) for _ in range(rnd.randrange(1, 30))), lang))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df)
    names, words, grams = plain_languages([r[1] for r in rows], [r[2] for r in rows])
    assert model.languages == names
    assert set(model.words) == set(words) and set(model.grams) == set(grams)
    for own, plain in ((model.words, words), (model.grams, grams)):
        assert all(np.allclose(model.table[row], plain[key]) for key, row in own.items())

    def scored(text):
        total, count = np.zeros(len(names)), 0
        for word in regex.findall(r"\p{L}+", text.lower()):
            count += 1
            if word in words:
                total += words[word]
                continue
            padded, found = f"<{word}>", []
            for i in range(len(padded)):
                hits = [padded[i:e] for e in range(min(i + language_id.ORDER, len(padded)), i, -1) if padded[i:e] in grams]
                found += [grams[hits[0]]] if hits else []
            if found:
                total += sum(found) / len(found)
        if not count:
            return "und", 0.0
        level = total * min(count, language_id.EVIDENCE) / count
        share = np.exp(level - level.max())
        return names[int(level.argmax())], float(1 / share.sum())

    new = ["abc cde! xyz", "unseenword éa", "gg", "12 ½", "", "A1b2c", "xx " * 100]
    asked = spark.createDataFrame([(t,) for t in new], "text string")
    got = {r.text: tuple(r.p) for r in asked.select("text", language_id.predict(F.col("text"), model).alias("p")).collect()}
    for text in new:
        lang, score = scored(text)
        assert got[text][0] == lang and got[text][1] == pytest.approx(score, abs=1e-9)


def test_quality_scores_equal_plain_ones(spark):
    """The score and the verdict from counts in plain Python, with the buckets that Spark names for each n-gram."""
    rnd = random.Random(10)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "x,"]
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 80))) for _ in range(60)] + [None, "", "one"]
    rows = list(enumerate(texts))
    labels = [(i, int(i % 3 == 0)) for i in range(40)] + [(None, 1), (999, 1)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    judged = quality_rules.judge(documents, spark.createDataFrame([(*r, 0) for r in labels], "doc_id long, quality int, toxic int"))
    split = documents.select("doc_id", quality_rules._buckets(quality_rules.words(F.col("text"))).alias("b")).collect()
    buckets = {r.doc_id: list(r.b or []) for r in split}
    trusted = {i for i, q in labels if q == 1}
    raw = np.zeros(quality_rules.BUCKETS) + quality_rules.SMOOTHING
    target = raw.copy()
    for i, own in buckets.items():
        for b in own:
            raw[b] += 1
            target[b] += i in trusted
    for r in judged.collect():
        own = buckets[r.doc_id]
        n = len((r.text or "").split())
        assert len(own) == n + max(n - 1, 0)
        if not own:
            assert r.score == 0.0
            continue
        expected = []
        for part in (np.arange(0, quality_rules.BUCKETS, 2), np.arange(1, quality_rules.BUCKETS, 2)):  # words, pairs
            ratio = np.log(target[part] / target[part].sum()) - np.log(raw[part] / raw[part].sum())
            expected.append(dict(zip(part.tolist(), ratio.tolist(), strict=True)))
        both = expected[0] | expected[1]
        assert r.score == pytest.approx(sum(both[b] for b in own) / len(own), abs=1e-6)
        assert r.kept == (not r.base_failed and r.score >= quality_rules.THRESHOLD)


def test_a_mix_comes_near_its_targets(spark):
    rnd = random.Random(11)
    rows = [(i, "w " * rnd.randrange(1, 40), rnd.choice(["a", "b", "c", "d", None])) for i in range(6000)]
    mixed = source_mix.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    found = mixed.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"), F.sum("size").alias("size"))
    for r in found.collect():
        assert abs(r.taken - r.target) < 0.05 * r.target and r.target <= 2 * r["size"] + 1e-6
    total = mixed.agg(F.sum(F.col("size") * F.col("copies")), F.sum("size")).first()
    assert math.isclose(total[0], 1.5 * total[1], rel_tol=0.03)


def test_a_rare_language_keeps_its_words(spark, monkeypatch):
    """A language with one document in a hundred has words and n-grams of its own beside one that has all the rest."""
    monkeypatch.setattr(language_id, "WORDS", 20)
    monkeypatch.setattr(language_id, "GRAMS", 20)
    monkeypatch.setattr(language_id, "LEAST", 10)
    monkeypatch.setattr(language_id, "TRAIN_DOCUMENTS", 60)
    rnd = random.Random(3)
    common = ["".join(rnd.choice("abcde") for _ in range(5)) for _ in range(60)]
    rows = [(i, " ".join(rnd.choices(common, k=30)), "many") for i in range(400)]
    rows += [(1000 + i, "xyzzy plugh xyzzy plugh", "few") for i in range(4)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert documents.count() > 2 * training.sample_evenly(documents, "lang", 60).count()
    assert training.sample_evenly(documents, "lang", 60).where("lang = 'few'").count() == 4
    model = language_id.train(documents)
    assert {"xyzzy", "plugh"} <= set(model.words) and len(model.words) <= 20
    asked = spark.createDataFrame([("plugh xyzzy",), (rows[0][1],)], "text string")
    assert [r.p.lang_pred for r in asked.select(language_id.predict(F.col("text"), model).alias("p")).collect()] == ["few", "many"]
