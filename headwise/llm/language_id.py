"""Language identification by words first, and by shorter and shorter character n-grams for unseen words.

Spark counts words and character n-grams by language over a bounded sample of labelled documents. A known word scores
its log frequency in each language. An unseen word is read from left to right: at each place the longest known n-gram
that starts there scores, so the order backs off from five characters to one. Every word of a text is scored; the means
decide.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headwise.llm import storage, training

#: Bounds of the model: labelled documents, words, n-grams of each order; all are shared out evenly among languages.
TRAIN_DOCUMENTS, WORDS, GRAMS, ORDER = 20_000, 50_000, 20_000, 5
#: Words, and n-grams of each order, that a language may have at least, however many languages there are.
LEAST = 1000
#: Added to each count of a language.
SMOOTHING = 0.5
#: Words looked up before are kept up to this number.
MEMO = 200_000
#: As many words at most speak for a language, so that long texts don't all score 1.
EVIDENCE = 20
#: Letters of a word that are counted as one; what follows counts as a word of its own.
LONGEST = 64
UNKNOWN = "und"

_LETTERS = re.compile(r"[a-z]+")
_ANY_LETTERS = regex.compile(r"\p{L}+")


def letters(token: str) -> list[str]:
    """The words of letters in a token, in lower case."""
    token = token.lower()
    return (_LETTERS if token.isascii() else _ANY_LETTERS).findall(token)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    words: dict[str, int]  # row in `table`
    grams: dict[str, int]
    table: np.ndarray  # log frequencies, a column for each language

    def rows(self, word: str) -> list[int]:
        """Rows of the table whose mean is the score of a word of letters, in lower case."""
        found = self.words.get(word)
        if found is not None:
            return [found]
        padded, grams, rows = f"<{word}>", self.grams, []
        for i in range(len(padded)):
            for end in range(min(i + ORDER, len(padded)), i, -1):
                found = grams.get(padded[i:end])
                if found is not None:
                    rows.append(found)
                    break
        return rows


def _table(counts: DataFrame, key: str, languages: list[str], most: int) -> dict[str, np.ndarray]:
    """Log frequency by language of each language's commonest keys; (key, lang, n) has at least two of each key."""
    share = max(most // len(languages), LEAST)
    every = counts.groupBy(key).agg(F.collect_list(F.struct("lang", "n")).alias("by"), F.sum("n").alias("all"))
    each = every.where("all > 1").select(key, "by", F.inline("by"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), key))
    # At most `share` keys of each language, the others' counts beside.
    found = each.withColumn("rank", rank).where(F.col("rank") <= share).select(key, "by").dropDuplicates([key]).collect()
    at = {x: i for i, x in enumerate(languages)}
    table: dict[str, np.ndarray] = {}
    for name, by in sorted(found):
        row = table[name] = np.full(len(languages), SMOOTHING)
        for lang, n in by:
            row[at[lang]] += n
    if not table:
        return {}
    totals = sum(table.values())
    return {name: np.log(row) - np.log(totals) for name, row in table.items()}


def _grams(word: str, order: int) -> Column:
    """All runs of `order` characters of a word; of a shorter one, itself."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(word) - order + 1, F.lit(1)))
    return F.transform(starts, lambda i: F.substr(word, i, F.lit(order)))


def train(documents: DataFrame) -> Model:
    """Fit on about TRAIN_DOCUMENTS of the given documents that have text and lang, as many of each language."""
    storage.small_batches(documents.sparkSession)
    labelled = training.sample_evenly(
        documents.where("text is not null and lang is not null and doc_id is not null"), "lang", TRAIN_DOCUMENTS
    )
    words = (
        labelled.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(rf"(\p{{L}}{{1,{LONGEST}}})"), 1)).alias("word"))
        .groupBy("word", "lang")
        .agg(F.count(F.lit(1)).alias("n"))
        .persist()
    )
    languages = sorted(r[0] for r in words.select("lang").distinct().collect())
    if not languages:
        words.unpersist()
        return Model([], {}, {}, np.zeros((0, 0)))
    padded = words.select(F.concat(F.lit("<"), "word", F.lit(">")).alias("word"), "lang", "n")
    grams: dict[str, np.ndarray] = {}
    for order in range(1, ORDER + 1):
        counts = (
            padded.select("lang", "n", F.explode(_grams("word", order)).alias("gram"))
            .groupBy("gram", "lang")
            .agg(F.sum("n").alias("n"))
        )
        grams |= _table(counts, "gram", languages, GRAMS)
    known = _table(words, "word", languages, WORDS)
    words.unpersist()
    table = np.array([*known.values(), *grams.values()]).reshape(-1, len(languages))
    row = dict(zip(grams, range(len(known), len(table)), strict=True))
    return Model(languages, dict(zip(known, range(len(known)), strict=True)), row, table)


class Reader:
    """Sums of the word scores of texts; tokens seen before are looked up."""

    #: Tokens looked up at once; a longer text is read in parts of so many.
    STEP = MEMO // 4

    def __init__(self, model: Model):
        self.model = model
        # Rows of the tokens: log frequencies of their words in each language, and the number of words.
        self.scores = np.zeros((4 * MEMO, len(model.languages) + 1))
        self.size, self.memo = 0, training.Memo(MEMO, self._places)

    def _places(self, new: list[str]) -> list[int]:
        """Rows of tokens that weren't looked up before."""
        words = [(k, self.model.rows(word)) for k, token in enumerate(new) for word in letters(token)]
        owner = np.array([k for k, _ in words], np.int64)
        sizes = np.array([len(rows) for _, rows in words], np.int64)
        rows = np.array([r for _, rows in words for r in rows], np.int64)
        share = np.repeat(1 / np.maximum(sizes, 1), sizes)
        place = slice(self.size, self.size + len(new))
        for i in range(len(self.model.languages)):
            self.scores[place, i] = np.bincount(np.repeat(owner, sizes), self.model.table[rows, i] * share, len(new))
        self.scores[place, -1] = np.bincount(owner, minlength=len(new))
        self.size = place.stop
        return list(range(place.start, place.stop))

    def _add(self, parts: list[tuple[int, list[str]]], totals: np.ndarray) -> None:
        if self.size > 3 * MEMO:
            self.size, self.memo = 0, training.Memo(MEMO, self._places)
        memo = self.memo.lookup([own for _, own in parts])
        at = np.fromiter(map(memo.__getitem__, chain.from_iterable(own for _, own in parts)), np.int64)
        owner = np.repeat([k for k, _ in parts], [len(own) for _, own in parts])
        for i in range(totals.shape[1]):
            totals[:, i] += np.bincount(owner, self.scores[at, i], len(totals))

    def totals(self, texts: Iterable[str | None]) -> np.ndarray:
        """For each text, its summed log frequencies in each language, and the number of its words."""
        split = [(text or "").split() for text in texts]
        totals = np.zeros((len(split), self.scores.shape[1]))
        parts, held = [], 0
        for k, tokens in enumerate(split):
            for begin in range(0, len(tokens), self.STEP):
                parts.append((k, tokens[begin : begin + self.STEP]))
                held += len(parts[-1][1])
                if held >= self.STEP:
                    self._add(parts, totals)
                    parts, held = [], 0
        if parts:
            self._add(parts, totals)
        return totals


def predict(text: Column, model: Model) -> Column:
    """lang_pred and score (the share of the best language, 0 to 1) of each text, read whole.

    A null text, or one without letters, is `und` with score 0, as is any text if nothing could be learned. Equal
    scores go to the first language by name. Equal texts get equal results.
    """

    @F.pandas_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        reader, names = Reader(model), np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            totals = np.concatenate([reader.totals(batch.iloc[i : i + 200]) for i in range(0, len(batch), 200)] or [np.zeros((0, len(names)))])
            count = totals[:, -1]
            told = (count > 0) & (len(names) > 1)
            best, score = np.full(len(batch), len(names) - 1), np.zeros(len(batch))
            level = totals[told, :-1] * (np.minimum(count, EVIDENCE) / np.maximum(count, 1))[told, None]
            if len(level):
                best[told] = level.argmax(axis=1)
                score[told] = 1 / np.exp(level - level.max(axis=1, keepdims=True)).sum(axis=1)
            yield pd.DataFrame({"lang_pred": names[best], "score": score})

    return predicted(text)
