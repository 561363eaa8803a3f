"""Toxicity by a support vector machine over a subsequence string kernel.

The kernel of two words sums over their common subsequences of `LENGTH` characters, weighted by DECAY for every
character that each spans, and is normalised; inserted characters and other endings lower it only a little. Words
written with spaces between their letters are joined first. Landmarks, chosen from words that toxic documents have more
often, are the Nyström basis: a sentence is the vector of the largest kernel value any of its words has with each
landmark, mapped by the inverse square root of the landmarks' own kernel matrix. A linear machine is trained on labelled
sentences; of a toxic document, the sentence that scores highest so far. A document scores as its highest sentence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwise.llm import near_dedup, storage, training

#: Bounds of the model: labelled documents of either kind, words looked at as landmarks at a time, and landmarks beyond
#: those that each cover SUPPORT texts which no other one covers.
TRAIN_DOCUMENTS, CANDIDATES, LANDMARKS, SUPPORT = 4_000, 300, 40, 4
#: Texts are near copies, which count once, if this share of their minwise tokens agree.
COPIES = 0.5
LENGTH, DECAY = 3, 0.7
#: Kernel values below this count as none, which leaves most words without any.
FLOOR = 0.55
#: A word is compared if it has this share of a landmark's character pairs (with up to GAP characters between).
PAIRS, GAP = 0.5, 3
#: Characters of a word that are compared (its other parts are words of their own), and words remembered.
PIECE, MEMO = 16, 200_000
#: Stands before every word, so that beginnings are alike only to beginnings.
START = "^"
#: Score from which a document is toxic.
THRESHOLD = 0.3

_SPACED = re.compile(r"(?<!\S)\w(?:[ .*_-]\w){3,}(?!\w)")
_LETTERS = re.compile(r"[\W\d_]+")


def plain(token: str) -> list[str]:
    """The letters of a token in lower case after the mark START, in pieces of PIECE."""
    word = START + _LETTERS.sub("", token.lower())
    return [word[i : i + PIECE] for i in range(0, len(word), PIECE // 2) if i == 0 or len(word) - i > PIECE // 2]


def tokens(text: str | None) -> list[str]:
    """Tokens of a text; letters with single characters between them are one token."""
    return _SPACED.sub(lambda m: re.sub(r"[ .*_-]", "", m[0]), text or "").split()


def _codes(words: list[str]) -> np.ndarray:
    """Characters as numbers, a row for each word, 0 beyond its end."""
    width = max(map(len, words), default=1) or 1
    return np.array(words, f"<U{width}").view(np.int32).reshape(len(words), width)


def kernel(left: list[str], right: list[str]) -> np.ndarray:
    """Gap-weighted common subsequences of LENGTH characters, for every pair of a left and a right word."""
    s, t = _codes(left), _codes(right)
    n, m = s.shape[1], t.shape[1]
    shape = (len(left), len(right))
    same = [[(s[:, i, None] == t[None, :, j]) & (s[:, i, None] > 0) for j in range(m)] for i in range(n)]
    # prefix[j]: of pairs of prefixes (s[:i], t[:j]), subsequences of the length so far, weighted up to their ends
    prefix = [[np.ones(shape, np.float32)] * (m + 1)] * (n + 1)
    for _ in range(LENGTH - 1):
        zero = np.zeros(shape, np.float32)
        after = [[zero] * (m + 1)]
        for i in range(1, n + 1):
            row, run = [zero], zero
            for j in range(1, m + 1):
                run = DECAY * run + DECAY * DECAY * np.where(same[i - 1][j - 1], prefix[i - 1][j - 1], np.float32(0))
                row.append(DECAY * after[i - 1][j] + run)
            after.append(row)
        prefix = after
    total = np.zeros(shape, np.float32)
    for i in range(n):
        for j in range(m):
            total += DECAY * DECAY * np.where(same[i][j], prefix[i][j], np.float32(0))
    return total


def own(words: list[str]) -> np.ndarray:
    """Kernel of each word with itself."""
    s = _codes(words)
    n, size = s.shape[1], len(words)
    prefix = [[np.ones(size, np.float32)] * (n + 1)] * (n + 1)
    same = [[(s[:, i] == s[:, j]) & (s[:, i] > 0) for j in range(n)] for i in range(n)]
    for _ in range(LENGTH - 1):
        zero = np.zeros(size, np.float32)
        after = [[zero] * (n + 1)]
        for i in range(1, n + 1):
            row, run = [zero], zero
            for j in range(1, n + 1):
                run = DECAY * run + DECAY * DECAY * np.where(same[i - 1][j - 1], prefix[i - 1][j - 1], np.float32(0))
                row.append(DECAY * after[i - 1][j] + run)
            after.append(row)
        prefix = after
    total = np.zeros(size, np.float32)
    for i in range(n):
        for j in range(n):
            total += DECAY * DECAY * np.where(same[i][j], prefix[i][j], np.float32(0))
    return total


def _alike(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Which words have the share PAIRS of the character pairs of any landmark."""
    marks = _codes(landmarks)
    letters = np.unique(marks[marks > 0])
    n = len(letters) + 1

    def pairs(codes: np.ndarray) -> np.ndarray:
        """For each word, which pairs it has; letters of no landmark count as none."""
        at = np.minimum(np.searchsorted(letters, codes), n - 2)
        at = np.where(letters[at] == codes, at + 1, 0)
        has, row = np.zeros((len(codes), n * n), bool), np.arange(len(codes))[:, None]
        for g in range(1, GAP + 2):
            first, second = at[:, :-g], at[:, g:]
            has[row, np.where((first > 0) & (second > 0), first * n + second, 0)] = True
        has[:, 0] = False
        return has

    wanted = pairs(marks)
    used = wanted.any(axis=0)
    wanted = wanted[:, used].astype(np.float32)
    enough = PAIRS * wanted.sum(axis=1)
    out = np.zeros(len(words), bool)
    for begin in range(0, len(words), 2048):
        some = pairs(_codes(words[begin : begin + 2048]))[:, used].astype(np.float32)
        out[begin : begin + 2048] = ((some @ wanted.T) >= enough).any(axis=1)
    return out


def similarity(words: list[str], landmarks: list[str], scale: np.ndarray) -> np.ndarray:
    """Normalised kernel with the landmarks (whose own values are `scale`), nothing below FLOOR."""
    out = np.zeros((len(words), len(landmarks)), np.float32)
    if not words or not landmarks:
        return out
    near = sorted(np.flatnonzero(_alike(words, landmarks)).tolist(), key=lambda i: len(words[i]))
    for begin in range(0, len(near), 512):
        part = near[begin : begin + 512]
        some = [words[i] for i in part]
        norm = np.sqrt(np.maximum(own(some), 1e-12)[:, None] * scale[None, :])
        value = kernel(some, landmarks) / norm
        out[part] = np.where(value >= FLOOR, value, np.float32(0))
    return out


@dataclass(frozen=True)
class Model:
    landmarks: list[str]
    scale: np.ndarray
    weights: np.ndarray  # of the kernel values, the Nyström map included
    bias: float
    slope: float  # score = 1 / (1 + exp(-(slope * margin + shift)))
    shift: float


class Sentences:
    """Kernel values of the sentences of texts; words seen before are looked up."""

    def __init__(self, landmarks: list[str], scale: np.ndarray):
        self.landmarks, self.scale = landmarks, scale
        self.memo = training.Memo(MEMO, self._places)
        self.rows = [np.zeros((1, len(landmarks)), np.float32)]  # row 0: a word like no landmark
        self.size = 1

    def _places(self, new: list[str]) -> list[int]:
        """Rows of the tokens."""
        if not new:
            return []
        pieces = [plain(x) for x in new]
        flat = similarity([p for own_ in pieces for p in own_], self.landmarks, self.scale)
        first = np.cumsum([0, *map(len, pieces[:-1])])  # a token has one piece at least
        best = np.maximum.reduceat(flat, first, axis=0)
        like = best.any(axis=1)
        self.rows.append(best[like])
        places = np.where(like, self.size - 1 + np.cumsum(like), 0)
        self.size += int(like.sum())
        return places.tolist()

    def of(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """For each text, the vectors of its sentences that are like any landmark (maybe none)."""
        split = [tokens(x and x.lower()) for x in texts]
        if self.size > MEMO // 4:
            self.__init__(self.landmarks, self.scale)
        memo = self.memo.lookup(split)
        self.rows = [np.concatenate(self.rows)]
        table = self.rows[0]
        for own_ in split:
            ids = np.array([memo[x] for x in own_], np.int64)
            like = np.flatnonzero(ids)
            if not len(like):
                yield np.zeros((0, table.shape[1]), np.float32)
                continue
            ends = np.array([x[-1] in ".!?" for x in own_[: like[-1] + 1]], np.int64)
            sentence = np.cumsum(ends)[like] - ends[like]
            first = np.flatnonzero(np.diff(sentence, prepend=-1))
            yield np.maximum.reduceat(table[ids[like]], first, axis=0)


def _nystrom(landmarks: list[str], scale: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh(similarity(landmarks, landmarks, scale).astype(float))
    return (vectors / np.sqrt(np.maximum(values, 0.05))) @ vectors.T


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 400, cost: float = 1e-3) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by gradient descent with momentum from zero."""
    w, b = np.zeros(x.shape[1]), 0.0
    speed_w, speed_b = np.zeros_like(w), 0.0
    weight = weight / weight.sum()
    step = 0.5 / (2 * (weight * (1 + (x**2).sum(axis=1))).sum() + cost)
    for _ in range(rounds):
        short = np.maximum(0, 1 - y * (x @ w + b)) * weight * y
        speed_w = 0.9 * speed_w + 2 * x.T @ short - cost * w
        speed_b = 0.9 * speed_b + 2 * short.sum()
        w, b = w + step * speed_w, b + step * speed_b
    return w, b


def _classes(labelled: DataFrame) -> DataFrame:
    """A class for each labelled document, the same for near copies of one kind: doc_id, class."""

    def sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = near_dedup.shingle_sets(list(batch["text"]))
            tokens = [near_dedup._tokens(x) if len(x) else b"" for x in sets]
            yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy(), "toxic": batch["toxic"].to_numpy(), "tokens": tokens})

    texts = labelled.select(F.col("doc_id").cast("string").alias("doc_id"), "toxic", F.col("text").cast("binary").alias("text"))
    found = sorted(map(tuple, texts.mapInPandas(sketches, "doc_id string, toxic int, tokens binary").collect()))  # bounded by TRAIN_DOCUMENTS
    rows = []
    for kind in (0, 1):
        own_ = [(i, t) for i, k, t in found if k == kind and t]
        table = np.array([np.frombuffer(t, "<u4") for _, t in own_]).reshape(len(own_), near_dedup.TOKENS)
        left = np.arange(len(own_))
        while len(left):
            like = (table[left] == table[left[0]]).mean(axis=1) >= COPIES
            rows += [(own_[i][0], 2 * int(left[0]) + kind) for i in left[like].tolist()]
            left = left[~like]
    return labelled.sparkSession.createDataFrame(rows, "doc_id string, class int")


def _landmarks(labelled: DataFrame) -> list[str]:
    """Words that toxic documents have more often than others, unlike each other; near copies count as one document.

    In every round the words are ranked by the toxic texts that no landmark covers so far, until no word adds SUPPORT of
    them: words of one group of texts, however many, cannot keep out those of others.
    """
    named = labelled.withColumn("doc_id", F.col("doc_id").cast("string")).join(F.broadcast(_classes(labelled)), "doc_id")
    words = named.select("toxic", "class", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1))).alias("word"))
    counted = words.where(F.length("word").between(LENGTH + 1, PIECE - 1)).groupBy("word").agg(
        F.collect_set(F.when(F.col("toxic") == 1, F.col("class"))).alias("texts"),
        F.count_distinct(F.when(F.col("toxic") == 0, F.col("class"))).alias("others"),
    )
    bad = F.size("texts")
    odds = bad * F.log((bad + 0.5) / (F.col("others") + 0.5))
    fit = counted.where((bad >= SUPPORT) & (F.col("others") <= 0.05 * bad)).select("word", "texts", odds.alias("odds")).persist()
    chosen: list[str] = []
    covered: set[int] = set()
    further: list[str] = []
    while True:
        new = F.size(F.array_except("texts", F.array(*map(F.lit, sorted(covered))).cast("array<int>")))
        top = fit.where(new >= SUPPORT).orderBy(F.desc(new * F.col("odds") / F.size("texts")), "word").limit(CANDIDATES).collect()
        if not top:
            break
        for r in top:
            if len(covered.union(r["texts"])) >= len(covered) + SUPPORT:
                chosen.append(START + r["word"])
                covered.update(r["texts"])
            elif len(further) < CANDIDATES:
                further.append(START + r["word"])
    fit.unpersist()
    if not chosen:
        return []
    # Words whose texts are covered already are as good for texts to come; as many as there is room for.
    found = chosen + further
    scale = own(found)
    alike = similarity(found, found, scale)
    kept = list(range(len(chosen)))
    for i in range(len(chosen), len(found)):
        if len(kept) < LANDMARKS and all(alike[i, j] < 0.75 for j in kept):
            kept.append(i)
    return [found[i] for i in kept]


def train(documents: DataFrame, labels: DataFrame) -> Model:
    """Fit on at most about TRAIN_DOCUMENTS toxic and as many other labelled documents among those given."""
    marked = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = marked.agg(F.avg("toxic")).first()[0] or 0.0
    # The labels are sampled before texts are fetched, of both kinds alike.
    chosen = [training.sample(marked.where(F.col("toxic") == k), TRAIN_DOCUMENTS) for k in (1, 0)]
    wanted = F.broadcast(chosen[0].unionByName(chosen[1]))  # TRAIN_DOCUMENTS bounds it
    rows = documents.select("doc_id", "text").where("text is not null")
    labelled = rows.join(wanted, "doc_id").dropDuplicates(["doc_id"]).persist()
    landmarks = _landmarks(labelled)
    if not landmarks:
        labelled.unpersist()
        return Model([], np.zeros(0), np.zeros(0), -1.0, 1.0, -3.0)
    scale = own(landmarks)

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sentences = Sentences(landmarks, scale)
        for batch in batches:
            found = list(sentences.of(batch["text"].tolist()))
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"].to_numpy(), "toxic": batch["toxic"].to_numpy(), "v": [x.ravel().tolist() for x in found]}
            )

    bag = labelled.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(vectors, "doc_id string, toxic int, v array<float>")
    rows_ = sorted(bag.collect(), key=lambda r: r["doc_id"])  # bounded by TRAIN_DOCUMENTS
    labelled.unpersist()
    m = len(landmarks)
    bags = [np.array(r["v"], float).reshape(-1, m) if r["v"] else np.zeros((1, m)) for r in rows_]
    toxic = np.array([r["toxic"] for r in rows_])
    basis = _nystrom(landmarks, scale)
    best = [int(np.argmax(x.max(axis=1))) for x in bags]
    for _ in range(3):
        x = np.concatenate([b[[k]] if t else b for b, t, k in zip(bags, toxic, best, strict=True)]) @ basis
        y = np.concatenate([np.full(1 if t else len(b), 1 if t else -1) for b, t in zip(bags, toxic, strict=True)])
        weight = np.where(y > 0, 1 / max((y > 0).sum(), 1), 1 / max((y < 0).sum(), 1))
        w, b = _machine(x, y, weight)
        best = [int(np.argmax(v @ basis @ w)) for v in bags]
    weights = basis @ w
    margin = np.array([(v @ weights).max() + b for v in bags])
    slope, shift = _logistic(margin, toxic, prior)
    return Model(landmarks, scale, weights, float(b), slope, shift)


def _logistic(margin: np.ndarray, toxic: np.ndarray, prior: float, rounds: int = 300) -> tuple[float, float]:
    """Slope and shift that turn a margin into a probability, with the kinds as frequent as among all labels."""
    weight = np.where(toxic == 1, prior / max(toxic.sum(), 1), (1 - prior) / max((1 - toxic).sum(), 1))
    a, c = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margin + c, -30, 30)))
        g, h = weight * (p - toxic), weight * p * (1 - p) + 1e-9
        hess = np.array([[(h * margin**2).sum() + 1e-4, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-4]])
        step = np.linalg.solve(hess, [(g * margin).sum() + 1e-4 * a, g.sum()])
        a, c = a - 0.5 * step[0], c - 0.5 * step[1]
    return float(a), float(c)


def score(text: Column, model: Model) -> Column:
    """Score (0 to 1) of each text, read whole.

    A null or empty text scores as one without any word like a landmark, which is the lowest score. Equal texts score
    alike. If nothing could be learned, all texts get the same low score.
    """

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sentences = Sentences(model.landmarks, model.scale)
        for batch in batches:
            margins: list[float] = []
            for begin in range(0, len(batch), 100):
                found = sentences.of(batch.iloc[begin : begin + 100].tolist())
                margins += [max(float((v @ model.weights).max(initial=0)), 0.0) + model.bias for v in found]
            yield pd.Series(1 / (1 + np.exp(-np.clip(model.slope * np.array(margins) + model.shift, -30, 30))))

    return scores(text)


def clean(documents: DataFrame, model: Model) -> DataFrame:
    """The documents that score below THRESHOLD, with the columns they came with."""
    storage.small_batches(documents.sparkSession)
    name = storage.unused(documents, "_toxicity")
    scored = documents.select(*documents.columns, score(F.col("text"), model).alias(name))
    return scored.where(F.col(name) < THRESHOLD).select(documents.columns)
