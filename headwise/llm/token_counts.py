"""Numbers of tokens by the whole-token shortcut.

A pre-token is a run of word marks with the characters up to the next mark. No piece of the vocabulary has a mark after
another character, so nothing is ever merged over the edge of a pre-token, and a text has as many tokens as its
pre-tokens together. Offline, every vocabulary string that could be a pre-token is given to the library: those that come
back as one token are whole tokens. In a text these are only counted; the library merges the others, each of which is
remembered. A model for which one of these facts can't be proved is used on whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwise.llm import storage, training

#: Documents above so many tokens are over the limit.
LIMIT = 4096
MARK = "▁"
_PRE_TOKEN = re.compile(f"{MARK}+[^{MARK}]*")


class Counter:
    """Token counts of whole texts."""

    #: Remembered pre-tokens, and characters of the longest one that is remembered.
    MEMO, LONGEST = 200_000, 64
    #: Characters of texts that are split at once.
    TOGETHER = 1 << 20

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.memo = training.Memo(self.MEMO, self._merged)
        self.pieces = [self.library.id_to_piece(i) for i in range(self.library.vocab_size())]
        self.splits = self._splits()
        self.whole = frozenset(self._whole()) if self.splits else frozenset()

    def _splits(self) -> bool:
        """Whether texts are normalised to marks for spaces and one in front, and no piece reaches over a mark."""
        marked = all(self.library.normalize(x) == MARK + x.replace(" ", MARK) for x in ("a b", "  a  b ", "a\n b", " "))
        return marked and not any(MARK in piece.lstrip(MARK) for piece in self.pieces)

    def _whole(self) -> Iterator[str]:
        likely = [x for x in self.pieces if _PRE_TOKEN.fullmatch(x)]
        return (x for x, n in zip(likely, self._merged(likely), strict=True) if n == 1)

    def _merged(self, pre_tokens: list[str]) -> list[int]:
        """By the library, which puts the first mark in front itself."""
        # The text of one mark alone would be empty; one of two marks is a space.
        return [len(x) if p != MARK else 1 for p, x in zip(pre_tokens, self.library.encode([p[1:] for p in pre_tokens], num_threads=1), strict=True)]

    def counts(self, texts: list[str | None]) -> list[int]:
        if not self.splits:
            return [len(x) for x in self.library.encode([x or "" for x in texts], num_threads=1)]
        out: list[int] = []
        group: list[str] = []
        size = 0
        for text in texts:
            group.append(text or "")
            size += len(group[-1])
            if size > self.TOGETHER:
                out += self._counts(group)
                group, size = [], 0
        return out + self._counts(group)

    def _counts(self, texts: list[str]) -> list[int]:
        whole = self.whole
        rest: list[list[str]] = []
        counted: list[int] = []
        for text in texts:
            found = _PRE_TOKEN.findall(self.library.normalize(text)) if text else []
            own = [x for x in found if x not in whole]
            long = [x for x in own if len(x) > self.LONGEST]
            counted.append(len(found) - len(own) + (sum(self._merged(long)) if long else 0))
            rest.append([x for x in own if len(x) <= self.LONGEST] if long else own)
        memo = self.memo.lookup(rest)
        return [n + sum(map(memo.__getitem__, own)) for n, own in zip(counted, rest, strict=True)]


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One for each Python worker, which keeps what it has merged."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def n_tokens(text: Column, path: str) -> Column:
    """Tokens of each text by the sentencepiece model at `path`, without begin and end; 0 for null."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(counter(path).counts(texts.tolist()), dtype="int64")

    return count(text)


def count(documents: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Documents with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    `path` names a sentencepiece model that all machines have. Special strings inside texts are ordinary text, as in
    the library. A null or empty text has 0 bytes and 0 tokens. Rows are counted one by one, whatever their doc_id, so
    repeated rows come back as often. An empty table gives an empty table. All columns stay; one that has a new name is
    replaced.
    """
    storage.small_batches(documents.sparkSession)
    return documents.withColumns(
        {"n_bytes": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"), "n_tokens": n_tokens(F.col("text"), path)}
    ).withColumn("over_limit", F.col("n_tokens") > limit)
