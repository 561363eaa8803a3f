"""Removal of repeated passages, found by recompression.

Every text is parsed into symbols in rounds. A round names the maximal runs of a symbol, or the adjacent pairs whose
first symbol falls into the left half and whose second falls into the right half of the round's alphabet; names are
hashes of what they stand for, so all tasks give the same name to the same string without any exchange, and the inside
of equal passages gets equal symbols. Only symbols of up to `limit` words take part in a round, which bounds how far the
parse looks around.

* Low symbols: an *anchor* is three adjacent ones, kept by its own hash with probability 1/2. With each goes its context,
  the words that its parse depends on. A window that contains the context of an anchor seen once can't be repeated.
* High symbols of at least one window: if one is seen twice, every window inside it is repeated, and only the first
  block that holds it passes these windows on.
* The windows that remain are verified by their own hash, counted over all documents.

Texts are dealt into blocks of bounded size. Each block sends every distinct symbol or window once, with its count, so a
passage that a third of all documents share is one row for a block, and what comes back to a block is what it sent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headwise.llm import hashing

BLOCK_CHARS = 2_000_000

_FAR = np.int64(1) << 40
_ANCHOR, _HIGH = np.uint64(0xA5A5A5A5), np.uint64(0x5A5A5A5A)
#: What each round names, and the longest symbol (in words) that takes part.
LOW = (("run", 1), ("pair", 1), ("pair", 1), ("run", 2), ("pair", 2), ("pair", 2))
HIGH = tuple((kind, limit) for limit in (4, 8, 16, 32, 64) for kind in ("run", "pair", "pair", "pair"))


class Symbols:
    """Parsed texts: for every symbol its name, its words [start, end) and the words [low, high) it depends on.

    A symbol that never takes part in a round stands before each text and at the end.
    """

    def __init__(self, words: np.ndarray, offsets: np.ndarray):
        live = np.insert(np.ones(len(words), bool), offsets, False)
        self.live = live
        self.name = np.insert(words, offsets, np.uint64(0))
        self.start = np.insert(np.arange(len(words), dtype=np.int64), offsets, offsets)
        self.end = self.start + live
        self.low = np.where(live, self.start, -_FAR)
        self.high = np.where(live, self.end, _FAR)
        self.rounds = 0

    def apply(self, kind: str, limit: int, context: bool) -> None:
        self.rounds += 1
        active = self.live & (self.end - self.start <= limit)
        if kind == "run":
            self._runs(active, context)
        else:
            self._pairs(active, context)

    def _runs(self, active: np.ndarray, context: bool) -> None:
        same = active[1:] & active[:-1] & (self.name[1:] == self.name[:-1])
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        last = np.append(first[1:], len(self.name)) - 1
        if context:  # a run ends where its neighbours differ, so it depends on them
            moved = active[first]
            self.low = np.where(moved, self.low[np.maximum(first - 1, 0)], self.low[first])
            self.high = np.where(moved, self.high[np.minimum(last + 1, len(self.high) - 1)], self.high[last])
        if len(first) == len(self.name):
            return
        length = last - first + 1
        named = hashing.joined(self.name[first], hashing.mix(length.astype(np.uint64)))
        self.name = np.where(length > 1, named, self.name[first])
        self.start, self.end, self.live = self.start[first], self.end[last], self.live[first]

    def _pairs(self, active: np.ndarray, context: bool) -> None:
        half = hashing.mix(self.name ^ np.uint64(self.rounds * 0x51ED2701)) >> np.uint64(63) == 1
        left, right = active & ~half, active & half
        first = np.flatnonzero(left[:-1] & right[1:])
        if context:  # a left symbol without partner depends on what follows it, a right one on what precedes it
            left[first] = right[first + 1] = False
            alone, lone = np.flatnonzero(left), np.flatnonzero(right)
            low, high = self.low, self.high.copy()
            high[alone] = self.high[alone + 1]
            high[first] = self.high[first + 1]
            low = low.copy()
            low[lone] = self.low[lone - 1]
            self.low, self.high = low, high
        self.name[first] = hashing.joined(self.name[first], self.name[first + 1])
        self.end[first] = self.end[first + 1]
        keep = np.ones(len(self.name), bool)
        keep[first + 1] = False
        self.name, self.start, self.end, self.live = (x[keep] for x in (self.name, self.start, self.end, self.live))
        if context:
            self.low, self.high = self.low[keep], self.high[keep]


def parse(words: np.ndarray, offsets: np.ndarray, window: int) -> tuple[tuple, tuple]:
    """Anchors (name, low, high) and high symbols (name, start, end) of the texts."""
    s = Symbols(words, offsets)
    for kind, limit in LOW:
        s.apply(kind, limit, context=True)
    name = hashing.joined(hashing.joined(s.name[:-2], s.name[1:-1]), s.name[2:]) ^ _ANCHOR
    low, high = s.low[:-2], s.high[2:]
    usable = (high - low <= window) & s.live[:-2] & s.live[1:-1] & s.live[2:] & (name >> np.uint64(63) == 0)
    anchors = name[usable], low[usable], high[usable]
    names, starts, spans = [], [], []
    for kind, limit in HIGH:
        s.apply(kind, limit, context=False)
        wide = np.flatnonzero(s.live & (s.end - s.start >= window))
        names.append(s.name[wide])
        starts.append(s.start[wide])
        spans.append(s.end[wide] - s.start[wide])
    name, start, span = (np.concatenate(x) for x in (names, starts, spans))
    _, first = np.unique(start << np.int64(24) ^ span, return_index=True)  # a symbol may stay over several rounds
    return anchors, (name[first] ^ _HIGH, start[first], start[first] + span[first])


def _marked(begin: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """True at each position inside any of the ranges [begin, end)."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, begin, 1)
    np.add.at(step, end, -1)
    return np.cumsum(step[:n]) > 0


def _member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values are in the sorted table."""
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values


class Parsed:
    """A buffer of texts against what is known to be shared."""

    def __init__(self, texts: list[bytes | None], window: int):
        self.words, self.offsets = hashing.words(texts)
        self.window = window
        self.anchors, self.highs = parse(self.words, self.offsets, window)

    def names(self) -> np.ndarray:
        return np.concatenate([self.anchors[0], self.highs[0]])

    def judge(self, shared: np.ndarray, owned: np.ndarray) -> None:
        """repeated: window starts inside a shared high symbol; owned: those inside one that this block passes on;
        open: starts of windows that neither a high symbol proves repeated nor an anchor proves unique."""
        n, w = len(self.words), self.window
        name, start, end = self.highs
        here = _member(name, shared)
        self.repeated = _marked(start[here], end[here] - w + 1, n)
        here = _member(name, owned)
        self.owned = _marked(start[here], end[here] - w + 1, n)
        name, low, high = self.anchors
        once = ~_member(name, shared)
        unique = _marked(np.maximum(high[once] - w, 0), low[once] + 1, n)
        sizes = np.diff(self.offsets)
        inside = _marked(self.offsets[:-1], self.offsets[:-1] + np.maximum(sizes - w + 1, 0), n)
        self.open = np.flatnonzero(inside & ~unique & ~self.repeated)

    def hashes(self, starts: np.ndarray) -> np.ndarray:
        return hashing.windows(self.words, starts, self.window)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _counted(parts: list[np.ndarray], twice: list[np.ndarray], block: int) -> pd.DataFrame:
    """Distinct values with their counts; those in `twice` count two at least."""
    name, n = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_counts=True)
    if twice:
        more = np.unique(np.concatenate(twice))
        name, n = np.concatenate([name, more]), np.concatenate([n, np.full(len(more), 2)])
    return pd.DataFrame({"name": _signed(name), "block": np.full(len(name), block, np.int64), "n": n.astype(np.int64)})


def _sorted(rows: pd.DataFrame, which: pd.Series | None = None) -> np.ndarray:
    values = rows["name"] if which is None else rows.loc[which, "name"]
    return np.sort(values.to_numpy(np.int64).view(np.uint64))


def _parsed(docs: pd.DataFrame, window: int) -> Iterator[tuple[int, list, Parsed]]:
    texts = list(docs["text"])
    for begin, end in hashing.buffers(texts):
        yield begin, texts[begin:end], Parsed(texts[begin:end], window)


def remove_repeats(documents: DataFrame, window: int = 35) -> DataFrame:
    """Documents without the words that any repeated run of `window` words covers.

    Words are separated by ASCII white space. A window is repeated if its word sequence starts anywhere else, in the
    same document or another; all windows are judged on the input. Returns a row for each input row: doc_id, n_words,
    n_removed, kept_text (the words that stay, with single spaces).

    Null or empty texts have no words and come back as an empty text. Repeated rows are repeated text, so they lose
    their windows as any other copy does; a null doc_id is returned as it is. Texts shorter than a window stay whole.
    An empty table gives an empty table. Other columns are ignored.
    """
    texts = documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    total = documents.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_CHARS))
    dealt = texts.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    id_type = documents.schema["doc_id"].dataType

    def symbols(docs: pd.DataFrame) -> pd.DataFrame:
        return _counted([p.names() for _, _, p in _parsed(docs, window)], [], int(docs["block"].iloc[0]))

    def open_windows(docs: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(docs):
            return pd.DataFrame({"name": [], "block": [], "n": []}, dtype=np.int64)
        shared, owned = _sorted(known), _sorted(known, known["owner"])
        once, twice = [], []
        for _, _, p in _parsed(docs, window):
            p.judge(shared, owned)
            once.append(p.hashes(p.open))
            twice.append(p.hashes(np.flatnonzero(p.owned)))
        return _counted(once, twice, int(docs["block"].iloc[0]))

    def without(docs: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        high = known["kind"] == 0
        shared, repeated = _sorted(known, high), _sorted(known, ~high)
        ids = docs["doc_id"]
        rows: list[tuple] = []
        for _, texts, p in _parsed(docs, window):
            p.judge(shared, shared[:0])
            open_repeated = p.open[_member(p.hashes(p.open), repeated)]
            starts = np.concatenate([np.flatnonzero(p.repeated), open_repeated])
            gone = _marked(starts, starts + window, len(p.words))
            for i, text in enumerate(texts):
                lost = gone[p.offsets[i] : p.offsets[i + 1]]
                kept = (text or b"").split()
                n, n_lost = len(kept), int(lost.sum())
                if n_lost:
                    kept = [word for word, out in zip(kept, lost.tolist(), strict=True) if not out]
                rows.append((n, n_lost, b" ".join(kept).decode()))
        out = pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_text"])
        out.insert(0, "doc_id", ids.reset_index(drop=True))
        return out

    counts = "name long, block long, n long"
    by_name = Window.partitionBy("name")
    shared = (
        dealt.groupBy("block")
        .applyInPandas(symbols, counts)
        .withColumns({"total": F.sum("n").over(by_name), "first": F.min("block").over(by_name)})
        .where("total > 1")
        .select("block", "name", (F.col("block") == F.col("first")).alias("owner"))
    )
    repeated = (
        dealt.groupBy("block")
        .cogroup(shared.groupBy("block"))
        .applyInPandas(open_windows, counts)
        .withColumn("total", F.sum("n").over(by_name))
        .where("total > 1")
    )
    known = shared.select("block", "name", F.lit(0).alias("kind")).unionByName(
        repeated.select("block", "name", F.lit(1).alias("kind"))
    )
    return (
        dealt.groupBy("block")
        .cogroup(known.groupBy("block"))
        .applyInPandas(without, "doc_id string, n_words long, n_removed long, kept_text string")
        .withColumn("doc_id", F.col("doc_id").cast(id_type))
    )
