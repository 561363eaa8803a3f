"""Bounded training sets for the models, alike in every run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(folds: int, fold: int) -> Column:
    """Whether crc32 of the doc_id, as text, falls into the fold that nothing is learned from; a null counts as ''."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == fold


def sample(rows: DataFrame, most: int) -> DataFrame:
    """About `most` of the rows (all, if there are fewer): those with the smallest hashes of their doc_id."""
    share = min(1.0, most / max(rows.count(), 1))
    return rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))


def sample_evenly(rows: DataFrame, by: str, most: int) -> DataFrame:
    """About `most` of the rows at most, the same number of each value (all, if it has fewer), by hashes as in `sample`.

    Values without null, few enough for a row of each on the driver.
    """
    counts = rows.groupBy(by).count().collect()
    if not counts:
        return rows
    shares = [(F.lit(value), F.lit(int(min(1.0, most / len(counts) / n) * (1 << 20)))) for value, n in counts]
    limit = F.create_map(*[x for pair in shares for x in pair])[F.col(by)]
    return rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < limit)


class Memo:
    """Values of tokens, computed for many at once and remembered; what was used lately survives when room runs out."""

    #: `values` doesn't remember longer tokens.
    LONGEST = 128

    def __init__(self, size: int, compute: Callable[[list[str]], list]):
        self.size, self.compute = size, compute
        self.recent: dict = {}
        self.older: dict = {}

    def lookup(self, lists: list[list[str]]) -> dict:
        """A dict with the values of all tokens in the lists."""
        self._make_room()
        recent, older = self.recent, self.older
        missing = {x for own in lists for x in own if x not in recent}
        new = [x for x in missing if x not in older]
        recent.update((x, older[x]) for x in missing if x in older)
        recent.update(zip(new, self.compute(new), strict=True))
        return recent

    def values(self, tokens: list) -> list:
        """The values of tokens that are all different; no value is None."""
        self._make_room()
        found = list(map(self.recent.get, tokens))
        missing = [i for i, x in enumerate(found) if x is None]
        names = [tokens[i] for i in missing]
        values = list(map(self.older.get, names))
        computed = iter(self.compute([x for x, value in zip(names, values, strict=True) if value is None]))
        values = [next(computed) if x is None else x for x in values]
        short = [(x, value) for x, value in zip(names, values, strict=True) if len(x) <= self.LONGEST]
        self.recent.update(short[: self.size])
        for i, x in zip(missing, values, strict=True):
            found[i] = x
        return found

    def _make_room(self) -> None:
        if len(self.recent) > self.size:
            self.older, self.recent = self.recent, {}
