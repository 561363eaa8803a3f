"""Centroid clustering over a vector-approximation file.

Every component of a vector is compressed to one of 16 cells, two cells a byte: 64 components take 32 bytes. A round asks
the approximations first. Tables hold, for each byte, the least and the greatest squared distance of what lies in its
two cells to each centroid; added up they give an interval for every centroid, and only centroids whose interval begins
below the lowest end can be nearest. A vector is fetched, that is, leaves the file scan for the exact distance, only
where intervals overlap, or where it has changed its cluster: sums of clusters are carried from round to round and
corrected by the vectors that moved. The first round, which makes the sums, and the last one, which returns exact
distances, need every vector.

Bounds of cells come from each component's mean and deviation over all vectors, the outermost ones from the extremes, so
an interval always holds and results don't depend on where the bounds are. No step shuffles more than a row for each
cluster and task; centroids and tables are all that the driver holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headwise.llm import storage

CELLS = 16
#: Largest absolute integer component, for which squared distances are exact in 64 bits with up to 2,000 components.
LARGEST = 1 << 24
#: Below this all sums are exact as doubles, too, and matrix products can be used.
_DOUBLES = 1 << 20


def whole_components(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component x as double; null for vectors with a null or non-finite component."""
    x = vector.cast("array<double>")
    usable = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return F.when(usable, F.transform(x, lambda c: F.floor(c * scale)))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as one matrix of integers; raises if a component is beyond LARGEST."""
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)
    if len(values) and max(int(values.max()), -int(values.min())) > LARGEST:
        raise ValueError(f"components must lie between {-LARGEST} and {LARGEST} after scaling")
    return values


def squared(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Exact squared distances of all points to all centers."""
    if max(np.abs(points).max(initial=0), np.abs(centers).max(initial=0)) < _DOUBLES:
        p, c = points.astype(np.float64), centers.astype(np.float64)
        return ((p * p).sum(1)[:, None] + (c * c).sum(1) - 2 * (p @ c.T)).astype(np.int64)
    return np.stack([((points - c) ** 2).sum(1) for c in centers], 1)


@dataclass(frozen=True)
class Grid:
    """Cells of every component."""

    low: np.ndarray  # components x cells: least integer inside
    high: np.ndarray  # greatest

    @classmethod
    def of(cls, least: np.ndarray, most: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> Grid:
        """Cells that about as many vectors share each, if components are spread like normal ones."""
        at = np.array([NormalDist().inv_cdf(i / CELLS) for i in range(1, CELLS)])
        inner = np.floor(mean[:, None] + spread[:, None] * at).astype(np.int64).clip(least[:, None], most[:, None])
        return cls(np.hstack([least[:, None], inner]), np.hstack([np.maximum(inner - 1, least[:, None]), most[:, None]]))

    def pack(self, points: np.ndarray) -> np.ndarray:
        """Two cells a byte; an odd last component has a byte of its own."""
        n, width = points.shape
        cells = np.zeros((n, width + width % 2), np.uint8)
        for d in range(width):
            cells[:, d] = np.searchsorted(self.low[d, 1:], points[:, d], "right")
        return cells[:, 0::2] * np.uint8(CELLS) + cells[:, 1::2]


class Approximation:
    """Which centroids can be nearest, by the bytes of a vector alone."""

    def __init__(self, grid: Grid, centroids: np.ndarray):
        self.grid, self.centroids = grid, centroids

    def __getstate__(self) -> dict:  # tables are made where they are used
        return {"grid": self.grid, "centroids": self.centroids}

    @cached_property
    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """For each byte of a vector and each of its values: bounds of the distance to each centroid."""
        to_low = self.grid.low[:, :, None] - self.centroids.T[:, None, :]
        to_high = self.grid.high[:, :, None] - self.centroids.T[:, None, :]
        inside = (to_low <= 0) & (to_high >= 0)
        least = np.where(inside, 0, np.minimum(to_low**2, to_high**2))
        most = np.maximum(to_low**2, to_high**2)
        return tuple(self._by_byte(x) for x in (least, most))

    @staticmethod
    def _by_byte(x: np.ndarray) -> np.ndarray:
        if len(x) % 2:
            x = np.concatenate([x, np.zeros_like(x[:1])])
        pair = x[0::2, :, None, :] + x[1::2, None, :, :]
        return pair.reshape(len(pair), CELLS * CELLS, -1)

    def possible(self, packed: np.ndarray) -> np.ndarray:
        """Vectors x centroids: whether the interval begins at or below the lowest end."""
        least, most = self.tables
        low = np.zeros((len(packed), len(self.centroids)), np.int64)
        high = low.copy()
        for p in range(packed.shape[1]):
            low += least[p][packed[:, p]]
            high += most[p][packed[:, p]]
        return low <= high.min(1, keepdims=True)

    def nearest(self, packed: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid (ties: the smaller one) and the exact squared distance."""
        possible = self.possible(packed)
        found = possible.argmax(1)
        distance = np.zeros(len(points), np.int64)
        alone = possible.sum(1) == 1
        distance[alone] = ((points[alone] - self.centroids[found[alone]]) ** 2).sum(1)
        several = np.flatnonzero(~alone)
        if len(several):
            exact = np.where(possible[several], squared(points[several], self.centroids), np.iinfo(np.int64).max)
            found[several] = exact.argmin(1)
            distance[several] = exact.min(1)
        return found, distance


def _bytes(cells: pa.Array | pd.Series) -> np.ndarray:
    values = cells.to_pylist() if isinstance(cells, pa.Array) else cells
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(cells), -1)


def _packed(grid: Grid):
    width = len(grid.low)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = grid.pack(matrix(batch.column("v"), width))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"), pa.array([row.tobytes() for row in cells], pa.binary())],
                ["vec_id", "v", "cells"],
            )

    return pack


def _fetched(before: Approximation, now: Approximation):
    """Whether the bytes leave open where a vector belongs, or say that it has moved."""

    @F.pandas_udf("boolean")
    def fetched(cells: pd.Series) -> pd.Series:
        packed = _bytes(cells)
        was, is_ = before.possible(packed), now.possible(packed)
        settled = (was.sum(1) == 1) & (is_.sum(1) == 1) & (was.argmax(1) == is_.argmax(1))
        return pd.Series(~settled)

    return fetched


def _changes(before: Approximation | None, now: Approximation):
    """For each task and cluster: vectors that came less those that left, and their sum."""
    k, width = now.centroids.shape

    def changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for batch in batches:
            if not len(batch):
                continue
            points, packed = matrix(batch.column("v"), width), _bytes(batch.column("cells"))
            for form, sign in ((now, 1), (before, -1)):
                if form is not None:
                    found, _ = form.nearest(packed, points)
                    np.add.at(n, found, sign)
                    np.add.at(total, found, sign * points)
        some = np.flatnonzero(n.astype(bool) | total.any(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array(n[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))],
            ["cluster", "n", "total"],
        )

    return changes


def _assigned(form: Approximation):
    width = form.centroids.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, distance = form.nearest(_bytes(batch.column("cells")), matrix(batch.column("v"), width))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(found, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"]
            )

    return assign


def _grid(kept: DataFrame, width: int) -> Grid | None:
    def each(make) -> Column:
        return F.array(*[make(F.col("v")[d]) for d in range(width)])

    row = kept.agg(
        F.count(F.lit(1)).alias("n"), each(F.min).alias("least"), each(F.max).alias("most"),
        each(F.avg).alias("mean"), each(F.stddev_pop).alias("spread"),
    ).first()
    if not row.n:
        return None
    whole = [np.array(x, np.int64) for x in (row.least, row.most)]
    return Grid.of(*whole, np.array(row["mean"]), np.array(row.spread))


def _corrected(changes: DataFrame, width: int) -> list[tuple[int, int, list[int]]]:
    """A row for each cluster; exact whatever the number of vectors."""
    exact = "decimal(38,0)"
    total = F.array(*[F.sum(F.col("total")[d].cast(exact)) for d in range(width)]).alias("total")
    rows = changes.groupBy("cluster").agg(F.sum("n").alias("n"), total).collect()
    return [(r.cluster, int(r.n), [int(x) for x in r.total]) for r in rows]


def cluster(
    embeddings: DataFrame, clusters: int = 16, rounds: int = 3, width: int = 64, scale: int = 64, seed: str = "1",
    vector: str = "embedding",
) -> tuple[DataFrame, np.ndarray]:
    """Assign all vectors to centroids: (DataFrame of vec_id, cluster, distance; the final centroids).

    Vectors with exactly `width` components, none null or non-finite, take part, with each component x as the integer
    floor(scale * x); others are left out. Centroids begin as the vectors with the smallest sha256 of `seed:vec_id` (ties:
    by vector; a null vec_id after all others), as many as there are if they are fewer than `clusters`. In every round
    each vector goes to the nearest centroid (squared Euclidean distance, ties to the smaller number), and each centroid
    with vectors becomes their componentwise floor(sum / count). Distances are squared, to the final centroids.

    Repeated rows and vec_ids, also null ones, each count and come back. An empty table, or one without a vector that
    takes part, gives an empty table and no centroids. Other columns, whatever their names, are ignored. Integer
    components beyond LARGEST raise.
    """
    spark: SparkSession = embeddings.sparkSession
    v = whole_components(F.col(vector), scale)
    kept = embeddings.select("vec_id", v.alias("v")).where((F.size(vector) == width) & F.col("v").isNotNull())
    schema = T.StructType([kept.schema["vec_id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    grid = _grid(kept, width)
    if grid is None:
        return spark.createDataFrame([], schema), np.zeros((0, width), np.int64)
    by_hash = [F.col("vec_id").isNull(), F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256), F.col("v")]
    centroids = np.array([r.v for r in kept.orderBy(*by_hash).limit(clusters).collect()], np.int64)
    file_schema = T.StructType([*kept.schema.fields, T.StructField("cells", T.BinaryType())])
    file = storage.staged(kept.mapInArrow(_packed(grid), file_schema), "vectors")
    n, total = [0] * len(centroids), [[0] * width for _ in centroids]
    before = None
    for _ in range(rounds):
        now = Approximation(grid, centroids)
        open_ = file.select("cells", "v")
        if before is not None:
            open_ = open_.where(_fetched(before, now)("cells"))
        changes = open_.mapInArrow(_changes(before, now), "cluster int, n long, total array<long>")
        for c, more, sums in _corrected(changes, width):
            n[c] += more
            total[c] = [a + b for a, b in zip(total[c], sums, strict=True)]
        centroids = np.array(
            [[x // m for x in sums] if m else old.tolist() for m, sums, old in zip(n, total, centroids, strict=True)], np.int64
        )
        before = now
    return file.mapInArrow(_assigned(Approximation(grid, centroids)), schema), centroids


_KEPT = """
kept AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE len(embedding) = 64
        AND len(list_filter(embedding, lambda x: x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x))) = 64
),
c0 AS (
    SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v
    FROM kept QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id), v) <= 16
)"""


def _oracle() -> str:
    parts = [_KEPT]
    distance = "list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    nearest = "SELECT k.vec_id, any_value(k.v) AS v, min((%s, c.c)) AS best FROM kept k, c%d c GROUP BY k.vec_id"
    for r in range(3):
        parts.append(f"a{r} AS ({nearest % (distance, r)})")
        parts.append(f"""
u{r} AS (SELECT best[2] AS c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}),
s{r} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM u{r} GROUP BY c, i),
m{r} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) / n AS BIGINT) ORDER BY i) AS v FROM s{r} GROUP BY c),
c{r + 1} AS (SELECT c{r}.c, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} ON m{r}.c = c{r}.c)""")
    parts.append(f"a3 AS ({nearest % (distance, 3)})")
    return (
        "WITH " + ",\n".join(parts) + """
SELECT a3.vec_id, CAST(c3.c AS INTEGER) AS cluster, CAST(best[1] AS BIGINT) AS distance,
    CAST(sum(best[1]) OVER (PARTITION BY c3.c) AS BIGINT) AS cluster_inertia,
    CAST(sum(best[1]) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(c3.v, ',')) AS centroid_sha256
FROM a3 JOIN c3 ON c3.c = best[2]
"""
    )


#: DuckDB SQL of the query, for tables whose vec_ids are distinct.
ORACLE = _oracle()
