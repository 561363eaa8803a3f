"""Product codes of vectors, each part's entry found by Orchard's search.

A vector is cut into equal parts, and every part position has a codebook. The search keeps, for every entry, the list of
all entries sorted by distance to it. It starts at an entry, walks down this entry's list and jumps to the list of the
first entry that is nearer; entries are marked when they are visited and never compared again. By the triangle
inequality nothing beyond twice the current distance can be nearer, so the walk ends there, with the exact nearest
entry. A batch of parts is searched together: each step compares the next few listed entries of every part still open.

Codebooks are learned on all vectors: a task adds up the parts of each entry, and a row for each entry and part position
of each task is all that is shuffled. The driver holds the codebooks only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headwise.llm import storage
from headwise.llm.vector_file import matrix, squared, whole_components

ENTRIES = 256
#: Listed entries that a step compares, and parts that are searched together.
STEP, TOGETHER = 8, 4096
#: Most label sums that are sent to every executor; about 20 bytes each.
BROADCAST_LABELS = 100_000
_FAR = np.iinfo(np.int64).max


class Codebook:
    """The entries of one part position."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries

    def __getstate__(self) -> dict:  # lists are made where they are used
        return {"entries": self.entries}

    @cached_property
    def lists(self) -> tuple[np.ndarray, np.ndarray]:
        """Of every entry: all entries by distance to it (itself first), and the squared distances.

        Lists are filled up to whole steps with entries at an infinite distance.
        """
        between = squared(self.entries, self.entries)
        np.fill_diagonal(between, -1)
        order = np.argsort(between, axis=1, kind="stable")
        reach = np.take_along_axis(between, order, 1)
        spare = -len(order) % STEP
        return np.pad(order, ((0, 0), (0, spare)), mode="edge"), np.pad(reach, ((0, 0), (0, spare)), constant_values=_FAR)

    @cached_property
    def size(self) -> np.ndarray:
        return (self.entries.astype(np.int64) ** 2).sum(1)

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each part (ties: the lower index) and the squared distance."""
        found, distance = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        for i in range(0, len(parts), TOGETHER):
            found[i : i + TOGETHER], distance[i : i + TOGETHER] = self._search(parts[i : i + TOGETHER])
        return found, distance

    def _distances(self, parts: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """Of every part to its own row of entries."""
        difference = self.entries[entries] - parts[:, None, :]
        return np.einsum("nkd,nkd->nk", difference, difference)

    def _search(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lists, reach = self.lists
        n, steps = len(parts), lists.shape[1] // STEP
        # All start at entry 0.
        at, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
        best = self._distances(parts, np.zeros((n, 1), np.int64))[:, 0]
        visited = np.zeros((n, len(self.entries)), bool)
        visited[:, 0] = True
        open_ = np.arange(n)
        while len(open_):
            here = at[open_]
            columns = place[open_, None] * STEP + np.arange(STEP)
            listed = lists[here[:, None], columns]
            inside = reach[here[:, None], columns] <= 4 * best[open_, None]  # squares of twice the distance
            new = inside & ~visited[open_[:, None], listed]
            some = new.any(1)
            rows = open_[some]
            distance = np.where(new[some], self._distances(parts[rows], listed[some]), _FAR)
            visited[rows[:, None], np.where(new[some], listed[some], at[rows, None])] = True
            # The nearest of the step, ties to the lower index; the entry it stands at is always marked.
            least = distance.min(1)
            entry = np.where(distance == least[:, None], listed[some], len(self.entries)).min(1)
            nearer = (least < best[rows]) | ((least == best[rows]) & (entry < at[rows]))
            place[open_] += 1
            jump = rows[nearer]
            at[jump], best[jump], place[jump] = entry[nearer], least[nearer], 0
            # A list ends with its last entry, or where it leaves twice the current distance.
            jumped = np.zeros(n, bool)
            jumped[jump] = True
            more = jumped[open_] | (inside[:, -1] & (place[open_] < steps))
            open_ = open_[more]
        return at, best


def _learned(books: list[Codebook], width: int):
    """For each task, part position and entry: parts it is nearest to, and their sum."""
    size = width // len(books)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(books), ENTRIES), np.int64)
        total = np.zeros((len(books), ENTRIES, size), np.int64)
        for batch in batches:
            vectors = matrix(batch.column("v"), width)
            for p, book in enumerate(books):
                parts = vectors[:, p * size : (p + 1) * size]
                found, _ = book.nearest(parts)
                np.add.at(n[p], found, 1)
                np.add.at(total[p], found, parts)
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]),
                pa.array(total[part, entry].tolist(), pa.list_(pa.int64())),
            ],
            ["part", "entry", "n", "total"],
        )

    return learn


def _coded(books: list[Codebook], width: int):
    size = width // len(books)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = matrix(batch.column("v"), width)
            error = np.zeros(len(vectors), np.int64)
            codes = np.zeros((len(vectors), len(books)), np.uint8)
            for p, book in enumerate(books):
                codes[:, p], distance = book.nearest(vectors[:, p * size : (p + 1) * size])
                error += distance
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array([x.tobytes().hex() for x in codes], pa.string()), pa.array(error)],
                ["vec_id", "label", "code", "error"],
            )

    return code


def _updated(books: list[Codebook], vectors: DataFrame, width: int) -> list[Codebook]:
    size = width // len(books)
    exact = "decimal(38,0)"
    total = F.array(*[F.sum(F.col("total")[i].cast(exact)) for i in range(size)]).alias("total")
    sums = vectors.select("v").mapInArrow(_learned(books, width), "part int, entry int, n long, total array<long>")
    entries = [book.entries.copy() for book in books]
    for r in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), total).collect():  # a row for each used entry
        entries[r.part][r.entry] = [int(x) // int(r.n) for x in r.total]
    return [Codebook(x) for x in entries]


def encode(
    embeddings: DataFrame, parts: int = 4, rounds: int = 4, scale: int = 1024, vector: str = "embedding"
) -> tuple[DataFrame, list[np.ndarray]]:
    """Codes of all vectors: (DataFrame of vec_id, label, code, error; the codebook of each part position).

    Rows whose vector is null or has null or non-finite components are left out. Each component x is the integer
    floor(scale * x), and a vector is cut into `parts` equal parts. A part position's codebook begins as that part of
    the 256 vectors with the smallest vec_ids (fewer if there are fewer; ties: by vector; null vec_ids last). Each round
    assigns every part to the nearest entry (squared Euclidean distance, ties to the lower index) and replaces the entry
    by the floor(sum / count) of its parts; unused entries stay. Codes have two hex digits for each part; error is the
    sum of the final squared distances.

    Vectors must have one length, a multiple of `parts`; of several lengths the most frequent one is coded (ties: the
    smaller), and rows of another length come back with null code and error. Repeated rows and vec_ids, also null ones,
    each count and come back. An empty table gives an empty table and empty codebooks. A missing label column is a null
    one; other columns, whatever their names, are ignored. Integer components beyond LARGEST raise.
    """
    label = F.col("label") if "label" in embeddings.columns else F.lit(None).cast("int").alias("label")
    whole = embeddings.select("vec_id", label, whole_components(F.col(vector), scale).alias("v")).where("v is not null")
    kept = storage.staged(whole, "vectors")
    length = F.size("v")
    lengths = kept.groupBy(length.alias("length")).count().where((F.col("length") > 0) & (F.col("length") % parts == 0))
    most = lengths.orderBy(F.desc("count"), "length").first()
    other = kept.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if most is None:
        return other, [np.zeros((0, 0), np.int64)] * parts
    width = most.length
    vectors = kept.where(length == width)
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).collect()
    start = np.array([r.v for r in first], np.int64)
    books = [Codebook(np.ascontiguousarray(x)) for x in np.split(start, parts, axis=1)]
    for _ in range(rounds):
        books = _updated(books, vectors, width)
    schema = T.StructType([*other.schema.fields])
    coded = vectors.mapInArrow(_coded(books, width), schema).unionByName(other.where(length != width))
    return coded, [book.entries for book in books]


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Coded vectors and label_error, the sum of errors over equal labels (nulls together)."""
    sums = storage.staged(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "labels")
    other = sums.select(F.col("label").alias("other"), "label_error")
    if sums.count() <= BROADCAST_LABELS:
        other = F.broadcast(other)
    return coded.join(other, F.col("label").eqNullSafe(F.col("other")), "left").drop("other")


def digest(books: list[np.ndarray]) -> str:
    """Lowercase hex sha256 of all components as decimal integers, by part, entry and position, joined by commas."""
    numbers = [str(x) for book in books for x in np.ravel(book).tolist()]
    return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def _oracle() -> str:
    parts = ["""
kept AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x))) = len(embedding)
),
cut AS (
    SELECT vec_id, part, v[part * len(v) // 4 + 1 : (part + 1) * len(v) // 4] AS v
    FROM kept, (SELECT unnest([0, 1, 2, 3]) AS part)
),
b0 AS (
    SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, v
    FROM cut QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= 256
)"""]
    distance = "list_sum(list_transform(list_zip(k.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    nearest = (
        f"SELECT k.vec_id, k.part, any_value(k.v) AS v, min(({distance}, b.e)) AS best "
        "FROM cut k JOIN b%d b ON b.part = k.part GROUP BY k.vec_id, k.part"
    )
    for r in range(4):
        parts.append(f"""a{r} AS ({nearest % r}),
u{r} AS (SELECT part, best[2] AS e, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}),
s{r} AS (SELECT part, e, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM u{r} GROUP BY part, e, i),
m{r} AS (SELECT part, e, list(CAST((s - ((s % n) + n) % n) / n AS BIGINT) ORDER BY i) AS v FROM s{r} GROUP BY part, e),
b{r + 1} AS (
    SELECT b.part, b.e, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN m{r} m ON m.part = b.part AND m.e = b.e
)""")
    parts.append(f"a4 AS ({nearest % 4})")
    parts.append("""coded AS (
    SELECT vec_id, string_agg(lower(printf('%02x', best[2])), '' ORDER BY part) AS code, CAST(sum(best[1]) AS BIGINT) AS error
    FROM a4 GROUP BY vec_id
),
books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b4)""")
    return (
        "WITH " + ",\n".join(parts) + """
SELECT kept.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded ON coded.vec_id = kept.vec_id CROSS JOIN books
"""
    )


#: DuckDB SQL of the query, for tables whose vec_ids are distinct and whose vectors have one length.
ORACLE = _oracle()
