"""Clusters, product codes and token counts against plain versions, with the awkward cases."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from headwise.llm import token_counts, vector_codes, vector_file

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "vec_id long, embedding array<double>, label int, v int, cells string, distance string, code int"


def rows(width, n=300, seed=5):
    """Groups, ties, copies, outliers, vectors of other lengths, and such as can't take part."""
    rnd = np.random.default_rng(seed)
    middle = rnd.normal(size=(7, width))
    vectors = [(middle[i % 7] + rnd.normal(size=width) * 0.2).round(2).tolist() for i in range(n)]
    vectors += [vectors[3]] * 20 + [[0.0] * width, [-40.0] * width, [1e3] + [0.0] * (width - 1)]
    out = [(i, v, i % 3 or None) for i, v in enumerate(vectors)]
    out += [out[5], (None, vectors[1], 1), (None, vectors[1], None)]
    bad = [None, [], [float("nan")] * width, [float("inf")] + [0.0] * (width - 1), [None] + [0.0] * (width - 1), [1.0] * (width + 1)]
    out += [(1000 + i, v, 1) for i, v in enumerate(bad)]
    return [(*r, 9, "c", "d", 1) for r in out]


def usable(data, scale, width):
    kept = [(r[0], r[1], r[2]) for r in data if r[1] and all(x is not None and np.isfinite(x) for x in r[1])]
    return [(i, np.floor(np.array(v) * scale).astype(np.int64), label) for i, v, label in kept if len(v) == width]


def plain_nearest(points, centers):
    distance = ((points[:, None] - centers) ** 2).sum(2)
    return distance.argmin(1), distance.min(1)


def updated(points, found, centers):
    return np.array([points[found == c].sum(0) // max((found == c).sum(), 1) if (found == c).any() else old for c, old in enumerate(centers)])


@pytest.mark.parametrize("width", [6, 7])
def test_clusters_equal_plain_ones(spark, width):
    data = rows(width)
    kept = usable(data, 64, width)
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1].tolist())
    centers = np.array([r[1] for r in sorted(kept, key=key)[:16]])
    points = np.array([r[1] for r in kept])
    for _ in range(3):
        centers = updated(points, plain_nearest(points, centers)[0], centers)
    found, distance = plain_nearest(points, centers)
    want = sorted((str(r[0]), c, d) for r, c, d in zip(kept, found.tolist(), distance.tolist(), strict=True))
    table = spark.createDataFrame(data, SCHEMA).repartition(5)
    got, centroids = vector_file.cluster(table, width=width)
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in got.collect()) == want
    assert (centroids == centers).all()


def test_intervals_hold_and_leave_little_open():
    rnd = np.random.default_rng(1)
    centers = rnd.integers(-300, 300, (9, 12))
    points = centers[rnd.integers(0, 9, 2000)] + rnd.integers(-20, 21, (2000, 12))
    grid = vector_file.Grid.of(points.min(0), points.max(0), points.mean(0), points.std(0))
    form = vector_file.Approximation(grid, centers)
    packed = grid.pack(points)
    possible = form.possible(packed)
    found, distance = plain_nearest(points, centers)
    assert possible[np.arange(2000), found].all()
    assert (possible.sum(1) == 1).mean() > 0.9
    assert (form.nearest(packed, points)[0] == found).all() and (form.nearest(packed, points)[1] == distance).all()
    # A settled vector that didn't move isn't fetched.
    fetched = vector_file._fetched(form, form).func(__import__("pandas").Series([x.tobytes() for x in packed]))
    assert fetched.mean() < 0.1


def test_few_vectors_and_empty_tables_of_clusters(spark):
    table = spark.createDataFrame([r for r in rows(6) if r[0] in (3, 4, 1000, 1005)], SCHEMA)
    got, centroids = vector_file.cluster(table, width=6)
    assert sorted((r.vec_id, r.distance) for r in got.collect()) == [(3, 0), (4, 0)] and len(centroids) == 2
    got, centroids = vector_file.cluster(table.limit(0), width=6)
    assert got.count() == 0 and got.columns == ["vec_id", "cluster", "distance"] and len(centroids) == 0
    with pytest.raises(Exception, match="must lie between"):
        vector_file.cluster(spark.createDataFrame([(1, [1e9, 0.0])], "vec_id long, embedding array<double>"), width=2)[0].count()


@pytest.mark.parametrize("n", [8, 700])
def test_codes_equal_plain_ones(spark, n):
    data = rows(8, n)
    kept = usable(data, 1024, 8)
    points = np.array([r[1] for r in kept])
    first = sorted(kept, key=lambda r: (r[0] is None, r[0], r[1].tolist()))[:256]
    books = np.split(np.array([r[1] for r in first]), 4, axis=1)
    cut = np.split(points, 4, axis=1)
    for _ in range(4):
        books = [updated(p, plain_nearest(p, b)[0], b) for p, b in zip(cut, books, strict=True)]
    near = [plain_nearest(p, b) for p, b in zip(cut, books, strict=True)]
    code = ["".join(f"{x:02x}" for x in c) for c in np.stack([f for f, _ in near], 1).tolist()]
    error = sum(d for _, d in near).tolist()
    by_label: dict = {}
    for (_, _, label), e in zip(kept, error, strict=True):
        by_label[label] = by_label.get(label, 0) + e
    want = [(str(r[0]), c, e, by_label[r[2]]) for r, c, e in zip(kept, code, error, strict=True)]
    # A vector of another length and an empty one can't be coded; label 1 has errors besides.
    want += [("1001", None, None, by_label[1]), ("1005", None, None, by_label[1])]
    coded, found = vector_codes.encode(spark.createDataFrame(data, SCHEMA).repartition(3))
    got = [(str(r.vec_id), r["code"], r.error, r.label_error) for r in vector_codes.with_label_errors(coded).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert all((a == b).all() for a, b in zip(found, books, strict=True))
    numbers = ",".join(str(x) for b in books for row in b.tolist() for x in row)
    assert vector_codes.digest(found) == hashlib.sha256(numbers.encode()).hexdigest()


@pytest.mark.parametrize("entries,width", [(1, 2), (7, 3), (256, 4), (256, 16)])
def test_orchard_search_is_exact(entries, width):
    rnd = np.random.default_rng(entries + width)
    book = vector_codes.Codebook(rnd.integers(-9, 10, (entries, width)))  # with many ties and equal entries
    parts = rnd.integers(-12, 13, (3000, width))
    found, distance = plain_nearest(parts, book.entries)
    got = book.nearest(parts)
    assert (got[0] == found).all() and (got[1] == distance).all()


def test_empty_tables_of_codes(spark):
    table = spark.createDataFrame(rows(8), SCHEMA).limit(0)
    coded, books = vector_codes.encode(table)
    assert coded.count() == 0 and [b.size for b in books] == [0] * 4
    assert vector_codes.with_label_errors(coded).columns == ["vec_id", "label", "code", "error", "label_error"]
    coded, _ = vector_codes.encode(spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "vec_id long, embedding array<float>"))
    assert [tuple(r) for r in coded.collect()] == [(1, None, None, None)]


def test_token_counts_equal_the_library(spark):
    rnd = random.Random(4)
    some = [" ", "  ", "a", "the", " the", "\n", "\t", "é", "▁", "<s>", "</s>", "<0x0A>", "日本", "😀", "1", "23", "\x00", "ﬁ", "."]
    texts: list = [None, "", " ", "▁", "▁▁ the", "x" * 100_000, "the " * 60_000, "日" * 30_000, " " * 5000]
    texts += ["".join(rnd.choice(some) for _ in range(rnd.randrange(12))) for _ in range(3000)]
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = sorted((i, len((x or "").encode()), len(library.encode(x or "")), len(library.encode(x or "")) > 4096) for i, x in enumerate(texts))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"n_tokens": F.lit("x"), "whole": F.lit(1)})
    got = token_counts.count(table, MODEL)
    assert sorted(got.columns) == ["doc_id", "n_bytes", "n_tokens", "over_limit", "text", "whole"]
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()) == want
    assert token_counts.count(table.limit(0), MODEL).count() == 0
    doubled = token_counts.count(table.where("doc_id = 4").union(table.where("doc_id = 4")).withColumn("doc_id", F.lit(None)), MODEL)
    assert doubled.count() == 2


def test_token_counts_of_documents(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = token_counts.count(documents, MODEL).select("text", "n_tokens").collect()
    assert [r.n_tokens for r in got] == [len(x) for x in library.encode([r.text or "" for r in got])]


def test_whole_tokens_are_proved():
    counter = token_counts.Counter(MODEL)
    assert counter.splits and "▁the" in counter.whole and len(counter.whole) > 10_000
    rnd = random.Random(2)
    assert all(len(counter.library.encode(x[1:])) == 1 for x in rnd.sample(sorted(counter.whole - {"▁"}), 500))
    counter.splits = False  # a model without proof: whole texts
    assert counter.counts(["a b", None, "  the"]) == [2, 0, len(counter.library.encode("  the"))]
