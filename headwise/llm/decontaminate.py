"""Benchmark passages in training text, found by exact word windows.

Every window of a benchmark item is looked up by its longest word, the *probe*: the set of probes is broadcast, a pass
over all words keeps the few positions where one stands, and there the window itself is compared. Probes are broadcast
only if they are few (`BROADCAST_WINDOWS`, counted); otherwise the same join is left to Spark, which shuffles it.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwise.llm import storage

WINDOW = 13
#: A document is contaminated if one of so many words is hit, or more.
SHARE = 20
#: Most windows of a benchmark that are sent to every executor; about 200 bytes each.
BROADCAST_WINDOWS = 100_000

NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
#: The same in a text that isn't lower-cased.
_ANY_NO_WORD, _ANY_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def words(text: Column) -> Column:
    """Lower-cased (A-Z) runs of a-z, digits and characters beyond ASCII; null has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, NO_WORD + "+"), "")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows of all items: probe (a word of it), at (where it stands), size, id (hash of its words), items."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("words"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    cut = items.where((F.size("words") > 0) & F.col("item").isNotNull()).select(
        "item", F.explode(F.transform(starts, lambda s: F.slice("words", s, window))).alias("window")
    )
    longest = F.array_max(F.transform("window", lambda w, i: F.struct(F.length(w).alias("n"), (-i).alias("i"), w.alias("w"))))
    return (
        cut.groupBy("window")
        .agg(F.collect_set("item").alias("items"))
        .withColumn("longest", longest)
        .select(
            F.col("longest.w").alias("probe"), (-F.col("longest.i")).alias("at"), F.size("window").alias("size"),
            F.xxhash64("window").alias("id"), "items",
        )
    )


def _unused(documents: DataFrame, name: str) -> str:
    """The name, or a longer one if the table has a column of that name."""
    taken = {c.lower() for c in documents.columns}
    while name in taken:
        name = f"_{name}"
    return name


def scan(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """What of every document stands in a benchmark: all its columns, n_words, n_hit, items and hits.

    hits has (start, size) of every occurrence of an item's window; n_hit counts the words inside any; items are the
    item_ids as sorted strings. An item with fewer words than a window is one window, an item without words none.

    A null or empty text has no words. Null item_ids can't be named and are left out. Repeated rows each get the same
    result, also with a null or repeated doc_id, since rows are matched by doc_id and text together. Without items
    nothing is hit. A column of the input that has one of the new names is replaced.
    """
    probes = benchmark_windows(benchmark, window)
    if probes.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS:
        probes = F.broadcast(probes)
    docs = documents.drop("n_words", "n_hit", "items", "hits")
    doc, text, split, places = (_unused(docs, name) for name in ("_doc", "_text", "_words", "_found"))
    stands = docs.select("doc_id", F.xxhash64("text").alias(text), F.posexplode(words(F.col("text"))).alias("pos", "probe"))
    start = F.col("pos") - F.col("at")
    found = (
        stands.join(probes, "probe")
        .where(start >= 0)
        .groupBy("doc_id", text)
        .agg(F.collect_set(F.struct(start.alias("start"), "size", "id", "items")).alias(places))
        .withColumnRenamed("doc_id", doc)
    )
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(text))
    matched = docs.join(found, same, "left").withColumn(split, words(F.col("text")))
    true = F.filter(places, lambda c: F.xxhash64(F.slice(split, c["start"] + 1, c["size"])) == c["id"])
    matched = matched.withColumn(places, F.array_sort(F.coalesce(F.when(F.col(places).isNotNull(), true), F.array())))
    zero = F.lit(0).cast("long")
    covered = F.aggregate(
        places,
        F.struct(zero.alias("n"), zero.alias("end")),
        lambda sofar, c: F.struct(
            (sofar["n"] + F.greatest(zero, c["start"] + c["size"] - F.greatest(sofar["end"], c["start"]))).alias("n"),
            F.greatest(sofar["end"], (c["start"] + c["size"]).cast("long")).alias("end"),
        ),
        lambda end: end["n"],
    )
    return matched.select(
        *docs.columns,
        F.size(split).cast("long").alias("n_words"),
        covered.alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.transform(places, lambda c: c["items"])))).alias("items"),
        F.transform(places, lambda c: F.struct(c["start"].alias("start"), c["size"].alias("size"))).alias("hits"),
    )


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))


def without_documents(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, as they are."""
    # The verdicts are written before anything is filtered by them: a filter on the scan's own columns would be moved
    # below them, and the words of a text split anew for every window compared.
    doc, text, bad = (_unused(documents, name) for name in ("_doc", "_text", "_bad"))
    scanned = scan(documents.select("doc_id", "text"), benchmark)
    verdicts = scanned.select(F.col("doc_id").alias(doc), F.xxhash64("text").alias(text), contaminated().alias(bad))
    rejected = storage.staged(verdicts, "verdicts").where(F.col(bad))
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(text))
    return documents.join(rejected, same, "left_anti")


def without_spans(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All documents, without the words that are hit and what separates them from the next word."""
    pieces = F.regexp_extract_all("text", F.lit(f"({_ANY_WORD}+{_ANY_NO_WORD}*)"), 1)
    kept = F.filter(
        pieces, lambda _, i: ~F.exists("hits", lambda h: (h["start"] <= i) & (i < h["start"] + h["size"]))
    )
    lead = F.regexp_extract("text", f"^({_ANY_NO_WORD}*)", 1)
    text = F.when(F.size("hits") > 0, F.concat(lead, F.array_join(kept, ""))).otherwise(F.col("text"))
    return scan(documents, benchmark).withColumn("text", text).select(documents.columns)


ORACLE = rf"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '{_WORD}+') AS w FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
cut AS (
  SELECT item, list_slice(w, s, s + {WINDOW - 1}) AS v
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS s FROM items WHERE len(w) > 0)),
windows AS (SELECT len(v) AS n, array_to_string(v, ' ') AS v, list(DISTINCT item) AS items FROM cut GROUP BY ALL),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS v
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM docs JOIN sizes ON len(w) >= n)),
hits AS (SELECT doc_id, p.n, s, items FROM places p JOIN windows USING (n, v)),
words_hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY 1),
items_hit AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names
  FROM (SELECT doc_id, unnest(items) AS item FROM hits) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
FROM docs LEFT JOIN words_hit USING (doc_id) LEFT JOIN items_hit USING (doc_id)
"""
