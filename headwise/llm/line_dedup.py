"""Repeated runs of lines, found by winnowing.

A run counts if it has `MIN_LINES` lines or `MIN_CHARS` characters. In every smallest run that counts, a document selects
the line with the smallest hash (all, if several are equal) as a fingerprint, one row for each. Two documents that share
a run share such a line, so a fingerprint that occurs once in the corpus is passed over with all around it. From the
positions of shared ones the match is extended line by line, to the left and to the right, as far as a smallest run
reaches; equal ones are joined, and the lines of all but the first occurrence are deleted. Longer runs are chains of
smallest ones, so they go as a whole.

Counting and the choice of the first occurrence combine map-side. In the two joins that lead back to the positions,
hot groups are broadcast and their rows dealt evenly (see `groups`).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwise.llm import storage
from headwise.llm.groups import with_groups

MIN_LINES = 3
#: Characters (line feeds not counted) from which a run of fewer lines counts.
MIN_CHARS = 30


def _reaches(min_lines: int) -> list[tuple[int, int]]:
    """How far runs of at most `min_lines` lines reach to the left and to the right of a line of theirs."""
    return [(left, size - left) for size in range(min_lines) for left in range(size + 1)]


def _all(conditions: list[Column]) -> Column:
    return F.coalesce(reduce(lambda a, b: a & b, conditions), F.lit(False))


def _extensions(min_lines: int, min_chars: int) -> Column:
    """Runs around a line that count and have no smaller hash than the line's: the first line, and what the run holds."""
    runs = []
    for left, right in _reaches(min_lines):
        members = [F.col(f"near.l{min_lines - 1 + k}") for k in range(-left, right + 1)]
        there = [m.isNotNull() for m in members] + [F.col("near.l%d.h" % (min_lines - 1)) <= m["h"] for m in members]
        if len(members) < min_lines:
            there.append(reduce(lambda a, b: a + b, [m["n"] for m in members]) >= min_chars)
        run = F.struct(
            (F.col("at") - left).alias("s"), F.lit(len(members)).alias("k"), F.xxhash64(*[m["h"] for m in members]).alias("held")
        )
        runs.append(F.when(_all(there), run))
    return F.array_compact(F.array(*runs))


def remove_runs(documents: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> DataFrame:
    """Documents without the runs of lines that occurred before, if these have `min_lines` lines or `min_chars` characters.

    Lines end at line feeds and are compared as they are. A run occurred before if the same lines stand in a row in a
    document with a smaller doc_id, or earlier in the same one (runs may overlap); runs are judged on the input. Returns
    all columns with the text that stays, n_lines and n_removed.

    A null text has no lines and stays null; an empty text is one empty line. Runs with fewer lines and characters stay,
    also where they are a whole text. A null doc_id comes after all others. Rows that repeat both doc_id and text are
    one document, so none makes the other a repetition; texts that share a doc_id are ordered by their hash. A column
    named like a new one is replaced.
    """
    docs = documents.drop("n_lines", "n_removed")
    doc, key, lost, lines = (storage.unused(docs, x) for x in ("_doc", "_key", "_gone", "_lines"))
    text_key = F.xxhash64("text")
    hashed = docs.where("text is not null").select(
        F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", text_key.alias("_text")).alias("doc"),
        F.transform(F.split("text", "\n"), lambda x: F.struct(F.xxhash64(x).alias("h"), F.length(x).alias("n"))).alias("lines"),
    )
    # Each line with its neighbours, as far as a smallest run reaches.
    around = lambda i: F.struct(
        *[F.when(i + k >= 0, F.get("lines", i + k)).alias(f"l{min_lines - 1 + k}") for k in range(1 - min_lines, min_lines)]
    )
    placed = hashed.select("doc", F.posexplode(F.transform("lines", lambda x, i: around(i))).alias("at", "near"))
    placed = placed.select("doc", (F.col("at") + 1).alias("at"), "near", F.col(f"near.l{min_lines - 1}.h").alias("print"))
    selected = placed.where(F.size(_extensions(min_lines, min_chars)) > 0)
    n = F.count(F.lit(1)).alias("n")
    ends = F.min(F.struct("doc", "at")).alias("least"), F.max(F.struct("doc", "at")).alias("most")
    shared = selected.groupBy("print").agg(*ends, n).where("least < most").select("print", "n")
    extended = (
        with_groups(selected, shared, "print", ["doc", "at"])
        .select("doc", "print", F.explode(_extensions(min_lines, min_chars)).alias("run"))
        .select("doc", "run.s", "run.k", F.struct("print", "run.held", "run.k").alias("same"))
    )
    first = extended.groupBy("same").agg(F.min(F.struct("doc", "s")).alias("first"), F.max(F.struct("doc", "s")).alias("most"), n)
    first = first.where("first < most").drop("most")
    later = with_groups(extended, first, "same", ["doc", "s"]).where(F.struct("doc", "s") > F.col("group.first"))
    gone = later.groupBy("doc").agg(F.collect_set(F.struct("s", "k")).alias("runs")).select(
        F.col("doc.doc_id").alias(doc), F.col("doc._text").alias(key),
        F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["s"], r["s"] + r["k"] - 1)))).alias(lost),
    )
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & (text_key == F.col(key))
    joined = docs.join(gone, same, "left").withColumn(lines, F.split("text", "\n"))
    kept = F.transform(
        F.array_except(F.sequence(F.lit(1), F.size(lines)), F.col(lost)), lambda i: F.element_at(lines, i)
    )
    text = F.when(F.col(lost).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return joined.select(
        *[text.alias(c) if c == "text" else c for c in docs.columns],
        F.coalesce(F.when(F.col("text").isNotNull(), F.size(lines)), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.when(F.col(lost).isNotNull(), F.size(lost)), F.lit(0)).cast("long").alias("n_removed"),
    )


ORACLE = f"""
WITH docs AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
starts AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS s FROM docs),
places AS (
  SELECT doc_id, s, k, list_slice(l, s, s + k - 1) AS v
  FROM starts, unnest(range(1, {MIN_LINES} + 1)) AS sizes(k)
  WHERE s + k - 1 <= len(l)
    AND (k = {MIN_LINES} OR list_sum(list_transform(list_slice(l, s, s + k - 1), lambda x: length(x))) >= {MIN_CHARS})),
later AS (
  SELECT doc_id, s, k FROM (SELECT doc_id, s, k, row_number() OVER (PARTITION BY v ORDER BY doc_id NULLS LAST, s) AS r FROM places)
  WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + k)) AS i FROM later),
kept AS (
  SELECT doc_id, string_agg(l[i], chr(10) ORDER BY i) AS text, count(*) AS n
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM docs) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(l) AS n_lines, len(l) - coalesce(n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs LEFT JOIN kept k USING (doc_id)
"""
