"""Perspective rotation: a dialogue rendered once for every participant, who is the assistant there.

The other participants are users with their names, and the mask covers what the assistant says. Only one shuffle carries
texts: turns are gathered by conversation and part (`PART_TURNS` turn numbers), so a conversation of any length is dealt
over many tasks, and a part of very many rows into pieces; who takes part comes from the narrow columns, as rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turn numbers of one rendered part.
PART_TURNS = 256
#: Turns without number are dealt over so many parts of their own, after all others.
UNNUMBERED_PARTS = 64
#: Distinct rows of a part from which it is cut into pieces of about so many.
PART_ROWS = 4096
SYSTEM = "system"
END = "<|end|>"


def _part(turn: Column, speaker: Column, text: Column) -> tuple[Column, Column]:
    """Part of the conversation, and a number among the parts without turn numbers."""
    numbered = F.floor(turn / PART_TURNS)
    return numbered, F.when(turn.isNull(), F.pmod(F.crc32(F.concat_ws("\n", speaker, text).cast("binary")), F.lit(UNNUMBERED_PARTS)))


def _same(left: str, right: str, columns: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns])


def _cut(rows: DataFrame) -> DataFrame:
    """The rows with the piece of their part: 0, unless a part has more than PART_ROWS distinct rows.

    The distinct rows of such a part are counted by turn. A row's place is the number of those of earlier turns, and
    among those of its own turn one drawn by its hash.
    """
    long = rows.groupBy("conv_id", "part").count().where(F.col("count") > PART_ROWS)
    if long.isEmpty():
        return rows.withColumn("piece", F.lit(0).cast("long"))
    content = F.concat(F.coalesce("speaker", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    slot = F.conv(F.substring(F.md5(content.cast("binary")), 1, 13), 16, 10).cast("long")  # 52 bits, as in the SQL
    of_long = rows.alias("r").join(long.alias("l"), _same("r", "l", ["conv_id", "part"]), "left_semi")
    counted = of_long.select("conv_id", "part", "turn", slot.alias("slot")).distinct().groupBy("conv_id", "part", "turn").agg(
        F.count(F.lit(1)).alias("n")
    )
    part = Window.partitionBy("conv_id", "part")  # no more than PART_TURNS turns, or the one without number
    before = F.sum("n").over(part.orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    cuts = counted.select("*", before.alias("before"), F.sum("n").over(part).alias("all")).where(F.col("all") > PART_ROWS)
    piece = F.floor((F.col("before") + F.pmod(slot, F.col("n"))) / PART_ROWS)
    return rows.alias("r").join(cuts.alias("c"), _same("r", "c", ["conv_id", "part", "turn"]), "left").select(
        "r.*", F.coalesce(piece, F.lit(0)).cast("long").alias("piece")
    )


def rotate(conversations: DataFrame, speaker: str = "role") -> DataFrame:
    """Every dialogue from the side of every participant, in parts.

    Returns conv_id, part, piece, perspective (the participant who is the assistant), n_turns, text and mask: the ranges
    [start, end) of characters in `text` to train on, as "start-end" joined by commas. A turn is rendered as
    `<|assistant|>`, `<|user name=NAME|>`, `<|user|>` or `<|system|>`, a line break, its text, `<|end|>` and a line
    break; the mask covers the assistant's texts with their end marks.

    Participants are the distinct non-null speakers but "system", which is no one's side and stays what it is. A part
    holds the turns with the same turn number divided by PART_TURNS (rounded down); each part is rendered for everyone
    in the conversation. A part of more than PART_ROWS distinct rows comes in pieces 0, 1, ... of about as many, in the
    order of turn numbers; rows alike in turn number are dealt over pieces by their content. Ties on a turn number are ordered by speaker, then text, nulls first. A row repeated exactly
    is one turn. Turns without number follow in parts numbered -1, -2, ... by their content. A null speaker is a user
    without name; a null text is empty; rows with a null conv_id are one conversation. A conversation without
    participants gives no row, an empty table an empty table. Other columns are ignored.
    """
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col(speaker).alias("speaker"), "text")
    numbered, unnumbered = _part(F.col("turn"), F.col("speaker"), F.col("text"))
    rows = rows.withColumn("part", F.coalesce(numbered, -1 - unnumbered).cast("long"))
    rows = _cut(rows)
    place = ["conv_id", "part", "piece"]
    parts = rows.groupBy(place).agg(
        F.array_sort(F.collect_set(F.struct("turn", "speaker", F.coalesce("text", F.lit("")).alias("text")))).alias("turns")
    )
    people = rows.where(F.col("speaker") != SYSTEM).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    sides = rows.select(place).distinct().alias("p").join(
        people.alias("c"), F.col("p.conv_id").eqNullSafe(F.col("c.conv_id"))
    ).select("p.conv_id", "part", "piece", "perspective")
    seen = parts.alias("t").join(sides.alias("s"), _same("t", "s", place)).select(
        *[f"t.{c}" for c in place], "turns", "perspective"
    )
    pieces = F.transform("turns", lambda t: F.concat(_header(t["speaker"], F.col("perspective")), t["text"], F.lit(f"{END}\n")))
    rendered = seen.withColumn("pieces", pieces).withColumn(
        "ends", F.aggregate("pieces", F.array(F.lit(0)), lambda ends, x: F.concat(ends, F.array(F.element_at(ends, -1) + F.length(x))))
    )
    spans = F.transform(
        "turns",
        lambda t, i: F.when(
            t["speaker"] == F.col("perspective"),
            F.concat(
                (F.col("ends")[i] + F.length(_header(t["speaker"], F.col("perspective")))).cast("string"),
                F.lit("-"),
                (F.col("ends")[i + 1] - 1).cast("string"),
            ),
        ),
    )
    return rendered.select(
        "conv_id", "part", "piece", "perspective", F.size("turns").cast("long").alias("n_turns"),
        F.array_join("pieces", "").alias("text"), F.array_join(spans, ",").alias("mask"),
    )


def _header(speaker: Column, perspective: Column) -> Column:
    return (
        F.when(speaker.isNull(), "<|user|>\n")
        .when(speaker == SYSTEM, f"<|{SYSTEM}|>\n")
        .when(speaker == perspective, "<|assistant|>\n")
        .otherwise(F.concat(F.lit("<|user name="), speaker, F.lit("|>\n")))
    )


def _oracle(part_rows: int) -> str:
    return f"""
WITH rows_ AS (
  SELECT DISTINCT conv_id, turn, role, coalesce(text, '') AS text, CAST(floor(turn / {PART_TURNS}.0) AS BIGINT) AS part,
    CAST('0x' || substr(md5(coalesce(role, '') || chr(10) || coalesce(text, '')), 1, 13) AS BIGINT) AS slot
  FROM conversations),
turns AS (SELECT conv_id, part, turn, count(DISTINCT slot) AS n FROM rows_ GROUP BY ALL),
cuts AS (
  SELECT *, sum(n) OVER (PARTITION BY conv_id, part) AS "all",
    sum(n) OVER (PARTITION BY conv_id, part ORDER BY turn NULLS FIRST) - n AS before
  FROM turns),
dealt AS (
  SELECT r.*, CASE WHEN "all" > {part_rows} THEN CAST(floor((before + slot % n) / {float(part_rows)}) AS BIGINT) ELSE 0 END AS piece
  FROM rows_ r JOIN cuts c ON r.conv_id IS NOT DISTINCT FROM c.conv_id AND r.part = c.part AND r.turn = c.turn),
people AS (SELECT DISTINCT conv_id, role AS perspective FROM rows_ WHERE role <> '{SYSTEM}'),
pieces AS (
  SELECT r.conv_id, part, piece, perspective, turn, role, text,
    CASE WHEN role IS NULL THEN '<|user|>' WHEN role = '{SYSTEM}' THEN '<|{SYSTEM}|>'
         WHEN role = perspective THEN '<|assistant|>' ELSE '<|user name=' || role || '|>' END || chr(10) AS header
  FROM dealt r JOIN people p ON r.conv_id IS NOT DISTINCT FROM p.conv_id),
placed AS (
  SELECT *, header || text || '{END}' || chr(10) AS told,
    sum(length(header || text || '{END}' || chr(10)))
      OVER (PARTITION BY conv_id, part, piece, perspective ORDER BY turn, role NULLS FIRST, text) AS stop
  FROM pieces)
SELECT conv_id, part, piece, perspective, count(*) AS n_turns,
  string_agg(told, '' ORDER BY turn, role NULLS FIRST, text) AS text,
  coalesce(string_agg(CAST(stop - length(told) + length(header) AS BIGINT) || '-' || CAST(stop - 1 AS BIGINT), ','
    ORDER BY turn, role NULLS FIRST, text) FILTER (WHERE role = perspective), '') AS mask
FROM placed GROUP BY ALL
"""


#: DuckDB SQL of the query, for tables whose turns all have numbers.
ORACLE = _oracle(PART_ROWS)
