"""Chat formatting by perspective rotation, in DataFrame functions only.

Every participant of a conversation gets a rendering of the whole dialogue in which they are the
assistant and the others are named users. A rendering is a sequence of pieces, one row per turn, each with the
places of the characters to learn from; so a conversation of any length is never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from occurra.session import cut_lineage

#: Roles that instruct and never answer: rendered alike for everyone, without a perspective of their own.
INSTRUCTING = ("system",)
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _head(role: str, name: Column | None = None) -> Column:
    if name is None:
        return F.lit(f"{OPEN}{role}\n")
    return F.concat(F.lit(f"{OPEN}{role} name="), name, F.lit("\n"))


def perspectives(turns: DataFrame, instructing: tuple[str, ...] = INSTRUCTING) -> DataFrame:
    """``conv_id, perspective``: the distinct speakers of each conversation; NULL speakers and instructions are none."""
    return (
        turns.filter(F.col("role").isNotNull() & ~F.col("role").isin(list(instructing)))
        .select("conv_id", F.col("role").cast("string").alias("perspective"))
        .distinct()
    )


def chat_format(turns: DataFrame, instructing: tuple[str, ...] = INSTRUCTING) -> DataFrame:
    """``conv_id, perspective, turn, speaker_role, piece, learn_first, learn_past``.

    ``turns`` has ``conv_id, turn, role, text``. Order pieces by ``turn``, ties by ``piece``. The characters from
    ``learn_first`` up to ``learn_past`` of a piece are the perspective's own words and their end mark; both are
    0 elsewhere. NULL text is empty; a turn without a speaker comes from the user ``unknown``; NULL
    ``conv_id`` is a conversation like any other; one in which nobody speaks but instructions has no perspective
    and gives no row. Repeated rows are rendered as often as they come.
    """
    rows = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    # stored, so that a conversation with very many turns can be split in the join
    views = cut_lineage(perspectives(rows, instructing), "views").withColumnRenamed("conv_id", "c")
    both = rows.join(views, F.col("conv_id").eqNullSafe(F.col("c")))
    own = F.col("role").eqNullSafe(F.col("perspective"))
    instructs = F.coalesce(F.col("role").isin(list(instructing)), F.lit(False))
    head = (
        F.when(own, _head("assistant"))
        .when(instructs, F.concat(F.lit(OPEN), F.col("role"), F.lit("\n")))
        .otherwise(_head("user", F.coalesce("role", F.lit("unknown"))))
    )
    role = F.when(own, F.lit("assistant")).when(instructs, F.col("role")).otherwise(F.lit("user"))
    body = F.concat("text", F.lit(CLOSE))
    return both.select(
        "conv_id", "perspective", "turn", role.alias("speaker_role"),
        F.concat(head, body, F.lit("\n")).alias("piece"),
        F.when(own, F.length(head)).otherwise(0).cast("long").alias("learn_first"),
        F.when(own, F.length(head) + F.length(body)).otherwise(0).cast("long").alias("learn_past"),
    )


ORACLE_SQL = """
WITH views AS (SELECT DISTINCT conv_id, role AS perspective FROM conversations WHERE role <> 'system'),
heads AS (
  SELECT t.conv_id, v.perspective, t.turn, t.role IS NOT DISTINCT FROM v.perspective AS own, coalesce(t.text, '') AS text,
    CASE WHEN t.role = v.perspective THEN 'assistant' WHEN t.role = 'system' THEN 'system' ELSE 'user' END AS speaker_role,
    CASE WHEN t.role = v.perspective THEN '<|im_start|>assistant' || chr(10)
      WHEN t.role = 'system' THEN '<|im_start|>system' || chr(10)
      ELSE '<|im_start|>user name=' || coalesce(t.role, 'unknown') || chr(10) END AS head
  FROM conversations t JOIN views v ON t.conv_id IS NOT DISTINCT FROM v.conv_id)
SELECT conv_id, perspective, turn, speaker_role, head || text || '<|im_end|>' || chr(10) AS piece,
  CASE WHEN own THEN length(head) ELSE 0 END AS learn_first,
  CASE WHEN own THEN length(head) + length(text) + 10 ELSE 0 END AS learn_past
FROM heads"""
